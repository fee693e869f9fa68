"""The catalogue of queries: name -> (query, SQL or None). Queries over driver tables use portable rules that SQL engines share; those
on linguistic tables join the seed, whose rows the SQL repeats as VALUES."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import seed
from ..functions import bags, tags
from ..functions.text import case_style, fallback_class, shape, syllables
from ..operators import alternation, candidates, generation, learning, tagging, viterbi
from ..operators import tokens as tok
from ..session import configure, cut, spread
from ..sources import tables
from . import alternation_sql

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        CATALOG[f.__name__] = (run, sql)
        return run

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


def portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.tokens(read(spark, sf_dir, "documents"), exact=False)


def arrays(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return tok.token_arrays(read(spark, sf_dir, "documents"), *keep, exact=False)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir).select(F.lower("token").alias("token")).distinct()


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)})"


_P = tok.PORTABLE.replace("'", "''")
T = f"t AS (SELECT doc_id, lang, source, unnest(range(0, len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '{_P}') AS w FROM documents))"
V = f"{T}, v AS (SELECT DISTINCT lower(token) AS token FROM t)"


@query(f"WITH {T} SELECT doc_id, pos::INT AS pos, token FROM t")
def tokenize_documents(spark, d):
    """Portable tokens of all documents."""
    return portable(spark, d)


@query()
def exact_tokens(spark, d):
    """Tokens by the full ordered rule set."""
    return tok.tokens(read(spark, d, "documents"))


@query("SELECT doc_id, list_filter(string_split(trim(text), ' '), lambda x: x <> '') AS tokens FROM documents")
def brute_split(spark, d):
    return read(spark, d, "documents").select("doc_id", tok.brute_split(F.col("text")).alias("tokens"))


_C = ", ".join(f"'{c}'" for c in tok.CLOSERS)


@query(f"""WITH {T}, r AS (SELECT doc_id, pos, token, token IN ('"', ')') AS g, sum((token NOT IN ('"', ')'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM t),
h AS (SELECT *, first_value(CASE WHEN NOT g THEN token END) OVER w AS head, coalesce(sum((token = ')')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS br FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY pos)),
s AS (SELECT *, coalesce(g AND head IN ('.', '!', '?') AND br = 0, false) AS glued, coalesce(sum((token IN ({_C}))::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM h),
n AS (SELECT *, closed - glued::INT AS seg FROM s), m AS (SELECT *, sum((NOT glued)::INT) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS n FROM n)
SELECT doc_id, pos::INT AS pos, token, (sum((NOT glued AND (n - 1) % {tok.LENGTH_CAP + 1} = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS sent_id FROM m""")
def sentence_split(spark, d):
    return tok.numbered(arrays(spark, d, "doc_id"), "doc_id")


_SHAPE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[^\p{{Lu}}\p{{L}}\p{{N}}]+', '.', 'g'), '\p{{N}}+', '9', 'g'), '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]+', 'x', 'g'), '\p{{Lu}}+', 'X', 'g')"


@query(f"WITH {T} SELECT {_SHAPE.format('token')} AS shape, count(*) AS n FROM t GROUP BY 1")
def word_shape_counts(spark, d):
    return portable(spark, d).groupBy(shape(F.col("token")).alias("shape")).agg(F.count("*").alias("n"))


_PRE = ", ".join(f"CASE WHEN length(token) >= {n} THEN left(token, {n}) END AS pre{n}, CASE WHEN length(token) >= {n} THEN right(token, {n}) END AS suf{n}" for n in range(1, 5))


@query(f"WITH {V} SELECT token, {_PRE} FROM v")
def affix_features(spark, d):
    return vocabulary(spark, d).select("token", *learning.affixes(F.col("token")))


@query(f"""WITH {T} SELECT doc_id, pos::INT AS pos, lag(lower(token)) OVER w AS prev_lower, lead(lower(token)) OVER w AS next_lower, lag({_SHAPE.format('token')}) OVER w AS prev_shape, lead({_SHAPE.format('token')}) OVER w AS next_shape,
lag(pos) OVER w IS NULL AS bos, lead(pos) OVER w IS NULL AS eos FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def context_features(spark, d):
    return learning.array_features(arrays(spark, d, "doc_id"), "doc_id").select("doc_id", "pos", "prev_lower", "next_lower", "prev_shape", "next_shape", "bos", "eos")


_CASE = r"CASE WHEN regexp_matches(token, '[\p{Lu}\p{Ll}]') AND upper(token) = token THEN 'upper' WHEN regexp_matches(token, '^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$') THEN 'first' ELSE 'other' END"


@query(f"WITH {T}, k AS (SELECT {_CASE} AS style FROM t) SELECT style, count(*) AS n FROM k GROUP BY 1")
def case_styles(spark, d):
    return portable(spark, d).groupBy(case_style(F.col("token")).alias("style")).agg(F.count("*").alias("n"))


@query(f"WITH {V} SELECT token, len(regexp_extract_all(token, '[aāeēiīouū]+'))::INT AS n FROM v")
def syllable_counts(spark, d):
    return vocabulary(spark, d).select("token", syllables(F.col("token")).alias("n"))


_BRUTE = "b AS (SELECT DISTINCT unnest(list_filter(string_split(trim(text), ' '), lambda x: x <> '')) AS token FROM documents)"


@query(f"""WITH {_BRUTE} SELECT token, CASE WHEN regexp_matches(token, '^\\d+[.]$') THEN 'ordinal' WHEN regexp_matches(token, '^[-−]?\\d+([ ]\\d\\d\\d)*([.,]\\d+)?$') OR regexp_matches(token, '^\\d+(/\\d+)$') THEN 'number'
WHEN regexp_matches(token, '^\\p{{L}}{{1,3}}[.]$') THEN 'short abbreviation' WHEN regexp_matches(token, '^(\\p{{L}}+[.])+$') THEN 'abbreviation' ELSE 'none' END AS cls FROM b""")
def regex_fallback_class(spark, d):
    t = read(spark, d, "documents").select(F.explode(tok.brute_split(F.col("text"))).alias("token")).distinct()
    return t.select("token", fallback_class(F.col("token")).alias("cls"))


_EV = values("e", "paradigm_id, ending_id, ending", [(e[1], e[2], e[3]) for e in seed.ENDING_ROWS])
_LONGEST = max(len(e[3]) for e in seed.ENDING_ROWS)
_SUF = f"s AS (SELECT token, k, right(token, k) AS suffix, left(token, length(token) - k) AS stem FROM (SELECT token, unnest(range(0, greatest(least(length(token) - 2, {_LONGEST}), 0) + 1)) AS k FROM v)), m AS (SELECT token, k, stem, paradigm_id, ending_id FROM s JOIN e ON suffix = ending)"


def _matches(spark, d):
    e = seed.catalog(spark).endings.select("paradigm_id", "ending_id", "ending")
    return candidates.ending_matches(vocabulary(spark, d), e)


@query(f"WITH {V}, {_EV}, {_SUF} SELECT token, k::INT AS k, stem, paradigm_id, ending_id FROM m")
def suffix_ending_match(spark, d):
    return _matches(spark, d).select("token", "k", "stem", "paradigm_id", "ending_id")


@query(f"WITH {V}, {_EV}, {_SUF} SELECT token, k::INT AS k, paradigm_id, ending_id FROM (SELECT *, rank() OVER (PARTITION BY token ORDER BY k DESC) AS r FROM m WHERE k > 0) WHERE r = 1")
def longest_ending_guess(spark, d):
    m = _matches(spark, d).where("k > 0")
    return m.withColumn("r", F.rank().over(Window.partitionBy("token").orderBy(F.desc("k")))).where("r = 1").select("token", "k", "paradigm_id", "ending_id")


_STEMS = [("lv", r[3] or 1, i, (r[5 + i] or r[6] or r[5].lower()[:-1]), r[0]) for r in seed.LEXEME_ROWS for i in (1, 2, 3)]


@query(f"WITH {values('x', 'language, paradigm_id, stem_type, stem, lexeme_id', _STEMS)} SELECT paradigm_id, stem_type, stem, lexeme_id::BIGINT AS lexeme_id FROM x")
def stem_index(spark, d):
    return candidates.stems(seed.catalog(spark)).select("paradigm_id", "stem_type", F.col("base_stem").alias("stem"), "lexeme_id")


_FORMS = sorted({(s[3] + e[3],) for s in _STEMS for e in seed.ENDING_ROWS if s[1] == e[1] and s[2] == e[5]})


@query(f"WITH {T}, {values('forms', 'form', _FORMS)}, v AS (SELECT lower(token) AS token FROM t UNION SELECT form FROM forms), {_EV}, {values('x', 'language, paradigm_id, stem_type, stem, lexeme_id', [s for s in _STEMS if s[2] == 1])}, {_SUF} SELECT DISTINCT token, m.ending_id, lexeme_id::BIGINT AS lexeme_id FROM m JOIN x USING (paradigm_id, stem)")
def stem_lookup(spark, d):
    s = candidates.stems(seed.catalog(spark)).where("stem_type = 1").select("paradigm_id", F.col("base_stem").alias("stem"), "lexeme_id")
    words = vocabulary(spark, d).union(spark.createDataFrame(_FORMS, "token string")).distinct()
    e = seed.catalog(spark).endings.select("paradigm_id", "ending_id", "ending")
    return candidates.ending_matches(words, e).join(s, ["paradigm_id", "stem"]).select("token", "ending_id", "lexeme_id").distinct()


_SAMPLES = sorted({x for x in "mac mēc mic moc māc myc krs ej iej uoj dov lobuok vysulobuok vyslobuok lobuoka lobuļuok muocei ļdei dzeiv runuo skraidē juomuoc juorunuo ļļ muokslin tautiš kuš rak rok tēv mež galdiņ lāč zaļ vislielāk lielāk jārakt jārok skaņ dod skaš guļ sak saka saki māk sēž sēdē sacī gulē vajag vajadzē iet ej kos pūz zemnīc lūdz sarūdz veikus inā sargā ļaud kāj mājās".split()})
_SAMPLES = sorted({*_SAMPLES, *(x + e for e in alternation_sql.endings() for x in ("ma", "vis"))})
_IDS = [*alternation_sql.BACK, *alternation_sql.REDIRECTS, 999]
_ASKED = [("", False, False), ("kod", True, True), ("mat", False, True), ("mas", False, False), ("gāj", True, False)]
_CASE_SQL = f"{values('samples', 'stem', [(x,) for x in _SAMPLES])}, {values('ids', 'mija', [(x,) for x in _IDS])}, {values('asked', 'third_stem, proper, superlative', _ASKED)}, c AS (SELECT * FROM samples, ids, asked)"


def _mija(spark, direction):
    """Variants of sample stems under every number, in order."""
    asked = F.explode(F.array(*[F.struct(F.lit(t).alias("third_stem"), F.lit(p).alias("proper"), F.lit(u).alias("superlative")) for t, p, u in _ASKED]))
    rows = spark.createDataFrame([(x,) for x in _SAMPLES], "stem string").withColumn("mija", F.explode(F.lit(_IDS).cast("array<int>"))).withColumn("x", asked).select("stem", "mija", "x.*")
    key = ["stem", "mija", "third_stem", "proper", "superlative"]
    number = F.row_number().over(Window.partitionBy(*key).orderBy("variant_ord"))
    return alternation.variants(rows, direction).withColumn("variant_no", number).drop("variant_ord")


@query(f"WITH {_CASE_SQL} SELECT * FROM {alternation_sql.variants_sql('c', 'a')}")
def mija_analysis(spark, d):
    """Base stems of sample stems under every alternation."""
    return _mija(spark, "a")


@query(f"WITH {_CASE_SQL} SELECT * FROM {alternation_sql.variants_sql('c', 'g')}")
def mija_generation(spark, d):
    """Stems of forms of sample stems under every alternation."""
    return _mija(spark, "g")


_FATAL = "1, 2, 5, 6, 7, 8, 9, 14, 15, 17, 23, 26, 36, 37"
_AGAIN_SQL = f"""WITH {_CASE_SQL}, f AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM {alternation_sql.variants_sql('c', 'a')}),
again AS (SELECT id, stem AS wanted, variant AS stem, mija, CASE WHEN mija = 6 AND ends_with(third_stem, 'ī') THEN third_stem[:-2] ELSE third_stem END AS third_stem, unnest(list_distinct([proper, FALSE])) AS proper, coalesce(degree, '') = 'Vispārākā' AS superlative FROM f WHERE mija IN ({_FATAL})),
met AS (SELECT DISTINCT id FROM {alternation_sql.variants_sql('again', 'g', 'id, wanted')} WHERE lower(variant) = lower(wanted))
SELECT * EXCLUDE (id) FROM f WHERE mija NOT IN ({_FATAL}) OR (mija = 7 AND ends_with(variant, 'dod')) OR id IN (SELECT id FROM met)"""


@query(_AGAIN_SQL)
def mija_roundtrip(spark, d):
    """Analyses that hold when inflected again."""
    return alternation.verified(_mija(spark, "a"))


@query(f"WITH {values('redirects', 'mija, prefix, least, target, vowels', [(k, *v) for k, v in alternation_sql.REDIRECTS.items()])} SELECT mija, prefix, least, target, vowels FROM redirects")
def redirect_prefix(spark, d):
    return alternation.redirects(spark)


_BAGS = [(1, {"Pakāpe": "P"}, {"Vārdšķira": "Lietvārds", "Lietvārda tips": "Sugas vārds"}, {"Lietvārda tips": "Īpašvārds", "Joma": "x"}, {"Pakāpe": "E"}), (2, {}, {"Dzimte": "Vīriešu"}, {"Dzimte": "Sieviešu"}, {"Dzimte": "Kopdzimte"}), (3, {"a": "1"}, {}, {"b": "2|3"}, {})]
_FLAT = [(i, o, k, v) for i, *b in _BAGS for o, bag in enumerate((b[0], b[1], b[2], b[1], b[3])) for k, v in bag.items()]


def _bag_rows(spark):
    return spark.createDataFrame(_BAGS, "id int, variant map<string,string>, paradigm map<string,string>, lexeme map<string,string>, ending map<string,string>").select("id", bags.reading(F.col("variant"), F.col("paradigm"), F.col("lexeme"), F.col("ending")).alias("attrs"))


_MERGED = f"{values('f', 'id, o, k, v', _FLAT)}, merged AS (SELECT id, k, v FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY o DESC) AS r FROM f) WHERE r = 1)"


@query(f"WITH {_MERGED} SELECT id, k, v FROM merged")
def attr_merge(spark, d):
    return _bag_rows(spark).select("id", F.explode("attrs").alias("k", "v"))


_ASK = [("Dzimte", "kopdzimte"), ("b", "3"), ("Pakāpe", "E"), ("missing", "x")]


def _match(kind):
    def run(spark, d):
        ask = spark.createDataFrame(_ASK, "key string, wanted string")
        return _bag_rows(spark).crossJoin(ask).select("id", "key", kind(F.col("attrs"), F.col("key"), F.col("wanted")).alias("matches"))

    return run


def _match_sql(missing: str) -> str:
    return f"WITH {_MERGED}, {values('a', 'k, wanted', _ASK)}, i AS (SELECT DISTINCT id FROM f) SELECT id, a.k AS key, CASE WHEN v IS NULL THEN {missing} ELSE list_contains(string_split(lower(v), '|'), lower(wanted)) END AS matches FROM i CROSS JOIN a LEFT JOIN merged USING (id, k)"


CATALOG["attr_match_strong"] = (_match(bags.strong), _match_sql("false"))
CATALOG["attr_match_weak"] = (_match(bags.weak), _match_sql("true"))
for _n in ("attr_match_strong", "attr_match_weak"):
    CATALOG[_n] = (lambda s, d, f=CATALOG[_n][0]: f(configure(s), d), CATALOG[_n][1])

_WORDS = "tēvu galdu rīgs lauks meži 12. zzz nerok aizrok tēviņš racējs rakt lielāks vislielākais jārok un mežs Kalns mājas uz".split()


def _readings(spark, words=_WORDS, settings=seed.Settings()):
    cat = seed.catalog(spark)
    # the readings are asked several times: computed once
    return cat, cut(candidates.analyze(spark.createDataFrame([(w,) for w in words], "token string"), cat, settings))


@query()
def analyze_words(spark, d):
    """Ranked readings of sample words."""
    return _readings(spark)[1].withColumn("attrs", bags.to_json(F.col("attrs")))


_RANK = [("tēvu", 0, 1, 4, "c"), ("tēvu", 1, 1, 7, "c"), ("x", 0, None, 4, "c"), ("x", 1, 6, 99, "c"), ("Rīgas", 0, None, 5, "c"), ("Rīgas", 1, None, 5, "p")]
_RS = "token string, cand int, lexeme_id bigint, ending_id int, kind string"


@query(f"""WITH {values('r', 'token, cand, lexeme_id, ending_id, kind', _RANK)}, {values('ef', 'ending_id, e', seed.END_FREQ)}, {values('lf', 'lexeme_id, l', seed.LEX_FREQ)},
s AS (SELECT *, 0.1::DOUBLE + coalesce(e, 0) + 1000 * coalesce(l, 0) - CASE WHEN lexeme_id IS NULL THEN 5 ELSE 0 END AS score, ((kind = 'p') = regexp_matches(token, '^\\p{{Lu}}'))::INT AS agrees FROM r LEFT JOIN ef USING (ending_id) LEFT JOIN lf USING (lexeme_id))
SELECT token, cand, round(score, 6) AS score, row_number() OVER (PARTITION BY token ORDER BY score DESC, agrees DESC, cand)::INT AS rank FROM s""")
def rank_readings(spark, d):
    rows = spark.createDataFrame(_RANK, _RS)
    tip = F.when(F.col("kind") == "p", "Īpašvārds").otherwise("Sugas vārds")
    r = rows.select("token", F.lit(1).alias("tier"), "lexeme_id", "ending_id", F.lit(1).alias("paradigm_id"), F.lit("lv").alias("language"), F.lit("").alias("lemma"), F.create_map(F.lit("Lietvārda tips"), tip).alias("attrs"), F.lit(0).alias("k"), F.col("cand").alias("ord"))
    return candidates.ranked(r, seed.catalog(spark)).select("token", F.col("cand_idx").alias("cand"), F.round("score", 6).alias("score"), "rank")


_RARE = [("a", 1, "Reti"), ("a", 2, ""), ("b", 3, "Reti"), ("c", 4, "Apvidvārds"), ("d", 5, "Apvidvārds"), ("d", 6, "Reti")]


@query(f"WITH {values('r', 'token, id, usage', _RARE)}, w AS (SELECT *, bool_or(usage <> 'Reti') OVER (PARTITION BY token) AS common FROM r) SELECT token, id FROM w WHERE (usage <> 'Reti' OR NOT common) AND usage <> 'Apvidvārds'")
def rare_filter(spark, d):
    r = spark.createDataFrame(_RARE, "token string, id int, usage string").select("token", "id", F.create_map(F.lit("Lietojums"), "usage").alias("attrs"))
    return candidates.drop_rare(r).select("token", "id")


@query(f"""WITH {V}, {_EV}, {values('x', 'language, paradigm_id, stem_type, stem, lexeme_id', [s for s in _STEMS if s[2] == 1])}, {_SUF},
hit AS (SELECT DISTINCT token FROM m JOIN x USING (paradigm_id, stem)), num AS (SELECT token FROM v ANTI JOIN hit USING (token) WHERE regexp_matches(token, '^\\d+([.,]\\d+)?$'))
SELECT token, 'lexicon' AS tier FROM hit UNION ALL SELECT token, 'pattern' FROM num UNION ALL SELECT token, 'none' FROM v ANTI JOIN hit USING (token) ANTI JOIN num USING (token)""")
def fallback_tiers(spark, d):
    """Every token at the first tier that knows it."""
    v = vocabulary(spark, d)
    hit = stem_lookup(spark, d).select("token").distinct()
    flag = v.join(hit.withColumn("known", F.lit(True)), "token", "left")
    return flag.select("token", F.when(F.col("known"), "lexicon").when(F.col("token").rlike(r"^\d+([.,]\d+)?$"), "pattern").otherwise("none").alias("tier"))


_PV = values("p", "prefix", [(p[2],) for p in seed.PREFIX_ROWS if p[0] == "lv" and p[1] == "verb"])


#: What is put before every word, so that there are prefixes to take off.
_HEADS = [("",), ("ne",), ("aiz",), ("jāuz",), ("visne",), ("jāvisaiz",), ("uzne",)]


@query(f"""WITH {T}, {values("heads", "head", _HEADS)}, v AS (SELECT DISTINCT head || lower(token) AS token FROM t, heads), {_PV}, c AS (SELECT token, CASE WHEN starts_with(token, 'jā') THEN substr(token, 3) ELSE token END AS cur, CASE WHEN starts_with(token, 'jā') THEN 'jā' ELSE '' END AS keep FROM v),
g AS (SELECT *, starts_with(cur, 'vis' || prefix) AS sup FROM c, p WHERE starts_with(cur, 'vis' || prefix) OR starts_with(cur, prefix))
SELECT token, prefix, keep || CASE WHEN sup THEN 'vis' || substr(cur, 4 + length(prefix)) ELSE substr(cur, 1 + length(prefix)) END AS residue FROM g WHERE keep || CASE WHEN sup THEN 'vis' || substr(cur, 4 + length(prefix)) ELSE substr(cur, 1 + length(prefix)) END <> ''""")
def prefix_strip(spark, d):
    """Verb prefixes taken off every word, with and without one put before it."""
    heads = F.explode(F.array(*[F.lit(h) for h, in _HEADS]))
    words = vocabulary(spark, d).withColumn("head", heads).select(F.concat("head", "token").alias("token")).distinct()
    return candidates.prefix_residues(words, seed.catalog(spark).prefixes).select("token", "prefix", "residue")


@query("SELECT * FROM (VALUES ('blars', 1, 'noun-1a', 50::BIGINT), ('blars', 13, 'adj-1', 5::BIGINT), ('mežs', 1, 'noun-1a', 50::BIGINT)) t(token, paradigm_id, name, n)")
def suitable_paradigms(spark, d):
    return candidates.suitable_paradigms(spark.createDataFrame([("mežs",), ("blars",)], "token string"), seed.catalog(spark))


_TAGGED = [(1, "ncmsn1", {"Vārdšķira": "Lietvārds", "Lietvārda tips": "Sugas vārds", "Dzimte": "Vīriešu", "Skaitlis": "Vienskaitlis", "Locījums": "Nominatīvs", "Deklinācija": "1"}), (2, "ncfsn5", {"Vārdšķira": "Lietvārds", "Lietvārda tips": "Sugas vārds", "Dzimte": "Sieviešu", "Skaitlis": "Vienskaitlis", "Locījums": "Nominatīvs", "Deklinācija": "5"}), (3, "-", {}), (4, "-", {"Dzimte": "Vīriešu"}), (5, "nc____", {"Vārdšķira": "Lietvārds"})]


@query(f"WITH {values('t', 'id, tag', [(i, t) for i, t, _ in _TAGGED])} SELECT id, tag FROM t")
def to_tag(spark, d):
    return tags.to_tag(spark.createDataFrame([(i, b) for i, _, b in _TAGGED], "id int, attrs map<string,string>"), seed.catalog(spark).tag_values)


_TAGS = [(1, "ncmsn1"), (2, "vmnipi13__n"), (3, "a_msnys"), (4, "-"), (5, "?x"), (6, "cc_")]
_TV = values("tv", "attr_lv, attr_en, pos, markup_pos, value_lv, value_en, tag, default_tags", seed.TAG_ROWS)


@query(f"""WITH {_TV}, {values('t', 'id, code', _TAGS)}, h AS (SELECT id, code, value_lv AS pos FROM t JOIN tv ON attr_lv = 'Vārdšķira' AND tag = left(code, 1))
SELECT id, 'Vārdšķira' AS k, pos AS v FROM h UNION ALL SELECT id, attr_lv, min(value_lv) FROM h JOIN tv ON tv.pos = h.pos AND substr(code, markup_pos + 1, 1) = tag AND tag NOT IN ('_', '-') GROUP BY id, attr_lv""")
def from_tag(spark, d):
    return tags.from_tag(spark.createDataFrame(_TAGS, "id int, tag string"), seed.catalog(spark).tag_values).select("id", F.explode("attrs").alias("k", "v"))


_EN = [(i, k, v) for i, _, b in _TAGGED for k, v in b.items()] + [(9, "Joma", "x")]


@query(f"""WITH {_TV}, {values('b', 'id, k, v', _EN)}, n AS (SELECT attr_lv, min(attr_en) AS en FROM tv GROUP BY 1), w AS (SELECT attr_lv, value_lv, min(value_en) AS en FROM tv GROUP BY ALL)
SELECT id, coalesce(n.en, k) AS k, coalesce(w.en, v) AS v FROM b LEFT JOIN n ON n.attr_lv = k LEFT JOIN w ON w.attr_lv = k AND w.value_lv = v""")
def translate_attrs(spark, d):
    rows = spark.createDataFrame([(i, b) for i, _, b in _TAGGED] + [(9, {"Joma": "x"})], "id int, attrs map<string,string>")
    return tags.translated(rows, seed.catalog(spark).tag_values).select("id", F.explode("attrs").alias("k", "v"))


def _forms_sql(rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) t(lemma, ending_id, form)"


_TEVS = [("tēvs", i + 1, f) for i, f in enumerate("tēvs tēva tēvam tēvu tēvā tēvi tēvu tēviem tēvus tēvos".split())] + [("mežs", i + 1, f) for i, f in enumerate("mežs meža mežam mežu mežā".split())]


@query(_forms_sql(_TEVS))
def inflect_paradigm(spark, d):
    return generation.inflect(spark.createDataFrame([("tēvs",), ("mežs",)], "lemma string"), seed.catalog(spark)).select("lemma", "ending_id", "form")


_RAKT = [("rakt", e, n + f) for e, f in ((71, "rakt"), (72, "roku"), (73, "roc"), (74, "rok"), (75, "raku"), (77, "racis")) for n in ("", "ne")] + [("rakt", 76, "jārok")]


@query(_forms_sql(_RAKT))
def inflect_negated(spark, d):
    return generation.inflect(spark.createDataFrame([("rakt",)], "lemma string"), seed.catalog(spark)).select("lemma", "ending_id", "form")


_LIELS = [("liels", 51 + i, "liel" + a + e) for i, e in enumerate("s a am u ā i u iem us os".split()) for a in ("", "āk")] + [("liels", 61, "lielais"), ("liels", 61, "lielākais"), ("liels", 61, "vislielākais")]


@query(_forms_sql(_LIELS))
def degree_forms(spark, d):
    return generation.inflect(spark.createDataFrame([("liels",)], "lemma string"), seed.catalog(spark)).select("lemma", "ending_id", "form")


def _phrase(spark, phrases):
    rows = [(i, j, t) for i, p in enumerate(phrases) for j, t in enumerate(p.split())]
    words = sorted({t for _, _, t in rows})
    cat, r = _readings(spark, words, seed.Settings(guessing=True))
    forms = cut(generation.inflect(r.select("lemma").distinct(), cat))
    return spark.createDataFrame(rows, "phrase_id int, pos int, token string"), r, forms


_PH = [("Nominatīvs", "tēvs mežs"), ("Ģenitīvs", "tēva meža"), ("Datīvs", "tēvam mežam"), ("Akuzatīvs", "tēvu mežu"), ("Lokatīvs", "tēvā mežā")]


@query(f"SELECT 0 AS phrase_id, * FROM (VALUES {', '.join(f'({lit(a)}, {lit(b)})' for a, b in _PH)}) t(\"case\", phrase)")
def phrase_table(spark, d):
    return generation.inflect_phrase(*_phrase(spark, ["tēvs mežs"]))


@query("SELECT * FROM (VALUES (0, 'tēvs'), (1, 'liels tēvs')) t(phrase_id, phrase)")
def normalize_phrase(spark, d):
    return generation.normalize_phrase(*_phrase(spark, ["tēvus", "lielu tēvu"]))


@query()
def people_grid(spark, d):
    return generation.inflect_people(*_phrase(spark, ["Kalns Zzz"]))


@query("SELECT * FROM (VALUES (0, 'Gen,Nom,Dat,Acc,Loc'), (1, 'Nom,Gen,Dat,Acc,Loc,V1,V2,V3,Inf,S,TR,Adv'), (2, 'Inf,V1,V2,V3'), (3, 'uzGen'), (4, 'S'), (5, 'Adv')) t(phrase_id, tags)")
def valency_tags(spark, d):
    t, r, _ = _phrase(spark, ["tēvu", "qqq!", "rakt", "uz mežu", "un tēvs", "ātri"])
    return generation.valency_tags(t, r).select("phrase_id", F.array_join("tags", ",").alias("tags"))


_LT = f"WITH {T}, p AS (SELECT lower(token) AS token, lang FROM t)"
_MAJ = "n AS (SELECT token, lang, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT *, (sum(n) OVER (PARTITION BY token))::BIGINT AS total, row_number() OVER (PARTITION BY token ORDER BY n DESC, lang) AS r FROM n)"


def _labelled(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("lang", F.explode(tok.portable_tokens(F.col("text"))).alias("token")).select(F.lower("token").alias("token"), "lang")


@query(f"{_LT}, {_MAJ} SELECT token, lang, n, total FROM b WHERE r = 1 AND n >= 2")
def form_majority(spark, d):
    return learning.majority(_labelled(spark, d), "token", "lang")


@query(f"{_LT}, {_MAJ} SELECT token, lang, n, total FROM b WHERE r = 1 AND total >= 5 AND n >= 0.85 * total")
def strong_overrides(spark, d):
    return learning.strong_overrides(_labelled(spark, d), "token", "lang")


@query(f"{_LT}, {_MAJ} SELECT token, lang, n, total FROM b WHERE r = 1 AND n >= 2 AND n >= 0.8 * total")
def lemma_overrides(spark, d):
    return learning.lemma_overrides(_labelled(spark, d), "token", "lang")


_BG = f"""WITH {T}, s AS (SELECT doc_id, pos, left(lower(token), 1) AS state FROM t), p AS (SELECT coalesce(lag(state) OVER (PARTITION BY doc_id ORDER BY pos), '<s>') AS prev, state AS cur FROM s),
n AS (SELECT prev, cur, count(*) AS c FROM p GROUP BY ALL), z AS (SELECT count(DISTINCT cur) AS v FROM n), a AS (SELECT cur, sum(c) AS c FROM n GROUP BY 1), al AS (SELECT sum(c) AS n, count(*) AS v FROM a),
big AS (SELECT prev, cur, ln((c + 1)::DOUBLE / ((sum(c) OVER (PARTITION BY prev)) + v)::DOUBLE) AS logp FROM n, z UNION ALL SELECT '<DEFAULT>', cur, ln((c + 1)::DOUBLE / (n + v)::DOUBLE) FROM a, al)"""


def _bigrams(spark, d):
    # one pair for each token: of no tokens none
    rows = arrays(spark, d).where("size(tokens) > 0").select(F.transform("tokens", lambda t: F.substring(F.lower(t), 1, 1)).alias("s"))
    return learning.bigrams_of(rows.select(F.inline(learning.pairs(F.col("s"))).alias("prev", "cur")))


@query(f"{_BG} SELECT prev, cur, round(logp, 6) AS logp FROM big")
def bigram_logprob(spark, d):
    return _bigrams(spark, d).withColumn("logp", F.round("logp", 6))


_ASKB = [("a", "b"), ("q", "q"), ("?", "~"), ("t", "h"), ("<s>", "t"), ("zz", "e")]


@query(f"{_BG}, {values('q', 'prev, cur', _ASKB)} SELECT q.prev, q.cur, round(coalesce(x.logp, y.logp, -10), 6) AS logp FROM q LEFT JOIN big x ON x.prev = q.prev AND x.cur = q.cur AND x.prev <> '<DEFAULT>' LEFT JOIN big y ON y.prev = '<DEFAULT>' AND y.cur = q.cur")
def bigram_backoff(spark, d):
    return learning.transition(spark.createDataFrame(_ASKB, "prev string, cur string"), _bigrams(spark, d)).withColumn("logp", F.round("logp", 6))


@query("WITH r AS (SELECT doc_id, source, lang FROM documents), w AS (SELECT *, count(*) OVER (PARTITION BY source, lang) AS n, count(*) OVER (PARTITION BY source) AS total FROM r) SELECT doc_id, source, lang FROM w WHERE n >= 5 AND total >= 40")
def label_pruning(spark, d):
    return learning.pruned(read(spark, d, "documents").select("doc_id", "source", "lang"), "source", "lang", 5, 40)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def label_census(spark, d):
    return learning.census(read(spark, d, "documents"), "lang")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def holdout_split(spark, d):
    return learning.holdout(read(spark, d, "documents").select("doc_id"), "doc_id")


def _predicted(spark, d):
    rows = _labelled(spark, d)
    return rows.join(learning.majority(rows, "token", "lang").select("token", F.col("lang").alias("predicted")), "token", "left")


_PR = f"{_LT}, {_MAJ}, m AS (SELECT token, lang AS predicted FROM b WHERE r = 1 AND n >= 2), j AS (SELECT p.lang, predicted FROM p LEFT JOIN m USING (token))"


@query(f"{_PR} SELECT count(*) AS n, count(*) FILTER (WHERE predicted IS NULL) AS missing, count(*) FILTER (WHERE lower(lang) = lower(predicted)) AS correct, round(100.0::DOUBLE * count(*) FILTER (WHERE lower(lang) = lower(predicted)) / count(*), 4) AS percent FROM j")
def accuracy_metrics(spark, d):
    return learning.accuracy(_predicted(spark, d), "lang", "predicted")


@query(f"{_PR} SELECT lang, predicted, count(*) AS n FROM j WHERE lang <> predicted GROUP BY ALL ORDER BY n DESC, lang, predicted LIMIT 10")
def confusion_top10(spark, d):
    return learning.confusion(_predicted(spark, d), "lang", "predicted")


@query(f"WITH {T} SELECT doc_id, pos::INT AS pos, first_value(CASE WHEN regexp_matches(token, '^\\p{{L}}') THEN token END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_word FROM t")
def next_nontrivial(spark, d):
    """The next word of each token, skipping numbers and punctuation."""
    rows = arrays(spark, d, "doc_id")
    return rows.select("doc_id", F.posexplode(learning.next_where("tokens", lambda t: t.rlike(r"^\p{L}"))).alias("pos", "next_word"))


@query(f"WITH {T}, c AS (SELECT doc_id, lower(token) AS token, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, token, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS r FROM c) WHERE r <= 8")
def beam_top8(spark, d):
    """The eight most frequent tokens of each document, by the beam's ranking."""
    # texts are shuffled, not their tokens: a document is counted in its row
    docs = read(spark, d, "documents").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    words = F.transform("texts", lambda t: F.transform(tok.portable_tokens(t), F.lower))
    rows = docs.select("doc_id", F.sort_array(F.flatten(words)).alias("low"))
    return rows.select("doc_id", F.inline(viterbi.most_frequent("low")))


def lattice(spark):
    rows = [(0, 0, 0, 0, "n", -1.0), (0, 0, 0, 1, "v", -2.0), (0, 0, 1, 0, "n", -3.0), (0, 0, 1, 1, "v", -1.0), (0, 0, 2, 0, "n", -1.0)]
    t = spark.createDataFrame([("n", "v", -0.5), ("v", "n", -0.2)], "prev string, cur string, logp double")
    return spark.createDataFrame(rows, "doc_id bigint, sent_id int, pos int, cand_idx int, state string, emission double"), t


@query()
def viterbi_lattice(spark, d):
    return viterbi.viterbi(*lattice(spark))


_XL = [r[5] for r in seed.LEXEME_ROWS] + ["a/s", "...", "2. pakāpe", "x"]


@query(f"WITH {values('l', 'lemma', [(x,) for x in _XL])} SELECT DISTINCT lemma FROM l WHERE length(lemma) >= 2 AND regexp_matches(lemma, '[ ./''\\d]') AND NOT regexp_matches(lemma, '^\\.+$')")
def exception_lemmas(spark, d):
    return tok.exception_lemmas(spark.createDataFrame([(x,) for x in _XL], "lemma string"))


@query(f"SELECT * FROM (VALUES ('lexemes', {len(seed.LEXEME_ROWS)}::BIGINT), ('paradigms', {len(seed.PARADIGM_ROWS)}), ('endings', {len(seed.ENDING_ROWS)}), ('prefixes', {len(seed.PREFIX_ROWS)}), ('tag_values', {len(seed.TAG_ROWS)})) t(\"table\", n)")
def catalog_counts(spark, d):
    return tables.counts(seed.catalog(spark))


@query()
def ranked_vocabulary(spark, d):
    """The flagship: ranked readings of every distinct token of documents, with their tags."""
    cat = seed.catalog(spark)
    v = tok.tokens(read(spark, d, "documents")).select("token").distinct()
    r = cut(candidates.analyze(v, cat, seed.Settings(guessing=True)).withColumn("id", F.concat_ws("\t", "token", F.col("cand_idx").cast("string"))))
    return r.join(tags.to_tag(r, cat.tag_values), "id").select("token", "rank", "lemma", "tag", "score", bags.to_json(F.col("attrs")).alias("attrs"))


@query()
def tag_documents(spark, d):
    """Lemma, tag and attributes of every token of the documents."""
    return tagging.tag(read(spark, d, "documents"), seed.catalog(spark)).withColumn("attrs", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs")))))


from . import lexical  # noqa: E402, F401  registers more queries
