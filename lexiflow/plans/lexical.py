"""More queries of the catalogue: lookups, filters, closed classes, accuracies and trained models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import seed
from ..operators import closed, learning, lookups, models
from ..operators import tokens as tok
from .queries import T, arrays, portable, query, read, values

_LEX = ["lexeme_id", "entry_id", "human_id", "paradigm_id", "paradigm_name", "lemma", "stem1"]
_LEXEMES = [r[:7] for r in seed.LEXEME_ROWS] + [(1, 9, "tēvs:9", 1, "noun-1a", "tēvs", "tēv"), (6, 1, "māja:0", 7, "noun-4f", "māja", "māj")]
_LEX_SQL = values("l", ", ".join(_LEX), _LEXEMES)


def _lexemes(spark):
    return spark.createDataFrame(_LEXEMES, "lexeme_id bigint, entry_id bigint, human_id string, paradigm_id int, paradigm_name string, lemma string, stem1 string")


@query(f"WITH {_LEX_SQL} SELECT lexeme_id::BIGINT AS lexeme_id, entry_id::BIGINT AS entry_id, human_id, paradigm_id, paradigm_name, lemma, stem1 FROM l WHERE lexeme_id IN (1, 3, 6, 99) QUALIFY row_number() OVER (PARTITION BY lexeme_id ORDER BY entry_id, human_id) = 1")
def lexeme_by_id(spark, d):
    """The first lexeme of each id."""
    return lookups.lexemes_by_id(_lexemes(spark), spark.createDataFrame([(1,), (3,), (6,), (6,), (99,)], "lexeme_id bigint"))


@query(f"WITH {_LEX_SQL} SELECT lexeme_id::BIGINT AS lexeme_id, entry_id::BIGINT AS entry_id, human_id, paradigm_id, paradigm_name, lemma, stem1 FROM l WHERE lemma IN ('tēvs', 'māja', 'Mežs')")
def lexeme_by_lemma(spark, d):
    """All lexemes of each lemma."""
    return lookups.lexemes_by_lemma(_lexemes(spark), spark.createDataFrame([("tēvs",), ("māja",), ("Mežs",)], "lemma string"))


@query(f"WITH {_LEX_SQL} SELECT lexeme_id::BIGINT AS lexeme_id, entry_id::BIGINT AS entry_id, human_id, paradigm_id, paradigm_name, lemma, stem1 FROM l WHERE paradigm_name = 'noun-1a'")
def lexeme_by_paradigm(spark, d):
    """All lexemes of a paradigm."""
    return lookups.lexemes_by_paradigm(_lexemes(spark), "noun-1a")


_ENDINGS = [(r[1], r[2], r[3], k, v) for r in seed.ENDING_ROWS for k, v in (r[7] or {"-": "-"}).items()]


@query(f"""WITH {values("e", "paradigm_id, ending_id, ending, k, v", _ENDINGS)} SELECT paradigm_id, ending_id, ending FROM e GROUP BY ALL
HAVING count(*) FILTER (WHERE k = 'Locījums' AND lower(v) = 'datīvs') > 0 AND count(*) FILTER (WHERE k = 'Skaitlis' AND lower(v) = 'daudzskaitlis') > 0""")
def endings_by_attributes(spark, d):
    """Endings of the dative plural."""
    return lookups.endings_with(seed.catalog(spark).endings, {"Locījums": "datīvs", "Skaitlis": "Daudzskaitlis"}).select("paradigm_id", "ending_id", "ending")


_TAGS = values("t", "attr_lv, attr_en, pos, markup_pos, value_lv, value_en, tag, default_tags", seed.TAG_ROWS)
_ASKED = [("Skaitlis", "Vienskaitlis", "p"), ("Locījums", "Datīvs", "n"), ("Vārdšķira", "Lietvārds", "v"), ("Pakāpe", "Pārākā", "x"), ("Nekas", "Nekas", "s")]


@query(f"""WITH {_TAGS}, {values("a", "attr_lv, value_asked, tag_asked", _ASKED)}
SELECT a.attr_lv, value_asked, tag_asked, (SELECT arg_min(tag, (coalesce(pos, ''), markup_pos)) FROM t WHERE t.attr_lv = a.attr_lv AND t.value_lv = value_asked) AS tag,
  (SELECT arg_min(value_lv, (coalesce(pos, ''), markup_pos)) FROM t WHERE t.attr_lv = a.attr_lv AND t.tag = tag_asked) AS value_lv FROM a""")
def tagset_lookups(spark, d):
    """Tags of values and values of tags."""
    tags = seed.catalog(spark).tag_values
    asked = spark.createDataFrame(_ASKED, "attr_lv string, value_asked string, tag_asked string")
    rows = lookups.tag_values_of(asked.withColumnRenamed("value_asked", "value_lv"), tags).withColumnsRenamed({"value_lv": "value_asked", "tag": "found"})
    return lookups.values_of_tags(rows.withColumn("tag", F.col("tag_asked")), tags).drop("tag").withColumnRenamed("found", "tag")


@query(f"WITH {_TAGS} SELECT attr_lv, min(markup_pos)::INT AS markup_pos FROM t WHERE pos = 'Darbības vārds' GROUP BY attr_lv")
def attributes_for_pos(spark, d):
    """The attributes of verbs."""
    return lookups.attributes_for_pos(seed.catalog(spark).tag_values, "Darbības vārds")


_WORDS = ["etc.", "ETC.", "Dr.", "dr", "***", "word", "my.own", "u.c."]


@query(f"""WITH {values("w", "token", [(x,) for x in _WORDS])} SELECT token, lower(token) IN ({", ".join("'" + e.lower().replace("'", "''") + "'" for e in (*tok.EXCEPTIONS, *tok.SIGNS, "My.own"))}) AS whole FROM w""")
def kept_whole(spark, d):
    """Which tokens are exceptions of the tokenizer."""
    return spark.createDataFrame([(x,) for x in _WORDS], "token string").select("token", lookups.kept_whole(F.col("token"), ["My.own"]).alias("whole"))


_READINGS = [("raksti", 1, "Īpašvārds", "lv"), ("raksti", 2, "Sugas vārds", "lv"), ("Raksti", 3, "Īpašvārds", "lv"), ("raksti", 4, None, "ltg"), ("Rīga", 5, "Īpašvārds", None), ("čuļs", 6, "īpašvārds", "ltg")]


def _readings(spark):
    rows = spark.createDataFrame(_READINGS, "token string, id int, kind string, language string")
    return rows.withColumn("attrs", F.when(F.col("kind").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("Lietvārda tips"), "kind")))


@query(f"WITH {values('r', 'token, id, kind, language', _READINGS)} SELECT token, id FROM r WHERE NOT (token = lower(token) AND coalesce(lower(kind) = 'īpašvārds', FALSE))")
def without_proper_nouns(spark, d):
    """Readings of tokens in lower case, proper nouns left out."""
    return lookups.without_proper(_readings(spark)).select("token", "id")


@query(f"WITH {values('r', 'token, id, kind, language', _READINGS)} SELECT 'lv' AS asked, id FROM r WHERE coalesce(language, '') <> 'ltg' UNION ALL SELECT 'ltg', id FROM r WHERE language = 'ltg' UNION ALL SELECT '', id FROM r")
def language_filter(spark, d):
    """Readings of each language."""
    out = None
    for asked in ("lv", "ltg", ""):
        rows = lookups.of_language(_readings(spark), asked).select(F.lit(asked).alias("asked"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


_CASES = ("Nominatīvs", "Ģenitīvs", "Datīvs", "Akuzatīvs", "Lokatīvs", None)
_PRONOUNS = sorted({(f, lemma) for f, lemma, _ in closed.pronoun_rows()} | {("savs", "savs"), ("savas", "savs"), ("kādiem", "kāds"), ("nevienam", "neviens"), ("nekā", "nekas"), ("ne", "ne"), ("katrā", "katrs"), ("Mani", "es")})
_STATES = [(None, None, None), ("Nepiemīt", "Vienskaitlis", "Nē"), ("Kopdzimte", None, "Jā")]


@query(f"""WITH {values("p", "form, lemma", _PRONOUNS)}, {values("c", "kase", [(x,) for x in _CASES])}, {values("s", "gender, number, negation", _STATES)},
{values("own", "form, lemma, code", closed.pronoun_rows())}, {values("ends", "kase, e, code", closed.ending_rows())},
asked AS (SELECT * FROM p, c, s),
coded AS (SELECT a.*, coalesce((SELECT code FROM own o WHERE o.form = lower(a.form) AND o.lemma = a.lemma),
  (SELECT arg_max('-' || code, length(e)) FROM ends x WHERE x.kase = a.kase AND ends_with(lower(a.form), e) AND length(a.form) > length(e))) AS code FROM asked a),
filled AS (SELECT form, lemma, kase, gender AS was, negation AS denied, CASE WHEN code[1] <> '-' THEN code[1] END AS person,
  CASE WHEN coalesce(gender, 'Nepiemīt') = 'Nepiemīt' THEN coalesce(CASE code[3] WHEN 'm' THEN 'Vīriešu' WHEN 'f' THEN 'Sieviešu' END, gender) ELSE gender END AS gender,
  CASE WHEN coalesce(number, 'Nepiemīt') = 'Nepiemīt' THEN coalesce(CASE code[2] WHEN 's' THEN 'Vienskaitlis' WHEN 'p' THEN 'Daudzskaitlis' END, number) ELSE number END AS number,
  CASE WHEN starts_with(lemma, 'ne') AND length(lemma) > 2 AND coalesce(negation, 'Nē') = 'Nē' THEN 'Jā' ELSE negation END AS negation FROM coded)
SELECT * FROM filled""")
def pronoun_attributes(spark, d):
    """Person, gender and number of pronouns by form, case and ending."""
    rows = spark.createDataFrame(_PRONOUNS, "form string, lemma string").crossJoin(spark.createDataFrame([(x,) for x in _CASES], "kase string"))
    rows = rows.crossJoin(spark.createDataFrame(_STATES, "gender string, number string, negation string"))
    bag = F.create_map(F.lit("Vārdšķira"), F.lit("Vietniekvārds"), F.lit("Locījums"), "kase", F.lit("Dzimte"), "gender", F.lit("Skaitlis"), "number", F.lit("Noliegums"), "negation")
    rows = rows.select("kase", "gender", "negation", F.col("form").alias("token"), "lemma", F.lit(1).cast("bigint").alias("lexeme_id"), F.map_filter(bag, lambda k, v: v.isNotNull()).alias("attrs"))
    got = closed.with_pronouns(rows)
    at = lambda k: F.try_element_at("attrs", F.lit(k))
    return got.select(F.col("token").alias("form"), "lemma", "kase", F.col("gender").alias("was"), F.col("negation").alias("denied"), at("Persona").alias("person"), at("Dzimte").alias("gender"), at("Skaitlis").alias("number"), at("Noliegums").alias("negation"))


_LISTS = [("Darbības vārds", "rakt", "Transitivitāte", "Transitīvs"), ("Darbības vārds", "varēt", "Darbības vārda tips", "Modāls modificētājs"), ("Apstākļa vārds", "ātri", "Pakāpe", "Pamata"), ("Darbības vārds", "varēt", "Transitivitāte", "Intransitīvs")]
_LISTED = [(1, "Darbības vārds", "rakt", "Intransitīvs"), (2, "Darbības vārds", "varēt", None), (3, "Apstākļa vārds", "ātri", None), (4, "Lietvārds", "rakt", None), (5, "Darbības vārds", "skriet", "Intransitīvs")]


@query(f"""WITH {values("l", "pos, lemma, attr, v", _LISTS)}, {values("r", "id, pos, lemma, transitivity", _LISTED)},
bag AS (SELECT id, pos, lemma, 'Transitivitāte' AS k, transitivity AS v, 0 AS o FROM r WHERE transitivity IS NOT NULL UNION ALL SELECT id, r.pos, r.lemma, attr, l.v, 1 FROM r JOIN l ON r.pos = l.pos AND r.lemma = l.lemma)
SELECT id, k, arg_max(v, o) AS v FROM bag GROUP BY id, k""")
def lemma_lists(spark, d):
    """Attributes that lists of verbs and adverbs correct."""
    rows = spark.createDataFrame(_LISTED, "id int, pos string, lemma string, transitivity string")
    bag = F.map_filter(F.create_map(F.lit("Vārdšķira"), "pos", F.lit("Transitivitāte"), "transitivity"), lambda k, v: v.isNotNull())
    got = closed.with_lemma_lists(rows.select("id", "lemma", bag.alias("attrs")), spark.createDataFrame(_LISTS, "pos string, lemma string, attr string, value string"))
    return got.select("id", F.explode("attrs").alias("k", "v")).where("k <> 'Vārdšķira'")


_JUDGED = "lang, lower(token) AS gold_lemma, substr(lower(token), 1, 3) AS gold_tag, token AS lemma, substr(token, 1, 3) AS tag"
_SHARE = "round(100 * avg(coalesce({}, FALSE)::INT), 4)"
_ACC = f"count(*) AS n, {_SHARE.format('lower(gold_lemma) = lower(lemma)')} AS lemma_percent, {_SHARE.format('gold_tag = tag')} AS tag_percent, {_SHARE.format('gold_tag[1] = tag[1]')} AS pos_percent"


def _judged(spark, d):
    rows = arrays(spark, d, "lang").select("lang", F.explode("tokens").alias("token"))
    return rows.selectExpr("lang", "lower(token) AS gold_lemma", "substr(lower(token), 1, 3) AS gold_tag", "token AS lemma", "substr(token, 1, 3) AS tag")


@query(f"WITH {T}, j AS (SELECT {_JUDGED} FROM t) SELECT lang, {_ACC} FROM j GROUP BY lang")
def accuracy_by_run(spark, d):
    """Lemma, tag and part-of-speech accuracy of each run (here of each language)."""
    return lookups.tagging_accuracy(_judged(spark, d), ["lang"])


@query(f"""WITH {T}, j AS (SELECT {_JUDGED} FROM t), a AS (SELECT lang, {_ACC} FROM j GROUP BY lang), m AS (SELECT unnest(['lemma_percent', 'tag_percent', 'pos_percent']) AS metric, unnest([lemma_percent, tag_percent, pos_percent]) AS v FROM a)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev, min(v) AS low, max(v) AS high FROM m GROUP BY metric""")
def accuracy_over_runs(spark, d):
    """Mean and spread of the accuracies over the runs."""
    return lookups.over_seeds(lookups.tagging_accuracy(_judged(spark, d), ["lang"]), ["lemma_percent", "tag_percent", "pos_percent"])


@query(f"WITH {values('l', 'source, paradigm_id, stem1, attributes_json', [(r[10], r[3], r[6], r[9]) for r in seed.LEXEME_ROWS])} SELECT source, count(*) AS n, count(*) - count(paradigm_id) AS without_paradigm, count(*) - count(stem1) AS without_stem, count(*) - count(attributes_json) AS without_attributes FROM l GROUP BY source")
def extraction_counts(spark, d):
    """What the extracted lexemes of each source lack."""
    return lookups.extraction_counts(seed.catalog(spark).lexemes)


_LABELS = ("a", "n", "v")


def _weight(i: int, bucket: str) -> str:
    return f"(({bucket} * 31 + {i} * 17) % 13 - 6) / 10.0"


@query(f"""WITH {T}, f AS (SELECT doc_id, pos, list_distinct([length(token) % 7, (unicode(token) % 11 + 7)::BIGINT, 40]) AS b FROM t),
x AS (SELECT doc_id, pos, unnest(b) AS bucket FROM f), l AS (SELECT unnest(['a', 'n', 'v']) AS label, unnest([0, 1, 2]) AS i),
s AS (SELECT doc_id, pos, label, i / 10.0 + sum(CASE WHEN bucket < 30 THEN ((bucket * 31 + i * 17) % 13 - 6) / 10.0 ELSE 0 END) AS score FROM x, l GROUP BY doc_id, pos, label, i)
SELECT doc_id, pos::INT AS pos, label, round(score - ln(sum(exp(score)) OVER (PARTITION BY doc_id, pos)), 9) AS logp FROM s""")
def tag_emissions(spark, d):
    """Log probabilities of all labels for every token, from a table of weights."""
    rows = portable(spark, d).selectExpr("doc_id", "pos", "array_distinct(array(length(token) % 7, ascii(token) % 11 + 7, 40)) AS buckets")
    weights = spark.createDataFrame([(name, -1, i / 10) for i, name in enumerate(_LABELS)] + [(name, b, ((b * 31 + i * 17) % 13 - 6) / 10) for i, name in enumerate(_LABELS) for b in range(30)], models.WEIGHTS)
    return models.log_proba(rows, weights, ["doc_id", "pos"]).withColumn("logp", F.round("logp", 9))


@query()
def model_accuracy(spark, d):
    """A model of the language of single tokens, fitted on documents of even number and asked about the others: n, missing, correct, percent."""
    docs = read(spark, d, "documents").where("doc_id % 5 < 2")
    toks = tok.token_arrays(docs, "doc_id", "lang", exact=False).withColumn("tokens", F.slice("tokens", 1, 200))
    rows = models.buckets(learning.array_features(toks, "doc_id", "lang"))
    weights = models.train(rows.where("doc_id % 2 = 0"), "lang", max_train=4000, iterations=15)
    asked = rows.where("doc_id % 2 = 1")
    return learning.accuracy(models.best_labels(asked, weights, ["doc_id", "pos", "lang"]), "lang", "label")
