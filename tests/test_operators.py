"""Operators on literal inputs."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lexiflow import seed, session
from lexiflow.functions import bags, tags, text
from lexiflow.operators import alternation, candidates, generation, learning, viterbi
from lexiflow.operators import tokens as tok
from lexiflow.plans.queries import lattice
from lexiflow.sources import tables

TOKENS = [
    ("Es eju mājās.", ["Es", "eju", "mājās", "."]),
    ("plkst. 14:30", ["plkst.", "14:30"]),
    ("Skat www.example.lv vai https://example.com/path", ["Skat", "www.example.lv", "vai", "https://example.com/path"]),
    ("kontakts: peteris@example.com", ["kontakts", ":", "peteris@example.com"]),
    ("Likuma 1.2.3.4. punkts", ["Likuma", "1.2.3.4.", "punkts"]),
    ("2009-12-14 un 2024.05.08", ["2009-12-14", "un", "2024.05.08"]),
    ("Ko?! Ej!?", ["Ko", "?!", "Ej", "!?"]),
    ("1 234,56 EUR", ["1 234,56", "EUR"]),
    ("a t s t a r p e s", ["a t s t a r p e s"]),
    ("Jaņus u.c. svētkus", ["Jaņus", "u.c.", "svētkus"]),
    ("etc. un", ["etc.", "un"]),
    ("12.", ["12", "."]),
    ("12. decembris", ["12.", "decembris"]),
    ("1234,- EUR", ["1234,-", "EUR"]),
    ("12A. iela", ["12A", ".", "iela"]),
    ("mājā (1.2. p.)", ["mājā", "(", "1.2.", "p", ".", ")"]),
    ("A/S Rīga", ["A", "/", "S", "Rīga"]),
    ("U.S.A.", ["U.", "S.", "A", "."]),
    ("24:00", ["24", ":", "00"]),
    ("it's", ["it'", "s"]),
    ("K. Barons", ["K.", "Barons"]),
    ("Dž. Rauls", ["Dž.", "Rauls"]),
    ("(vārds)", ["(", "vārds", ")"]),
    ("vārds-vārds", ["vārds-vārds"]),
    ("-5", ["-", "5"]),
    ("3/4", ["3/4"]),
    ("a b vai", ["a b", "vai"]),
    ("x x x ", ["x x x"]),
    ("co­op", ["coop"]),
    ("'vārds'", ["'", "vārds", "'"]),
    ("100 000 000", ["100 000 000"]),
    ("5 m", ["5", "m"]),
    ("", []),
    ("  ", []),
    (None, None),
]


def test_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "id int, text string")
    got = {r.id: r.t for r in rows.select("id", tok.exact_tokens(F.col("text")).alias("t")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(TOKENS)}
    one = spark.createDataFrame([("Skat mr.foo today.",)], "text string").select(tok.exact_tokens(F.col("text"), ["mr.foo"]).alias("t")).first().t
    assert one == ["Skat", "mr.foo", "today", "."]


def test_tokens_lose_nothing(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    lost = docs.where(F.regexp_replace(F.array_join(tok.exact_tokens(F.col("text")), ""), r"\s", "") != F.regexp_replace("text", r"[\s­]", ""))
    assert lost.count() == 0


def split(tokens, cap=250):
    out, cur = [], []
    for t in tokens:
        if not cur and t in '")' and out and out[-1][-1] in (".", "!", "?", '"'):
            out[-1].append(t)
            continue
        cur.append(t)
        if t in tok.CLOSERS or len(cur) > cap:
            out.append(cur)
            cur = []
    return out + ([cur] if cur else [])


def test_sentences(spark):
    rng = random.Random(4)
    docs = [["Nu", ".", '"', ")", '"', "x"], ["Ko", "?!", '"', "Tā", ".", ")", '"', "x"], ["w"] * 600, [], ['"', "a", "."]]
    docs += [[rng.choice(["a", ".", "!", '"', ")", "?!", "…"]) for _ in range(rng.randrange(40))] for _ in range(60)]
    rows = spark.createDataFrame([(i, j, t) for i, d in enumerate(docs) for j, t in enumerate(d)], "doc_id int, pos int, token string")
    got = {}
    for r in tok.sentences(rows).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, {}).setdefault(r.sent_id, []).append(r.token)
    for i, d in enumerate(docs):
        assert list(got.get(i, {}).values()) == split(d), d
    assert [len(s) for s in got[2].values()] == [251, 251, 98]


def forms(spark, direction, *rows):
    df = spark.createDataFrame([(s, m, t, p, u) for s, m, t, p, u in rows], "stem string, mija int, third_stem string, proper boolean, superlative boolean")
    return [(r.variant, r.degree, r.mark) for r in alternation.variants(df, direction).orderBy("stem", "mija", "variant_ord").collect()]


A = ("", False, False)


@pytest.mark.parametrize(
    ("stem", "mija", "found"),
    [
        ("rakt", 0, ["rakt"]), ("lāč", 1, ["lāc"]), ("skaņ", 1, ["skan"]), ("dod", 7, ["dod"]), ("vislielāk", 3, ["liel", "visliel", "vislielāk"]),
        ("jārakt", 4, ["rakt"]), ("rakt", 4, []), ("jā", 4, []), ("", 0, []), ("rakst", 18, []), ("rakst", 40, []), ("zņ", 1, []), ("kš", 1, ["kst", "ks", "kt"]),
    ],
)
def test_alternation_analysis(spark, stem, mija, found):
    assert [v for v, _, _ in forms(spark, "a", (stem, mija, *A))] == found


def test_alternation_generation(spark):
    assert [v for v, _, _ in forms(spark, "g", ("zaļ", 3, "", False, True))] == ["zaļ", "zaļāk", "viszaļāk"]
    assert [v for v, _, _ in forms(spark, "g", ("rakt", 4, *A))] == ["jārakt"]
    assert [v for v, _, _ in forms(spark, "g", ("kost", 7, "kod", False, False))] == ["kosti"]
    assert [v for v, _, _ in forms(spark, "g", ("lauž", 7, "lauz", False, False))] == ["lauz"]


@pytest.mark.parametrize(("direction", "mija", "pairs"), [("g", 160, [("mac", "moc"), ("mēc", "māc"), ("mic", "myc")]), ("a", 160, [("moc", "mac"), ("myc", "mic"), ("krs", "krs")])])
def test_latgalian_vowels(spark, direction, mija, pairs):
    rows = spark.createDataFrame(pairs, "stem string, wanted string").withColumn("got", alternation.vowel_changed(F.col("stem"), direction))
    assert all(r.wanted == r.got for r in rows.collect())


def test_latgalian_alternation(spark):
    assert [v for v, _, _ in forms(spark, "a", ("ej", 111, *A))] == ["ie"]
    assert [(v, d) for v, d, _ in forms(spark, "a", ("vysulobuok", 106, *A))] == [("lob", "Vispārākā")]
    assert [v for v, _, _ in forms(spark, "g", ("runuo", 111, *A))] == ["runuoj", "runov"]
    assert [v for v, _, _ in forms(spark, "g", ("lob", 103, "", False, True))] == ["lob", "lobuok", "vyslobuok", "vysulobuok"]
    assert [v for v, _, _ in forms(spark, "a", ("kul", 127, *A))] == ["kulē"]
    assert [v for v, _, _ in forms(spark, "g", ("kulē", 127, "", False, False))] == ["kuļ"]


def test_every_number_is_known():
    known = {*alternation.ANALYSIS, *alternation.REDIRECTS}
    assert len(alternation.ANALYSIS) == len(alternation.GENERATION) == 59 and len(alternation.REDIRECTS) == 20
    assert not known & {18, *range(39, 99)}


def test_bags(spark):
    row = spark.range(1).select(F.create_map(F.lit("Tips"), F.lit("Lietvārds|Vārds")).alias("b"))
    one = lambda c: row.select(c.alias("x")).first().x
    assert one(bags.strong(F.col("b"), "Tips", F.lit("LIETVĀRDS"))) and one(bags.strong(F.col("b"), "Tips", F.lit("vārds")))
    assert not one(bags.strong(F.col("b"), "Cits", F.lit("x"))) and one(bags.weak(F.col("b"), "Cits", F.lit("x")))
    assert one(bags.strong(F.col("b"), "Cits", F.lit(None).cast("string")))
    assert one(bags.to_json(bags.remove(bags.add(F.col("b"), "A", "1"), "Tips"))) == '{"A":"1"}'


@pytest.mark.parametrize(("token", "shape", "style"), [("Rīga", "Xx", "first"), ("2006.", "9.", "other"), ("LU-MII", "X.X", "upper"), ("abc12", "x9", "other"), ("A", "X", "upper"), ("aB", "xX", "other")])
def test_shapes(spark, token, shape, style):
    r = spark.createDataFrame([(token,)], "t string").select(text.shape(F.col("t")).alias("s"), text.case_style(F.col("t")).alias("c")).first()
    assert (r.s, r.c) == (shape, style)


def test_suffixes_leave_two_characters(spark):
    e = spark.createDataFrame([("",), ("s",), ("as",), ("j",)], "ending string")
    got = candidates.ending_matches(spark.createDataFrame([("mas",), ("ej",)], "token string"), e)
    assert sorted((r.token, r.ending) for r in got.collect()) == [("ej", ""), ("mas", ""), ("mas", "s")]


@pytest.fixture(scope="module")
def readings(spark):
    session.configure(spark)
    cat = seed.catalog(spark)
    words = "tēvu galdu rīgs lauks meži 12. zzz nerok aizrok tēviņš racējs vislielākais jārok un blarus Blars".split()
    return cat, session.cut(candidates.analyze(spark.createDataFrame([(w,) for w in words], "token string"), cat, seed.Settings(guessing=True)))


def test_analysis(readings):
    got = {}
    for r in readings[1].orderBy("token", "rank").collect():
        got.setdefault(r.token, []).append(r)
    assert [r.ending_id for r in got["tēvu"]] == [7, 4] and len(got["galdu"]) == 2
    assert got["rīgs"][0].attrs["Lietvārda tips"] == "Sugas vārds"
    assert "lauks" not in got
    assert {r.lemma for r in got["meži"]} == {"meža"}
    assert got["12."][0].lemma == "12." and "zzz" not in got
    assert got["nerok"][0].attrs["Noliegums"] == "Jā" and got["aizrok"][0].lemma == "aizrakt"
    assert got["racējs"][0].attrs["Avota pamatforma"] == "rakt"
    assert got["vislielākais"][0].attrs["Pakāpe"] == "Vispārākā"
    assert got["blarus"][0].ending_id == 9 and got["blarus"][0].lemma == "blars" and got["Blars"][0].lemma == "Blars"
    for rows in got.values():
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))


def test_inflect_and_analyse_agree(spark, readings):
    """Every form of a regular lemma has a reading with its own ending."""
    cat, _ = readings
    made = session.cut(generation.inflect(spark.createDataFrame([("tēvs",), ("māja",), ("liels",)], "lemma string"), cat))
    back = candidates.lexicon_readings(made.select(F.col("form").alias("token")).distinct(), cat)
    lost = made.join(back.select(F.col("token").alias("form"), "ending_id", "lexeme_id"), ["form", "ending_id", "lexeme_id"], "left_anti")
    assert lost.count() == 0


def test_tags_return(spark):
    cat = seed.catalog(spark)
    codes = [(1, "ncmsn1"), (2, "a_fsnys"), (3, "vmnipi13__n")]
    again = tags.to_tag(tags.from_tag(spark.createDataFrame(codes, "id int, tag string"), cat.tag_values), cat.tag_values)
    assert sorted((r.id, r.tag) for r in again.collect()) == codes


def test_viterbi(spark):
    got = viterbi.viterbi(*lattice(spark)).orderBy("pos").collect()
    assert [r.cand_idx for r in got] == [0, 1, 0]


def test_viterbi_is_optimal(spark):
    rng = random.Random(9)
    states = "abc"
    trans = {(p, c): -rng.random() * 5 for p in [*states, "<s>"] for c in states if rng.random() < 0.8} | {("<DEFAULT>", c): -6.0 for c in "ab"}
    lookup = lambda p, c: trans.get((p, c), trans.get(("<DEFAULT>", c), -10.0))
    rows, best = [], {}
    for d in range(12):
        sent = [[(rng.choice(states), -rng.random()) for _ in range(rng.randrange(1, 4))] for _ in range(4)]
        rows += [(d, 0, i, j, s, e) for i, c in enumerate(sent) for j, (s, e) in enumerate(c)]
        score = {}
        for path in itertools.product(*[range(len(c)) for c in sent]):
            v, prev = 0.0, "<s>"
            for c, j in zip(sent, path):
                v, prev = v + c[j][1] + viterbi.WEIGHT * lookup(prev, c[j][0]), c[j][0]
            score[path] = v
        best[d] = max(score, key=lambda p: score[p])
    t = spark.createDataFrame([(p, c, v) for (p, c), v in trans.items()], "prev string, cur string, logp double")
    df = spark.createDataFrame(rows, "doc_id bigint, sent_id int, pos int, cand_idx int, state string, emission double")
    got = {}
    for r in viterbi.viterbi(df, t).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.cand_idx)
    assert {d: tuple(p) for d, p in got.items()} == best


def test_prepositions(spark):
    rows = [(0, 0, 0, "uz", {"Vārdšķira": "Prievārds"}), (0, 0, 1, "?", None), (0, 0, 2, "un", {"Vārdšķira": "Saiklis"}), (0, 0, 3, "mājām", {"Skaitlis": "Daudzskaitlis"})]
    got = generation.prepositions_agree(spark.createDataFrame(rows, "doc_id int, sent_id int, pos int, token string, attrs map<string,string>")).orderBy("pos").first()
    assert got.attrs == {"Vārdšķira": "Prievārds", "Skaitlis": "Daudzskaitlis", "Rekcija": "Datīvs"}


def test_overrides_and_ties(spark):
    rows = spark.createDataFrame([("a", "x")] * 5 + [("b", "y"), ("b", "x")] + [("c", "x")], "k string, v string")
    assert sorted(tuple(r) for r in learning.majority(rows, "k", "v").collect()) == [("a", "x", 5, 5)]
    assert [r.k for r in learning.strong_overrides(rows, "k", "v").collect()] == ["a"]


def test_sources(spark, tmp_path):
    cat = seed.catalog(spark)
    tables.write_lexemes(cat.lexemes, str(tmp_path / "lex"))
    assert tables.lexemes(spark, str(tmp_path / "lex")).count() == len(seed.LEXEME_ROWS)
    (tmp_path / "p.json").write_text(json.dumps({"prefixes": [{"language": "lv", "negation": ["ne"], "debitive": [], "superlative": [], "verb": ["aiz", "aiz", "uz"]}], "paradigms": [{"id": 1, "name": "n", "language": "lv", "stems": 1, "lemma_ending_id": 1, "attributes": {"a": "b"}, "endings": [{"id": 1, "ending": "s", "stem_change": 0, "stem_id": 1, "attributes": {}}]}]}))
    p, e, x = tables.paradigms(spark, str(tmp_path / "p.json"))
    assert (p.count(), e.count(), x.count()) == (1, 1, 3)
    (tmp_path / "s.json").write_text('{"ending_frequencies":{"1":50},"lexeme_frequencies":{"7":2}}')
    assert tables.statistics(spark, str(tmp_path / "s.json"))[0].first() == (1, 50)
    (tmp_path / "o.json").write_text('{"iet":"i"}')
    assert tables.overrides(spark, str(tmp_path / "o.json")).first() == ("iet", "i")
    assert tables.overrides(spark, None).count() == 0
    (tmp_path / "c.txt").write_text("<s>\nEs\tp\tes\nir\tv\tbūt\tx\n</s>\n\n<g/>\nlost\tn\tlost\n<s>\nJā\tq\tjā\n</s>\n<s>\nopen\tn\topen\n")
    got = [tuple(r)[1:] for r in tables.corpus(spark, str(tmp_path / "c.txt")).orderBy("sent_id", "pos").collect()]
    assert got == [(1, 0, "Es", "p", "es"), (1, 1, "ir", "v", "būt"), (2, 0, "Jā", "q", "jā")]
    assert tables.corpus(spark, str(tmp_path / "c.txt"), sentences=False).count() == 5
    (tmp_path / "l.xml").write_text('<r><Lexeme ID="5" lemma="x" stem1="y" paradigm="1"><Attributes/></Lexeme><Lexeme ID="6" lemma="z" paradigm="1"/></r>')
    xml = tables.lexemes_from_xml(spark, str(tmp_path / "l.xml"), "x")
    both = tables.united([xml, cat.lexemes], cat.paradigms)
    assert xml.count() == 2 and {r.paradigm_name for r in both.where("source = 'x'").collect()} == {"noun-1a"}


def test_stream(spark, sf001, tmp_path):
    from lexiflow.operators import tokens as batch
    from lexiflow.streaming import tokens as streaming

    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text", F.timestamp_seconds("doc_id").alias("ts"))
    docs.write.parquet(str(tmp_path / "in"))
    q = streaming.counted(streaming.read(spark, str(tmp_path / "in"), "doc_id bigint, text string, ts timestamp")).writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    # the batch operator's tokens
    want = {r["token"]: r["count"] for r in batch.tokens(docs.withColumn("text", F.lower("text")), exact=False).groupBy("token").count().collect()}
    assert {r["token"]: r["n"] for r in spark.table("counted").groupBy("token").agg(F.sum("n").alias("n")).collect()} == want
