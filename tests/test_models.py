"""Models and the Viterbi fold against enumeration, and the closed classes against written-out values."""

import itertools
import math
import random

from pyspark.sql import functions as F

from lexiflow.operators import closed, learning, models
from lexiflow.operators.viterbi import FLOOR, viterbi

KEYS = ["doc_id", "sent_id", "pos"]


def toy(spark, n=400):
    rng = random.Random(4)
    words = {"n": ["galds", "tēvs", "lauks"], "v": ["rakt", "skriet", "iet"], "a": ["liels", "sarkans"]}
    rows = []
    for i in range(n):
        label = rng.choice("nva")
        rows.append((i // 5, 0, i % 5, rng.choice(words[label]), label, label + rng.choice("12") if label != "a" else "a1"))
    return spark.createDataFrame(rows, "doc_id int, sent_id int, pos int, token string, label string, tag string")


def test_training_and_scoring(spark, tmp_path):
    rows = toy(spark)
    feats = models.buckets(learning.features(rows)).join(rows.select(*KEYS, "label", "tag"), KEYS)
    w = models.train(feats, "label", iterations=15)
    models.saved(w, str(tmp_path / "w"))
    w = models.loaded(spark, str(tmp_path / "w"))
    got = models.log_proba(feats, w, KEYS)
    sums = got.groupBy(*KEYS).agg(F.sum(F.exp("logp")).alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 400 and all(abs(r.s - 1) < 1e-9 and r.n == 3 for r in sums)
    best = models.best_labels(feats, w, KEYS).join(rows.withColumnRenamed("label", "gold"), KEYS)
    assert best.where("label = gold").count() >= 396
    # brute force of one row
    table = {(r.label, r.bucket): r.weight for r in w.collect()}
    one = feats.where("doc_id = 3 AND pos = 2").first()
    score = {v: table[v, -1] + sum(table.get((v, b), 0.0) for b in one.buckets) for v in "nva"}
    z = math.log(sum(math.exp(s) for s in score.values()))
    for r in got.where("doc_id = 3 AND pos = 2").collect():
        assert abs(r.logp - (score[r.label] - z)) < 1e-9
    none = feats.where("false")
    assert models.train(none, "label").count() == 0 and models.log_proba(none, w, KEYS).count() == 0
    assert models.train(feats.where("label = 'a'"), "label").count() == 1


def test_models_by_part_of_speech(spark):
    rows = toy(spark)
    feats = models.buckets(learning.features(rows)).join(rows.select(*KEYS, F.col("label").alias("of"), "tag"), KEYS)
    w = models.train_per_pos(feats.withColumnRenamed("of", "pos_"), "pos_", "tag", group_least=50, iterations=5)
    assert {r.pos for r in w.select("pos").distinct().collect()} == {"n", "v", "a"}
    asked = feats.select("doc_id", "sent_id", F.col("pos").alias("at"), F.col("of").alias("pos"), "buckets", "tag")
    got = models.log_proba(asked, w, ["doc_id", "sent_id", "at"])
    mine = got.join(asked.select("doc_id", "sent_id", "at", "pos"), ["doc_id", "sent_id", "at"])
    assert mine.where("left(label, 1) <> pos").count() == 0 and mine.where("label = 'a1' AND logp <> 0").count() == 0
    scored = models.score_tags(asked.select("doc_id", "sent_id", "at", "tag"), asked, w, ["doc_id", "sent_id", "at"])
    assert scored.where("logp IS NULL").count() == 0


def test_viterbi_by_enumeration(spark):
    rng = random.Random(5)
    states = ["A", "B", "C"]
    trans = {(p, c): round(rng.uniform(-5, 0), 3) for p in ["<s>", *states, "<DEFAULT>"] for c in states if rng.random() < 0.7}
    rows, want = [], set()
    for doc in range(30):
        places = [p for p in range(rng.randint(1, 7)) if rng.random() < 0.85]
        lattice = {p: [(i, rng.choice(states), round(rng.uniform(-3, 0), 3)) for i in range(rng.randint(1, 4))] for p in places}
        rows += [(doc, 0, p, i, s, e) for p, c in lattice.items() for i, s, e in c]
        chance = lambda p, c: trans.get((p, c), trans.get(("<DEFAULT>", c), FLOOR))
        runs = [list(g) for _, g in itertools.groupby(places, key=lambda p, it=itertools.count(): p - next(it))]
        for run in runs:
            best = None
            for path in itertools.product(*(lattice[p] for p in run)):
                v = sum(e for _, _, e in path) + 0.5 * sum(chance(a[1], b[1]) for a, b in itertools.pairwise(path))
                v += 0.5 * chance("<s>", path[0][1]) if run[0] == 0 else 0
                if best is None or v > best[0] + 1e-9:
                    best = (v, path)
            want |= {(doc, 0, p, c[0]) for p, c in zip(run, best[1])}
    df = spark.createDataFrame(rows, "doc_id int, sent_id int, pos int, cand_idx int, state string, emission double")
    table = spark.createDataFrame([(p, c, v) for (p, c), v in trans.items()], "prev string, cur string, logp double")
    assert {tuple(r) for r in viterbi(df, table, 0.5).select("doc_id", "sent_id", "pos", "cand_idx").collect()} == want


def test_sequences_and_emission_tiers(spark):
    rows = toy(spark, 60)
    feats = models.buckets(learning.features(rows)).join(rows.select(*KEYS, "label"), KEYS)
    w = models.train(feats, "label", iterations=15)
    flat = spark.createDataFrame([("<DEFAULT>", v, 0.0) for v in "nva"], "prev string, cur string, logp double")
    alone = {tuple(r) for r in models.best_labels(feats, w, KEYS).select(*KEYS, "label").collect()}
    assert {tuple(r) for r in models.label_sequences(feats, w, flat).collect()} == alone
    candidates = spark.createDataFrame([(1, 0, 0, i, t) for i, t in enumerate(["nc", "ncm", "v", "x"])], "doc_id int, sent_id int, pos int, cand_idx int, tag string")
    one = lambda label: spark.createDataFrame([(1, 0, 0, label)], "doc_id int, sent_id int, pos int, label string")
    tags = spark.createDataFrame([(1, 0, 0, "nc", -0.5)], "doc_id int, sent_id int, pos int, tag string, logp double")
    got = {r.tag: r.emission for r in models.rescored(candidates, tags, one("nc"), one("v")).collect()}
    assert got == {"nc": -0.5, "ncm": -9.8, "v": -100.0, "x": -1000.0}


def test_pronouns(spark):
    assert len(closed.pronoun_rows()) == 68 and len(closed.ending_rows()) == 24
    rows = [("Manī", "es", 1, {"Vārdšķira": "Vietniekvārds", "Skaitlis": "Nepiemīt"}), ("savām", "savs", 1, {"Vārdšķira": "Vietniekvārds", "Locījums": "Datīvs"}), ("nekas", "nekas", 1, {"Vārdšķira": "Vietniekvārds", "Noliegums": "Nē"}), ("es", "es", None, {"Vārdšķira": "Vietniekvārds"}), ("tu", "tu", 1, {"Vārdšķira": "Lietvārds"}), ("to", "tā", 1, {"Vārdšķira": "Vietniekvārds", "Dzimte": "Vīriešu"})]
    got = [r.attrs for r in closed.with_pronouns(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, token string, lemma string, lexeme_id bigint, attrs map<string,string>")).orderBy("i").collect()]
    assert got[0] == {"Vārdšķira": "Vietniekvārds", "Persona": "1", "Skaitlis": "Vienskaitlis"}
    assert got[1]["Dzimte"] == "Sieviešu" and got[1]["Skaitlis"] == "Daudzskaitlis" and "Persona" not in got[1]
    assert got[2]["Noliegums"] == "Jā" and got[3] == rows[3][3] and got[4] == rows[4][3]
    assert got[5] == {"Vārdšķira": "Vietniekvārds", "Dzimte": "Vīriešu", "Persona": "3"}
