"""Models that travel with the plan and models that are joined score alike."""

import random

from pyspark.sql import functions as F

from lexiflow.operators import models
from lexiflow.plans.queries import CATALOG
from tests.test_long_documents import shuffles


def test_scores_of_both_kinds(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["n", "v", "q", None]), [rng.randrange(60) for _ in range(rng.randrange(5))] if i % 7 else None) for i in range(200)]
    asked = spark.createDataFrame(rows, "id int, pos string, buckets array<int>")
    w = [(p, f"{p}{k}", b, rng.uniform(-2, 2)) for p in "nv" for k in range(3) for b in (-1, *rng.sample(range(50), 20))] + [("n", "n9", 3, 1.0), ("n", "n0", 3, 0.25)]
    own = spark.createDataFrame(w, "pos string, label string, bucket int, weight double")
    for weights, keys in ((own, ["id"]), (own, ["id", "pos"]), (own.where("pos = 'n'").drop("pos"), ["id", "pos"])):
        got = models.log_proba(asked, weights, keys)
        assert shuffles(got) == 0
        a, b = ({tuple(r)[:-1]: r.logp for r in x.collect()} for x in (got, models.joined_log_proba(asked, weights, keys)))
        assert a.keys() == b.keys() and a and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_emissions_without_a_shuffle(spark, sf001):
    assert shuffles(CATALOG["tag_emissions"][0](spark, sf001)) == 0


def test_best_labels_of_both_kinds(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 3 else "x", [i % 5, 7]) for i in range(50)], "id int, lang string, buckets array<int>")
    w = spark.createDataFrame([(name, b, float((k * 7 + b * 3) % 4)) for k, name in enumerate("cab") for b in range(-1, 9)], models.WEIGHTS)
    small = models.best_labels(rows, w, ["id", "lang"])
    assert shuffles(small) == 0
    monkeypatch.setattr(models, "DENSE", 5)
    assert {tuple(r) for r in small.select("id", "lang", "label", F.round("logp", 9)).collect()} == {tuple(r) for r in models.best_labels(rows, w, ["id", "lang"]).select("id", "lang", "label", F.round("logp", 9)).collect()}
