"""The exact tokenizer against a character-level model of its automata."""

import random

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import tokens as tok
from lexiflow.operators.tokens import exact_tokens
from tests import token_model

PARTS = ["a", "b", "Ā", "Dz", "D", "12", "3", "2024", "-", ".", "..", "?", "!", ",", ":", "/", "''", " ", "  ", "\n", "@", "http://", "httpss://x", "www.", "lv", "LV", "_", "­", "plkst.", "u.c.", "etc", "Dr", "***", "’’", "é", "word", "longerword", "1 000", "20:15", "2009-12-14", "1.2.3.", "x y z", '"', "(", ")", "​", "ß", "€", "²", "½", "12,5", "7-", "1/2", "%", "&", "…"]


def compare(spark, rows, exceptions=()):
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    got = {r.id: r.t for r in df.select("id", exact_tokens(F.col("text"), exceptions).alias("t")).collect()}
    for i, text in enumerate(rows):
        assert (got[i] or []) == token_model.tokens(text, set(exceptions)), text


def test_golden():
    want = {"etc. un": ["etc.", "un"], "12.": ["12", "."], "12. decembris": ["12.", "decembris"], "U.S.A.": ["U.", "S.", "A", "."], "24:00": ["24", ":", "00"], "it's": ["it'", "s"], "a b vai": ["a b", "vai"], "x x x ": ["x x x"], "co­op": ["coop"], "": [], "  ": [], "100 000 000": ["100 000 000"], "5 m": ["5", "m"]}
    assert {t: token_model.tokens(t) for t in want} == want


def test_random_strings(spark):
    rng = random.Random(1)
    compare(spark, ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(20_000)])


def test_running_text(spark):
    rng = random.Random(2)
    words = ["word", "Other", "sentence", "of", "a", " ", " ", " ", ". ", ", ", "-", "12 ", " 'quoted' ", " 'two words' ", " it's ", '"', "(", ") ", "etc. ", "www.x.lv "]
    compare(spark, ["".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(5000)] + [None, "", " ", "x " * 50_000])


def test_exceptions(spark):
    rng = random.Random(3)
    own = ["New York", "longerword.", "ab cd.", "x-y"]
    words = ["New York", "new york", "New", "York", "longerword.", "longerword", "ab cd.", "ab", "cd.", "x-y", " ", ", ", ". ", "!"]
    compare(spark, ["".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(3000)], own)


@pytest.mark.parametrize("name", ["documents"])
def test_documents(spark, sf001, name):
    compare(spark, [r.text for r in spark.read.parquet(f"{sf001}/{name}.parquet").select("text").collect()])


def test_spread_small_scans(spark, sf001):
    from lexiflow.session import spread

    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert spread(big).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    tiny = spark.read.parquet(f"{sf001}/region.parquet")
    assert spread(tiny) is tiny and tok.tokens(tiny.select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"))).count() > 0


def test_white_space_is_skipped_and_marks_stand_alone():
    """No kind is tried at white space, and marks that begin none come early; not so where an exception begins with one."""
    from lexiflow.operators.tokens import pattern

    assert pattern().startswith("\\s*+(") and "[\\,\;" in pattern()
    assert not pattern([" x"]).startswith("\\s*+") and "\;" not in pattern([";)"]).split("]")[2]
