"""What depends on a document's other tokens is found in its row: no shuffle of tokens, and time in proportion to the document."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import learning, tokens
from lexiflow.plans.queries import CATALOG
from tests.oracle import compare

#: No text, no tokens, no words, one token, glued marks, a closer at the cap and around it.
TEXTS = [None, "", " \n ", "... ?! 12", "Vārds", 'A b. "C" (d). ") e!") f', ". ) \" ! \" \" ) ) x", "a" + " b" * 249 + ". \" c", "a" + " b" * 250 + ".) c", "a" + " b" * 251 + ". d" + " e" * 600, "ΔΑ ǅa Ⅷ a-b it's ½ 1,5.5 😀 ß"]


def documents(spark, path, texts, langs=("en", "lv", None)):
    rows = [(i, t, langs[i % len(langs)], "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def shuffles(df) -> int:
    """Exchanges of the plan, but for the one that spreads a small scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange ") - plan.count("REPARTITION_BY_NUM")


def test_next_nontrivial(spark, sf001, tmp_path):
    query, sql = CATALOG["next_nontrivial"]
    d = documents(spark, tmp_path, TEXTS)
    assert compare(spark, "next_nontrivial", query, sql, d) > 1000
    assert shuffles(query(spark, sf001)) == 0
    # quadratic, this took minutes: no word but the last
    d = documents(spark, tmp_path / "long", ["1 . " * 100_000 + "x"])
    began = time.time()
    assert query(spark, d).where("next_word = 'x'").count() == 200_000
    assert time.time() - began < 30


@pytest.mark.parametrize("name,most", [("sentence_split", 0), ("context_features", 0), ("accuracy_by_run", 1), ("bigram_logprob", None), ("bigram_backoff", None), ("beam_top8", 1)])
def test_in_rows(spark, sf001, tmp_path, name, most):
    """The same as SQL on odd texts; tokens are not shuffled."""
    query, sql = CATALOG[name]
    d = documents(spark, tmp_path, TEXTS)
    assert compare(spark, name, query, sql, d) > 0
    if most is not None:
        assert shuffles(query(spark, sf001)) == most


def test_counts_of_documents_in_several_rows(spark, tmp_path):
    """beam_top8 counts a document's rows together."""
    query, sql = CATALOG["beam_top8"]
    rows = [(1, "b a a c d e f g h i j"), (1, "j j b I"), (None, "x y"), (None, "y"), (2, None)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert compare(spark, "beam_top8", query, sql, str(tmp_path)) == 10


def test_features_of_arrays_and_of_tables(spark):
    """Lower case and shapes of lines are those of tokens, whatever letters do at the end of a word."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "ΑΣ ΣΑΣ. Σ İx Aİ ΑΣ'Α ΑΣ-Β é ́ x"])], "doc_id int, text string")
    wide = learning.features(tokens.tokens(docs, exact=False).withColumn("sent_id", F.lit(0))).drop("sent_id")
    mine = learning.array_features(tokens.token_arrays(docs, "doc_id", exact=False), "doc_id").select(wide.columns)
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, wide.collect()))


def test_sentences_of_arrays_and_of_tables(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(['"', ")", ".", "!", "...", "?!", "a", "b"]) for _ in range(rng.randrange(60)))) for i in range(300)], "doc_id int, text string")
    for cap in (1, 3, 250):
        rows = docs.select("doc_id", F.split("text", " ").alias("tokens"))
        mine = rows.select("doc_id", F.posexplode(tokens.sentence_numbers("tokens", cap)).alias("pos", "sent_id"))
        wide = tokens.sentences(rows.select("doc_id", F.posexplode("tokens").alias("pos", "token")), cap).select("doc_id", "pos", "sent_id")
        assert sorted(mine.collect()) == sorted(wide.collect())
