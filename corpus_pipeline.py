"""The corpus pipeline: toxicity, quality rules, near duplicates, source mixing, then BPE tokens.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents. Labels come from the labels table of sf_dir; those of documents that an earlier stage dropped have no effect.

Defined results: those of the operators (see their modules). Mixing emits a document as often as it is drawn, and each
emission has its own row of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiflow.llm._spark import discard, rewritten, table
from lexiflow.llm.bpe import encoded
from lexiflow.llm.mixing import mixed
from lexiflow.llm.near_dup import deduplicated
from lexiflow.llm.quality import good_quality
from lexiflow.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a certified rule go."""
    return good_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, decoded again and compared."""
    return encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Toxicity's label model, near-duplicate groups and BPE are beyond SQL; tests hold run() against a brute-force version of all
#: five stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. Each one's result but the last is kept in the shared folder, until the next one's is there; that of
    the last but one stays, as what is returned reads it."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, new = rewritten(stage(spark, docs, sf_dir), name)
        if path:
            discard(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
