"""Tokens of a stream of documents: an extension; the rules are those of the batch operators' portable tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import portable_tokens, tokens


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def counted(docs: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """window, token, n of a stream of documents (doc_id, text and a time)."""
    rows = docs.withWatermark(time, late)
    got = rows.select(time, F.explode(portable_tokens(F.lower("text"))).alias("token"))
    return got.groupBy(F.window(time, window), "token").agg(F.count("*").alias("n"))


__all__ = ["counted", "read", "tokens"]
