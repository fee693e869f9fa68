"""Operator 7: mixing sources to target weights by systematic sampling.

A source that holds `size` of the table's `total` characters and should make up a share `weight` of a mixture as long as
the table expects weight * total / size copies of each of its documents. The expected copies are summed along the source's
documents, one random offset in [0, 1) is added, and a document is emitted once for each integer that its stretch of the
running sum crosses. So a source of n documents gives its expected number of copies rounded up or down, whatever n is,
and no document's count is off by one or more.

Cost at scale. A source is cut into blocks by a hash of doc_id (of the text, where that is null), as many as keep a block of even one
single source below ROWS rows; sums of blocks are added up along the blocks, and the running sum within a block starts from them: no
source, however hot, is sorted in one task. Sums are integers (fixed point, 2 ** 20 to a copy), so they are exact in any order.

Defined results: the order within a source is by block, doc_id, n_chars and text, nulls first; rows equal in all of these
share their copies whichever comes first. A null source is the source ''. A null text has length 0. A source of no characters
has no weight and gives no rows. A document is expected max_epochs times at most: a source too small for its weight falls short of it
rather than being repeated without end. Sources missing from explicit targets get none; targets of absent sources
are ignored and the rest is scaled to 1. Further columns of any name are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import broadcast_if, cut, fresh, table

#: Without explicit targets a source's weight goes with the square root of its size. Blocks at least; rows a block, about; expected
#: copies of a document at most.
BLOCKS, ROWS, SEED, ONE, MAX_EPOCHS = 1024, 1 << 16, "mix-1", 1 << 20, 16.0


def _source() -> Column:
    return F.coalesce("source", F.lit(""))


def _block(blocks: int) -> Column:
    by = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return F.conv(F.substring(F.md5(by), 1, 8), 16, 10).cast("long") % blocks


def _blocks(docs: DataFrame) -> int:
    return max(BLOCKS, -(-docs.count() // ROWS))


def rates(docs: DataFrame, targets: Mapping[str, float] | None = None, blocks: int = BLOCKS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, block, rate (expected copies of a document, fixed point) and before (the running sum where the block begins,
    offset included): a row for each source and block."""
    size = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("size")
    cells = cut(docs.select(_source().alias("source"), _block(blocks).alias("block"), "text").groupBy("source", "block").agg(F.count("*").alias("n"), size))
    sources = cells.groupBy("source").agg(F.sum("size").cast("double").alias("size"))
    if targets is None:
        weight = F.sqrt("size")
    else:
        weight = F.lit(0.0)
        for s, w in targets.items():
            weight = F.when(F.col("source") == s, float(w)).otherwise(weight)
    sources = sources.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    # sources times blocks is what there is of cells; sums over all sources are two numbers
    whole = sources.agg(F.sum("size").alias("total"), F.sum("weight").alias("weights"))
    offset = F.conv(F.substring(F.md5(F.concat("source", F.lit("|" + SEED))), 1, 5), 16, 10).cast("long")
    copies = F.when(F.col("weight") > 0, F.least(F.col("weight") / F.col("weights") * F.col("total") / F.col("size"), F.lit(float(max_epochs)))).otherwise(0.0)
    per = sources.crossJoin(whole).select("source", F.floor(copies * ONE).cast("long").alias("rate"), offset.alias("offset"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(per, "source").select("source", "block", "rate", (F.col("offset") + F.col("rate") * F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("before"))


def mixed(docs: DataFrame, targets: Mapping[str, float] | None = None, blocks: int | None = None, copy_column: str | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The rows of docs, each as often as it is drawn; copy_column, if named, numbers a row's copies from 1."""
    blocks = blocks or _blocks(docs)
    per = cut(rates(docs, targets, blocks, max_epochs))
    src, block, at, rate, before, copies, n = fresh(docs.columns, "src", "block", "at", "rate", "before", "copies", copy_column or "copy")
    per = per.toDF(src, block, rate, before)
    order = Window.partitionBy(src, block).orderBy("doc_id", "n_chars", "text")
    rows = docs.withColumns({src: _source(), block: _block(blocks)}).withColumn(at, F.row_number().over(order).cast("long"))
    end = F.col(before) + F.col(rate) * F.col(at)
    drawn = rows.join(broadcast_if(per, per.count()), [src, block]).withColumn(copies, (F.floor(end / ONE) - F.floor((end - F.col(rate)) / ONE)).cast("int"))
    out = drawn.where(F.col(copies) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*docs.columns, *([F.col(n).alias(copy_column)] if copy_column else []))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to square-root weights: every column, and copy_no."""
    return mixed(table(spark, sf_dir, "documents"), copy_column="copy_no")


SQL = f"""
WITH blocks_ AS (SELECT greatest({BLOCKS}, (count(*) + {ROWS - 1}) // {ROWS}) AS blocks FROM documents),
d AS (SELECT documents.*, coalesce(source, '') AS src, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT % blocks AS block FROM documents, blocks_),
cells AS (SELECT src, block, count(*) AS n, sum(coalesce(length(text), 0)) AS size FROM d GROUP BY ALL),
sources AS (SELECT src, sum(size)::DOUBLE AS size, sqrt(sum(size)::DOUBLE) AS weight FROM cells GROUP BY src),
whole AS (SELECT sum(size) AS total, sum(weight) AS weights FROM sources),
per AS (SELECT src, CASE WHEN weight > 0 THEN floor(least(weight / weights * total / size, {MAX_EPOCHS}) * {ONE})::BIGINT ELSE 0 END AS rate, ('0x' || substr(md5(src || '|{SEED}'), 1, 5))::BIGINT AS u FROM sources, whole),
blocks AS (SELECT src, block, rate, u + rate * coalesce(sum(n) OVER (PARTITION BY src ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM cells JOIN per USING (src)),
spot AS (SELECT d.*, rate, b + rate * row_number() OVER (PARTITION BY src, block ORDER BY doc_id NULLS FIRST, n_chars NULLS FIRST, text NULLS FIRST) AS e FROM d JOIN blocks USING (src, block)),
drawn AS (SELECT *, (e // {ONE} - (e - rate) // {ONE})::INT AS copies FROM spot)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INT AS copy_no FROM drawn WHERE copies > 0"""
