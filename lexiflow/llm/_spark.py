"""Session helpers of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Where it is unset, a temporary folder is set
    for a local session; elsewhere that is an error, since another machine could not read it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lexiflow-")
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The table computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def rewritten(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table written as Parquet to the shared folder and read again, void columns as strings; and its path."""
    path = scratch(df.sparkSession, name)
    df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"}).write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that rewritten() wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def reach(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the session was started; on a cluster the package has to
    be installed or sent along."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; also makes the package importable for the workers."""
    reach(spark)
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


def broadcast_if(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A broadcast hint only for a table counted to have at most `most` rows; else Spark joins as it sees fit."""
    return F.broadcast(df) if rows <= most else df


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like the given ones that clash with none of `taken`, whatever their case."""
    low = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        out.append(n)
        low.add(n.lower())
    return out


#: Words of 64 bits in the bitmap of may_hold().
BITMAP = 2**19


def may_hold(rows: DataFrame, ids: DataFrame, on: str = "doc_id") -> DataFrame:
    """The rows whose `on`, a bigint, may be among those of ids: all that are, and some others by chance. They are told by a bitmap of
    fixed size, which is broadcast, so nothing is shuffled before the filter."""
    bit, slot = f"shiftleft(1L, cast(xxhash64({on}) & 63 AS int))", f"pmod(shiftright(xxhash64({on}), 6), {BITMAP})"
    at, bits = fresh(rows.columns, "slot", "bits")
    bitmap = ids.groupBy(F.expr(slot).alias(at)).agg(F.bit_or(F.expr(bit)).alias(bits))
    return rows.where(F.col(on).isNotNull()).withColumn(at, F.expr(slot)).join(F.broadcast(bitmap), at).where(f"{bits} & {bit} != 0").drop(at, bits)
