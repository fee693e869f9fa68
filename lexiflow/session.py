"""Session settings and materialisation."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Bags are merged by last value."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """The table computed once, in the folder that spark.checkpoint.dir names; a local session without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().isDefined()):
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexiflow-"))
    return df.checkpoint(eager=True)


#: A table of fewer bytes than this, compressed, may lie in one row group, hence in one task.
SMALL, TINY = 24 << 20, 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan of a small table over all cores, however few row groups it has. Larger tables have tasks enough as they lie, and are never
    shuffled for this; tiny ones aren't worth it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if TINY < size < SMALL else df
