"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmetric.session import materialize, prepare

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch: texts can be long, so a Python worker holds few at a time.
BATCH_ROWS = 256


def ready(spark: SparkSession) -> None:
    """The session's shared folder and package, and small Arrow batches."""
    prepare(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write a narrow frame to the shared checkpoint folder and go on from there."""
    ready(df.sparkSession)
    return materialize(df)


def settled(df: DataFrame) -> DataFrame:
    """``cut``, for frames behind large shuffles.  The files of its own shuffles go at
    once; those of other executions (a result written or counted before) Spark deletes
    when the driver's JVM collects the frames that made them, which a driver with
    little garbage may not do for a long time, so it is asked to."""
    out = cut(df)
    del df
    jvm = getattr(out.sparkSession, "_jvm", None)      # a remote session has none
    if jvm is not None:
        jvm.System.gc()
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
