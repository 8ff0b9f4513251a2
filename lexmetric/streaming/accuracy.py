"""Running accuracy totals kept up to date as batches of results arrive.

A Structured Streaming aggregation (``groupBy(code).agg(sum, count)``) in
``complete`` mode.  Each micro-batch's totals go to a table in the shared
folder through ``foreachBatch`` (the state lives in the checkpoint, so a
restarted query resumes where it stopped); the caller reads the final table
back as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmetric.operators.metrics import OVERALL
from lexmetric.session import shared_dir


def stream_totals(stream: DataFrame, code: str = "code", ok: str = "ok",
                  partial: str | None = None) -> DataFrame:
    """The streaming aggregate: correct and total per code, and the ratio.

    With ``partial`` (a score per result, E4) also its sum and the number of
    results that have one.
    """
    scores = [F.sum(F.col(partial).cast("double")).alias("partial_sum"),
              F.count(partial).alias("partial_n")] if partial else []
    return (stream.groupBy(code)
            .agg(F.sum(F.col(ok).cast("long")).alias("n_correct"),
                 F.count(F.lit(1)).alias("n"), *scores)
            .withColumn("accuracy", F.col("n_correct") / F.col("n")))


def report_totals(totals: DataFrame, code: str = "code") -> DataFrame:
    """The running report: full and partial accuracy per code and overall.

    ``totals`` are ``stream_totals`` with a partial score.  The overall row
    (``is_overall``, key ``average``) is the sum of the rows per code, so the
    state holds nothing twice; a missing code is a group of its own.  Partial
    accuracy is null where no result has one.
    """
    g = totals.groupingSets([[code], []], code).agg(
        *[F.sum(c).alias(c) for c in ("n", "n_correct", "partial_sum", "partial_n")],
        F.grouping(code).alias("_g"))
    return g.select(
        F.when(F.col("_g") == 1, F.lit(OVERALL)).otherwise(F.col(code).cast("string")).alias("key"),
        (F.col("_g") == 1).alias("is_overall"), "n", "n_correct",
        (F.col("n_correct") / F.col("n")).alias("full"),
        F.try_divide("partial_sum", "partial_n").alias("partial"))


def stream_accuracy(spark: SparkSession, stream: DataFrame, code: str = "code", ok: str = "ok",
                    out_dir: str | None = None, checkpoint: str | None = None,
                    available_now: bool = True, history: bool = False, partial: str | None = None):
    """Run the totals to completion over what is available and return them.

    With ``partial`` the tables are ``report_totals``: full and partial
    accuracy per code and overall.

    With ``history`` also return the totals as they stood after every
    micro-batch (``batch_id`` = the stream's epoch), the running report the
    reference prints after each batch; a replayed epoch overwrites its own
    partition of that table, so it is written once however often it runs.

    Called again with the same ``out_dir``, the stream goes on where it
    stopped: results that arrived since are added to the totals kept in the
    checkpoint, and the history goes on with the next epoch.
    """
    base = out_dir or shared_dir(spark, "stream-accuracy")
    target = f"{base}/totals"
    trail = f"{base}/history"
    ckpt = checkpoint or f"{base}/_checkpoint"
    totals = stream_totals(stream, code, ok, partial)

    def report(df: DataFrame) -> DataFrame:
        return report_totals(df, code) if partial else df

    def publish(batch: DataFrame, epoch_id: int) -> None:
        table = report(batch)
        table.write.mode("overwrite").parquet(target)
        if history:   # one folder per epoch; the folder name carries batch_id
            table.write.mode("overwrite").parquet(f"{trail}/batch_id={epoch_id}")

    # A source with nothing in it publishes nothing: the tables exist, empty.
    nothing = spark.createDataFrame([], report(totals).schema)
    nothing.write.mode("ignore").parquet(target)
    if history:
        nothing.write.mode("ignore").parquet(f"{trail}/batch_id=-1")
    writer = (totals.writeStream.outputMode("complete")
              .option("checkpointLocation", ckpt).foreachBatch(publish))
    writer = writer.trigger(availableNow=True) if available_now else writer
    query = writer.start()
    query.awaitTermination()
    done = spark.read.parquet(target)
    if history:
        return done, spark.read.parquet(trail)
    return done
