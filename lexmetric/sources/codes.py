"""Sidecar category codes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmetric.functions.columns import strip_text
from lexmetric.sources.files import read_lines


def read_codes(spark: SparkSession, path: str, pos: str = "pos",
               code: str = "code") -> DataFrame | None:
    """The side file of codes, line k (from 0) the code of sample k.

    Lines are stripped.  Without a file there are no codes: ``None``, which
    ``attach_codes`` takes.  Numbered by scan split (A5), so no code is sorted.
    """
    try:
        spark.read.text(path).schema    # a missing path is known without a job
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return read_lines(spark, path, value=code, pos=pos).withColumn(code, strip_text(code))


def attach_codes(samples: DataFrame, codes: DataFrame | None, pos: str = "pos",
                 code: str = "code") -> DataFrame:
    """Category codes joined by sample position; no codes -> null code.

    A left join on ``pos``: AQE broadcasts the code table when its runtime
    size is under the broadcast threshold and otherwise shuffles both sides
    (a code table has one row per sample, so its size is not bounded).
    """
    if codes is None:
        return samples.withColumn(code, F.lit(None).cast("string"))
    return samples.join(codes.select(pos, code), pos, "left")
