"""User functions (J1, J2): Arrow-batched, the predictor loaded once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def predict(df: DataFrame, make_fn: Callable[[], Callable[[list[str]], list[str]]],
            batch_size: int = 64, text: str = "text", keep: tuple[str, ...] = ("label",),
            key: str = "sample_id", out: str = "generated") -> DataFrame:
    """Run a user predictor over every sample; keep key, text, extras and
    the output.  ``make_fn()`` builds the predictor once per task (a model
    load); it receives lists of at most ``batch_size`` texts."""
    cols = [key, text, *keep]
    fields = [f for f in df.select(*cols).schema.fields]
    schema = T.StructType(fields + [T.StructField(out, T.StringType(), True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        for pdf in batches:
            outs: list[str] = []
            texts = pdf[text].tolist()
            for i in range(0, len(texts), batch_size):
                outs.extend(fn(texts[i:i + batch_size]))
            pdf = pdf.copy()
            pdf[out] = outs
            yield pdf

    return df.select(*cols).mapInPandas(run, schema)


def map_text(df: DataFrame, fn: Callable[[str], str], col: str = "text",
             out: str | None = None) -> DataFrame:
    """A user per-row text function (translator, romaniser) as an
    Arrow-batched pandas UDF; nulls pass through."""
    @F.pandas_udf(T.StringType())
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x))

    return df.withColumn(out or col, udf(F.col(col)))


def predict_numeric(df: DataFrame, make_fn, input_col: str, return_type=T.DoubleType(),
                    batch_size: int = 64, input_shape: list[int] | None = None,
                    out: str = "prediction") -> DataFrame:
    """J1 for numeric models: ``pyspark.ml.functions.predict_batch_udf``
    (Arrow batches; ``make_fn`` is called once per Python worker and returns
    a function from a numpy batch to a numpy batch)."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_fn, return_type=return_type, batch_size=batch_size,
                            input_tensor_shapes=[input_shape] if input_shape else None)
    return df.withColumn(out, udf(F.col(input_col)))
