"""Size checks before a broadcast.

A side is broadcast only after its size is measured: the row count and the
bytes of its columns (elements of arrays, maps and structs included) are summed by one small aggregate over that side (which
is itself an aggregated or checkpointed table wherever this is used).
Beyond the bound the join is left to the planner: a shuffle join, with
adaptive execution splitting skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_BYTES = 64 * 1024 * 1024


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """Bytes of one value: texts by length, arrays, maps and structs by their parts."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            inner = F.aggregate(value, F.lit(0).cast("long"),
                                lambda acc, x: acc + _bytes_of(x, kind.elementType))
        else:
            inner = F.size(value).cast("long") * 8
        return F.coalesce(inner, F.lit(0).cast("long")) + 16
    if isinstance(kind, T.MapType):
        return (_bytes_of(F.map_keys(value), T.ArrayType(kind.keyType))
                + _bytes_of(F.map_values(value), T.ArrayType(kind.valueType)))
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def estimated_bytes(df: DataFrame) -> int:
    """In-memory size, about: 16 bytes a row and the bytes of every field,
    nested ones by their elements."""
    total = F.lit(16).cast("long")
    for f in df.schema.fields:
        total = total + _bytes_of(F.col(f"`{f.name}`"), f.dataType)
    return int(df.select(total.alias("b")).agg(F.sum("b")).first()[0] or 0)


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when its measured size is at most ``max_bytes``."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df
