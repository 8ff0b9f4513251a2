"""Lookups of exploded keys (tokens, ids) in a table.

A table of measured small size is broadcast.  Beyond that the join shuffles by
key, and a key that stands for a good part of all rows would fill one task.  A
frequent-items sketch over the rows finds such keys (every key with more than
1 / HOT of the rows is among the ``HOT`` it names); their few table rows are
broadcast, and in the shuffle join the rows of hot keys are dealt by a salt
instead of their key.  Which keys the sketch names decides where rows go and
never what they find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmetric.operators.sizing import DEFAULT_MAX_BYTES, estimated_bytes
from lexmetric.session import materialize

#: Hot keys at most, and counters of the sketch (its error is 3.5 / TRACKED of all rows).
HOT, TRACKED = 1000, 2 ** 16
#: Parts the rows of hot keys are dealt to.
SALTS = 2 ** 16


def hot_keys(rows: DataFrame, on: str, hot: int = HOT) -> DataFrame:
    """(key): the most frequent values of ``on``, at most ``hot`` of them."""
    named = rows.where(F.col(on).isNotNull()).agg(F.expr(f"approx_top_k({on}, {hot}, {TRACKED})").alias("_top"))
    return named.select(F.explode("_top").alias("_item")).select(F.col("_item.item").alias(on))


def lookup(rows: DataFrame, table: DataFrame, on: str, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """``rows`` left-joined to ``table`` (unique in ``on``) without gathering the rows of a hot key."""
    cols = [c for c in table.columns if c != on]
    if estimated_bytes(table) <= max_bytes:
        return rows.join(F.broadcast(table), on, "left").select(*rows.columns, *cols)
    known = materialize(hot_keys(rows, on).join(table, on))      # HOT rows at most
    known = known.select(F.col(on).alias("_hot"), F.struct(*cols).alias("_known"))
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)) + 1
    dealt = rows.join(F.broadcast(known), F.col(on) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull() | F.col(on).isNull(), spread).otherwise(F.lit(0)))
    rest = table.select(F.col(on).alias("_cold"), F.struct(*cols).alias("_found"), F.lit(0).cast("long").alias("_zero"))
    # The salt keeps hot and null keys apart; no table row bears one.
    joined = dealt.join(rest.hint("shuffle_merge"),
                        (F.col(on) == F.col("_cold")) & (F.col("_salt") == F.col("_zero")), "left")
    got = F.coalesce("_known", "_found")
    return joined.select(*rows.columns, *[got[c].alias(c) for c in cols])
