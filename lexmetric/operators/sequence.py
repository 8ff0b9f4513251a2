"""Order as data: dense positions and running aggregates that scale.

A DataFrame has no row order, yet the reference's data is defined by it
(sample position, batch order, step order).  Two primitives carry that:

* ``with_position`` (D4): a dense 0-based position along an explicit order.
  It never uses one global ``Window.orderBy`` (which moves every row into a
  single task).  Rows are range-partitioned on the order, numbered inside each
  partition, and shifted by the row counts of the earlier partitions.  The
  count table has one row per partition, so broadcasting it is size-bounded.

* ``running`` : running sum / count / min / max along an order inside groups.
  A hot group (say a third of all rows) is split into ordered chunks by range
  partitioning on (group, order); each chunk is scanned locally and then
  shifted by the totals of the chunks before it, so no task ever holds a
  whole group, at any size.  ``strategy="window"`` is the plain window, for
  callers whose groups are bounded by contract (a beam, a batch).

Both read their range-partitioned, chunk-tagged frame twice (rows and
per-chunk totals).  That frame is checkpointed once into the shared
checkpoint folder: recomputing it could number chunks differently (adaptive
execution may coalesce the upstream differently per branch) and in-task row
ids are only stable for one computation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmetric.session import materialize

_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _names(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def _order_cols(order) -> list[Column]:
    if isinstance(order, (str, Column)):
        order = [order]
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _default_chunks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_position(df: DataFrame, order, name: str = "pos",
                  num_partitions: int | None = None) -> DataFrame:
    """Dense 0-based position along ``order`` (which must be unique).

    Equal to ``row_number() OVER (ORDER BY order) - 1`` but computed with a
    range shuffle plus a per-partition count, never a single-partition window.
    """
    order_cols = _order_cols(order)
    n = num_partitions or _default_chunks(df)
    tagged = materialize(
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_chunk", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    counts = tagged.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_chunk",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
    )
    local = F.col("_mid") - F.shiftleft(F.col("_chunk").cast("long"), 33)
    return (
        tagged.join(F.broadcast(offsets), "_chunk")
        .withColumn(name, F.col("_off") + local)
        .drop("_chunk", "_mid", "_off")
    )


def running(df: DataFrame, by, order, aggs: dict[str, tuple[str, str | Column]],
            exclusive: bool = False, strategy: str = "chunked",
            num_chunks: int | None = None) -> DataFrame:
    """Running aggregates along ``order`` within ``by`` groups.

    ``aggs`` maps an output name to ``(kind, column)`` with kind in
    sum / count / min / max, or ``lag`` (the value of the previous row, null
    on the first row of a group).  Inclusive of the current row unless
    ``exclusive`` (then the rows strictly before it; null when there are none,
    0 for count).  ``order`` must be unique within a group.

    ``strategy`` is ``chunked`` (any group size) or ``window`` (a group must
    fit a task); the caller decides, the data's size does not.
    """
    by_names = _names(by)
    order_cols = _order_cols(order)
    end = -1 if exclusive else 0
    specs = {out: (kind, F.col(c) if isinstance(c, str) else c) for out, (kind, c) in aggs.items()}
    if strategy not in ("chunked", "window"):
        raise ValueError(f"unknown strategy {strategy!r}")

    if strategy == "window":
        w_ord = (Window.partitionBy(*by_names) if by_names else Window.partitionBy()) \
            .orderBy(*order_cols)
        w = w_ord.rowsBetween(Window.unboundedPreceding, end)
        out = df
        for name, (kind, c) in specs.items():
            agg = F.lag(c, 1).over(w_ord) if kind == "lag" else _AGG[kind](c).over(w)
            out = out.withColumn(name, agg)
        return out

    n = num_chunks or _default_chunks(df)
    by_cols = [F.col(b) for b in by_names]
    ranged = materialize(df.repartitionByRange(n, *by_cols, *order_cols).withColumn(
        "_chunk", F.spark_partition_id()))
    w_local_ord = Window.partitionBy("_chunk", *by_names).orderBy(*order_cols)
    w_local = w_local_ord.rowsBetween(Window.unboundedPreceding, end)
    local = (ranged.withColumn("_rn", F.row_number().over(w_local_ord))
             .withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy("_chunk", *by_names))))
    for name, (kind, c) in specs.items():
        agg = F.lag(c, 1).over(w_local_ord) if kind == "lag" else _AGG[kind](c).over(w_local)
        local = local.withColumn(f"_l_{name}", agg)

    def chunk_total(kind: str, c: Column) -> Column:
        if kind == "lag":   # the value on the chunk's last row of the group
            return F.max(F.when(F.col("_rn") == F.col("_cnt"), c))
        return _AGG[kind](c)

    # One row per (chunk, group); the rows of a chunk are read from the same
    # checkpoint as ``local``, so both agree on every chunk number.
    totals = local.groupBy("_chunk", *by_names).agg(
        *[chunk_total(kind, c).alias(f"_t_{name}") for name, (kind, c) in specs.items()])
    w_prev = (Window.partitionBy(*by_names) if by_names else Window.partitionBy()) \
        .orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    prev_kind = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "lag": F.last}
    offsets = totals.select(
        F.col("_chunk").alias("_o_chunk"),
        *[F.col(b).alias(f"_o_{b}") for b in by_names],
        *[prev_kind[kind](f"_t_{name}").over(w_prev).alias(f"_o_{name}")
          for name, (kind, _) in specs.items()],
    )
    cond = F.col("_chunk") == F.col("_o_chunk")
    for b in by_names:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_o_{b}"))
    joined = local.join(offsets, cond, "left")
    for name, (kind, _) in specs.items():
        lc, oc = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        if kind in ("sum", "count"):
            val = F.coalesce(lc, F.lit(0)) + F.coalesce(oc, F.lit(0))
            if kind == "sum":
                val = F.when(lc.isNull() & oc.isNull(), F.lit(None)).otherwise(val)
        elif kind == "lag":
            val = F.when(F.col("_rn") == 1, oc).otherwise(lc)
        elif kind == "min":
            val = F.least(lc, oc)
        else:
            val = F.greatest(lc, oc)
        joined = joined.withColumn(name, val)
    drop = ["_chunk", "_o_chunk", "_rn", "_cnt"] + [f"_o_{b}" for b in by_names]
    drop += [f"_l_{n_}" for n_ in specs] + [f"_o_{n_}" for n_ in specs]
    return joined.drop(*drop)


def row_number_in_group(df: DataFrame, by, order, name: str = "rank",
                        strategy: str = "chunked") -> DataFrame:
    """1-based row number within ``by`` along ``order`` (a running count)."""
    return running(df, by, order, {name: ("count", F.lit(1))}, strategy=strategy)


def group_top_k(df: DataFrame, by: Sequence[str] | str, order, k: int,
                name: str = "rank") -> DataFrame:
    """First ``k`` rows per group along ``order``, with their 1-based rank.

    ``row_number() <= k`` is planned as a ``WindowGroupLimit``: each map task
    keeps only its own top ``k`` per group before the shuffle, so a hot group
    ships at most ``k`` rows per input partition.
    """
    w = Window.partitionBy(*_names(by)).orderBy(*_order_cols(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
