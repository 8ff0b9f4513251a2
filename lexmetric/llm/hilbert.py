"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a few bits each at cut points that
spread the rows evenly, the cell's index on the Hilbert curve orders the rows,
and the curve is cut into runs of equally many rows.  Neighbouring cells stay
in few files, so each file spans a narrow range of every column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmetric.llm.common import cut, partitions
from lexmetric.operators.sizing import broadcast_if_small

#: Bits per dimension (dimensions times bits is the curve's order; 3 * 4 = 4096 cells).
BITS = 4
#: Rows of a cell numbered in one task, about.
SLICE_ROWS = 100_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``cells`` (n x dimensions,
    values below 2**bits), by Skilling's public transposition method."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def as_text(column: Column) -> Column:
    """The whole value as text, a null before all others."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))


def text_cuts(docs: DataFrame, key: Column, shares: list[float]) -> list[str]:
    """Distinct values at which the rows in order of ``key`` (whole strings) reach
    the shares.  Values are counted and dealt by range; a total per partition and
    at most one value per share come to the driver."""
    counts = docs.groupBy(key.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = cut(counts.repartitionByRange(partitions(docs), "v").withColumn("p", F.spark_partition_id()))
    before, n = {}, 0
    for r in rows.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():
        before[r["p"]], n = n, n + r["n"]
    if not n:
        return []
    ahead = docs.sparkSession.createDataFrame(list(before.items()), "p int, ahead long")
    upto = F.col("ahead") + F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    reached = rows.join(F.broadcast(ahead), "p").select("v", "n", upto.alias("upto"))
    wanted = [F.lit(s * n) for s in shares]
    hit = F.exists(F.array(*wanted), lambda w: (w > F.col("upto") - F.col("n")) & (w <= F.col("upto")))
    return sorted((r[0] for r in reached.where(hit).select("v").collect()), key=lambda v: v.encode())


def curve(docs: DataFrame, dims, bits: int = BITS) -> Column:
    """The cell of a row on the curve.  ``dims`` are (column, type) pairs; nulls
    come before all values.  One pass finds the cut points of all numbers, one
    each those of a text: at most 2**bits - 1 values per dimension come to the driver.
    There are 2**(bits * dimensions) cells; more than 2**20 are refused."""
    if bits * len(dims) > 20:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits make more than 2**20 cells")
    shares = [i / 2 ** bits for i in range(1, 2 ** bits)]
    numeric = [isinstance(k, T.NumericType) for _, k in dims]
    keys = [F.coalesce(c.cast("double"), F.lit(-1.0)) if x else as_text(c) for (c, _), x in zip(dims, numeric, strict=True)]
    of_numbers = [F.percentile_approx(c, shares, 10_000) for c, x in zip(keys, numeric, strict=True) if x]
    found = iter(docs.agg(*of_numbers).first() if of_numbers else ())
    bins = []
    for c, x in zip(keys, numeric, strict=True):
        cuts = np.unique(next(found) or [0.0]).tolist() if x else text_cuts(docs, c, shares)
        bins.append(sum(((c > F.lit(q)).cast("int") for q in cuts), F.lit(0)))

    # The curve as a literal array, cell by cell: looked up where the row is read, without a Python worker.
    cells = np.array(list(np.ndindex(*[2 ** bits] * len(dims))), dtype=np.int64)
    at = F.lit(0)
    for b in bins:
        at = at * 2 ** bits + b
    return F.get(F.lit(hilbert_index(cells, bits)), at)


def placed(docs: DataFrame, cell: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, tie, cell) of every row; narrow from here on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(text).alias("tie"), cell.alias("cell"))


def positions(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, int]:
    """Distinct (doc_id, tie) with their copies and the first position in
    curve order; inside a cell a hash of id and text decides.  Returns the
    number of rows as well.

    No cell is numbered in one task: its hash range is cut into slices, slice
    counts are summed in a table of cells and slices."""
    one = rows.groupBy("cell", "doc_id", "tie", "size", "text_crc32").agg(
        F.count(F.lit(1)).alias("copies"))
    one = cut(one.withColumn("draw", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(2 ** 40))))
    # One row per cell: at most 2 ** (bits * dimensions).
    cells = one.groupBy("cell").agg(F.sum("copies").alias("n"))
    slices = cells.select("cell", (F.lit(1) + F.floor(F.col("n") / slice_rows)).alias("n_slices"))
    one = one.join(broadcast_if_small(cut(slices)), "cell").withColumn(
        "slice", F.floor(F.col("draw") * F.col("n_slices") / F.lit(2 ** 40)))
    totals = one.groupBy("cell", "slice").agg(F.sum("copies").alias("n"))
    # Ahead of a slice: the cells before (bounded table), then the slices before inside the cell.
    inside = totals.select("cell", "slice", F.coalesce(F.sum("n").over(
        Window.partitionBy("cell").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("in"))
    before = cells.select("cell", F.coalesce(F.sum("n").over(
        Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ahead = cut(inside.join(before, "cell").select("cell", "slice", (F.col("in") + F.col("before")).alias("ahead")))
    order = Window.partitionBy("cell", "slice").orderBy("draw", F.col("doc_id").asc_nulls_first(), "tie")
    n = int(totals.agg(F.sum("n")).first()[0] or 0)
    numbered = one.join(broadcast_if_small(ahead), ["cell", "slice"]).withColumn(
        "at", F.col("ahead") + F.coalesce(F.sum("copies").over(
            order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.select("doc_id", "tie", "size", "text_crc32", "cell", "copies", "at"), n


def metadata(docs: DataFrame) -> list[tuple[Column, T.DataType]]:
    """The dimensions used for documents: source, language and text length."""
    return [(F.col("source"), docs.schema["source"].dataType), (F.col("lang"), docs.schema["lang"].dataType),
            (F.length(F.coalesce(F.col("text"), F.lit(""))), T.LongType())]


def _run(at: Column, n: int, shards: int) -> list[Column]:
    """Shard and slot of a position: shard s starts at ceil(s * n / shards)."""
    starts = F.array(*[F.lit(-(-s * n // shards)).cast("long") for s in range(shards)])
    shard = F.size(F.filter(starts, lambda b: b <= at)) - 1
    return [shard.cast("int").alias("shard"), (at - F.get(starts, shard)).alias("slot")]


def assign(docs: DataFrame, dims=None, shards: int = 16, id_col: str = "doc_id",
           text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row: doc_id, size, text_crc32, cell, shard, slot.

    Null texts count as empty (size 1), null metadata sorts first, repeated
    rows take neighbouring slots, null ids sort among the rows of their cell,
    an empty table gives no rows; other columns are not read.  With fewer rows
    than shards some shards are empty.
    """
    cell = curve(docs, dims or metadata(docs), bits)
    one, n = positions(placed(docs, cell, id_col, text_col))
    each = one.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.withColumn("at", F.col("at") + F.col("k")).select(
        "doc_id", "size", "text_crc32", "cell", *_run(F.col("at"), n, shards))


def shard_rows(docs: DataFrame, dims=None, shards: int = 16, id_col: str = "doc_id",
               text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows themselves with shard and slot, ready for
    ``write.partitionBy("shard")``; input columns of those names are replaced.
    The texts move once, to meet their positions."""
    cell = curve(docs, dims or metadata(docs), bits)
    one, n = positions(placed(docs, cell, id_col, text_col))
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    ident = ["id", "tie", "cell"]
    plan = one.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), "tie", "cell", "at")
    # The row travels as one column, so its names cannot clash with ours.
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"),
                       F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), cell.alias("cell"))
    # Rows that agree in id, text and cell take their block of positions in any order of their other columns.
    number = F.row_number().over(Window.partitionBy(*ident).orderBy(F.xxhash64("row"))) - 1
    return rows.join(plan, ident).withColumn("pos", F.col("at") + number).select(
        "row.*", *_run(F.col("pos"), n, shards))
