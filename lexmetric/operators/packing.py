"""Greedy packing of an ordered table into batches, in parallel.

Rows are in order of (bucket, length, key).  The next row joins the open batch
while the batch stays within its sentences and its padded tokens, so a batch's
end hangs on where it began.  Inside a chunk of the order every row therefore
points at the row that would begin the next batch, and following the pointers
(doubled until they leave the chunk) tells for each place how many batches
begin from there on and how full the last one is.  A chunk is then a table
from "rows the open batch already holds" to "batches begun, rows the open batch
holds at the end"; the tables of all chunks are strung together, and a second
pass numbers the rows.  No row limit cuts the packing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmetric.session import materialize


def next_starts(bucket: np.ndarray, length: np.ndarray, max_tokens: int, max_sentences: int) -> tuple[np.ndarray, np.ndarray]:
    """(next, entry): the row that begins the next batch if row i begins one, and the row
    that begins the first new batch if h rows of the first row's bucket are held already."""
    m = len(length)
    rows = np.arange(m)
    # The batch that holds row j last can begin at j + 1 - room at the earliest; in order of length that never falls.
    room = np.minimum(max_sentences, max_tokens // np.maximum(length, 1))
    earliest = rows + 1 - room
    following, entry = np.empty(m, dtype=np.int64), np.zeros(max_sentences + 1, dtype=np.int64)
    edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), m]
    for lo, hi in zip(edges, edges[1:]):
        at = rows[lo:hi]
        following[lo:hi] = np.maximum(at + 1, lo + np.searchsorted(earliest[lo:hi], at, side="right"))
    if m:
        entry[1:] = np.searchsorted(earliest[:edges[1]], -np.arange(1, max_sentences + 1), side="right")
    return following, entry


def follow(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begun, last) for a batch beginning at each row, and 0 and the end for the end: batches
    begun from there to the chunk's end, and where the last of them begins.  By pointer doubling."""
    m = len(following)
    to = np.append(following, m)
    begun = np.append(np.ones(m, dtype=np.int64), 0)
    last = np.arange(m + 1)
    while (to < m).any():
        begun = begun + np.where(to < m, begun[to], 0)
        last = np.where(to < m, last[to], last)
        to = to[to]
    return begun, last


def string_together(chunks: list) -> dict[int, tuple[int, int]]:
    """chunk -> (rows held by the batch open at its beginning, batches begun before it)."""
    out, held, begun, bucket = {}, 0, 0, None
    for c in sorted(chunks, key=lambda c: c["chunk"]):
        held = held if c["first_bucket"] == bucket else 0
        out[c["chunk"]] = (held, begun)
        held, begun, bucket = c["held"][held], begun + c["begun"][held], c["last_bucket"]
    return out


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    parts = list(frames)     # one chunk: a partition of narrow rows
    if parts:
        yield from pd.concat(parts, ignore_index=True).groupby("_chunk", sort=True)


def pack(df: DataFrame, bucket: Column, length: str, key: str, max_tokens: int, max_sentences: int,
         num_chunks: int | None = None) -> DataFrame:
    """(key, bucket, number) of every row: batches are numbered from 0 in each bucket.

    ``key`` must be unique; a null length counts as 0.  A row longer than
    ``max_tokens`` is a batch of its own.
    """
    n = num_chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(
        df.select(F.col(key).alias("key"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n"),
                  F.coalesce(bucket, F.lit(0)).alias("bucket"))
        .repartitionByRange(n, "bucket", "n", "key").sortWithinPartitions("bucket", "n", "key")
        .withColumn("_chunk", F.spark_partition_id()))

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, rows in _chunks(frames):
            m = len(rows)
            following, entry = next_starts(rows["bucket"].to_numpy(), rows["n"].to_numpy(), max_tokens, max_sentences)
            begun, last = follow(following)
            # With nothing begun here the open batch goes on through the whole chunk.
            held = np.where(entry < m, m - last[entry], np.arange(len(entry)) + m)
            yield pd.DataFrame({"chunk": [chunk], "first_bucket": [rows["bucket"].iloc[0]],
                                "last_bucket": [rows["bucket"].iloc[-1]], "held": [held], "begun": [begun[entry]]})

    tables = rows.mapInPandas(summarise, "chunk int, first_bucket int, last_bucket int, held array<long>, begun array<long>")
    # A row per chunk with max_sentences + 1 numbers twice: bounded by the partitions.
    entries = string_together(tables.collect())

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, rows in _chunks(frames):
            held, before = entries[chunk]
            m = len(rows)
            following, entry = next_starts(rows["bucket"].to_numpy(), rows["n"].to_numpy(), max_tokens, max_sentences)
            starts = np.zeros(m, dtype=np.int64)
            at = int(entry[held])
            while at < m:
                starts[at] = 1
                at = int(following[at])
            yield pd.DataFrame({"key": rows["key"], "bucket": rows["bucket"], "number": before + np.cumsum(starts) - 1})

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("bucket", T.IntegerType()),
                           T.StructField("number", T.LongType())])
    numbered = rows.select("key", "n", "bucket", "_chunk").mapInPandas(number, schema)
    # One row per bucket (64 at most): its first batch.
    first = numbered.groupBy("bucket").agg(F.min("number").alias("_first"))
    return numbered.join(F.broadcast(first), "bucket").select(
        F.col("key").alias(key), "bucket", (F.col("number") - F.col("_first")).alias("number"))
