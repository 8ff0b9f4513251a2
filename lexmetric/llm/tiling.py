"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents become token hash sequences.  Seeds (hashes of
``min_match`` tokens in a row) that a document shares with an item make a
candidate pair; running Karp-Rabin then marks the longest unmarked common runs
again and again until none of ``min_match`` tokens is left.  The share of an
item's tokens that lie in tiles is its coverage, whatever the tiles' order.

Every document is tiled where it is read, so nothing of the documents is
shuffled and no passage, however common, gathers anywhere.  The benchmark is a
query set: it travels in blocks of at most ``block_tokens`` tokens, and a
larger benchmark takes more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least run of tokens that counts as a tile.
MIN_MATCH = 5
#: Share of an item's tokens in tiles from which a document is contaminated.
COVERAGE = 0.5
#: Tokens of benchmark items sent along at a time (8 bytes each, plus seeds).
BLOCK_TOKENS = 2_000_000
#: Bytes of text worked on at a time in a task.
CHUNK_BYTES = 1 << 20

_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_UNMIX = np.uint64(pow(int(_MIX), -1, 1 << 64))
_WORDBYTE = np.ones(256, dtype=bool)
for _c in range(128):
    _WORDBYTE[_c] = chr(_c).isalnum()


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, index of each text's first token, one more at the end).

    Tokens are runs of letters and digits (any byte outside ASCII counts as a
    letter), lower-cased.  A token's hash is the sum of its bytes times powers
    of a prime counted from its end, mixed."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends_of_text = np.cumsum([len(r) + 1 for r in raw])
    word = _WORDBYTE[data]
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    length = end - start
    within = np.flatnonzero(word)
    from_end = np.repeat(end, length) - within - 1
    value = (data[within].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()), _PRIME)[from_end]
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    h = np.add.reduceat(value, first)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    h ^= h >> np.uint64(32)
    return h, np.concatenate(([0], np.searchsorted(start, ends_of_text)))


def window_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``k`` tokens (by its first token)."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _MIX + tokens[i:i + n]
    return out ^ (out >> np.uint64(31))


class Rolling:
    """Hashes of the runs of any length of one sequence: sums of tokens times
    powers of an odd number, so a run is a difference of two sums, shifted."""

    def __init__(self, tokens: np.ndarray):
        powers = _powers(len(tokens) + 1, _MIX)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(tokens * powers[:-1], dtype=np.uint64)))
        self.back = _powers(len(tokens) + 1, _UNMIX)

    def at(self, first: np.ndarray, k: int) -> np.ndarray:
        return (self.sums[first + k] - self.sums[first]) * self.back[first]


def _among(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of ``many`` are among ``few``; only the few are sorted."""
    if not len(few):
        return np.zeros(len(many), dtype=bool)
    few = np.sort(few)
    return few[np.minimum(np.searchsorted(few, many), len(few) - 1)] == many


def _streak(at: np.ndarray) -> int:
    """Length of the longest run of neighbouring positions."""
    if not len(at):
        return 0
    breaks = np.flatnonzero(np.diff(at) != 1) + 1
    return int(np.diff(np.concatenate(([0], breaks, [len(at)]))).max())


def tile(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (item position, document position, length), longest first, ties by
    item then document position.

    The longest unmarked common run is found by halving (a run of some length
    holds runs of every smaller one); all runs of that length are then marked
    in order.  Positions that hold the same run are walked once, by a pointer
    over those already marked, so repeated words cost no pairs.  Only positions
    where a run of ``min_match`` tokens is shared are looked at."""
    if min(len(item), len(doc)) < min_match:
        return []
    a_mark, b_mark = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)
    a_roll, b_roll = Rolling(item), Rolling(doc)
    tiles: list[tuple[int, int, int]] = []
    a_all, b_all = np.arange(len(item) - min_match + 1), np.arange(len(doc) - min_match + 1)
    ah, bh = a_roll.at(a_all, min_match), b_roll.at(b_all, min_match)
    b_hit = _among(ah, bh)
    a_seed, b_seed = a_all[np.isin(ah, bh[b_hit])], b_all[b_hit]

    def free(seed: np.ndarray, mark: np.ndarray, size: int) -> np.ndarray:
        seed = seed[seed + size <= len(mark)]
        total = np.concatenate(([0], np.cumsum(mark)))
        return seed[total[seed + size] == total[seed]]

    def runs(size: int):
        a_at, b_at = free(a_seed, a_mark, size), free(b_seed, b_mark, size)
        ah, bh = a_roll.at(a_at, size), b_roll.at(b_at, size)
        return a_at, ah, b_at, bh, np.isin(ah, bh)

    most = min(_streak(a_seed), _streak(b_seed)) + min_match - 1
    while most >= min_match:
        low, high = min_match - 1, most     # the longest run lies in low..high
        while low < high:
            size = (low + high + 1) // 2
            if runs(size)[4].any():
                low = size
            else:
                high = size - 1
        if low < min_match:
            break
        size = low
        a_at, ah, b_at, bh, hit = runs(size)
        order = np.argsort(bh, kind="stable")       # equal runs by document position
        b_at, bh = b_at[order], bh[order]
        first = np.searchsorted(bh, ah[hit], "left").tolist()
        ends = np.searchsorted(bh, ah[hit], "right").tolist()
        passed: dict[int, int] = {}
        for i, lo, end in zip(a_at[hit].tolist(), first, ends, strict=True):
            # A run meets a tile of its own length only with one of its ends.
            if a_mark[i] or a_mark[i + size - 1]:
                continue
            p = start = passed.get(lo, lo)
            while p < end:
                j = int(b_at[p])
                if b_mark[j] or b_mark[j + size - 1]:
                    start = p + 1 if start == p else start
                elif np.array_equal(item[i:i + size], doc[j:j + size]):
                    a_mark[i:i + size] = b_mark[j:j + size] = True
                    tiles.append((i, j, size))
                    break
                p += 1
            passed[lo] = start
        # What is left lies at seeds whose run of min_match tokens is free.
        a_seed, b_seed = free(a_seed, a_mark, min_match), free(b_seed, b_mark, min_match)
        most = min(size - 1, min(_streak(a_seed), _streak(b_seed)) + min_match - 1)
    return tiles


def _blocks(items: list[tuple[int, str]], block_tokens: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    block, held = [], 0
    for key, text in items:
        tokens, _ = token_hashes([text])
        if held and held + len(tokens) > block_tokens:
            yield block
            block, held = [], 0
        block.append((key, tokens))
        held += len(tokens)
    if block:
        yield block


class Seeds:
    """Seeds of one block of items: sorted hashes, and the items behind each."""

    def __init__(self, block: list[tuple[int, np.ndarray]], min_match: int):
        self.items, self.min_match = block, min_match
        parts = [(window_hashes(t, min_match), i) for i, (_, t) in enumerate(block)]
        h = np.concatenate([p for p, _ in parts] or [np.zeros(0, dtype=np.uint64)])
        owner = np.concatenate([np.full(len(p), i) for p, i in parts] or [np.zeros(0, dtype=np.int64)])
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner = h[order], owner[order].astype(np.int64)
        # A bit table in front of the sorted search: most windows stop here.
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window position, item) of every shared seed."""
        maybe = np.flatnonzero(self.bits[(windows & np.uint64((1 << 22) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, windows[maybe], "left")
        hi = np.searchsorted(self.hashes, windows[maybe], "right")
        n = hi - lo
        spots = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.repeat(maybe, n), self.owner[spots]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK_BYTES:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def coverage(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH,
             threshold: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of every pair whose
    coverage reaches ``threshold``; repeated document rows give repeated pairs.

    Items with fewer than ``min_match`` tokens, null or empty ones cannot be
    covered; null and empty documents cover nothing; repeated items are one
    item per id and text.  An empty table on either side gives no rows.  Only
    the named columns are read.
    """
    schema = "doc_id bigint, item_id bigint, coverage double, n_tiles int, longest int"
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    # toLocalIterator: the driver holds one block of items at a time.
    items = ((r[0], r[1]) for r in benchmark.select(F.col(item_col).cast("long"), F.col(item_text))
             .where(F.col(item_text).isNotNull()).distinct().orderBy(item_col, item_text).toLocalIterator())
    for block in _blocks(items, block_tokens):
        sent = spark.sparkContext.broadcast(block)

        def work(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            seeds = Seeds(sent.value, min_match)
            for frame in frames:
                ids, texts = frame["doc_id"].tolist(), frame["text"].fillna("").tolist()
                found = []
                for lo, hi in _chunks(texts):
                    tokens, first = token_hashes(texts[lo:hi])
                    windows = window_hashes(tokens, min_match)
                    at, item = seeds.candidates(windows)
                    owner = np.searchsorted(first, at, "right") - 1
                    inside = at + min_match <= first[owner + 1]
                    pairs = {(int(d), int(i)) for d, i in zip(owner[inside], item[inside], strict=True)}
                    for d, i in sorted(pairs):
                        key, want = seeds.items[i]
                        tiles = tile(want, tokens[first[d]:first[d + 1]], min_match)
                        share = sum(t[2] for t in tiles) / len(want)
                        if share >= threshold:
                            found.append((ids[lo + d], key, share, len(tiles), max(t[2] for t in tiles)))
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "coverage", "n_tiles", "longest"]) \
                    .astype({"doc_id": "Int64", "item_id": "Int64"})

        part = rows.mapInPandas(work, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select(
        "doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"),
        F.lit(0).alias("n_tiles"), F.lit(0).alias("longest")).where("false")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          **options) -> DataFrame:
    """The documents no benchmark item is covered by.  Flagged documents are
    few (at most one row per copied passage), and rows are told apart by id and
    text, so a clean row with a flagged row's id stays."""
    # The row travels as one column, so its names cannot clash with ours.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("doc_id"))
    bad = coverage(keyed.select("doc_id", "text"), benchmark, "doc_id", "text", **options).select("doc_id").distinct()
    return keyed.join(bad, "doc_id", "left_anti").select("row.*")
