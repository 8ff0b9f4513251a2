"""N-gram Jaccard join over count vectors.

A document is the set of its distinct word shingles (64-bit hashes); equal
sets are one class.  Shingles are hashed into groups, and the group counts of a
class are a point whose summed coordinate minima bound the overlap of two sets
from above.  Far apart points are never compared:

* Entries.  Two linked sets of n and m shingles differ in at most d shingles,
  d known from n + m.  With more than d groups they agree in a whole group, so
  classes are entered under (size range, group, content of the group) and
  linked classes share an entry.  This is exact and needs no corpus
  statistics, and a shingle that very many documents share is rarely a group's
  whole content, so it gathers few entries.
* Hubs.  In every entry the member with the most company is its hub; each
  class is verified against the hubs it shares most entries with.  Verified
  links give first components, which settle nearly all entries.
* R-tree.  Entries whose members still lie in several components are packed
  into small leaves of points with bounding boxes; leaf pairs, then point
  pairs, are dropped when the summed minima show too little overlap, and the
  surviving pairs across components are verified on the whole sets.
* Links.  All links lie inside components.  Each component is cut into tiles,
  every pair of tiles is compared on the whole sets, and the links come out as
  counts per class, never as pairs.

A plain R-tree over all points would visit nearly every leaf (distances of
unrelated points crowd together in many dimensions); the entries bring the
points together first, the boxes and sums then work inside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmetric.llm.common import cut, partitions, settled
from lexmetric.llm.graph import components
from lexmetric.llm.tiling import _MIX, _chunks, window_hashes

#: Coordinates of the points by set size: (least size, groups).
GROUPS = ((1600, 2048), (96, 512), (0, 128))
#: Members of an entry compared in one task at a time, and points in a leaf.
TILE, LEAF = 512, 16
#: Members up to which a unit of work is compared pair by pair, with many others at once, and rows taken at a time.
FEW, UNIT_ROWS = 64, 4096
#: Groups put together for a first, rough sum of minima.
ROUGH = 8
#: Shingles in a tile whose links are counted, about, and different shingles compared at a time.
TILE_SHINGLES, WIDTH = 1_000_000, 8192
#: Hubs each class is verified against.
HUBS = 1
#: Bits of the filter of texts whose sets are needed again.
FILTER_BITS = 1 << 23
#: Texts or classes a task remembers at a time; beyond it forgets them all and does some again.
MET = 200_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end): words are
    runs without the six white space characters, A-Z lower-cased."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
    ends_of_text = np.cumsum([len(r) + 1 for r in raw])
    word = ~_SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    length = end - start
    within = np.flatnonzero(word)
    power = np.full(int(length.max()), 0x100000001B3, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    value = (data[within].astype(np.uint64) + np.uint64(1)) * power[np.repeat(end, length) - within - 1]
    h = np.add.reduceat(value, np.concatenate(([0], np.cumsum(length)[:-1])))
    return _mixed(h, 1), np.concatenate(([0], np.searchsorted(start, ends_of_text)))


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for lo, hi in _chunks(texts):
        tokens, first = word_hashes(texts[lo:hi])
        windows = _mixed(window_hashes(tokens, k), 2)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                yield np.unique(windows[a:b - k + 1])
            elif b > a:
                yield _mixed(window_hashes(tokens[a:b], b - a), 3 + b - a)
            else:
                yield np.zeros(0, dtype=np.uint64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two numbers that stand for a whole set; equal sets have equal ones."""
    both = [int(_mixed(s, salt).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for salt in (11, 12)]
    return both[0], both[1]


def point(s: np.ndarray) -> bytes:
    """Group counts of a set: a byte each, or four (after a first byte of 1) where one passes 255."""
    n = next(g for least, g in GROUPS if len(s) >= least)
    counts = np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n)
    if counts.max() > 255:
        return b"\x01" + counts.astype(np.uint32).tobytes()
    return b"\x00" + counts.astype(np.uint8).tobytes()


def _fold(vec: bytes) -> np.ndarray:
    return np.frombuffer(vec, np.uint32 if vec[0] else np.uint8, offset=1)


def _narrowed(points: np.ndarray, width: int) -> np.ndarray:
    """Points of fewer groups."""
    return points.reshape(len(points), -1, width).sum(1, dtype=np.uint32)


class Rule:
    """Linked when den * overlap >= num * union."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError(f"a threshold above 0 and up to 1 is needed, not {num}/{den}")
        self.num, self.den = num, den

    def apart(self, total: int) -> int:
        """Most shingles two linked sets of ``total`` elements together can differ in."""
        return total * (self.den - self.num) // (self.den + self.num)

    def linked(self, n: int, m: int, same: int) -> bool:
        return self.den * same >= self.num * (n + m - same)

    def ranges(self, n: int) -> list[tuple[int, int]]:
        """(number of the size range, most differing shingles) of every range a
        set of n shingles is entered in: its own, the one shared with larger sets,
        and those shared with smaller sets it may link to, one for each border between.
        Ranges start at powers of the square root of 2."""
        j = int(np.floor(2 * np.log2(n) + 1e-9))
        low, high = self._start(j), self._start(j + 1)
        while n < low:
            j, low, high = j - 1, self._start(j - 1), low
        while n >= high:
            j, low, high = j + 1, high, self._start(j + 2)
        out = [(2 * j, self.apart(2 * (high - 1)))]
        # Sets under a border b against sets from b on, up to the size they reach.
        reach = self.den * (high - 1) // self.num
        if self.den * n // self.num >= high:
            out.append((2 * (j + 1) - 1, self.apart(high - 1 + reach)))
        for i in range(j, 0, -1):
            b = self._start(i)
            reach = self.den * (b - 1) // self.num
            if n > reach:
                break
            out.append((2 * i - 1, self.apart(b - 1 + reach)))
        return out

    @staticmethod
    def _start(j: int) -> int:
        return int(np.ceil(2 ** (j / 2) - 1e-9))


def entries(s: np.ndarray, rule: Rule) -> np.ndarray:
    """Entry keys of a set with shingles."""
    out = []
    for number, apart in rule.ranges(len(s)):
        if apart == 0:  # only equal sets link
            continue
        # A few groups more than needed, so that agreeing in empty groups alone is not enough.
        spare = 2 + apart // 32
        groups = apart + 1 + spare
        g = (((s >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(g, prepend=-1))
        content = np.add.reduceat(_mixed(s, 21), first)
        filled = g[first]
        if groups - len(first) > spare:  # so many empty groups that they may be all two sets agree in
            empty = np.setdiff1d(np.arange(groups), filled)
            filled = np.concatenate((filled, empty))
            content = np.concatenate((content, np.zeros(len(empty), dtype=np.uint64)))
        out.append(_mixed(content ^ _mixed(filled.astype(np.uint64), 1000 + number), 22))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       _tie(F.col(text_col)).alias("tie"))


def _tie(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"), _tie(F.col(text_col)).alias("tie"))


def _unseen(frame: pd.DataFrame, seen: set[tuple[int, int]]) -> list[str]:
    """Texts whose hash and length the task has not met."""
    out = []
    for tie, text in zip(frame["tie"].tolist(), frame["text"].fillna("").tolist(), strict=True):
        if (tie, len(text)) not in seen:
            if len(seen) >= MET:
                seen.clear()
            seen.add((tie, len(text)))
            out.append(text)
    return out


def described(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tie, n, node, check) of every row; a task works out a text once."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int], tuple[int, int, int]] = {}
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            names = list(zip(frame["tie"].tolist(), map(len, texts), strict=True))
            if len(known) >= MET:
                known = {}
            new = {name: text for name, text in zip(names, texts, strict=True) if name not in known}
            for name, s in zip(new, shingle_sets(list(new.values()), k), strict=True):
                known[name] = (len(s), *digest(s))
            sets = [known[name] for name in names]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "tie": frame["tie"],
                                "n": [x[0] for x in sets], "node": [x[1] for x in sets], "check": [x[2] for x in sets]})
    return _sets(docs, id_col, text_col).mapInPandas(
        work, "doc_id long, tie long, n long, node long, check long")


def entered(docs: DataFrame, k: int, rule: Rule, text_col: str) -> DataFrame:
    """(key, node): the entries of every class; a copy met again in a task is left out."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        seen: set[tuple[int, int]] = set()
        for frame in frames:
            keys, nodes, held = [], [], 0
            for s in shingle_sets(_unseen(frame, seen), k):
                node = digest(s)[0]
                if not len(s) or node in met:
                    continue
                if len(met) >= MET:
                    met.clear()
                met.add(node)
                e = entries(s, rule)
                keys.append(e.astype(np.int64))
                nodes.append(np.full(len(e), node, dtype=np.int64))
                held += len(e)
                if held >= 100_000:
                    yield pd.DataFrame({"key": np.concatenate(keys), "node": np.concatenate(nodes)})
                    keys, nodes, held = [], [], 0
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "node": np.concatenate(nodes)})
    return _texts(docs, text_col).mapInPandas(work, "key long, node long")


def gathered(keyed: DataFrame) -> DataFrame:
    """(bucket, node, members, hits): entries with two members or more.  Entries
    of the same members are one bucket; ``hits`` counts them."""
    rows = keyed.repartition(partitions(keyed), "key")
    order, whole = Window.partitionBy("key").orderBy("node"), Window.partitionBy("key")
    rows = rows.withColumn("prev", F.lag("node").over(order)).where("prev is null or prev <> node")
    rows = rows.withColumn("next", F.lead("node").over(order)).withColumn("prev", F.lag("node").over(order))
    rows = rows.where("prev is not null or next is not null")
    rows = rows.select("node", F.count(F.lit(1)).over(whole).alias("members"),
                       F.sum(F.xxhash64("node").cast("double") % F.lit(2.0 ** 40)).over(whole).alias("x"),
                       F.expr("bit_xor(xxhash64(node, 7))").over(whole).alias("y"))
    return rows.groupBy(F.xxhash64(F.col("x").cast("long"), "y", "members").alias("bucket"), "node").agg(
        F.first("members").alias("members"), F.count(F.lit(1)).alias("hits"))


def _needed(nodes: DataFrame):
    """A broadcast bit table of the ties of ``nodes`` (one bit by hash; FILTER_BITS bits)."""
    word = F.pmod(F.col("tie"), F.lit(FILTER_BITS))
    # At most FILTER_BITS / 32 rows.
    got = nodes.select(F.floor(word / 32).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (word % 32).cast("int")).alias("b")) \
        .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 32, dtype=np.int64)
    bits[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return nodes.sparkSession.sparkContext.broadcast(bits)


def again(docs: DataFrame, nodes: DataFrame, classes: DataFrame, k: int, text_col: str, make) -> DataFrame:
    """(node, n, data) of the classes in ``nodes``, ``make(set)`` from the texts
    again.  One text stands for a class: a bit table of their hashes keeps most
    other texts from being cut into shingles, the join the rest of the shuffle."""
    nodes = cut(nodes.join(classes.select("node", "tie"), "node").groupBy("node").agg(F.min("tie").alias("tie")))
    bits = _needed(nodes)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()
        seen: set[tuple[int, int]] = set()
        for frame in frames:
            out, held = [], 0
            at = frame["tie"].to_numpy() % FILTER_BITS
            frame = frame[((bits.value[at // 32] >> (at % 32)) & 1).astype(bool)]
            for s in shingle_sets(_unseen(frame, seen), k):
                node = digest(s)[0]
                if len(s) and node not in met:
                    if len(met) >= MET:
                        met.clear()
                    met.add(node)
                    out.append((node, len(s), make(s)))
                    held += len(s)
                    if held > 500_000:
                        yield pd.DataFrame(out, columns=["node", "n", "data"])
                        out, held = [], 0
            yield pd.DataFrame(out, columns=["node", "n", "data"])
    rows = _texts(docs, text_col).mapInPandas(work, "node long, n long, data binary")
    return rows.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, rule: Rule,
             text_col: str) -> DataFrame:
    """The pairs (a, b) whose whole sets link.  Each set moves once, and once more for each pair."""
    pairs = settled(pairs.select("a", "b").distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = again(docs, nodes, classes, k, text_col, lambda s: s.tobytes())
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("data").alias("eb")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("data").alias("ea")), "a")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [rule.linked(n, m, len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64),
                                                         assume_unique=True)))
                    for n, m, x, y in zip(frame["na"], frame["nb"], frame["ea"], frame["eb"], strict=True)]
            yield frame.loc[keep, ["a", "b"]]
    return two.mapInPandas(work, "a long, b long")


class Leaves:
    """Points packed by size into leaves with bounding boxes (one level of an R-tree)."""

    def __init__(self, nodes, comps, sizes, vecs):
        order = np.lexsort((nodes, sizes))
        self.node, self.comp, self.n = nodes[order], comps[order], sizes[order]
        points = [vecs[i] for i in order]
        width = min(len(p) for p in points)
        cuts = np.arange(0, len(order), LEAF)
        self.cuts = np.append(cuts, len(order))
        self.least = np.minimum.reduceat(self.n, cuts)
        self.hold(np.stack([p if len(p) == width else _narrowed(p[None], width)[0] for p in points]))

    def hold(self, at: np.ndarray) -> None:
        """The points, their boxes, and the points in few groups, whose minima are summed sooner."""
        self.at, self.high = at, np.maximum.reduceat(at, self.cuts[:-1], axis=0)
        self.rough = _narrowed(at, at.shape[1] // ROUGH)


def _surviving(a: Leaves, b: Leaves, rule: Rule) -> Iterator[tuple[int, int]]:
    """Pairs across components whose summed minima allow a link."""
    if a.at.shape[1] != b.at.shape[1]:
        w = min(a.at.shape[1], b.at.shape[1])
        for x in (a, b):
            if x.at.shape[1] != w:
                x.hold(_narrowed(x.at, w))
    share = rule.num / (rule.num + rule.den)
    for i in range(len(a.high)):
        ai = slice(a.cuts[i], a.cuts[i + 1])
        box = np.minimum(a.high[i], b.high).sum(1, dtype=np.int64)
        met = np.flatnonzero(box + 1e-9 >= share * (a.least[i] + b.least))
        if not len(met):
            continue
        bj = np.concatenate([np.arange(b.cuts[j], b.cuts[j + 1]) for j in met.tolist()])
        least = share * (a.n[ai][:, None] + b.n[bj][None, :])
        ok = (np.minimum(a.n[ai][:, None], b.n[bj][None, :]) + 1e-9 >= least) \
            & (a.comp[ai][:, None] != b.comp[bj][None, :])
        for at, of in ((a.rough, b.rough), (a.at, b.at)):
            x, y = np.nonzero(ok)
            ok[x, y] = _summed(at, of, x + ai.start, bj[y]) + 1e-9 >= least[x, y]
        for x, y in zip(*np.nonzero(ok), strict=True):
            yield int(a.node[ai][x]), int(b.node[bj[y]])


def _summed(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed minima of the rows ``a`` of ``left`` and ``b`` of ``right``, some at a time."""
    out = np.zeros(len(a), dtype=np.int64)
    step = max(1, (1 << 18) // left.shape[1])
    for lo in range(0, len(a), step):
        out[lo:lo + step] = np.minimum(left[a[lo:lo + step]], right[b[lo:lo + step]]).sum(1, dtype=np.uint32)
    return out


def _minima(vec: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Summed minima of the points of every pair; the wider of two is folded."""
    used = np.unique(np.concatenate((left, right)))
    points = [_fold(vec[i]) for i in used.tolist()]
    width = np.array([len(p) for p in points], dtype=np.int64)
    left, right = np.searchsorted(used, left), np.searchsorted(used, right)
    narrow = np.minimum(width[left], width[right])
    out = np.zeros(len(left), dtype=np.int64)
    for w in np.unique(narrow).tolist():
        of = np.flatnonzero(narrow == w)
        rows = np.unique(np.concatenate((left[of], right[of])))
        at = np.stack([points[i] if width[i] == w else _narrowed(points[i][None], w)[0] for i in rows.tolist()])
        out[of] = _summed(at, at, np.searchsorted(rows, left[of]), np.searchsorted(rows, right[of]))
    return out


def _few(starts: np.ndarray, ends: np.ndarray, frame: dict, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs across components, of many small units at once, whose sizes and summed minima allow a link."""
    node, comp, n, tile = (frame[c] for c in ("node", "comp", "n", "tile"))
    one, two = [], []
    for size in np.unique(ends - starts).tolist():
        i, j = np.triu_indices(size, 1)
        at = starts[ends - starts == size][:, None]
        one.append((at + i).ravel())
        two.append((at + j).ravel())
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (one, two))
    least = rule.num / (rule.num + rule.den) * (n[a] + n[b])
    # Between two tiles, only pairs of one member of each.
    keep = (comp[a] != comp[b]) & ((frame["t"][a] == frame["u"][a]) | (tile[a] != tile[b]))
    keep &= np.minimum(n[a], n[b]) + 1e-9 >= least
    a, b, least = a[keep], b[keep], least[keep]
    ok = _minima(frame["data"], a, b) + 1e-9 >= least if len(a) else np.zeros(0, dtype=bool)
    x, y = node[a[ok]], node[b[ok]]
    return np.minimum(x, y), np.maximum(x, y)


def across(buckets: DataFrame, roots: DataFrame, docs: DataFrame, classes: DataFrame, k: int, rule: Rule,
           text_col: str) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that the R-tree
    lets through.  Buckets are cut into tiles of TILE members; every pair of
    tiles is one unit of work, so no bucket has to fit a task."""
    rows = buckets.join(roots, "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("comp"), "members")
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    rows = settled(rows.join(mixed, "bucket"))
    points = again(docs, rows.select("node").distinct(), classes, k, text_col, point)
    rows = rows.withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.withColumn("other", other).select(
        "bucket", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"),
        F.col("tile"), "node", "comp").join(points, "node")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= UNIT_ROWS:
                rest = pd.concat(held, ignore_index=True)
                starts = first_rows(rest)
                yield from units(rest.iloc[:starts[-1]], starts)
                held = [rest.iloc[starts[-1]:]]
                size = len(held[0])
        if size:
            rest = pd.concat(held, ignore_index=True)
            yield from units(rest, np.append(first_rows(rest), len(rest)))

    def first_rows(rows: pd.DataFrame) -> np.ndarray:
        return np.flatnonzero(rows[["bucket", "t", "u"]].ne(rows[["bucket", "t", "u"]].shift()).any(axis=1).to_numpy())

    def units(frame: pd.DataFrame, starts) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        node, comp, n, tile = (frame[c].to_numpy() for c in ("node", "comp", "n", "tile"))
        vec, t, u = frame["data"].to_list(), frame["t"].to_numpy(), frame["u"].to_numpy()
        starts, ends = starts[:-1], starts[1:]
        few = ends - starts <= FEW
        x, y = _few(starts[few], ends[few], {"node": node, "comp": comp, "n": n, "tile": tile, "t": t, "u": u,
                                             "data": vec}, rule)
        yield pd.DataFrame({"a": x, "b": y}).drop_duplicates()
        for a, b in zip(starts[~few], ends[~few], strict=True):
            if (comp[a:b] == comp[a]).all():
                continue
            at = np.arange(a, b)
            left, right = at[tile[a:b] == t[a]], at[tile[a:b] == u[a]]
            if not len(left) or not len(right):
                continue
            la = Leaves(node[left], comp[left], n[left], [_fold(vec[i]) for i in left])
            lb = la if t[a] == u[a] else Leaves(node[right], comp[right], n[right], [_fold(vec[i]) for i in right])
            out += [(min(p), max(p)) for p in _surviving(la, lb, rule)]
            if len(out) > 100_000:
                yield pd.DataFrame(out, columns=["a", "b"]).drop_duplicates()
                out = []
        yield pd.DataFrame(out, columns=["a", "b"]).drop_duplicates()
    dealt = rows.repartition(partitions(buckets), "bucket", "t", "u").sortWithinPartitions("bucket", "t", "u")
    return dealt.mapInPandas(work, "a long, b long")


def hub_pairs(buckets: DataFrame, hubs: int = HUBS) -> DataFrame:
    """(a, b): each class with the hubs it shares most entries with."""
    company = buckets.groupBy("node").agg(F.sum((F.col("members") - 1) * F.col("hits")).alias("company"))
    order = Window.partitionBy("bucket").orderBy(F.desc("company"), "node")
    met = (buckets.join(company, "node").withColumn("hub", F.first("node").over(order))
           .where("hub <> node").groupBy("node", "hub").agg(F.sum("hits").alias("hits")))
    mine = Window.partitionBy("node").orderBy(F.desc("hits"), "hub")
    top = met.withColumn("r", F.row_number().over(mine)).where(F.col("r") <= hubs)
    return top.select(F.col("hub").alias("a"), F.col("node").alias("b"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common elements of every set of ``left`` with every set of ``right``."""
    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    (x, of_x), (y, of_y) = flat(left), flat(right)
    both = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    spots = []
    for v, of in ((x, of_x), (y, of_y)):
        at = np.minimum(np.searchsorted(both, v), max(0, len(both) - 1))
        held = both[at] == v if len(both) else np.zeros(len(v), dtype=bool)
        order = np.argsort(at[held], kind="stable")
        spots.append((at[held][order], of[held][order]))
    for lo in range(0, len(both), WIDTH):
        marks = []
        for (at, of), n in zip(spots, out.shape, strict=True):
            a, b = np.searchsorted(at, (lo, lo + WIDTH))
            mark = np.zeros((n, min(WIDTH, len(both) - lo)), dtype=np.float32)
            mark[of[a:b], at[a:b] - lo] = 1.0
            marks.append(mark)
        out += (marks[0] @ marks[1].T).astype(np.int64)
    return out


def link_counts(home: DataFrame, docs: DataFrame, classes: DataFrame, k: int, rule: Rule, text_col: str) -> DataFrame:
    """(node, far): rows of other classes that each class of ``home`` (node, root, n,
    copies) links to.  Tiles hold at most about TILE classes and TILE_SHINGLES
    shingles; every pair of tiles of a component is one unit of work."""
    sizes = home.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")).where("members > 1")
    rows = cut(home.join(sizes, "root").withColumn("tiles", F.ceil(F.greatest(
        F.col("members") / TILE, F.col("total") / TILE_SHINGLES)).cast("int")))
    sets = again(docs, rows.select("node"), classes, k, text_col, lambda s: s.tobytes())
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "root", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"),
        "tile", "node", "copies").join(sets, "node")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for frame in frames:
            out = []
            for row in frame[["root", "t", "u", "tile", "node", "copies", "n", "data"]].itertuples(index=False):
                if row[:3] != key and held:
                    out += unit(held)
                    held = []
                key = row[:3]
                held.append(row)
            yield pd.DataFrame(out, columns=["node", "far"])
        yield pd.DataFrame(unit(held), columns=["node", "far"])

    def unit(held: list) -> list[tuple[int, int]]:
        left = [r for r in held if r.tile == r.t]
        right = left if held and held[0].t == held[0].u else [r for r in held if r.tile == r.u]
        if not left or not right:
            return []
        n, m = (np.array([r.n for r in x], dtype=np.int64) for x in (left, right))
        sets = [np.frombuffer(r.data, np.uint64) for r in left]
        same = overlaps(sets, sets if right is left else [np.frombuffer(r.data, np.uint64) for r in right])
        link = rule.linked(n[:, None], m[None, :], same)
        if right is left:
            np.fill_diagonal(link, False)
        out = list(zip([r.node for r in left], (link @ np.array([r.copies for r in right])).tolist(), strict=True))
        if right is not left:
            out += zip([r.node for r in right], (link.T @ np.array([r.copies for r in left])).tolist(), strict=True)
        return out
    dealt = rows.repartition(partitions(docs), "root", "t", "u").sortWithinPartitions("root", "t", "u")
    return dealt.mapInPandas(work, "node long, far long").groupBy("node").agg(F.sum("far").alias("far"))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
         text_col: str = "text", counted: bool = True) -> DataFrame:
    """One row per row: doc_id, tie (hash of the text), n_shingles, root (class
    that stands for the component, null if empty), component_id (smallest id
    reachable by links), and if ``counted`` n_links (other rows it links to, those
    of an equal set among them).

    Rows without words (null, empty or blank texts) have no shingles, no links and
    are their own component.  Rows with a null id take part in linking, but
    component ids come from the others (null when there is none).  Repeated
    rows and equal sets are one class.  An empty table gives no rows; other
    columns are not read.
    """
    rule = Rule(num, den)
    rows = cut(described(docs, k, id_col, text_col))
    classes = cut(rows.where("n > 0").groupBy("node", "check", "n").agg(
        F.min("doc_id").alias("first"), F.min("tie").alias("tie"), F.count(F.lit(1)).alias("copies")))
    buckets = settled(gathered(entered(docs, k, rule, text_col)))
    links = settled(verified(hub_pairs(buckets), docs, classes, k, rule, text_col))
    roots = cut(components(links))
    more = settled(verified(across(buckets, roots, docs, classes, k, rule, text_col), docs, classes, k, rule, text_col))
    roots = components(links.union(more))
    home = settled(classes.join(roots, "node", "left").select(
        "node", "first", "n", "copies", F.coalesce("root", "node").alias("root")))
    least = home.groupBy("root").agg(F.min("first").alias("component_id"))
    full = home.join(least, "root").select("node", "root", "component_id", "copies")
    links = []
    if counted:
        full = full.join(link_counts(home, docs, classes, k, rule, text_col), "node", "left")
        links = [F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("far", F.lit(0))).otherwise(0).alias("n_links")]
    return rows.withColumn("node", F.when(F.col("n") > 0, F.col("node"))).join(full, "node", "left").select(
        "doc_id", "tie", F.col("n").alias("n_shingles"), "root",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *links)


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row of each component stays: the one of its smallest id (null ids
    last, then by the text's hash; of rows alike in both, one).  Texts without
    words are linked with nothing and all stay."""
    found = join(docs, k, num, den, id_col, text_col, counted=False)
    first = found.where("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("f"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    stay = settled(first.select(name(F.col("f.doc_id")).alias("__id"), F.col("f.tie").alias("__tie")))
    blank = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    full = docs.where(~blank).withColumn("__id", name(F.col(id_col))).withColumn("__tie", _tie(F.col(text_col)))
    # Rows alike in id and text: one of them, by the hash of all columns.  The join's layout serves the window.
    one = Window.partitionBy("__id", "__tie").orderBy(F.xxhash64(*[F.col(c) for c in docs.columns]))
    kept = full.join(stay, ["__id", "__tie"], "left_semi").withColumn("__r", F.row_number().over(one))
    return kept.where("__r = 1").select(*docs.columns).unionByName(docs.where(blank))
