"""Toxicity by nearest labelled examples.

Terms are lower-cased words and word beginnings of 4 to 7 characters (marked
"^").  A bounded sample of labelled documents picks the terms that go with
either label (chi-squared); their document frequencies are counted over the whole
corpus.  Each labelled example is a TF-IDF vector in a block-max inverted
index, a document's nearest examples by cosine are found exactly (blocks whose
bound cannot reach the k-th best are skipped), and distance-weighted votes,
steadied by the base rate, give the score and its evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmetric.llm.common import cut

#: Labelled rows used, at most (smallest hashed ids).
MAX_EXAMPLES = 20_000
#: Terms kept, at most, by chi-squared, and the least chi-squared and count of one.
MAX_TERMS, MIN_CHI, MIN_COUNT = 4000, 12.0, 4
#: Neighbours that vote, examples in an index block, and the weight of the base rate.
K, BLOCK, PRIOR_WEIGHT = 15, 64, 1.0
#: Blocks of highest bound read first.
FIRST = 8

_WORD = re.compile(r"[^\W_]+")
#: UTF-8 with a space for every ASCII character that is in no word.
_PARTED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learnt from: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words(text: str | None) -> Counter:
    if not text:
        return Counter()
    text = text.lower()
    # Most words end at an ASCII character; only pieces with others are searched.
    parted = text.encode("utf-8", "surrogatepass").translate(_PARTED).decode("utf-8", "surrogatepass")
    out = Counter(parted.split())
    if not text.isascii():
        for piece in [w for w in out if not w.isascii()]:
            n = out.pop(piece)
            for w in _WORD.findall(piece):
                out[w] += n
    return out


def all_terms(counts: Counter) -> set[str]:
    """Every term of a text's words."""
    out: set[str] = set()
    for w in counts:
        out.add(w)
        for k in range(4, min(7, len(w)) + 1):
            out.add("^" + w[:k])
    return out


class Vocabulary(dict):
    """Term -> number.  The terms that are beginnings of a word hang on its first
    seven letters; they are looked up once for each and held, ``HELD`` at a time.  Most
    words are no term and begin like none, which ``whole`` and ``starts`` tell."""

    HELD = 200_000

    def __init__(self, names):
        super().__init__((t, i) for i, t in enumerate(names))
        self.held: dict[str, tuple[int, ...]] = {}
        self.whole = {t for t in names if t[0] != "^"}
        self.starts = {t[1:5] for t in names if t[0] == "^"}

    def __reduce__(self):
        return Vocabulary, (list(self),)

    def beginnings(self, start: str) -> tuple[int, ...]:
        if len(self.held) >= self.HELD:
            self.held.clear()
        found = (self.get("^" + start[:k]) for k in range(4, len(start) + 1))
        out = self.held[start] = tuple(t for t in found if t is not None)
        return out


def terms(counts: Counter, vocabulary: Vocabulary) -> dict[int, int]:
    """Term numbers of a text's words, with counts."""
    out: dict[int, int] = {}
    for w in counts.keys() & vocabulary.whole:
        out[vocabulary[w]] = counts[w]
    starts, held = vocabulary.starts, vocabulary.held.get
    for w in [w for w in counts if w[:4] in starts]:
        start, n = w[:7], counts[w]
        found = held(start)
        if found is None:
            found = vocabulary.beginnings(start)
        for t in found:
            out[t] = out.get(t, 0) + n
    return out


def arrays(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers, ascending, and their counts."""
    at = sorted(counts)
    return np.array(at, dtype=np.int32), np.array([counts[t] for t in at], dtype=np.int32)


def examples(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, y, text) of at most ``max_examples`` labelled rows outside the
    held-out fold; several labels of one id count as toxic if any does."""
    ids = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").alias("eid")).agg(F.max("toxic").alias("y"))
           .orderBy(F.xxhash64("eid"), "eid").limit(max_examples))
    # At most max_examples rows of two numbers: the broadcast is bounded by the parameter.
    return docs.select(F.col("doc_id").alias("eid"), F.col("text")).join(F.broadcast(ids), "eid").select(
        F.col("eid").alias("doc_id"), "y", "text")


def choose_terms(sample: DataFrame, max_terms: int = MAX_TERMS) -> list[str]:
    """Terms whose presence goes with label 1 or with label 0, best first (chi-squared, then name)."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tally: dict[str, list[int]] = {}
            for y, text in zip(frame["y"], frame["text"], strict=True):
                for t in all_terms(words(text)):
                    tally.setdefault(t, [0, 0])[1 if y else 0] += 1
            yield pd.DataFrame([(t, a, b) for t, (a, b) in tally.items()], columns=["term", "neg", "pos"])
    n = sample.groupBy(F.col("y") > 0).count().collect()
    n1 = float(sum(r[1] for r in n if r[0]))
    n0 = float(sum(r[1] for r in n if not r[0]))
    if not n1 or not n0:
        return []
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    total = n1 + n0
    chi = total * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2.0)) / ((a + b) * (total - a - b + 1e-9) * n1 * n0)
    rows = (sample.mapInPandas(count, "term string, neg long, pos long").groupBy("term")
            .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
            .where(a + b >= MIN_COUNT)
            .withColumn("chi", chi).where(F.col("chi") >= MIN_CHI)
            .orderBy(F.desc("chi"), "term").limit(max_terms).collect())
    return [r["term"] for r in rows]


def frequencies(docs: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """(documents, document frequency of each term) over the whole corpus."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(names)
        total, tally = 0, np.zeros(len(names), dtype=np.int64)
        for frame in frames:
            for text in frame["text"]:
                total += 1
                for t in terms(words(text), vocabulary):
                    tally[t] += 1
        yield pd.DataFrame({"t": np.concatenate(([-1], np.flatnonzero(tally))),
                            "n": np.concatenate(([total], tally[tally > 0]))})
    out, total = np.zeros(len(names), dtype=np.int64), 0
    # One row per kept term at most.
    for r in docs.select("text").mapInPandas(count, "t long, n long").groupBy("t").agg(F.sum("n")).collect():
        if r[0] < 0:
            total = int(r[1])
        else:
            out[r[0]] = r[1]
    return total, out


class Index:
    """Block-max inverted index over unit TF-IDF vectors of the examples: for each
    term the examples that hold it with their weights, and for each term and
    block of ``BLOCK`` examples the largest weight."""

    def __init__(self, names: list[str], idf: np.ndarray, rows: Iterable[tuple[int, int, dict[int, int] | tuple]],
                 k: int = K):
        """``rows``: (id, label, counts), the counts by term number or as two arrays (``arrays``)."""
        self.vocabulary, self.idf, self.k = Vocabulary(names), idf, k
        # Entries stay in arrays: as Python numbers and pairs they take ten times the driver's room.
        rows = [(i, y, *(arrays(counts) if isinstance(counts, dict) else counts)) for i, y, counts in rows]
        labels = [r[1] for r in rows]
        self.prior = float(np.mean(labels)) if rows else 0.0
        silent = [r[1] for r in rows if not len(r[2])]
        #: Base rate of examples without any term; their cosine is 0 with every text.
        self.silent = (sum(silent) + self.prior) / (len(silent) + 1.0)
        rows.sort(key=lambda r: (r[2].astype(">u4").tobytes(), r[0]))  # alike examples share blocks
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.y = np.array([r[1] for r in rows], dtype=np.float64)
        term = np.concatenate([np.zeros(0, dtype=np.int32), *(r[2] for r in rows)])
        weight = np.concatenate([np.zeros(0), *(self.unit(r[2], r[3]) for r in rows)])
        who = np.repeat(np.arange(len(rows)), np.array([len(r[2]) for r in rows], dtype=np.int64))
        order = np.argsort(term, kind="stable")
        ends = np.cumsum(np.bincount(term, minlength=len(names)))
        parts = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        who, weight = who[order], weight[order]
        self.who, self.weight = [who[a:b] for a, b in parts], [weight[a:b] for a, b in parts]
        blocks = -(-len(rows) // BLOCK)
        self.top = np.zeros((len(names), blocks))
        for t, (who, weight) in enumerate(zip(self.who, self.weight)):
            np.maximum.at(self.top[t], who // BLOCK, weight)
        self.memo: dict = {}

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(counts), dtype=np.int64)
        return at, self.unit(at, np.array([counts[t] for t in at.tolist()], dtype=np.int64))

    def unit(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of the terms ``at``, as a vector of length 1."""
        if not len(at):
            return np.zeros(0)
        weight = (1.0 + np.log(counts)) * self.idf[at]
        return weight / np.sqrt((weight ** 2).sum())

    def nearest(self, counts: dict[int, int]) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0 and all that tie with the last of
        them: (cosine, example)."""
        return list(zip(*(x.tolist() for x in self._nearest(counts)), strict=True))

    def _nearest(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` as cosines and examples, best first.  The blocks of highest bound give a floor under the
        k-th best; blocks whose bound does not reach it are left out."""
        at, weight = self.vector(counts)
        if not len(at) or not len(self.ids):
            return np.zeros(0), np.zeros(0, dtype=np.int64)
        bound = weight @ self.top[at]
        cosine = np.zeros((len(bound), BLOCK))
        flat = cosine.reshape(-1)
        # Lists are short beside their blocks, so they are added whole; blocks tell who is compared.
        for t, w in zip(at.tolist(), weight.tolist()):
            flat[self.who[t]] += w * self.weight[t]
        floor = 0.0
        if len(bound) > FIRST:
            sure = cosine[np.argpartition(-bound, FIRST)[:FIRST]].reshape(-1)
            floor = np.partition(sure, len(sure) - self.k)[len(sure) - self.k]
        blocks = np.flatnonzero(bound >= floor - 1e-9)
        got = cosine[blocks].reshape(-1)
        near = np.flatnonzero((got > 0) & (got >= floor - 1e-9))
        got, place = np.round(got[near], 12), blocks[near // BLOCK] * BLOCK + near % BLOCK
        if len(got) > self.k:
            keep = got >= np.partition(got, len(got) - self.k)[len(got) - self.k]
            got, place = got[keep], place[keep]
        ranked = np.lexsort((self.ids[place], -got))
        return got[ranked], place[ranked]

    def score(self, counts: dict[str, int]) -> tuple[float, list[int], list[float]]:
        """Share of label 1 among the neighbours, each weighing cos / (1.1 - cos),
        with the base rate as one neighbour more; ids and cosines of the nearest."""
        if not counts:
            return self.silent, [], []
        key = tuple(sorted(counts.items()))
        if key not in self.memo:
            cosine, place = self._nearest(counts)
            # All that tie with the k-th share the votes left to them, and sums are exact:
            # no order among ties can change a score.
            last = cosine == cosine[-1] if len(cosine) else np.zeros(0, dtype=bool)
            ties = int(last.sum())
            share = min(1.0, (self.k - len(cosine) + ties) / ties) if ties else 1.0
            votes = cosine / (1.1 - cosine) * np.where(last, share, 1.0)
            vote = math.fsum([PRIOR_WEIGHT * self.prior, *(votes * self.y[place]).tolist()])
            weight = math.fsum([PRIOR_WEIGHT, *votes.tolist()])
            if len(self.memo) >= 50_000:
                self.memo.clear()
            self.memo[key] = (vote / weight if len(cosine) else self.silent,
                              self.ids[place[:3]].tolist(), cosine[:3].tolist())
        return self.memo[key]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """Index of the bounded labelled sample; frequencies come from all of ``docs``."""
    sample = cut(examples(docs, labels, max_examples))
    names = choose_terms(sample)
    total, df = frequencies(docs, names)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(names)
        for frame in frames:
            got = [arrays(terms(words(t), vocabulary)) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": (frame["y"] > 0).astype("int64"),
                                "terms": [at.tobytes() for at, _ in got], "counts": [n.tobytes() for _, n in got]})
    rows = sample.mapInPandas(vectors, "doc_id long, y long, terms binary, counts binary").collect()
    return Index(names, idf, ((r[0], r[1], (np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32))) for r in rows))


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, score, neighbours (ids), cosines.

    Null, empty and term-less texts score the base rate of term-less examples;
    with no labelled rows every score is 0; null ids stay null; repeated rows
    score alike; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_EXAMPLES and MAX_TERMS

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        for frame in frames:
            got = [index.score(terms(words(t), index.vocabulary)) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": [g[0] for g in got],
                                "neighbours": [g[1] for g in got], "cosines": [g[2] for g in got]})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(work, "doc_id long, score double, neighbours array<long>, cosines array<double>")


def keep_clean(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text",
               reject_from: float = 0.5) -> DataFrame:
    """The rows whose score is under ``reject_from``, with their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        index = sent.value
        return pd.Series([index.score(terms(words(t), index.vocabulary))[0] for t in texts], dtype="float64")
    return docs.where(toxic(F.col(text_col)) < reject_from)
