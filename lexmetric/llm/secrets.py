"""Secret scans: fixed patterns plus a character Markov model.

Spans are code point offsets, end exclusive.  The three base patterns are
matched leftmost and non-overlapping, each for itself; their positions follow
from the lengths of the matches and of the gaps between them.  Candidate runs
that no base span touches are scored by two character Markov chains, one
trained on random strings and one on ordinary identifiers, and reported when
the mean log-likelihood ratio per step passes a threshold.  All expressions
are Spark's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmetric.llm.common import let

#: Fixed values of the base patterns: kind, pattern, group measured, its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Characters of the Markov chains; a candidate is a run of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 16
#: Runs of 16 to 19 without a letter are numbers (cards, accounts, times), no keys.
CANDIDATE = r"(?![0-9+/_=-]{16,19}(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{16,}"
#: Labelled sample for training: at most so many documents (smallest hashed ids).
TRAIN_DOCS = 2000
#: Weight of the back-off distribution in a row, as so many steps.
BACK_OFF = 20.0
#: Least mean log-likelihood ratio per character step (nats).
MIN_RATIO = 1.5

_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _matches(text: Column, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """Spans of the pattern's matches whose ``group`` has ``least`` characters."""
    def located(found, gaps, sizes):
        lengths = F.zip_with(gaps, found, lambda g, m: F.struct(
            F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len")))
        walk = F.aggregate(
            F.arrays_zip(lengths.alias("l"), sizes.alias("s")),
            F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["l"]["gap"] + F.coalesce(x["l"]["len"], F.lit(0))).alias("at"),
                F.when(F.length(x["s"]) >= least, F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + x["l"]["gap"]).alias("start"), F.lit(rank).alias("rank"),
                    (acc["at"] + x["l"]["gap"] + x["l"]["len"]).alias("end"),
                    F.lit(kind).alias("kind"))))).otherwise(acc["out"]).alias("out")),
            lambda acc: acc["out"])
        return walk
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    spans = let(F.struct(whole.alias("m"), F.split(text, pattern, -1).alias("g"),
                         measured.alias("s")),
                lambda x: located(x["m"], x["g"], x["s"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> list[Column]:
    """One array of spans per base kind."""
    return [_matches(text, p, g, n, i, k) for i, (k, p, g, n) in enumerate(BASE)]


def transitions(strings: DataFrame) -> DataFrame:
    """(label, a, b, n): counts of character steps in (label, s)."""
    chars = strings.select("label", F.filter(F.split("s", ""), lambda c: c != "").alias("c"))
    steps = chars.select("label", F.explode(F.zip_with(
        F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))),
        F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    return steps.groupBy(
        "label", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def labelled_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     n_docs: int = TRAIN_DOCS) -> DataFrame:
    """(label, s) from at most ``n_docs`` documents: "random" strings are
    digests of the ids written as hex, upper-case hex, base 64 and letters and
    digits; "plain" ones are the ordinary words and identifiers of the texts
    (runs of letters, digits, hyphens and underscores no longer than 40 characters that are
    no base match and hold fewer than four digits)."""
    ids = docs.select(F.col(id_col).alias("i")).where("i is not null").distinct()
    ids = ids.orderBy(F.xxhash64("i"), "i").limit(n_docs)
    # At most n_docs ids: the broadcast is bounded by the parameter.
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(ids), "i", "left_semi")
    digest = F.sha2(F.col("i").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    random = ids.select(F.explode(F.array(
        digest, F.upper(digest), b64, F.regexp_replace(b64, "[+/=]", ""),
        F.translate(b64, "+/", "-_"))).alias("s")).select(F.lit("random").alias("label"), "s")
    word = F.explode(F.regexp_extract_all(
        F.coalesce(F.col("text"), F.lit("")), F.lit("[A-Za-z0-9_-]{6,40}"), F.lit(0)))
    plain = texts.select(word.alias("s")).where(
        (F.length(F.regexp_replace("s", "[^0-9]", "")) < 4)).select(F.lit("plain").alias("label"), "s")
    return random.unionByName(plain)


def train(strings: DataFrame) -> list[float]:
    """Log-likelihood ratios random : plain for every character step, row major
    over ``ALPHABET``; each row backs off to how often a character occurs at all
    (add-one).  Bounded by the alphabet's square."""
    n = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = {"random": [0.0] * (n * n), "plain": [0.0] * (n * n)}
    for r in transitions(strings).where(
            F.col("a").isin(*ALPHABET) & F.col("b").isin(*ALPHABET)).collect():
        counts[r["label"]][at[r["a"]] * n + at[r["b"]]] += r["n"]
    logs = {}
    for label, table in counts.items():
        ends = [1.0 + sum(table[j::n]) for j in range(n)]
        total = sum(ends)
        logs[label] = [math.log((table[i * n + j] + BACK_OFF * ends[j] / total)
                                / (sum(table[i * n:(i + 1) * n]) + BACK_OFF))
                       for i in range(n) for j in range(n)]
    return [a - b for a, b in zip(logs["random"], logs["plain"], strict=True)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per character step of a run of ``ALPHABET``."""
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    n = len(ALPHABET)
    spots = F.transform(F.filter(F.split(token, ""), lambda c: c != ""),
                        lambda c: F.instr(F.lit(ALPHABET), c))
    total = let(spots, lambda p: F.aggregate(
        F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1),
                   lambda a, b: (a - 1) * n + b),
        F.lit(0.0), lambda acc, k: acc + F.element_at(weights, k)) / (F.size(p) - 1))
    return total


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text",
         min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per document: doc_id, base (array of spans by start, then kind
    as listed), found (base plus the model's spans of kind "markov").

    Null and empty texts have no spans; repeated rows give repeated results;
    a null id stays null; other columns of the input are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.array_sort(F.concat(*base_spans(text))).alias("base"),
                       _matches(text, CANDIDATE, 0, LEAST, 3, "markov").alias("runs"),
                       F.when(text.rlike(CANDIDATE), F.regexp_extract_all(
                           text, F.lit(CANDIDATE), F.lit(0))).alias("tokens"))
    scored = F.filter(
        F.zip_with("runs", F.coalesce("tokens", F.array().cast("array<string>")),
                   lambda r, t: F.struct(r.alias("span"), ratio(t, model).alias("llr"))),
        lambda x: (x["llr"] >= min_ratio) & ~F.exists("base", lambda b: (
            (b["start"] < x["span"]["end"]) & (x["span"]["start"] < b["end"]))))
    return rows.select("doc_id", "base", F.array_sort(F.concat(
        "base", F.transform(scored, lambda x: x["span"]))).alias("found"))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
