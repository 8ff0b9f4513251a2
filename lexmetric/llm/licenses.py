"""License notices with typing errors: pigeonhole seeds, then bounded-error matching.

A notice of which ``errors`` code points may be wrong is cut into ``errors`` + 1
pieces; one edit touches one piece, so a text that holds the notice holds a
piece as it is.  Spark looks for the pieces in the normalised texts; only texts
with one go to Python, where each piece found gives a window for the regex
library's bounded-error matching.  No shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(UPPER, UPPER.lower())
#: A word: digits, letters and everything beyond ASCII, A-Z lower-cased.
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_WORD = re.compile(f"[^{BETWEEN}]+")

#: Phrases counted exactly, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Notice:
    """Words of a notice, its label, and how many code points may be wrong."""
    text: str
    label: str
    errors: int

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): ``errors`` + 1 pieces of nearly equal length."""
        n, k = len(self.text), self.errors + 1
        ends = [i * n // k for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(ends, ends[1:])]


#: Names of licenses and wordings from their texts.  About one code point in twelve may be
#: wrong, fewer where another notice is as near as that.
NOTICES = (
    Notice("gnu general public license", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("gnu library general public license", "lgpl", 2),
    Notice("gnu affero general public license", "agpl", 2),
    Notice("gnu free documentation license", "gfdl", 2),
    Notice("apache license", "apache", 1),
    Notice("apache software license", "apache", 1),
    Notice("the mit license", "mit", 1),
    Notice("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", 7),
    Notice("licensed under cc by", "cc-by", 1),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("licensed under cc by sa", "cc-by-sa", 1),
    Notice("licensed under cc by nc", "cc-by-nc", 1),
    Notice("licensed under cc by nd", "cc-by-nd", 1),
    Notice("creative commons attribution sharealike", "cc-by-sa", 2),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 2),
    Notice("creative commons attribution noderivatives", "cc-by-nd", 2),
    Notice("creative commons zero", "cc0", 1),
    Notice("mozilla public license", "mpl", 1),
    Notice("eclipse public license", "epl", 1),
    Notice("bsd 2 clause license", "bsd", 1),
    Notice("bsd 3 clause license", "bsd", 1),
    Notice("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 7),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    Notice("free and unencumbered software released into the public domain", "unlicense", 5),
)

SPAN = "struct<label:string,start:long,end:long,first_word:long,edits:int,likeness:double>"
FOUND = (f"n_base long, first_word long, last_word long, base_labels array<string>, "
         f"labels array<string>, spans array<{SPAN}>, score double")


def normalised(text: Column) -> Column:
    """The words of a text, one space between them and around all."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, f"[{BETWEEN}]+", " ")), F.lit(" "))


def word_count(norm: Column) -> Column:
    return F.when(norm == "  ", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) - 1
                                                    ).cast("long")


def seeds(notices=NOTICES, base=BASE) -> list[str]:
    """Every string one of which a text with a label must hold."""
    exact = [f" {phrase} " for phrase, _ in base]
    return list(dict.fromkeys(exact + [piece for n in notices for _, piece in n.pieces()]))


class Finder:
    """Base places and notices of one text; built once in a task."""

    def __init__(self, notices=NOTICES, base=BASE):
        self.notices, self.base = tuple(notices), tuple(base)
        self.exact = [(re.compile(f"(?<= )(?={re.escape(p)} )"), p, label) for p, label in self.base]
        # Whole words only; (?b) takes the window's match of fewest errors.
        self.fuzzy = [regex.compile(f"(?b)(?<= )(?:{regex.escape(n.text)}){{e<={n.errors}}}(?= )") for n in self.notices]
        self.pieces = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            for offset, piece in n.pieces():
                where.setdefault(piece, []).append((i, offset))
        for piece, owners in where.items():
            self.pieces.add_word(piece, (len(piece), owners))
        if where:
            self.pieces.make_automaton()

    def windows(self, norm: str) -> set[tuple[int, int]]:
        """(notice, place): where the whole notice would begin, for each of its pieces found."""
        return {(i, end - length + 1 - offset) for end, (length, owners) in
                (self.pieces.iter(norm) if len(self.pieces) else ()) for i, offset in owners}

    def notices_in(self, norm: str) -> Iterator[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of the matches, ends exclusive.  A span begins at most
        ``errors`` from its window's place and ends at most as far from the notice's end; of
        overlapping spans of one notice those of fewest edits stay."""
        found: dict[int, set[tuple[int, int, int]]] = {}
        for i, at in self.windows(norm):
            n = self.notices[i]
            lo = max(0, at - n.errors - 1)
            m = self.fuzzy[i].search(norm[lo:max(0, at + len(n.text) + n.errors + 1)])
            if m and m.start() < m.end():
                found.setdefault(i, set()).add((sum(m.fuzzy_counts), lo + m.start(), lo + m.end()))
        for i, spans in found.items():
            kept: list[tuple[int, int]] = []
            for edits, start, end in sorted(spans):
                j = bisect.bisect_left(kept, (start, end))
                if (j == 0 or kept[j - 1][1] <= start) and (j == len(kept) or end <= kept[j][0]):
                    kept.insert(j, (start, end))
                    yield i, start, end, edits

    def __call__(self, text: str) -> dict:
        low = text.translate(_LOWER)
        at = [m.span() for m in _WORD.finditer(low)]
        norm = " " + " ".join(low[a:b] for a, b in at) + " "
        starts, here = [], 1
        for a, b in at:
            starts.append(here)
            here += b - a + 1
        spans, places = [], []

        def add(label, start, end, edits, length):
            first, last = bisect.bisect_right(starts, start) - 1, bisect.bisect_right(starts, end - 1) - 1
            spans.append((label, at[first][0], at[last][1], first, edits, max(0.0, 1.0 - edits / length)))
            return first

        base_labels = set()
        for pattern, phrase, label in self.exact:
            for m in pattern.finditer(norm):
                places.append(add(label, m.start(), m.start() + len(phrase), 0, len(phrase)))
                base_labels.add(label)
        near = list(self.notices_in(norm))
        fewest: dict[tuple[int, int], int] = {}
        for _, start, end, edits in near:
            fewest[start, end] = min(edits, fewest.get((start, end), edits))
        for i, start, end, edits in near:
            # Words that are nearer to another notice are that notice.
            if edits == fewest[start, end]:
                add(self.notices[i].label, start, end, edits, len(self.notices[i].text))
        spans = sorted(set(spans), key=lambda s: (s[1], s[2], s[0], s[4]))
        return {"n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
                "base_labels": sorted(base_labels), "labels": sorted({s[0] for s in spans}),
                "spans": [dict(zip(("label", "start", "end", "first_word", "edits", "likeness"), s)) for s in spans],
                "score": max((s[5] for s in spans), default=0.0)}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, base=BASE) -> DataFrame:
    """One row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score.

    ``spans`` are code points of the text as it stands, ends exclusive, whole
    words, with the edits and the likeness 1 - edits / length; ``score`` is the
    best likeness, 0 without a match.  Null and empty texts have no words and no
    labels; repeated rows are scanned each; an empty table gives no rows.  Only
    the two named columns are read, so extra columns cannot clash.
    """
    notices, base = tuple(notices), tuple(base)
    held: list[Finder] = []

    @F.pandas_udf(FOUND)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not held:
            held.append(Finder(notices, base))
        none = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": [], "labels": [], "spans": [], "score": 0.0}
        names = list(none)
        for texts in parts:
            rows = [none if t is None else held[0](t) for t in texts]
            out = pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in names}, columns=names)
            for c in ("first_word", "last_word", "n_base"):
                out[c] = out[c].astype("Int64")
            out["score"] = out["score"].astype("float64")
            yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       normalised(F.col(text_col)).alias("norm"))
    some = F.lit(False)
    for seed in seeds(notices, base):
        some = some | F.contains("norm", F.lit(seed))
    return (rows.select("doc_id", word_count(F.col("norm")).alias("n_words"), F.when(some, F.col("text")).alias("text"))
            .withColumn("found", find("text")).select("doc_id", "n_words", "found.*"))
