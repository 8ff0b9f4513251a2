"""Projections, filters and text rewrites."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmetric.functions.columns import strip_text


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B1: pick and order named columns (pruned down to the scan)."""
    return df.select(*cols)


def tag_empty(df: DataFrame, cols: Sequence[str] | str = "text", keep_empty: bool = False,
              outcome: str = "outcome") -> DataFrame:
    """Tag rows PASS / EMPTY; one empty side rejects a parallel row.

    A side is empty when it strips to ``''`` (or is null).  EMPTY rows are
    dropped unless ``keep_empty``.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    empty = F.lit(False)
    for c in cols:
        empty = empty | F.coalesce(strip_text(c) == F.lit(""), F.lit(True))
    tagged = df.withColumn(outcome, F.when(empty, F.lit("EMPTY")).otherwise(F.lit("PASS")))
    return tagged if keep_empty else tagged.filter(F.col(outcome) == F.lit("PASS"))


def apply_by_language(df: DataFrame, lang: str, fn: Callable[[Column], Column],
                      text: str = "text", language: str = "language") -> DataFrame:
    """Rewrite the text of one language; other rows pass through."""
    return df.withColumn(
        text, F.when(F.col(language) == F.lit(lang), fn(F.col(text))).otherwise(F.col(text)))


def preview(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """First ``n`` rows in input order (a top-k plan, no full sort)."""
    return df.orderBy(order).limit(n)


def filter_by_length(df: DataFrame, max_src: int, max_tgt: int,
                     src: str = "src_tokens", tgt: str = "tgt_tokens") -> DataFrame:
    """Drop samples longer than the allowed positions."""
    return df.filter((F.size(src) <= max_src) & (F.size(tgt) <= max_tgt))
