"""Corpus preparation as one lazy plan.

read samples -> position (D4) -> one row per language (D1) -> translations
from a memory (D2; D3 lists what is missing) -> even language mix (D5) ->
optional per-language rewrite (B6 / J2) -> tab-separated output (A7).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from lexmetric.operators.sequence import with_position
from lexmetric.operators.shape import (LANGUAGES, expand_languages, localize,
                                       pending_translations, rotating_sample)
from lexmetric.operators.text import apply_by_language


def prepare_corpus(samples: DataFrame, memory: DataFrame, order: list[str] | None = None,
                   mode: str = "rotating", rewrite: tuple[str, Callable[[Column], Column]] | None = None,
                   langs=LANGUAGES) -> tuple[DataFrame, DataFrame]:
    """Return ``(trimmed, pending)``: the down-sampled translated corpus and
    the (text, language) pairs the memory cannot translate yet."""
    if "pos" not in samples.columns:
        samples = with_position(samples, order or ["sample_id"])
    expanded = expand_languages(samples, langs)
    pending = pending_translations(expanded, memory)
    localized = localize(expanded, memory)
    trimmed = rotating_sample(localized, langs, mode=mode)
    if rewrite is not None:
        lang, fn = rewrite
        trimmed = apply_by_language(trimmed, lang, fn)
    return trimmed, pending
