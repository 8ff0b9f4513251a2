"""Joins and dataset shaping (D1-D3, D5-D11; D4 lives in ``sequence``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmetric.operators.packing import pack
from lexmetric.operators.sequence import with_position

# Fixed value: the languages every sample is expanded into, in this order.
LANGUAGES = ("fr", "es", "ar", "de", "en", "ja")
SOURCE_LANGUAGE = "en"


def expand_languages(df: DataFrame, langs: Sequence[str] = LANGUAGES, pos: str = "pos",
                     language: str = "language") -> DataFrame:
    """Every sample once per language, in the given order.

    ``pos`` becomes ``sample_pos * len(langs) + k``.  A generator over a
    literal array: no join, no shuffle, the rows multiply inside each task.
    """
    k = len(langs)
    arr = F.array(*[F.lit(x) for x in langs])
    out = df.select("*", F.posexplode(arr).alias("_k", "_lang"))
    if language in df.columns:
        out = out.drop(language)
    return (out.withColumn(pos, F.col(pos) * F.lit(k) + F.col("_k"))
            .withColumnRenamed("_lang", language).drop("_k"))


def _digests(text: str) -> list:
    """The key of a text that joins a memory: a 64-bit hash, which sorts fast, and a SHA-256,
    which settles equality without the text (null for a null text, which so meets nothing)."""
    return [F.xxhash64(text).alias("_h"), F.unhex(F.sha2(F.col(text), 256)).alias("_s")]


def localize(df: DataFrame, memory: DataFrame, source: str = SOURCE_LANGUAGE,
             text: str = "text", language: str = "language") -> DataFrame:
    """Source-language rows pass through; the others take their
    translation from a memory ``(src_text, language, translated)``; label and
    sem_type ride along.  A row with no translation keeps a null text (D3
    lists what is missing).  Only the rows that need a translation are
    shuffled for the join, by digests of their texts alone: the rows of one
    sample then travel side by side, where the shuffle's compression meets
    what they share, and the memory's translations of a text (one a language)
    are one row.  Neither the original text of such a row nor that of the
    memory is moved, and nothing is sorted before the shuffle."""
    is_source = F.col(language).eqNullSafe(F.lit(source))
    # The memory grows with the corpus (one row per text and language) and
    # its static size estimate is far below its real size: never broadcast.
    # Several translations of one text: the smallest, so no sample is doubled.
    known = memory.where(F.col("language") != F.lit(source)).select(
        *_digests("src_text"), F.col("language").alias("_l"), "translated").where(F.col("_s").isNotNull())
    mem = (known.repartition("_h", "_s").groupBy("_h", "_s", "_l").agg(F.min("translated").alias("_tr"))
           .groupBy("_h", "_s").agg(F.collect_list(F.struct("_l", "_tr")).alias("_trs")).hint("merge"))
    others = df.filter(~is_source).select(*[c for c in df.columns if c != text], *_digests(text))
    own = F.filter("_trs", lambda x: x["_l"] == F.col(language))
    translated = others.join(mem, ["_h", "_s"], "left").withColumn(text, F.get(own, 0)["_tr"])
    return df.filter(is_source).unionByName(translated.select(*df.columns))


def pending_translations(df: DataFrame, memory: DataFrame, source: str = SOURCE_LANGUAGE,
                         text: str = "text", language: str = "language") -> DataFrame:
    """D3: distinct (text, language) pairs that still need a translation.

    Texts are gathered by their digests in one shuffle of the samples, each
    with its languages; the languages the memory has for it are taken off.
    A null text is one pending pair for its language.
    """
    need = df.filter(F.col(language) != F.lit(source)).select(
        *_digests(text), F.col(text).alias("text"), F.col(language).alias("_l"))
    texts = need.repartition("_h", "_s").groupBy("_h", "_s").agg(
        F.first("text").alias("text"), F.collect_set("_l").alias("_need"))
    mem = memory.select(*_digests("src_text"), F.col("language").alias("_l")).where(F.col("_s").isNotNull())
    mem = mem.groupBy("_h", "_s").agg(F.collect_set("_l").alias("_has")).hint("merge")
    left = F.when(F.col("_has").isNull(), F.col("_need")).otherwise(F.array_except("_need", "_has"))
    return texts.join(mem, ["_h", "_s"], "left").select("text", F.explode(left).alias("language"))


def rotating_sample(df: DataFrame, langs: Sequence[str] = LANGUAGES, pos: str = "pos",
                    language: str = "language", mode: str = "rotating") -> DataFrame:
    """Keep the row whose language is on duty.

    ``rotating`` reproduces the reference's loop exactly: the duty language
    moves on at ``pos % 6 == 5`` before the comparison, so duty is
    ``floor((pos + 1) / 6) mod 6``.  ``balanced`` gives one row per sample:
    duty is ``floor(pos / 6) mod 6``.  One filter, no shuffle.
    """
    k = len(langs)
    shift = 1 if mode == "rotating" else 0
    duty = F.pmod(F.floor((F.col(pos) + F.lit(shift)) / F.lit(k)), F.lit(k)).cast("int")
    arr = F.array(*[F.lit(x) for x in langs])
    return df.filter(F.col(language) == F.element_at(arr, duty + F.lit(1)))


def replicate(df: DataFrame, k: int, copy: str = "copy") -> DataFrame:
    """``k`` indexed copies of every row (beam expansion)."""
    return df.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def batches(df: DataFrame, size: int, order: str | None = "pos", shuffle: bool = False,
            seed: int = 0, batch: str = "batch_id", key: str = "sample_id") -> DataFrame:
    """Batch ids over the order (or a seeded shuffle); the last batch may
    be short.  Positions come from D4, never a global window."""
    if shuffle:
        # The order hangs on seed and key alone, not on the rows' layout.
        draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        ranked = with_position(df.withColumn("_r", draw), ["_r", key], name="_bpos").drop("_r")
        return ranked.withColumn(batch, F.floor(F.col("_bpos") / size).cast("long")).drop("_bpos")
    return df.withColumn(batch, F.floor(F.col(order) / size).cast("long"))


def token_budget_batches(df: DataFrame, max_tokens: int, max_sentences: int,
                         length: str = "n_tokens", key: str = "sample_id", batch: str = "batch_id",
                         num_chunks: int | None = None) -> DataFrame:
    """Batches limited by sentences and by padded tokens.

    Rows are bucketed by length (power of two) and packed greedily along
    (length, key) while ``count <= max_sentences`` and ``count * longest <=
    max_tokens``.  A single row longer than ``max_tokens`` gets a batch of its
    own.  The batch id is ``<bucket>-<k>``.  Packing runs in ordered chunks
    whose results are strung together (``packing``): the chunks' number has no
    part in the result.
    """
    # Bits of length - 1: the power of two that holds the length, in whole numbers.
    bucket = F.when(F.col(length) <= 1, F.lit(0)).otherwise(
        F.length(F.bin(F.col(length).cast("long") - 1))).cast("int")
    packed = pack(df, bucket, length, key, max_tokens, max_sentences, num_chunks)
    return df.join(packed.select(key, F.concat_ws("-", "bucket", "number").alias(batch)), key)


def shard(df: DataFrame, num_shards: int, shard_id: int, pos: str = "pos") -> DataFrame:
    """Keep one shard (rows whose position is ``shard_id`` mod ``num_shards``)."""
    return df.filter(F.pmod(F.col(pos), F.lit(num_shards)) == F.lit(shard_id))


def pair_predictions(samples: DataFrame, preds: DataFrame, key: str = "sample_id") -> DataFrame:
    """Line up prediction, reference, text and extras by sample id."""
    return samples.join(preds, key, "inner")


def unmatched_predictions(samples: DataFrame, preds: DataFrame, key: str = "sample_id") -> DataFrame:
    """Predictions with no sample (reported, not silently dropped)."""
    return preds.join(samples.select(key), key, "left_anti")


def union_splits(frames: dict[str, DataFrame], split: str = "split") -> DataFrame:
    """The same job over several splits, tagged by a literal column."""
    out = None
    for name, frame in frames.items():
        tagged = frame.withColumn(split, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def apply_splits(frames: dict[str, DataFrame], fn: Callable[[DataFrame], DataFrame],
                 split: str = "split") -> DataFrame:
    """Run ``fn`` on every split and union the results."""
    return union_splits({k: fn(v) for k, v in frames.items()}, split)
