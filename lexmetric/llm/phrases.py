"""Collocations by SON partitioning.

The corpus is cut into shards.  A phrase that stands ``min_count`` times in a
language must reach its share of that count, ``min_count`` times the shard's
part of the language's words, in one shard at least.  So every shard is mined
completely at that lower support, level by level (a phrase of k words is
counted where its first and last k - 1 words are frequent), the locally
frequent phrases are united, and one more pass counts all of them exactly.

A shard is no task: its files are read by many tasks that count 32-bit gram
hashes in bounded buffers, and a shuffle by (shard, language, gram) sums them.
The united phrases travel as a bit filter of bounded size.  Whatever the
filter or a hash lets through by mistake is counted by its words like any
other phrase, so it can cost time and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmetric.llm.common import cut
from lexmetric.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ends of a piece; all become a line feed.
STOPS = ".,;:!?\x0b\x0c\r"
#: Shards of the corpus; a locally frequent phrase stands min_count / SHARDS times in one of them.
SHARDS = 3
#: Grams a task holds before it sums them.
BUFFER_GRAMS = 4_000_000
#: Bits of the largest filter (16 MB) and bits for each phrase below that.
MAX_BITS, BITS_EACH = 2 ** 27, 64


def tokens(text: Column) -> Column:
    """Words of a text with A-Z lower-cased, and a line feed where a piece ends."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + STOPS, UPPER.lower() + "\n" * len(STOPS))
    return F.regexp_extract_all(plain, F.lit(r"\n|[^ \t\n]+"), 0)


def word_ids(lang: Column, words: Column) -> Column:
    """32-bit hashes of (language, word), 0 at the end of a piece and of the text."""
    def one(w):
        h = F.hash(lang, w)
        return F.when(w == "\n", F.lit(0)).when(h == 0, F.lit(1)).otherwise(h)
    return F.concat(F.transform(words, one), F.array(F.lit(0)))


def rolling(ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """32-bit hash and validity (inside one piece) of the j words from each place, for j = 1 to k."""
    ids = ids.view(np.uint32).astype(np.uint64)
    mixed, inside = ids, ids != 0
    for j in range(k):
        if j:
            ahead = np.zeros_like(ids)
            ahead[:max(0, len(ids) - j)] = ids[j:]
            mixed = (mixed ^ (mixed >> np.uint64(29))) + ahead
            inside = inside & (ahead != 0)
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
        yield mixed >> np.uint64(32), inside


def maybe(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether the filter may hold a gram."""
    place = grams & np.uint64(len(bits) * 64 - 1)
    return ((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def bit_filter(grams: DataFrame) -> np.ndarray:
    """Bits of the distinct grams, set in Spark: at most MAX_BITS come to the driver."""
    n = grams.count()
    size = min(MAX_BITS, max(2 ** 12, 1 << (n * BITS_EACH - 1).bit_length())) if n else 2 ** 12
    place = F.col("gram").bitwiseAND(F.lit(size - 1))
    rows = (grams.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")))
    # At most size / 64 rows.
    found = rows.toArrow()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, one after the other, and the length of each list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten(), np.diff(column.offsets.to_numpy())


def local_grams(ids: DataFrame, k: int, shorter) -> DataFrame:
    """(shard, lang, gram, c) of the phrases of k words whose first and last k - 1 words may be
    frequent, summed within a task's buffer."""
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def drain():
            for (shard, lang), parts in held.items():
                grams, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), shard, dtype=np.int32)), pa.array([lang] * len(grams), pa.string()),
                     pa.array(grams.view(np.int64)), pa.array(c.astype(np.int64))], ["shard", "lang", "gram", "c"])
            held.clear()

        for batch in batches:
            values, lengths = _flat(batch.column("ids"))
            values = values.to_numpy(zero_copy_only=False)
            gram, inside = None, None
            for j, (g, inside) in enumerate(rolling(values, k), 1):
                if j == k - 1:
                    known = inside & maybe(shorter.value, g)
                gram = g
            if k > 1:
                inside = inside & known
                inside[:-1] &= known[1:]
            pairs = list(zip(batch.column("shard").to_pylist(), batch.column("lang").to_pylist()))
            number = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
            owner = np.repeat([number[p] for p in pairs], lengths)
            for pair, i in number.items():
                got = gram[inside & (owner == i)] if len(number) > 1 else gram[inside]
                if len(got):
                    held.setdefault(pair, []).append(got)
                    size += len(got)
            if size >= BUFFER_GRAMS:
                yield from drain()
                size = 0
        yield from drain()

    return ids.select("shard", "lang", "ids").mapInArrow(mine, "shard int, lang string, gram long, c long")


def counted(texts: DataFrame, filters: list, max_words: int) -> DataFrame:
    """(lang, phrase, words, f): places of every phrase of 1 to ``max_words`` words that the
    filters may hold, counted by its words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The sums of a batch go straight on: Spark's own aggregate adds them up before the shuffle.
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                rows = batch.filter(pa.array([x == lang for x in langs]))
                ids = _flat(rows.column("ids"))[0].to_numpy(zero_copy_only=False)
                # The words stand where the ids are no ends.
                of_text = _flat(rows.column("words"))[0].dictionary_encode()
                names = of_text.dictionary.to_pylist()
                codes = np.zeros(len(ids), dtype=np.int64)
                codes[ids != 0] = of_text.indices.to_numpy(zero_copy_only=False)
                hit = np.ones(len(ids), dtype=bool)
                same, phrases = codes, names
                for k, (gram, inside) in enumerate(rolling(ids, max_words), 1):
                    hit[:-1] &= hit[1:].copy() if k > 1 else True
                    hit &= inside
                    at = np.flatnonzero(hit)
                    at = at[maybe(filters[k - 1].value, gram[at])]
                    if not len(at):
                        break
                    hit = np.zeros(len(ids), dtype=bool)
                    hit[at] = True
                    # Equal numbers are equal words: number of the phrase before, then its last word.
                    last = codes[at + k - 1]
                    which = last if k == 1 else same[at] * len(names) + last
                    _, first, inverse, c = np.unique(which, return_index=True, return_inverse=True, return_counts=True)
                    ends = last[first].tolist()
                    phrases = ([names[e] for e in ends] if k == 1 else
                               [f"{phrases[s]} {names[e]}" for s, e in zip(same[at[first]].tolist(), ends)])
                    same = np.zeros(len(ids), dtype=np.int64)
                    same[at] = inverse
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()),
                         pa.array(np.full(len(phrases), k, dtype=np.int32)), pa.array(c.astype(np.int64))],
                        ["lang", "phrase", "words", "f"])

    parts = texts.mapInArrow(count, "lang string, phrase string, words int, f long")
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _lang(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("und"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100,
                     max_words: int = 5, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases standing ``min_count`` times or more in a
    language, (lang, n) with the words of each language)."""
    spark = docs.sparkSession
    texts = docs.select(_lang(lang_col).alias("lang"), tokens(F.col(text_col)).alias("words"))
    ids = texts.select("lang", word_ids(F.col("lang"), F.col("words")).alias("ids"),
                       F.size(F.filter("words", lambda w: w != "\n")).cast("long").alias("n"),
                       (F.spark_partition_id() % shards).alias("shard"))
    path = shared_dir(spark, "phrase-ids")
    ids.write.parquet(path)
    ids = spark.read.parquet(path)
    parts = cut(ids.groupBy("shard", "lang").agg(F.sum("n").alias("part")))
    total = cut(parts.groupBy("lang").agg(F.sum("part").alias("n")).where("n > 0"))
    support = parts.join(total, "lang").select(
        "shard", "lang", F.ceil(F.col("part").cast("decimal(19,0)") * min_count / F.col("n")).alias("support"))
    filters = []
    for k in range(1, max_words + 1):
        grams = local_grams(ids, k, filters[-1] if filters else None)
        whole = grams.groupBy("shard", "lang", "gram").agg(F.sum("c").alias("c"))
        local = whole.join(support, ["shard", "lang"]).where("c >= support").select("gram").distinct()
        filters.append(spark.sparkContext.broadcast(bit_filter(cut(local))))
    split = texts.select("lang", word_ids(F.col("lang"), F.col("words")).alias("ids"),
                         F.filter("words", lambda w: w != "\n").alias("words"))
    found = cut(counted(split, filters, max_words).where(F.col("f") >= min_count))
    for bits in filters:
        bits.unpersist()
    return found, total


def _first(phrase: Column, k: Column) -> Column:
    return F.call_function("substring_index", phrase, F.lit(" "), k)


def _rest(phrase: Column, first: Column) -> Column:
    return F.substring(phrase, F.length(first) + 2, F.length(phrase))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100,
                 max_words: int = 5, top: int = 2000, covered: int = 100, shards: int = SHARDS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    The score is floor(1000 * a * n / (l * r)) at the phrase's weakest cut, in
    decimals of 38 digits.  A phrase goes when a longer one that holds it has
    ``covered`` percent of its count; the longer ones by one word tell, since a
    phrase between the two counts at least as often as the longer.

    Null texts are empty, null languages are "und"; repeated rows count as often
    as they stand; ties in score and count are in byte order; an empty table
    gives no rows.  Only the two named columns are read, so extra columns
    cannot clash.
    """
    found, total = frequent_phrases(docs, text_col, lang_col, min_count, max_words, shards)
    longer = found.where("words > 1")
    phrase = F.col("phrase")
    first = _first(phrase, F.col("k"))
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", F.col("f").alias("a"), "k", first.alias("first"), _rest(phrase, first).alias("rest"))
    left = found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    big = "cast({} as decimal(19,0))".format
    score = F.expr(f"({big('1000')} * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    scored = (cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
              .groupBy("lang", "phrase", "a", "n")
              .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("at")))
    inner = longer.where("words > 2").select("lang", F.col("f").alias("over"), F.explode(F.array(
        _first(phrase, F.col("words") - 1), _rest(phrase, _first(phrase, F.lit(1))))).alias("phrase"))
    over = inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = scored.join(over, ["lang", "phrase"], "left").where(
        F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * covered))
    order = Window.partitionBy("lang").orderBy(F.col("at.score").desc(), F.col("a").desc(), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "at.l", "at.r", "n", "at.score"))


#: The same table in DuckDB, by counting every phrase.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split(translate(text,
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13),
           'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9)), chr(10))), '[^ \t]+') AS w
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
           FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
      FROM places GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM f WHERE k > 1),
scored AS (SELECT u.lang, u.phrase, u.a, u.c, x.f AS l, y.f AS r, t.n, (1000 * u.a * t.n) // (x.f * y.f) AS score
           FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.c], ' ')
           JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.c + 1:], ' ')
           JOIN totals t ON t.lang = u.lang),
weakest AS (SELECT * FROM scored
            QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (SELECT * FROM weakest p WHERE NOT EXISTS (
           SELECT 1 FROM f q WHERE q.lang = p.lang AND q.f >= p.a AND length(q.phrase) > length(p.phrase)
             AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000"""
