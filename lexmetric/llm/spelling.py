"""Spelling variants by permuterm rotations.

A word marked with a terminator, w$, has one rotation per code point.  The
rotation that ends in code point c of w = x c y is y$xc: all rotations that
begin with y$x and skip the last code point are words that differ from w in c
alone, and the whole rotation y$x is the word without c.  So one sort of the
rotations by prefix puts every replacement, insertion and deletion side by
side, in groups of one row per letter: a group cannot outgrow the alphabet,
whatever the words.  Groups are scanned for counts and their commonest word;
no pairs are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmetric.llm.common import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of the word rule once A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
#: Ends a word; no letter of the word rule.
MARK = "$"
#: A run loses one code point where this divides its checksum.
SLIP = 199


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, run): every letter run of every text, A-Z lower-cased."""
    low = F.translate(F.col(text_col), UPPER, UPPER.lower())
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(low, F.lit(RUN), 0)).alias("run"))


def slipped(doc: Column, run: Column, every: int = SLIP) -> Column:
    """``run``, without one code point where the checksum of ``doc:run`` says so."""
    h = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
                  ).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6,
                min_count: int = 5, every: int = SLIP) -> DataFrame:
    """(word, n) of the corpus; counts are summed where the texts are read, before the shuffle."""
    runs = letter_runs(docs, id_col, text_col)
    words = runs.select(slipped(F.col("doc"), F.col("run"), every).alias("word"))
    return (words.where(F.length("word") >= min_chars).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, n, first): a row per word and prefix it falls under.

    For each code point c of x c y: prefix y$x, skipped c.  For each gap of x y:
    the whole rotation y$x, skipped ''.  ``first`` marks the first of a run of
    equal letters, since leaving out any of them gives the same word.
    """
    w, n = F.col("word"), F.length("word")
    both = words.select("word", "n", F.explode(F.sequence(F.lit(0), n)).alias("at"))
    head = F.substring(w, F.lit(1), F.col("at"))
    letter = F.substring(w, F.col("at") + 1, F.lit(1))
    tail = F.substring(w, F.col("at") + 2, n)
    whole = F.struct(F.concat(F.substring(w, F.col("at") + 1, n), F.lit(MARK), head).alias("prefix"),
                     F.lit("").alias("skipped"), F.lit(False).alias("first"))
    skip = F.struct(F.concat(tail, F.lit(MARK), head).alias("prefix"), letter.alias("skipped"),
                    (letter != F.substring(w, F.col("at"), F.when(F.col("at") > 0, 1).otherwise(0))).alias("first"))
    rows = F.when(F.col("at") < n, F.array(whole, skip)).otherwise(F.array(whole))
    return both.select("n", F.inline(rows))


def unrotate(prefix: Column, letter: Column) -> Column:
    """The word x c y of prefix y$x and skipped code point c."""
    return F.concat(F.substring_index(prefix, MARK, -1), letter, F.substring_index(prefix, MARK, 1))


def neighbours(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n_near, form, form_n) for words with a near word, from words (word, n).

    Under one prefix all words are near one another.  A form is the group's
    commonest word (ties: the smallest); where that is the word itself none of
    the others can be ``times`` as frequent, so one minimum per group is enough.
    """
    group = Window.partitionBy("prefix")
    rows = rotations(words).withColumn("word", unrotate(F.col("prefix"), F.col("skipped")))
    skips = F.col("skipped") != ""
    seen = rows.select(
        "word", "n", "first", skips.alias("skips"),
        F.count(F.lit(1)).over(group).alias("members"),
        F.count(F.when(~skips, 1)).over(group).alias("wholes"),
        F.count(F.when(F.col("first"), 1)).over(group).alias("firsts"),
        F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"))).over(group).alias("best")
    ).where("members > 1")
    near = F.when(F.col("skips"), F.col("members") - F.col("wholes") - 1
                  + F.when(F.col("first"), F.col("wholes")).otherwise(0)).otherwise(F.col("firsts"))
    better = F.when(-F.col("best.less") >= F.col("n") * times, F.col("best"))
    return seen.groupBy("word").agg(F.sum(near).cast("long").alias("n_near"), F.min(better).alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from forms (word, form): pointers are doubled until none moves.

    A form is several times as frequent as its word, so chains are as long as
    the logarithm of the largest count, and rounds as the logarithm of that.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        now = cut(now.join(onward, "root", "left"))
        if not now.where("onward IS NOT NULL").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", F.coalesce("onward", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6,
             min_count: int = 5, times: int = 5, every: int = SLIP) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Null and empty texts hold no words; a null id counts as the text "null";
    repeated rows count as often as they stand; of equally frequent near words
    the smallest in code-point order is the form; words without a near word
    have n_near 0 and are their own root.  An empty table gives no rows.  Only
    the two named columns are read, so extra columns cannot clash.
    """
    words = cut(count_words(docs, id_col, text_col, min_chars, min_count, every))
    near = cut(neighbours(words, times))
    last = roots(near.where("form IS NOT NULL"))
    return (words.join(near, "word", "left").join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


#: The same table in DuckDB, with CRC-32 spelled out byte by byte and near words found
#: by the words that are left when one code point goes.
VARIANTS_SQL = r"""
WITH RECURSIVE
crc AS (SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x:
                 CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
        FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
         FROM documents),
occ AS (SELECT run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)) AS hx
        FROM runs GROUP BY doc_id, run),
sums AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hx) // 2),
             lambda i: CAST('0x' || substr(hx, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
             lambda s, b: xor(s >> 8, t[CAST(xor(s, b) & 255 AS BIGINT) + 1])), 4294967295) AS h
         FROM occ, crc),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
            SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                           ELSE run END AS word FROM sums)
          WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
         FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i
           AND a.word <> b.word
         UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
         UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
         FROM near GROUP BY word, n),
forms AS (SELECT word, other AS form, other_n AS form_n FROM best WHERE other_n >= 5 * n),
walk(word, now) AS (SELECT word, form FROM forms
                   UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON w.now = f.word),
roots AS (SELECT word, now FROM walk WHERE now NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(r.now, w.word) AS root, w.n,
       coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)"""
