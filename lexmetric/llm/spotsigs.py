"""Document fingerprints (SpotSigs).

A spot signature is a common word (anchor) together with the chain of the
next content words after it; a document's fingerprint is the set of its
signatures.  Two fingerprints are compared by Jaccard likeness, pruned by
length: the smaller set over the larger bounds the likeness from above, so
sets whose lengths lie apart are never intersected.  All expressions are
Spark's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmetric.llm.common import let, partitions

#: Anchors, the commonest short words of four languages.
ANCHORS = tuple("""
the of and to in is a for that with as on are by be this at was or an it from not he his
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es
le la les de et en un une du que qui dans est pour par sur au pas avec ce il
el los las que y del se por con no su para al lo como más o pero sus
""".split())
#: Content words in a chain.
CHAIN = 3


def _tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def signatures(text: Column, chain: int = CHAIN, anchors=ANCHORS) -> Column:
    """Sorted distinct 32-bit signatures of a text.

    A run of anchors counts as its last one.  A text with words but without a
    full chain has the one signature of all its words; null, empty and
    wordless texts have none.
    """
    stop = list(dict.fromkeys(anchors))

    def content(words):
        # "anchor<SOH>word" after an anchor, "<SOH>word" otherwise; anchors drop out.
        return F.filter(F.transform(words, lambda w, i: F.when(
            (w != "") & ~w.isin(stop), F.concat(
                F.when((i > 0) & F.get(words, i - 1).isin(stop), F.get(words, i - 1))
                .otherwise(F.lit("")), F.lit("\u0001"), w))), lambda x: x.isNotNull())

    def chains(marked):
        def one(i):
            follow = [F.substring_index(F.get(marked, i + k), "\u0001", -1) for k in range(1, chain)]
            return F.when(~F.get(marked, i).startswith("\u0001"),
                          F.hash(F.get(marked, i), *follow))
        return F.when(F.size(marked) >= chain, F.filter(
            F.transform(F.sequence(F.lit(0), F.size(marked) - chain), one),
            lambda h: h.isNotNull())).otherwise(F.array().cast("array<int>"))

    def of(words):
        found = let(content(words), chains)
        return let(F.struct(found.alias("f"), F.array_remove(words, "").alias("w")),
                   lambda x: F.when((F.size(x["f"]) == 0) & (F.size(x["w"]) > 0),
                                    F.array(F.hash(F.array_join(x["w"], " ")))).otherwise(x["f"]))
    return F.array_sort(F.array_distinct(let(_tokens(F.coalesce(text, F.lit(""))), of)))


def render(sigs: Column) -> Column:
    """A fingerprint as text: eight hex digits per signature, in order."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.hex(
        F.pmod(h.cast("long"), F.lit(2 ** 32))), 8, "0")), "")


def length_partition(n: Column, threshold: float = 0.8) -> Column:
    """Partition of a set length: sets of likeness ``threshold`` or more lie in
    the same partition or in neighbours."""
    return F.when(n > 0, F.floor(F.log(n) / F.lit(-math.log(threshold)) + 1e-9)).otherwise(-1).cast("int")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard of two fingerprints; 1 for two empty ones.  Pairs whose lengths
    alone keep them under ``floor`` are 0 without being intersected; disjoint
    value ranges are 0 as well."""
    def both(x):
        low = F.least(F.size(x["a"]), F.size(x["b"])).cast("double")
        high = F.greatest(F.size(x["a"]), F.size(x["b"])).cast("double")
        same = F.size(F.array_intersect(x["a"], x["b"])).cast("double")
        return (F.when(high == 0, 1.0).when((low == 0) | (low < floor * high), 0.0)
                .when((F.array_min(x["a"]) > F.array_max(x["b"]))
                      | (F.array_min(x["b"]) > F.array_max(x["a"])), 0.0)
                .otherwise(let(same, lambda s: s / (low + high - s))))
    return let(F.struct(a.alias("a"), b.alias("b")), both)


def near_pairs(prints: DataFrame, threshold: float = 0.8, id_col: str = "doc_id",
               sigs_col: str = "sigs") -> DataFrame:
    """(a, b, likeness) of all fingerprint classes with likeness >= threshold, a < b.

    Rows are classes of equal fingerprints already.  Each goes to its length
    partition and the next; pairs meet on one of the first signatures (rarest
    first) that sets of that likeness must share, then the length bound and
    the exact Jaccard decide.  Empty fingerprints pair with nothing.
    """
    p = prints.select(F.col(id_col).alias("id"), F.col(sigs_col).alias("sigs")).where(F.size("sigs") > 0)
    df = p.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rare = (p.select("id", F.explode("sigs").alias("s")).join(df, "s").where("df > 1")
            .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o")))
    n = F.size("sigs")
    # Signatures of frequency 1 come first in the order and match nothing.
    keyed = p.join(rare, "id").select(
        "id", "sigs", length_partition(n, threshold).alias("part"),
        F.expr(f"slice(o, 1, greatest(0, size(sigs) - cast(ceil({threshold} * size(sigs)) as int) + 1"
               " - (size(sigs) - size(o))))").alias("head"))
    keyed = keyed.select("id", "sigs", "part", F.explode("head.s").alias("s"))
    right = keyed.select(F.col("id").alias("rid"), F.col("sigs").alias("rs"), "s",
                         F.explode(F.array(F.col("part"), F.col("part") + 1, F.col("part") - 1)).alias("part"))
    hit = keyed.join(right, ["part", "s"]).where("id < rid")
    low, high = F.least(F.size("sigs"), F.size("rs")), F.greatest(F.size("sigs"), F.size("rs"))
    return (hit.where(low >= F.lit(threshold) * high).dropDuplicates(["id", "rid"])
            .select(F.col("id").alias("a"), F.col("rid").alias("b"),
                    likeness(F.col("sigs"), F.col("rs"), threshold).alias("likeness"))
            .where(F.col("likeness") >= threshold))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              n_buckets: int | None = None) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): each document with the next
    one by descending id, the first after the last; nulls are the last ids and
    equal ids follow by text.

    One shuffle of the texts.  Ids are cut at values that occur, so the
    largest id of each bucket is its bound; that row is sent to the bucket
    above as well, where it follows the bucket's smallest id.  The bounds are
    at most ``n_buckets`` numbers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = n_buckets or 2 * partitions(docs)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n + 1)], 100 * n)
                    .alias("q"), F.max("doc_id").alias("top")).first()
    bounds = sorted({int(x) for x in (cuts["q"] or [])} | ({int(cuts["top"])} if cuts["top"] is not None else set()))
    # Bucket k holds the ids up to bounds[k - 1], the first one null ids as well.
    if bounds:
        above = F.array(*[F.lit(b).cast("long") for b in bounds])
        mine = F.when(F.col("doc_id").isNull(), 1).otherwise(
            F.size(F.filter(above, lambda b: b < F.col("doc_id"))) + 1)
        is_bound = F.coalesce(F.array_contains(above, F.col("doc_id")), F.lit(False))
        # The largest id closes the circle below the smallest bucket.
        target = F.when(F.col("doc_id") == bounds[-1], F.lit(1)).otherwise(F.col("bucket") + 1)
    else:
        mine, is_bound, target = F.lit(0), F.lit(False), F.lit(0)
    placed = rows.withColumn("bucket", mine.cast("int"))
    # A border row goes to two buckets; "after" sorts its second copy behind the bucket's own rows.
    copies = F.when(is_bound, F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("after")),
        F.struct(target.cast("int").alias("bucket"), F.lit(1).alias("after")))
    ).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("after"))))
    dealt = (placed.withColumn("to", F.explode(copies))
             .select("doc_id", "text", F.col("to.bucket").alias("bucket"), F.col("to.after").alias("after"))
             .repartition(partitions(docs), "bucket")
             .withColumn("sigs", signatures(F.col("text"))))
    order = Window.partitionBy("bucket").orderBy("after", F.col("doc_id").desc_nulls_last(), "text")
    first = Window.partitionBy("bucket").orderBy("after", F.col("doc_id").desc_nulls_last(), "text") \
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = dealt.select(
        "*", F.lead("text").over(order).alias("t"), F.lead("sigs").over(order).alias("s"))
    if not bounds:  # ids are all null: one bucket, its first row follows its last
        seen = dealt.select("*", F.coalesce(F.lead("text").over(order), F.first("text").over(first)).alias("t"),
                            F.coalesce(F.lead("sigs").over(order), F.first("sigs").over(first)).alias("s"))
    # Without a follower (a border id on several rows): the document itself.
    return seen.where("after = 0").select(
        "doc_id", "text", "sigs", F.coalesce("t", "text").alias("next_text"),
        F.coalesce("s", "sigs").alias("next_sigs"))


def edited(text: Column, follower: Column) -> Column:
    """The last floor(n/2) code points replaced by the follower's first as many."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half),
                    F.substring(follower, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited form, with their likeness
    and the likeness to the next document's.

    Null texts count as empty (empty fingerprint, n_chars 0); null ids sort
    last; repeated rows follow each other; one document alone is its own next;
    an empty table gives no rows; other columns are not read.
    """
    rows = with_next(docs, id_col, text_col)
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("esigs", signatures(F.col("edit")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edit"), 256).alias("edited_sha256"),
        render(F.col("sigs")).alias("fingerprint"), render(F.col("esigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("esigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        length_partition(F.size("sigs")).alias("length_partition"))
