"""Mixing sources to target weights (Efraimidis-Spirakis sampling).

Targets per source come from one small table (a row per source) by water
filling; documents draw exponential keys -ln(u)/w, are ordered by key inside
their source and prefix-summed up to the source's token budget.  Whole epochs
come first: a source whose target is q times its size plus a rest takes every
document q times and the rest by key order.

The prefix sum never brings a source into one task: keys fall into slices of
about ``SLICE_ROWS`` rows, slice totals are summed in a small table, and the
window runs inside (source, slice).  Results do not depend on the slicing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmetric.llm.common import WORD, cut
from lexmetric.operators.sizing import broadcast_if_small

SLICE_ROWS = 100_000
_U_SCALE = float(2 ** 52)


def quality_weight(text: Column) -> Column:
    """Weight of a text in [0.25, 1]: a quarter plus three quarters of the
    share of code points that are neither ASCII digits nor ASCII symbols."""
    n = F.length(text)
    plain = F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", ""))
    return F.when(n > 0, F.lit(0.25) + F.lit(0.75) * plain / n).otherwise(F.lit(0.25))


def source_targets(per_source: DataFrame, weights=(1, 2, 3), share: float = 1.0,
                   max_epochs: int = 3) -> DataFrame:
    """Targets of sources given (source, source_size): sources in code point
    order (null last) weigh ``weights`` repeating and share ``share`` of all
    sizes; a target stops at ``max_epochs`` times its source's size and the
    excess goes to the others by weight.

    Water filling in closed form: in order of cap / weight the capped sources
    are a prefix, and the level is the budget left over the weight left at the
    first source that its share does not fill.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    # One row per source, so these windows hold as many rows as there are sources.
    ranked = per_source.select(
        "source", "source_size",
        F.element_at(w, (F.row_number().over(Window.orderBy(
            F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).alias("weight"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) * F.lit(float(share))
              - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    filled = ranked.withColumn("cap", cap).withColumn("level", level)
    filled = filled.withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    top = F.max(F.when(F.col("open"), F.col("level"))).over(whole)
    return filled.select(
        "source", "source_size",
        F.when(F.col("open"), F.coalesce(top, F.lit(0.0)) * F.col("weight"))
        .otherwise(F.col("cap")).alias("target"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", seed: int = 17) -> DataFrame:
    """(doc_id, source, size, draw, tie): words, exponential key and text digest.

    The only pass over the texts; everything after it is narrow."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 13),
        16, 10).cast("double") + 0.5) / F.lit(_U_SCALE)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (-F.log(u) / quality_weight(text)).alias("draw"), F.md5(text).alias("tie"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=(1, 2, 3), share: float = 1.0,
        max_epochs: int = 3, seed: int = 17, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, tie.

    Null or empty texts have size 0 and are taken once per whole epoch of
    their source (0 words).  Null sources are one source, last in order.  Null
    ids draw as the text "null".  Repeated rows stand and fall together: they
    have one key and one prefix (RANGE frame).  An empty table gives no rows.
    Only the three named columns are read, so extra columns cannot clash.
    """
    rows = cut(measured(docs, id_col, text_col, source_col, seed)
               .withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))))
    stats = cut(rows.groupBy("skey", "source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")))
    goals = source_targets(stats.select("source", "source_size"), weights, share, max_epochs)
    goals = goals.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
        "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(F.lit(0)).cast("long").alias("epochs"))
    goals = stats.select("skey", (F.lit(1) + F.floor(F.col("n_rows") / slice_rows))
                         .alias("n_slices")).join(goals, "skey")
    goals = broadcast_if_small(cut(goals))
    sliced = rows.join(goals, "skey").withColumn(
        "slice", F.least(F.col("n_slices") - 1, F.floor(
            (F.lit(1.0) - F.exp(-F.col("draw"))) * F.col("n_slices"))))
    totals = sliced.groupBy("skey", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = totals.select("skey", "slice", F.coalesce(F.sum("slice_size").over(
        Window.partitionBy("skey").orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ahead = broadcast_if_small(cut(ahead))
    prefix = F.sum("size").over(Window.partitionBy("skey", "slice").orderBy(
        "draw", F.struct("doc_id", "tie")).rangeBetween(
            Window.unboundedPreceding, Window.currentRow)) + F.col("ahead")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    # The document on the border is taken when its middle lies inside the budget.
    extra = (F.col("prefix") - F.col("size") / 2.0 < rest) & (F.col("size") > 0)
    return (sliced.join(ahead, ["skey", "slice"]).withColumn("prefix", prefix)
            .withColumn("copies", F.col("epochs") + extra.cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken"), "tie"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it."""
    id_col = options.get("id_col", "doc_id")
    text_col, source_col = options.get("text_col", "text"), options.get("source_col", "source")
    plan = cut(mix(docs, **options).where("copies > 0").select(
        "doc_id", "source", "tie", "copies").distinct())
    # The row travels as one column, so its names cannot clash with ours.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("row_id"),
                       F.col(source_col).cast("string").alias("row_source"),
                       F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("row_tie"))
    hit = (F.col("row_id").eqNullSafe(F.col("doc_id")) & F.col("row_source").eqNullSafe(F.col("source"))
           & (F.col("row_tie") == F.col("tie")))
    return (rows.join(plan, hit).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("row.*"))


MIX_SQL = r"""
WITH m AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)
               AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u,
         CASE WHEN length(coalesce(text, '')) > 0
              THEN 0.25 + 0.75 * length(regexp_replace(text, '[!-@\[-`{-~]', '', 'g')) / length(text)
              ELSE 0.25 END AS w,
         md5(coalesce(text, '')) AS tie
  FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS ssize,
             CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
      FROM m GROUP BY source),
l AS (SELECT *, 3.0 * ssize AS cap,
             (sum(ssize) OVER () - coalesce(sum(3.0 * ssize) OVER (
                ORDER BY 3.0 * ssize / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY 3.0 * ssize / weight, source NULLS LAST
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM s),
g AS (SELECT source, ssize,
             CASE WHEN cap > lev * weight
                  THEN coalesce(max(CASE WHEN cap > lev * weight THEN lev END) OVER (), 0.0) * weight
                  ELSE cap END AS target
      FROM l),
p AS (SELECT m.*, g.ssize, g.target,
             CASE WHEN g.ssize > 0 THEN floor(g.target / g.ssize) ELSE 0 END AS ep,
             sum(size) OVER (PARTITION BY m.source ORDER BY -ln(u) / w, m.doc_id, tie) AS prefix
      FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, CAST(ep + CASE WHEN prefix - size / 2.0 < target - ep * ssize AND size > 0
                               THEN 1 ELSE 0 END AS BIGINT) AS copies FROM p)
"""
