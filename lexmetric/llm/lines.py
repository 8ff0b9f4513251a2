"""Line dedup by site-relative frequency.

Lines are what a page shows between block-level tags.  A line is boilerplate
on a host when the share of the host's pages that contain it exceeds a ratio.
Counting is a partial aggregate over (host, line hash), so neither a hot host
nor a hot line meets in one task; a host has at most (mean lines a page) /
ratio boilerplate lines, so they travel as one short array per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmetric.llm.common import cut
from lexmetric.operators.sizing import broadcast_if_small

#: Share of a host's pages above which a line goes, and least pages that must hold it: one page alone repeats nothing.
RATIO, MIN_PAGES = 0.5, 2

#: Tags that end a line.
_TAGS = ("address|article|aside|blockquote|body|br|button|caption|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|"
         "figure|footer|form|h[1-6]|head|header|hr|html|label|legend|li|main|menu|nav|ol|option|p|pre|section|select|"
         "summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul")
_STEPS = (("(?is)<!--.*?-->", " "), ("(?is)<script[ \t\r\n>].*?</script *>", " "), ("(?is)<style[ \t\r\n>].*?</style *>", " "),
          ("[ \t\r\n\f]+", " "), (f"(?i)</?({_TAGS})( [^>]*)?/?>", "\n"), ("<[^>]*>", ""))
#: Character references decoded, the ampersand last.
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
               ("&middot;", "·"), ("&amp;", "&"))
_HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host and port of a URL; empty for null or other texts."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def lines_of(html: Column) -> Column:
    """The shown lines of a page: tags out, references decoded, trimmed, no empty ones."""
    text = F.coalesce(html, F.lit(""))
    for pattern, put in _STEPS:
        text = F.regexp_replace(text, pattern, put)
    for name, put in _REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(put))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def dedup(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped, text (kept lines).

    Null and empty pages have no lines; pages without a host are one site of
    the empty name; repeated rows are pages of their own; a line counts once a
    page; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        lines_of(F.col(html_col)).alias("lines"))
    seen = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("h"))
    # Only lines that some page shares go on; totals per host are a small table of their own.
    counts = seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = broadcast_if_small(cut(pages.select(host_of(F.col(url_col)).alias("host")).groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"))))
    bad = counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(
        F.collect_list("h").alias("bad"))
    out = rows.join(broadcast_if_small(cut(bad)), "host", "left").withColumn(
        "kept", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(
            F.filter("lines", lambda x: ~F.array_contains(F.col("bad"), F.xxhash64(x)))))
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
                      F.array_join("kept", "\n").alias("text"))


def dedup_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same in DuckDB SQL over ``pages``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = "coalesce(html, '')"
    for pattern, put in _STEPS:
        escaped = "chr(10)" if put == "\n" else q(put)
        text = f"regexp_replace({text}, {q(pattern)}, {escaped}, 'g')"
    for name, put in _REFERENCES:
        text = f"replace({text}, {q(name)}, {q(put)})"
    return f"""
WITH r AS (SELECT row_number() OVER () AS rid, page_id,
                  lower(regexp_extract(coalesce(url, ''), {q(_HOST)}, 1)) AS host,
                  list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls
           FROM pages),
t AS (SELECT host, count(*) AS pages FROM r GROUP BY host),
c AS (SELECT host, l, count(*) AS n FROM (SELECT host, unnest(list_distinct(ls)) AS l FROM r) GROUP BY ALL
      HAVING count(*) >= {min_pages}),
b AS (SELECT c.host, list(l) AS bad FROM c JOIN t USING (host) WHERE n > {ratio} * pages GROUP BY c.host),
k AS (SELECT r.page_id, r.host, ls, CASE WHEN bad IS NULL THEN ls
             ELSE list_filter(ls, lambda x: NOT list_contains(bad, x)) END AS kept FROM r LEFT JOIN b USING (host))
SELECT page_id, host, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text FROM k"""
