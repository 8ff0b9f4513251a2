"""Sources and sinks.

Tab-separated samples, line-aligned side files, JSON prediction batches,
encoded lines, reports and vector text files.  Readers take explicit schemas
(never inferred); writers never trim whitespace, and quoted fields use the
doubled-quote dialect so texts with tabs, quotes and newlines round-trip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmetric.operators.lookup import lookup
from lexmetric.operators.sequence import running
from lexmetric.operators.sizing import broadcast_if_small
from lexmetric.session import materialize, shuffles_freed, staged
from lexmetric.sources.splits import numbered_lines, quoted_records, scan_lines, strict_fields

SAMPLE_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("sem_type", T.StringType()),
])

TRANSLATED_FIELDS = ("idx", "text", "label", "sem_type", "language")

_TSV = {"sep": "\t", "quote": '"', "escape": '"', "multiLine": "true",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# A bare empty field reads as null, a quoted one as the empty text: the marker
# is a text that no field holds, else Spark takes both for null.
_TSV_RECORD = {**{k: v for k, v in _TSV.items() if k != "multiLine"}, "nullValue": "\x00"}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table spread over at least the session's default parallelism.

    When the files give fewer scan splits than cores (one large row group is
    one task), the rows are spread round-robin once, so the text work after
    the scan (splitting, exploding, partial aggregation) runs on every core.
    On a cluster the files give thousands of splits and this is a no-op.
    """
    df = spark.read.format(fmt).load(path)
    try:
        want = spark.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - remote session: leave the scan as it is
        return df
    return df.repartition(want) if have < want else df


def _parsed(spark: SparkSession, path: str, schema: T.StructType, header: bool, source_file: str | None) -> DataFrame:
    """Fields of quoted records; every split of a file is read by its own task."""
    records = quoted_records(spark, path)
    if header:      # the first record of every file
        records = records.where((F.col("block") != 0) | (F.col("n") != 0))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    fields = F.from_csv("record", ddl, _TSV_RECORD)
    named = [F.col("path").alias(source_file)] if source_file else []
    return records.select(fields.alias("_r"), *named).select("_r.*", *([source_file] if source_file else []))


def read_samples(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_SCHEMA,
                 source_file: str | None = None) -> DataFrame:
    """A1: headerless three-column TSV (text, label, sem_type); fields may hold
    quoted tabs, quotes and line feeds, and large files are read in many tasks.
    ``source_file`` names a column for the path of each row's file."""
    return _parsed(spark, path, schema, header=False, source_file=source_file)


def read_translated(spark: SparkSession, path: str, source_file: str | None = None) -> DataFrame:
    """A2: TSV with a header whose first (index) column has no name; it
    becomes ``idx BIGINT``.  Read as A1."""
    schema = T.StructType([T.StructField("idx", T.LongType())] +
                          [T.StructField(c, T.StringType()) for c in TRANSLATED_FIELDS[1:]])
    return _parsed(spark, path, schema, header=True, source_file=source_file)


def write_samples(df: DataFrame, path: str, index: str = "pos",
                  cols: Sequence[str] = TRANSLATED_FIELDS[1:], mode: str = "errorifexists",
                  compression: str = "none") -> None:
    """TSV with a header and the index column first, in index order.

    The index column has an empty name.  An empty text is written as a quoted
    empty field and a null as a bare one, so both come back as they were.
    ``compression`` (say gzip) is that of the part files; all readers here take
    them, one task a file.  The rows are staged before they are ordered.
    """
    rows = staged(df.select(index, *[c for c in cols if c != index]))
    out = rows.repartitionByRange(F.col(index)).sortWithinPartitions(index)
    with shuffles_freed(df.sparkSession):
        (out.select(F.col(index).alias(""), *cols).write.mode(mode)
         .options(**_TSV).option("header", "true").option("compression", compression).csv(path))


def write_headerless(df: DataFrame, path: str, cols: Sequence[str] = ("text", "label", "sem_type"),
                     mode: str = "errorifexists") -> None:
    """A1's file form: no header, no index."""
    df.select(*cols).write.mode(mode).options(**_TSV).option("header", "false").csv(path)


def rebuild_output(df: DataFrame, path: str, writer=None) -> None:
    """Drop the prepared data at ``path`` and write it again (as zstd
    Parquet, unless ``writer`` does it)."""
    if writer is None:
        with shuffles_freed(df.sparkSession):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        writer(df, path, mode="overwrite")


def read_lines(spark: SparkSession, path: str, value: str = "line", pos: str = "pos") -> DataFrame:
    """Lines of text files with their 0-based position in file order.

    Files are ordered by name.  A line's position is the number of lines in the
    splits before its own plus its place there, so no text is sorted.
    """
    return numbered_lines(spark, path, value, pos)


def write_lines(df: DataFrame, path: str, line: str = "line", order: str = "pos",
                mode: str = "errorifexists", compression: str = "none") -> None:
    """One line per row in ``order`` (range-partitioned, so part files follow
    the order and no single task sorts everything); ``compression`` as in A7."""
    _write_text(df.select(order, line).repartitionByRange(F.col(order)), path, line, order, mode, compression)


def _write_text(ranged: DataFrame, path: str, line: str, order: str, mode: str, compression: str) -> None:
    with shuffles_freed(ranged.sparkSession):
        (ranged.sortWithinPartitions(order).select(line).write.mode(mode)
         .option("compression", compression).text(path))


def read_strict_tsv(spark: SparkSession, path: str, fields: Sequence[str] = TRANSLATED_FIELDS,
                    header: bool = True, on_bad: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """A3: split every line on tab and demand exactly ``len(fields)`` fields.

    Returns ``(good, bad)``: bad lines go to a quarantine frame with their raw
    text.  ``on_bad="raise"`` fails as the reference does when any line is
    bad (one short job that stops at the first bad line).  Every line is
    stripped before it is split.  A file's first line is its header, and
    skipped, when its names after the first are ``fields[1:]`` (the index
    column may be nameless); the same line further down is data.
    """
    # The stripped header of a nameless index has one field less.
    lines = strict_fields(scan_lines(spark, path), fields[1:] if header else None)
    ok = F.col("n_fields") == F.lit(len(fields))
    good = lines.filter(ok).select(F.split("value", "\t", -1).alias("_parts")).select(
        *[F.element_at("_parts", i + 1).alias(f) for i, f in enumerate(fields)])
    bad = lines.filter(~ok).select(F.col("value").alias("raw"), "n_fields")
    if on_bad == "raise":
        first = bad.limit(1).collect()
        if first:
            raise ValueError(f"line with {first[0]['n_fields']} fields, expected {len(fields)}: "
                             f"{first[0]['raw'][:200]!r}")
    return good, bad


def write_plain_tsv(df: DataFrame, path: str, fields: Sequence[str] = TRANSLATED_FIELDS,
                    order: str = "idx", mode: str = "errorifexists", compression: str = "none") -> None:
    """A3's file form: fields joined by tab with no quoting, header first.  The
    lines are staged before they are ordered."""
    spark = df.sparkSession
    head = spark.createDataFrame([(-1, "\t".join(fields))], f"{order} long, line string")
    body = df.select(F.col(order).cast("long").alias(order),
                     F.concat_ws("\t", *[F.col(f).cast("string") for f in fields]).alias("line"))
    write_lines(head.unionByName(staged(body)), path, order=order, mode=mode, compression=compression)


def scan_dir(spark: SparkSession, directory: str, name_contains: str, reader) -> DataFrame:
    """A4: read every entry of ``directory`` whose name contains a word.

    The word becomes a path glob, so unmatched files are never listed into
    the scan; ``source_file`` tells which entry each row came from (``reader``
    takes the column's name under that keyword).
    """
    pattern = f"{directory.rstrip('/')}/*{name_contains}*"
    return reader(spark, pattern, source_file="source_file")


def read_parallel_lines(spark: SparkSession, paths: Sequence[str],
                        names: Sequence[str] | None = None) -> DataFrame:
    """A5: line-aligned files side by side; stops at the shortest (an inner
    join on line position)."""
    names = list(names or [f"line{i}" for i in range(len(paths))])
    out = None
    for p, n in zip(paths, names):
        side = read_lines(spark, p, value=n)
        out = side if out is None else out.join(side, "pos")
    return out


def write_prediction_batches(df: DataFrame, path: str, batch: str = "batch_id",
                             pos: str = "pos", fields: Sequence[str] = ("text", "label", "generated"),
                             mode: str = "errorifexists", cumulative: bool = False,
                             compression: str = "none") -> None:
    """One JSON array per batch per line, batches in order; ``compression`` as in A7.

    A batch is bounded by the batch size, so collecting it is bounded.  Rows are
    dealt by ranges of batches and gathered where they then lie: one shuffle.
    ``cumulative`` writes the monolingual file form, whose line k repeats the
    batches before it: its size is quadratic in the batches by definition, so
    it is for files of few batches.
    """
    if cumulative:
        last = df.agg(F.max(batch).alias("_last"))
        df = df.join(F.broadcast(last)).withColumn(batch, F.explode(F.sequence(F.col(batch), F.col("_last"))))
    arr = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), *[F.col(f) for f in fields]))),
        lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    ranged = df.select(batch, pos, *fields).repartitionByRange(F.col(batch))
    lines = ranged.groupBy(batch).agg(F.to_json(arr).alias("line"))
    _write_text(lines, path, "line", batch, mode, compression)


def read_prediction_batches(spark: SparkSession, path: str,
                            fields: Sequence[str] = ("text", "label", "generated"),
                            cumulative: bool = False) -> DataFrame:
    """A8 reader: explode each JSON array line back into rows; ``pos`` is the
    row's place in the whole file (rows of the lines before it plus its own).
    Lines that are no JSON array are in ``malformed_prediction_lines``.

    ``cumulative`` reads the monolingual file form where line k repeats
    batches 1..k: every line gives the rows it adds to the line before, so
    ``batch_id`` is the line a row came with, and no task parses the whole.
    The read fails if a line does not begin with the rows of the one before it.
    """
    lines = read_lines(spark, path, value="line", pos="line_no")
    if cumulative:
        lines = _added_rows(lines)
    parsed = lines.select(F.col("line_no").alias("batch_id"), _prediction_rows(fields).alias("_rows"))
    # Two numbers a line; the lines themselves are not moved to meet them.
    sizes = materialize(parsed.select("batch_id", F.greatest(F.size("_rows"), F.lit(0)).alias("_n")))
    offsets = materialize(running(sizes, None, ["batch_id"], {"_off": ("sum", "_n")}, exclusive=True).drop("_n"))
    rows = parsed.join(broadcast_if_small(offsets), "batch_id").select(
        "batch_id", "_off", F.posexplode("_rows").alias("_i", "r"))
    return rows.select("batch_id", "r.*", (F.coalesce("_off", F.lit(0)) + F.col("_i")).cast("long").alias("pos"))


def _added_rows(lines: DataFrame) -> DataFrame:
    """Of every line of a growing file, the JSON array of the rows it adds.

    Length and digest of the line before decide where the addition begins and
    whether the repetition is true; no line meets another, and only additions
    (together one file's last line) are written to the shared folder."""
    opened = F.regexp_replace("line", r"\]\s*$", "")
    before = lines.select((F.col("line_no") + 1).alias("line_no"), F.length(opened).alias("_len"),
                          F.sha2(opened, 256).alias("_sha"))
    joined = lookup(lines, before, "line_no")
    tail = F.ltrim(F.expr("substring(line, _len + 1)"))
    first, none_yet = F.col("_len").isNull(), F.col("_len") == 1
    true = (F.sha2(F.expr("substring(line, 1, _len)"), 256) == F.col("_sha")) & (
        none_yet | F.substring(tail, 1, 1).isin(",", "]"))
    added = F.when(first, F.col("line")).otherwise(F.concat(F.lit("["), F.regexp_replace(tail, "^,", "")))
    parts = materialize(joined.select("line_no", added.alias("line"), (first | true).alias("_true")))
    if parts.where(~F.col("_true")).limit(1).count():
        raise ValueError("not a growing prediction file: a line does not repeat the one before it")
    return parts.drop("_true")


def _prediction_rows(fields: Sequence[str]):
    elem = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return F.from_json("line", T.ArrayType(elem))


def malformed_prediction_lines(spark: SparkSession, path: str,
                               fields: Sequence[str] = ("text", "label", "generated")) -> DataFrame:
    """A8 quarantine: the lines that ``read_prediction_batches`` cannot parse."""
    return (spark.read.text(path).withColumnRenamed("value", "line")
            .filter(_prediction_rows(fields).isNull()))


def write_encoded(df: DataFrame, path: str, line: str = "line", pos: str = "pos",
                  mode: str = "errorifexists") -> None:
    """One encoded line per sample, in input order."""
    write_lines(df, path, line=line, order=pos, mode=mode)


def write_report(lines: DataFrame, path: str, line_no: str = "line_no") -> None:
    """A10: the text report; refuses to overwrite an existing report."""
    write_lines(lines.select(line_no, "line"), path, order=line_no, mode="errorifexists")


def read_vectors_text(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``token v1 ... vdim`` lines -> ``(token, vec ARRAY<DOUBLE>)``;
    lines without exactly ``dim`` numbers are in ``malformed_vector_lines``."""
    return _vector_lines(spark, path).filter(_whole_vector(dim)).select("token", "vec")


def malformed_vector_lines(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """A12 quarantine: lines with another count of values, or with a value
    that is no number."""
    return _vector_lines(spark, path).filter(~_whole_vector(dim)).select("value")


def _vector_lines(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.col("value"), " ")
    return spark.read.text(path).select(
        "value", F.element_at(parts, 1).alias("token"),
        F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                    lambda x: x.try_cast("double")).alias("vec"))


def _whole_vector(dim: int):
    return (F.size("vec") == F.lit(dim)) & ~F.exists("vec", lambda x: x.isNull())


def write_vectors_text(df: DataFrame, path: str, token: str = "token", vec: str = "vec",
                       mode: str = "errorifexists") -> None:
    """A12's file form: token and values separated by single spaces."""
    line = F.concat_ws(" ", F.col(token), F.array_join(
        F.transform(vec, lambda x: x.cast("double").cast("string")), " "))
    df.select(line.alias("value")).write.mode(mode).text(path)
