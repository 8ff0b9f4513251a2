"""The reference's inputs, stood in by the driver's tables.

The reference ships no data; these frames map its inputs onto the tables in
``/root/testdata/sf*/`` (see FIXTURES.md §2).  Each frame has a DuckDB twin in
``lexmetric.oracle`` built by the same rule, so every registered query can be
checked against plain SQL.  Every frame reads whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmetric.functions.columns import words
from lexmetric.operators.sequence import with_position
from lexmetric.operators.shape import LANGUAGES
from lexmetric.sources.codes import attach_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from lexmetric.sources.files import read_table
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as samples: sample_id = pos = doc_id, sem_type = source,
    language = lang, tokens = the whitespace words of the whole text, label =
    those words joined by one space."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("pos"), "text",
        F.col("source").alias("sem_type"), F.col("lang").alias("language"),
        words("text").alias("tokens"),
    ).withColumn("label", F.array_join("tokens", " "))


def hypothesis_tokens(tokens, key) -> F.Column:
    """The deterministic hypothesis: the reference without the words where
    ``(i + sample_id) % 7 == 0`` (``i`` 0-based)."""
    return F.filter(tokens, lambda x, i: (i + key) % 7 != 0)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    hyp = hypothesis_tokens(F.col("tokens"), F.col("sample_id"))
    return (s.withColumn("ref_tokens", F.col("tokens"))
            .withColumn("hyp_tokens", hyp)
            .withColumn("generated", F.array_join(hyp, " ")))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as the category-code side file: pos = doc_id, code = quality."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("pos"), F.col("quality").cast("string").alias("code"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their code (A6), exact match (0/1) and E4 score."""
    from lexmetric.operators.metrics import with_outcomes
    return with_outcomes(attach_codes(predictions(spark, sf_dir), codes(spark, sf_dir)))


def mixed_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``scored``, but texts of an even number of characters are answered
    in full, so full accuracy differs by code, language and source."""
    from lexmetric.operators.metrics import with_outcomes
    even = F.length("text") % 2 == 0
    mixed = (predictions(spark, sf_dir)
             .withColumn("hyp_tokens", F.when(even, F.col("tokens")).otherwise(F.col("hyp_tokens")))
             .withColumn("generated", F.when(even, F.col("label")).otherwise(F.col("generated"))))
    return with_outcomes(attach_codes(mixed, codes(spark, sf_dir)))


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as n-best hypotheses: sample = order, beam = line number
    (ties broken by part and supplier), score = -price/1000, length = qty."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("beam"),
        F.col("l_partkey").alias("tie1"), F.col("l_suppkey").alias("tie2"),
        (-F.col("l_extendedprice") / F.lit(1000)).alias("score"),
        F.col("l_quantity").alias("length"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as score candidates: step = line number, token = part,
    model = supplier, lprob = -(10 * discount + 1)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("step"),
        F.col("l_partkey").alias("token_id"), F.col("l_suppkey").alias("model"),
        (-(F.lit(10) * F.col("l_discount") + F.lit(1))).alias("lprob"))


def model_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate scored by three models: model 0 as it is, model 1 lower
    by the tax, model 2 rules out every third part (``-inf``)."""
    li = table(spark, sf_dir, "lineitem")
    base = -(F.lit(10) * F.col("l_discount") + F.lit(1))
    score = (F.when(F.col("model") == 0, base).when(F.col("model") == 1, base - F.col("l_tax"))
             .when(F.col("l_partkey") % 3 == 0, F.lit(float("-inf"))).otherwise(base / 2))
    rows = li.withColumn("model", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("step"),
        F.col("l_partkey").alias("token_id"), "model", score.alias("lprob"))


def broken_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``candidates`` with few tokens (part % 5, so pad, end and unknown are
    common), NaN where the supplier is divisible by 4 and ``-inf`` where it
    leaves 1; ``forced`` is step % 5 up to step 3, else null."""
    c = candidates(spark, sf_dir)
    score = (F.when(F.col("model") % 4 == 0, F.lit(float("nan")))
             .when(F.col("model") % 4 == 1, F.lit(float("-inf"))).otherwise(F.col("lprob")))
    return (c.withColumn("part", F.col("token_id")).withColumn("token_id", (F.col("part") % 5).cast("long"))
            .withColumn("lprob", score)
            .withColumn("forced", F.when(F.col("step") <= 3, (F.col("step") % 5).cast("long"))))


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a training log: epoch = day number of ts (its calendar date;
    ts carries no time zone), step = position along (ts, event_id),
    loss = value, split = event_type."""
    ev = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    log = ev.select(F.lit("events").alias("run"), F.col("event_type").alias("split"),
                    day.alias("epoch"), F.col("value").alias("loss"), "ts", "event_id")
    return with_position(log, ["ts", "event_id"], name="step").drop("ts")


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 attention: tgt = i div 8, src = i mod 8,
    sample = label, model = vec_id % 2, head = vec_id."""
    emb = table(spark, sf_dir, "embeddings")
    ex = emb.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    return ex.select(
        F.col("label").cast("long").alias("sample_id"), (F.col("vec_id") % 2).alias("model"),
        F.col("vec_id").alias("head"), F.floor(F.col("i") / 8).cast("int").alias("tgt_pos"),
        (F.col("i") % 8).cast("int").alias("src_pos"), F.col("x").cast("double").alias("attn"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings scaled by (vec_id + 1), since they are already unit length."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label", F.transform(
        "embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)).alias("vec"))


def translation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x languages, translated = '<lang>:<text>', minus the
    documents with doc_id % 5 = 0 (an incomplete memory)."""
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 5 != 0)
    arr = F.array(*[F.lit(x) for x in LANGUAGES])
    # Texts are made distinct before they are multiplied: language and translation hang on them alone.
    return (docs.select(F.col("text").alias("src_text")).distinct()
            .select("src_text", F.explode(arr).alias("language"))
            .withColumn("translated", F.concat(F.col("language"), F.lit(":"), F.col("src_text"))))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: every user turn beside the turn that follows it ('' if
    none), positioned along (conv_id, turn)."""
    conv = table(spark, sf_dir, "conversations")
    user = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    pairs = user.join(nxt, ["conv_id", "turn"], "left").withColumn(
        "tgt", F.coalesce(F.col("tgt"), F.lit("")))
    return with_position(pairs, ["conv_id", "turn"], name="pos")
