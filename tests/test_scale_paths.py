"""The ways taken beyond a broadcast or a task's share give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexmetric.operators import shape, tokens
from lexmetric.operators.lookup import hot_keys, lookup


def greedy(rows, max_tokens, max_sentences):
    out, open_bucket, k, held = {}, None, {}, 0
    for bucket, n, key in sorted((0 if n <= 1 else (n - 1).bit_length(), n, key) for key, n in rows):
        if bucket != open_bucket:
            open_bucket, held = bucket, 0
            k[bucket] = 0
        elif held + 1 > max_sentences or (held + 1) * n > max_tokens:
            k[bucket], held = k[bucket] + 1, 0
        held += 1
        out[key] = f"{bucket}-{k[bucket]}"
    return out


@pytest.mark.parametrize("chunks", [1, 3, 16])
@pytest.mark.parametrize("max_tokens,max_sentences", [(64, 5), (300, 100), (1, 1), (1000, 7)])
def test_packing_is_greedy_in_any_number_of_chunks(spark, chunks, max_tokens, max_sentences):
    r = random.Random(max_tokens)
    rows = [(i, r.choice([0, 1, 2, 3, 7, 8, 9, 30, 100, 400, r.randint(1, 200)])) for i in range(600)]
    rows += [(1000 + i, 5) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id long, n_tokens int").repartition(4)
    got = shape.token_budget_batches(df, max_tokens, max_sentences, num_chunks=chunks).collect()
    assert {x.sample_id: x.batch_id for x in got} == greedy(rows, max_tokens, max_sentences)
    assert len(got) == len(rows)


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "sample_id long, n_tokens int")
    assert shape.token_budget_batches(df, 10, 10).collect() == []


@pytest.fixture
def hot_rows(spark):
    """A third of the rows are one token."""
    return spark.range(60_000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "the").when(F.col("id") % 100 == 7, F.lit(None))
        .otherwise(F.concat(F.lit("w"), F.col("id") % 900)).alias("token"))


def test_lookup_is_the_same_beyond_the_broadcast(spark, hot_rows):
    table = hot_rows.select("token").where("token <> 'w5'").distinct().withColumn("token_id", F.length("token"))
    small, large = lookup(hot_rows, table, "token"), lookup(hot_rows, table, "token", max_bytes=0)
    assert small.columns == large.columns and small.count() == 60_000
    assert small.exceptAll(large).count() == large.exceptAll(small).count() == 0


def test_no_task_holds_a_hot_token(spark, hot_rows):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        assert "the" in {x.token for x in hot_keys(hot_rows, "token", 5).collect()}
        table = hot_rows.select("token").distinct().where("token is not null").withColumn("token_id", F.lit(1))
        held = (lookup(hot_rows, table, "token", max_bytes=0).select(F.spark_partition_id().alias("p"))
                .groupBy("p").count().collect())
        mean = 60_000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert max(x["count"] for x in held) < 1.5 * mean
    finally:
        spark.conf.set(coalesce, old)


def test_encode_decode_embed_on_both_ways(spark):
    df = spark.createDataFrame([(i, ["the"] * 20 + [f"w{i % 9}", "odd"] + [None] * (i % 2)) for i in range(50)] + [(99, [])],
                               "sample_id long, tokens array<string>")
    vocab = tokens.build_vocab(df.select(F.filter("tokens", lambda t: t != "odd").alias("tokens"))).cache()
    vectors = vocab.where("token_id % 2 = 0").select("token_id", F.array(F.lit(1.0), F.col("token_id") * 2.0).alias("vec"))

    def both(fn):
        a, b = fn({}), fn({"max_bytes": 0})
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        return a
    ids = both(lambda o: tokens.encode(df, vocab, keep=[], **o)).cache()
    assert tokens.UNK in ids.where("sample_id = 1").first().ids
    both(lambda o: tokens.decode(ids, vocab, keep=[], **o))
    both(lambda o: tokens.embed_tokens(ids, vectors, keep=[], **o))
