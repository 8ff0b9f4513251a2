"""No operator or stage trips over extra columns of its own names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmetric.llm.queries import QUERIES
from lexmetric.llm import common

#: Names the operators use inside.
HOSTILE = ["i", "id", "row", "tie", "cell", "at", "copies", "copy", "key", "draw", "size", "target", "shard", "slot", "n",
           "word", "run", "words", "found", "spans", "label", "term", "y", "eid", "line", "host", "h", "v", "p", "c",
           "__text", "__copies", "__at", "__id", "__tie", "bucket", "entry", "class", "node", "root", "a", "b"]
TABLES = {"documents", "pages", "labels", "benchmark", "conversations"}


@pytest.fixture(scope="module")
def hostile(spark, sf_dir):
    def read(session, folder, name):
        common.ready(session)
        df = session.read.parquet(f"{folder}/{name}.parquet").limit(120)
        return df.select("*", *[F.lit("x").alias(c) for c in HOSTILE if c not in df.columns])
    return read


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_with_hostile_columns(spark, sf_dir, hostile, monkeypatch, name):
    from lexmetric.llm import queries
    monkeypatch.setattr(queries, "table", hostile)
    assert QUERIES[name](spark, sf_dir).count() >= 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_hostile_columns(spark, sf_dir, hostile, monkeypatch, name, stage):
    monkeypatch.setattr(corpus_pipeline, "table", hostile)
    docs = hostile(spark, sf_dir, "documents").drop("shard", "slot")
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns + (["shard", "slot"] if name == "sharding" else [])
    assert out.count() <= 3 * docs.count()
