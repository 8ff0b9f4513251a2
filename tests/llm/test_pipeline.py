"""The pipeline over the smallest tables, and what each stage must do."""

import corpus_pipeline
from lexmetric.llm.queries import ORACLE, QUERIES


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.select("doc_id", "shard", "slot").collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
