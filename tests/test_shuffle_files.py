"""Shuffle files of checkpointed frames, and what the evaluation plan shuffles."""

import time

from pyspark.sql import functions as F

from lexmetric.plans.evaluation import evaluate_hypotheses
from lexmetric.session import FILE_CLEANUP, materialize


def _shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    sizes = {f.getPath(): f.length() for f in (files.apply(i) for i in range(files.size()))}
    return sum(n for path, n in sizes.items() if path.endswith(".data") and "shuffle_" in path)


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("k"), "id").repartition(7, "k")
    before, setting = _shuffle_bytes(spark), spark.conf.get(FILE_CLEANUP, None)
    got = materialize(rows)         # rows is still held, so no garbage collection takes its files
    until = time.time() + 10
    while _shuffle_bytes(spark) > before + 100_000 and time.time() < until:
        time.sleep(0.2)
    assert _shuffle_bytes(spark) <= before + 100_000
    assert spark.conf.get(FILE_CLEANUP, None) == setting
    assert got.count() == rows.count() == 200_000       # the frame itself can still be run


def test_codes_meet_scores_not_texts(spark):
    hyps = spark.createDataFrame([(1, 0, [5, 6], -1.0), (1, 1, [5], -9.0), (2, 0, [6], -1.0)],
                                 "sample_id long, beam int, tokens array<int>, score double")
    targets = spark.createDataFrame([(1, 0, [5, 6]), (2, 1, [5, 6])], "sample_id long, pos long, target_tokens array<int>")
    vocab = spark.createDataFrame([(5, "a", 1, False), (6, "b", 1, False)],
                                  "token_id int, token string, n long, is_special boolean")
    codes = spark.createDataFrame([(0, "x")], "pos long, code string")
    out = evaluate_hypotheses(hyps, targets, vocab, codes)
    plan = out["summary"]._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = plan[next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(pos#" in line) + 1]
    assert "AS correct#" in moved and "AS partial#" in moved
    assert out["scored"].columns[-3:] == ["code", "correct", "partial"]
    rows = {r.sample_id: r for r in out["scored"].collect()}
    assert (rows[1].correct, rows[1].partial, rows[1].code) == (1, 1.0, "x")
    assert (rows[2].correct, rows[2].partial, rows[2].code) == (0, 0.0, None)
