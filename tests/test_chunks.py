"""Lookups of tokens by chunk dictionaries: no row per token moves, and repeated keys stay as they were."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexmetric.operators import tokens as TK


@pytest.fixture(scope="module")
def case(spark):
    rows = spark.createDataFrame(
        [(1, ["a", "bé", None, "zz", "a"]), (2, []), (3, None), (4, ["q", ""]),
         (5, ["a"]), (5, ["zz", "q"]), (None, ["a"]), (None, ["zz"])], "sample_id long, tokens array<string>")
    vocab = spark.createDataFrame([(3, "<unk>", True), (4, "a", False), (5, "bé", False), (6, "zz", False)],
                                  "token_id int, token string, is_special boolean")
    return rows, vocab


@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_no_row_per_token(case, max_bytes):
    rows, vocab = case
    ids = TK.encode(rows, vocab, keep=[], max_bytes=max_bytes)
    text = TK.decode(ids, vocab, keep=[], max_bytes=max_bytes)
    assert "explode" not in text._jdf.queryExecution().optimizedPlan().toString()
    assert {r.sample_id: r.ids for r in ids.collect()} == {
        1: [4, 5, 3, 6, 4], 2: [], 3: [], 4: [3, 3], 5: [4, 6, 3], None: [4, 6]}
    assert {r.sample_id: r.decoded for r in text.collect()} == {
        1: "a bé zz a", 2: "", 3: "", 4: "", 5: "a zz", None: "a zz"}


def test_every_row_stays_without_keep(case):
    got = sorted(((r.sample_id, r.tokens, r.ids) for r in TK.encode(*case).collect()), key=str)
    want = [(1, ["a", "bé", None, "zz", "a"], [4, 5, 3, 6, 4]), (2, [], []), (3, None, []), (4, ["q", ""], [3, 3]),
            (5, ["a"], [4, 6, 3]), (5, ["zz", "q"], [4, 6, 3]), (None, ["a"], None), (None, ["zz"], None)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_continuations_by_numbers(spark, n):
    rows = [(1, ["a", "b", "a", "b", "c", "a", "b", "a"]), (2, ["a"]), (2, ["a", "b", "é"]), (2, ["a", "b", "z"]),
            (3, None), (4, ["x", None, "x", None, "y"]), (None, ["p", "q", "r"]), (None, ["p", "q", "s"])]
    got = TK.ngram_continuations(spark.createDataFrame(rows, "sample_id long, tokens array<string>"), n)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for key, t in rows:
        for i in range(len(t or []) - n + 1):
            want.setdefault((key, tuple(t[i:i + n - 1])), set()).add(t[i + n - 1])
    assert {(r.sample_id, tuple(r.prefix)): r.continuations for r in got.collect()} == {
        k: sorted(v - {None}) for k, v in want.items()}


def test_memory_by_text_alone(spark):
    from lexmetric.operators import shape as D
    rows = spark.createDataFrame([(i, "t", x, "l") for i, x in enumerate(("en", "de", "fr", "es"))],
                                 "sample_id long, text string, language string, label string")
    memory = spark.createDataFrame([("t", "de", "T2"), ("t", "de", "T1"), ("t", "en", "no"), ("t", "es", None)],
                                   "src_text string, language string, translated string")
    got = D.localize(rows, memory)
    assert {r.language: r.text for r in got.collect()} == {"en": "t", "de": "T1", "fr": None, "es": None}
    plan = got._jdf.queryExecution().executedPlan().toString()
    # No translation is sorted or gathered before the shuffle.
    assert not any("partial_" in x for x in plan[plan.rindex("Exchange hashpartitioning"):].splitlines())
    assert [tuple(r) for r in D.pending_translations(rows, memory).collect()] == [("t", "fr")]


def test_compressed_parts(spark, tmp_path):
    from lexmetric.sources import files as A
    rows = spark.createDataFrame([(i, f'a\t"{i}\n' * 50, None, "", "de") for i in range(40)],
                                 "pos long, text string, label string, sem_type string, language string")
    A.write_samples(rows, f"{tmp_path}/s", compression="gzip")
    assert sorted(map(tuple, A.read_translated(spark, f"{tmp_path}/s").collect())) == sorted(map(tuple, rows.collect()))
    assert not [x for x in (tmp_path / "s").glob("part-*") if x.suffix != ".gz"]
    plain = rows.select(F.col("pos").alias("idx"), F.lit("x").alias("text"), F.lit("y").alias("label"),
                        F.lit("z").alias("sem_type"), "language")
    A.write_plain_tsv(plain, f"{tmp_path}/p", compression="gzip")
    good, bad = A.read_strict_tsv(spark, f"{tmp_path}/p")
    assert sorted(int(r.idx) for r in good.collect()) == list(range(40)) and not bad.count()
