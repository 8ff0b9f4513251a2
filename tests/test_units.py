"""Hand-made frames for the edge cases the reference's code implies."""

import math

from pyspark.sql import functions as F

from lexmetric import functions as C
from lexmetric.operators import metrics as E
from lexmetric.operators import ranking as R
from lexmetric.operators import text as B
from lexmetric.operators import tokens as TK


def test_partial_accuracy_cases(spark):
    rows = [
        (1, ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"], ["a", "b", "c", "d", "e", "f", "g", "h"]),
        (2, ["a", "b"], ["a", "b", "x", "y"]),      # extra tokens cost nothing
        (3, [], ["a"]),                             # empty reference -> null
        (4, ["a", "b", "c"], []),                   # empty hypothesis
        (5, ["a", "b", "c"], ["b", "c"]),           # shifted: no match, minus one
    ]
    df = spark.createDataFrame(rows, "id int, ref array<string>, hyp array<string>")
    got = {r.id: r.p for r in df.select("id", C.partial_accuracy("hyp", "ref").alias("p")).collect()}
    assert math.isclose(got[1], 0.6)
    assert got[2] == 1.0
    assert got[3] is None
    assert got[4] == 0.0
    assert got[5] == 0.0


def test_strip_and_words(spark):
    df = spark.createDataFrame([(" \t a  b\n",), ("",), (None,)], "t string")
    out = df.select(C.strip_text("t").alias("s"), C.words("t").alias("w")).collect()
    assert out[0].s == "a  b" and out[0].w == ["a", "b"]
    assert out[1].s == "" and out[1].w == []
    assert out[2].s is None


def test_tag_empty_parallel_rows(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "  "), (None, "b")], "src string, tgt string")
    tagged = B.tag_empty(df, ["src", "tgt"], keep_empty=True).collect()
    assert [r.outcome for r in tagged] == ["PASS", "EMPTY", "EMPTY"]
    assert B.tag_empty(df, ["src", "tgt"]).count() == 1


def test_missing_code_is_its_own_group(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), (None, 1)], "code string, correct int")
    rows = {(r.key, r.is_overall): r.full for r in E.full_accuracy(df).collect()}
    assert rows[("average", True)] == 2 / 3
    assert rows[(None, False)] == 1.0
    assert rows[("x", False)] == 0.5


def test_argmax_ties_go_to_lowest_id(spark):
    df = spark.createDataFrame([(1, 1, 7, -1.0), (1, 1, 5, -1.0), (1, 1, 9, -2.0)],
                               "sample_id long, step int, token_id long, lprob double")
    row = E.argmax_token(df, ["sample_id", "step"]).collect()[0]
    assert row.best_token == 5


def test_constrain_scores_nan_pad_unk_eos(spark):
    df = spark.createDataFrame(
        [(1, 1, 9, float("nan")), (1, 1, 1, -1.0), (1, 1, 3, -1.0), (1, 0, 2, -1.0), (1, 5, 9, -1.0),
         (1, 5, 2, -1.0)], "sample_id long, step int, token_id long, lprob double")
    out = R.constrain_scores(df, pad=1, unk=3, eos=2, unk_penalty=0.5, min_len=1, max_len=5).collect()
    vals = [r.lprob for r in out]
    assert vals[0] == float("-inf") and vals[1] == float("-inf")
    assert vals[2] == -1.5
    assert vals[3] == float("-inf")      # eos below min_len
    assert vals[4] == float("-inf")      # at max_len only eos
    assert vals[5] == -1.0


def test_rank_ties_break_by_beam(spark):
    df = spark.createDataFrame([(1, 2, -1.0), (1, 1, -1.0), (1, 3, -0.5)],
                               "sample_id long, beam int, score double")
    ranked = {r.beam: r.rank for r in R.rank_hypotheses(df).collect()}
    assert ranked == {3: 1, 1: 2, 2: 3}
    top = {r.beam: r.rank for r in R.rank_hypotheses(df, top=2).collect()}
    assert top == {3: 1, 1: 2}


def test_ngrams_skip_short_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "a", "b", "a"])],
                               "sample_id long, tokens array<string>")
    rep = TK.repeated_ngrams(df, 3).collect()
    assert {tuple(r.ngram): r.n for r in rep} == {("a", "b", "a"): 2}
    banned = {r.token for r in TK.banned_next_tokens(df, 3).collect()}
    assert banned == {"b"}


def test_log_softmax_needs_positive_temperature(spark):
    df = spark.createDataFrame([(1, 1, 1.0)], "sample_id long, step int, lprob double")
    try:
        R.log_softmax(df, ["sample_id", "step"], temperature=0)
    except ValueError:
        pass
    else:
        raise AssertionError("temperature 0 accepted")


def test_output_length_limit_min_len(spark):
    df = spark.createDataFrame([(10,)], "n int")
    assert df.select(C.output_length_limit("n", 0.0, 5, 100).alias("l")).first().l == 5
    failed = False
    try:
        df.select(C.output_length_limit("n", 0.0, 5, 100, min_len=10).alias("l")).collect()
    except Exception:  # noqa: BLE001
        failed = True
    assert failed


def test_clean_id_string_and_render(spark):
    df = spark.createDataFrame([([3, 14, 15],), ([],)], "ids array<int>")
    out = df.select(C.clean_id_string(C.list_repr("ids")).alias("c")).collect()
    assert [r.c for r in out] == ['"3 14 15"', '""']
    s = spark.createDataFrame([([-1.0, -0.5],)], "s array<double>")
    assert s.select(C.render_scores(F.transform("s", C.to_log2)).alias("r")).first().r == "-1.4427 -0.7213"


def test_collate_moves_eos_and_pads(spark):
    df = spark.createDataFrame([(0, [5, 6, 2]), (0, [7, 2])], "batch_id long, ids array<int>")
    out = [r.ids for r in TK.collate(df, move_eos_to_front=True).collect()]
    assert out == [[2, 5, 6], [2, 7, 1]]


def test_report_numbers_format_like_python(spark):
    vals = [0.0625, 1.0005, 0.0005, 0.1235, 2.675, -0.0625, 0.0, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r.s for r in df.select(C.format_exact("v", 3).alias("s")).collect()]
    assert got == ["%.3f" % v for v in vals]
    four = [r.s for r in df.select(C.format_fixed("v", 4).alias("s")).collect()]
    assert four == ["%.4f" % v for v in vals]
    big = spark.createDataFrame([(-12345.67891,)], "v double")
    assert big.select(C.format_fixed("v", 4).alias("s")).first().s == "-12345.6789"
