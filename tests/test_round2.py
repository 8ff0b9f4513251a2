"""Cases the stand-in tables do not hold: infinities, unknown ids, null keys, layouts."""

import math

import pytest
from pyspark.sql import functions as F

from lexmetric import functions as C
from lexmetric.operators import metrics as E
from lexmetric.operators import ranking as R
from lexmetric.operators import shape as D
from lexmetric.operators import tokens as TK
from lexmetric.operators.sizing import estimated_bytes
from lexmetric.sources import files as A
from lexmetric.streaming.accuracy import stream_accuracy

INF = float("inf")


def test_ensemble_keeps_null_groups_and_minus_infinity(spark):
    rows = [(None, -1.0), (None, -1.0), (1, -INF), (1, -INF), (2, -INF), (2, 0.0)]
    df = spark.createDataFrame(rows, "g long, lprob double")
    got = {r.g: r.ensemble_lprob for r in E.ensemble_logprob(df, ["g"]).collect()}
    assert got[None] == pytest.approx(-1.0) and got[1] == -INF
    assert got[2] == pytest.approx(math.log(0.5))


def test_log_softmax_and_quota_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 0.0), (None, 0.0), (1, 3.0)], "g long, lprob double")
    got = R.log_softmax(df, ["g"]).collect()
    assert len(got) == 3 and {round(r.log_prob, 6) for r in got if r.g is None} == {round(math.log(0.5), 6)}
    hyps = spark.createDataFrame([(None, 1, 0), (None, 2, 1), (7, 1, 0)], "sample_id long, step long, rank long")
    done = R.finished_quota(hyps, 2, 9).collect()
    assert len(done) == 3 and {r.done_step for r in done if r.sample_id is None} == {2}


def test_decode_uses_the_vocabulary(spark):
    vocab = spark.createDataFrame([(0, "<s>", True), (1, "<pad>", True), (2, "</s>", True), (3, "<unk>", True),
                                   (4, "a", False), (5, "<sep>", True)], "token_id int, token string, is_special boolean")
    ids = spark.createDataFrame([(1, [4, 999]), (2, [4, 5, 4]), (3, [])], "sample_id long, ids array<int>")
    got = {r.sample_id: r.decoded for r in TK.decode(ids, vocab, keep=[]).collect()}
    assert got == {1: "a <unk>", 2: "a a", 3: ""}


def test_banned_candidates_stay_with_minus_infinity(spark):
    cands = spark.createDataFrame([(1, "x", -1.0), (1, "y", -2.0)], "sample_id long, token string, lprob double")
    banned = spark.createDataFrame([(1, "x"), (1, "x")], "sample_id long, token string")
    assert {r.token: r.lprob for r in TK.ban_tokens(cands, banned).collect()} == {"x": -INF, "y": -2.0}


def test_numbers_print_as_python_prints_them(spark):
    df = spark.createDataFrame([(x,) for x in (INF, -INF, float("nan"), 1.25)], "x double")
    assert [r[0] for r in df.select(C.format_fixed("x", 1)).collect()] == ["inf", "-inf", "nan", "1.2"]


def test_localize_with_doubled_memory(spark):
    rows = spark.createDataFrame([(1, "hi", "de")], "sample_id long, text string, language string")
    memory = spark.createDataFrame([("hi", "de", "b"), ("hi", "de", "a")], "src_text string, language string, translated string")
    assert [r.text for r in D.localize(rows, memory).collect()] == ["a"]


def test_shuffled_batches_do_not_hang_on_the_layout(spark):
    df = spark.range(300).withColumnRenamed("id", "sample_id")
    got = [sorted(map(tuple, D.batches(df.repartition(n), 32, shuffle=True, seed=3)
                      .select("sample_id", "batch_id").collect())) for n in (1, 4, 13)]
    assert got[0] == got[1] == got[2]


def test_token_budget_with_text_keys(spark):
    df = spark.createDataFrame([("a", 3), ("b", 4)], "sample_id string, n_tokens int")
    assert D.token_budget_batches(df, 100, 10).count() == 2


def test_size_check_sees_array_elements(spark):
    vectors = spark.range(100).select(F.array_repeat(F.lit(1.0), 1024).alias("v"))
    assert estimated_bytes(vectors) > 100 * 1024 * 8


def test_strip_knows_every_white_space_character(spark):
    import sys
    spaces = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()]
    df = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in spaces], "t string")
    assert [r[0] for r in df.select(C.strip_text("t")).collect()] == ["a" + c + "b" for c in spaces]


def _file(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_strict_reader_takes_line_one_as_header(spark, tmp_path):
    header = "\ttext\tlabel\tsem_type\tlanguage"
    path = _file(tmp_path, "t.tsv", header, "0\ta\tb\tc\tde  ", "idx\ttext\tlabel\tsem_type\tlanguage", "1\tx")
    good, bad = A.read_strict_tsv(spark, path)
    assert sorted(map(tuple, good.collect())) == [("0", "a", "b", "c", "de"), ("idx", "text", "label", "sem_type", "language")]
    assert [tuple(r) for r in bad.collect()] == [("1\tx", 2)]


def test_written_samples_keep_empty_texts_and_nulls(spark, tmp_path):
    rows = [(0, "", "l", "s", "de"), (1, None, "l", "s", "de"), (2, "a\tb\n\"c\"", "l", "s", "de")]
    df = spark.createDataFrame(rows, "pos long, text string, label string, sem_type string, language string")
    path = str(tmp_path / "out")
    A.write_samples(df, path)
    assert sorted(map(tuple, A.read_translated(spark, path).collect())) == rows
    head = [f.read_text().split("\t")[0] for f in (tmp_path / "out").glob("part-*")]
    assert set(head) <= {"", '""'}


def test_prediction_files(spark, tmp_path):
    a, b = '{"text":"a","label":"b","generated":"c"}', '{"text":"d","label":"e","generated":"f"}'
    path = _file(tmp_path, "p.jsonl", f"[{a},{b}]", "broken", f"[{b}]")
    got = A.read_prediction_batches(spark, path).orderBy("pos").collect()
    assert [(r.pos, r.batch_id, r.text) for r in got] == [(0, 0, "a"), (1, 0, "d"), (2, 2, "d")]
    assert [r.line for r in A.malformed_prediction_lines(spark, path).collect()] == ["broken"]
    grown = _file(tmp_path, "g.jsonl", f"[{a}]", f"[{a},{b}]")
    assert [(r.pos, r.text) for r in A.read_prediction_batches(spark, grown, cumulative=True).orderBy("pos").collect()] \
        == [(0, "a"), (1, "d")]


def test_vector_lines_without_whole_numbers_are_set_aside(spark, tmp_path):
    path = _file(tmp_path, "v.txt", "a 1 2", "b 1 x", "c 1")
    assert [r.token for r in A.read_vectors_text(spark, path, 2).collect()] == ["a"]
    assert sorted(r.value for r in A.malformed_vector_lines(spark, path, 2).collect()) == ["b 1 x", "c 1"]


def test_end_token_of_score_minus_infinity_fills_a_slot(spark):
    cands = spark.createDataFrame([(1, 9, -1.0), (1, 2, -INF)], "g long, token_id int, lprob double")
    got = {r.token_id: (r.finished, r.active) for r in R.top_candidates(cands, 2, ["g"], eos=2).collect()}
    assert got == {9: (False, True), 2: (False, True)}


def test_minimum_length_gives_way_to_a_forced_token(spark):
    cands = spark.createDataFrame([(0, 2, -1.0, 2), (0, 5, -1.0, 2), (0, 2, -1.0, None), (0, 5, -1.0, None)],
                                  "step int, token_id int, lprob double, forced int")
    got = {(r.token_id, r.forced): r.lprob for r in
           R.constrain_scores(cands, 1, 3, 2, min_len=2, prefix="forced").collect()}
    assert got == {(2, 2): -1.0, (5, 2): -INF, (2, None): -INF, (5, None): -1.0}


def test_prefixes_carry_the_end_token(spark):
    df = spark.createDataFrame([(1, ["s"], ["a", "b", "c"])], "sample_id long, src_tokens array<string>, tgt_tokens array<string>")
    cut = [r.tokens for r in TK.expand_prefixes(df, horizon=1, end="e").orderBy("prefix_len").collect()]
    assert cut == [["s", "a", "e"], ["s", "b", "e"], ["s", "c", "e"]]
    whole = [len(r.tokens) for r in TK.expand_prefixes(df, horizon=0, end="e").orderBy("prefix_len").collect()]
    assert whole == [3, 4, 5]


def test_code_line_in_order_of_appearance(spark):
    df = spark.createDataFrame([("b", 1, 0), ("a", 0, 1)], "code string, correct int, pos long")
    assert E.code_accuracy_line(E.accuracy_by_code(df, pos="pos")).first().line == "Code type Accuracy : b : 1.0  ;  a : 0.0"


def test_stream_without_input_gives_empty_totals(spark, tmp_path):
    stream = spark.readStream.schema("code string, ok boolean").parquet(str(tmp_path))
    totals, history = stream_accuracy(spark, stream, history=True)
    assert totals.count() == 0 and history.count() == 0 and "batch_id" in history.columns
