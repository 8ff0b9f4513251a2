"""Reports in whole, codes from a side file, totals over restarts, memory joins by digest."""

from pyspark.sql import functions as F

from lexmetric.operators import metrics as E
from lexmetric.operators import shape as D
from lexmetric.operators import tokens as TK
from lexmetric.sources import attach_codes, read_codes
from lexmetric.streaming.accuracy import stream_accuracy


def test_codes_without_a_file(spark, tmp_path):
    samples = spark.range(3).withColumnRenamed("id", "pos")
    codes = read_codes(spark, str(tmp_path / "none.code"))
    assert codes is None
    assert [r.code for r in attach_codes(samples, codes).collect()] == [None] * 3


def test_codes_are_stripped_and_may_be_too_few(spark, tmp_path):
    path = tmp_path / "test.word-predicate.code"
    path.write_text(" a \n\nb\t\n", encoding="utf-8")
    codes = read_codes(spark, str(path))
    got = attach_codes(spark.range(4).withColumnRenamed("id", "pos"), codes).orderBy("pos").collect()
    assert [r.code for r in got] == ["a", "", "b", None]


def test_codes_of_an_empty_file(spark, tmp_path):
    path = tmp_path / "empty.code"
    path.write_text("")
    assert read_codes(spark, str(path)).count() == 0


SCORED = "pos long, code string, correct int, partial double"


def test_whole_report(spark):
    rows = [(0, "b", 1, 1.0), (1, "a", 0, 0.5), (2, "b", 0, 0.0), (3, None, 1, None)]
    summary = E.summary_table(spark.createDataFrame(rows, SCORED))
    lines = [r.line for r in E.full_report(summary, "m.pt").orderBy("line_no").collect()]
    assert lines[:3] == ["Model : m.pt ;  Accuracy : 0.5",
                         "Code type Accuracy : b : 0.5  ;  a : 0.0  ;  None : 1.0",
                         "  acc: [0.5, 0.0, 1.0]"]
    assert lines[3] == "     full " + " " * 73 + "average: 0.500" and len(lines) == 11
    assert lines[7].startswith("  partial ") and lines[7].endswith("average: 0.500")
    assert lines[10].endswith("None: nan")


def test_small_accuracies_print_as_python_does(spark):
    rows = [(i, "a", int(i == 0), 0.0) for i in range(3000)]
    summary = E.summary_table(spark.createDataFrame(rows, SCORED))
    assert E.full_report(summary, "m").filter("line_no = 2").first().line == f"  acc: [{1 / 3000}]"


def test_report_of_nothing(spark):
    summary = E.summary_table(spark.createDataFrame([], SCORED))
    lines = [r.line for r in E.full_report(summary, "m").orderBy("line_no").collect()]
    assert lines == ["Model : m ;  Accuracy : nan", "Code type Accuracy : ", "  acc: []"]


RESULTS = "code string, ok boolean, partial double"


def _arrive(spark, src, rows):
    spark.createDataFrame(rows, RESULTS).coalesce(1).write.mode("append").parquet(src)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    src, base = str(tmp_path / "src"), str(tmp_path / "out")
    loads = [[("a", True, 1.0), ("b", False, None)], [("a", False, 0.0)], [(None, True, 0.5)]]
    for rows in loads:
        _arrive(spark, src, rows)
        stream = spark.readStream.schema(RESULTS).parquet(src)
        totals, history = stream_accuracy(spark, stream, out_dir=base, history=True, partial="partial")
    # Nothing new: the totals stay, no batch is added.
    totals, history = stream_accuracy(spark, spark.readStream.schema(RESULTS).parquet(src), out_dir=base,
                                      history=True, partial="partial")
    got = {(r.batch_id, r.key, r.is_overall): (r.n, r.n_correct, r.full, r.partial) for r in history.collect()}
    assert got == {
        (0, "a", False): (1, 1, 1.0, 1.0), (0, "b", False): (1, 0, 0.0, None), (0, "average", True): (2, 1, 0.5, 1.0),
        (1, "a", False): (2, 1, 0.5, 0.5), (1, "b", False): (1, 0, 0.0, None), (1, "average", True): (3, 1, 1 / 3, 0.5),
        (2, "a", False): (2, 1, 0.5, 0.5), (2, "b", False): (1, 0, 0.0, None), (2, None, False): (1, 1, 1.0, 0.5),
        (2, "average", True): (4, 2, 0.5, 0.5)}
    assert {(r.key, r.is_overall): r.n for r in totals.collect()} == {
        ("a", False): 2, ("b", False): 1, (None, False): 1, ("average", True): 4}


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    """The commit of the last batch is lost: the restart runs it again."""
    src, base = str(tmp_path / "src"), tmp_path / "out"
    for rows in ([("a", True, 1.0)], [("a", False, 0.0)]):
        _arrive(spark, src, rows)
        stream = spark.readStream.schema(RESULTS).parquet(src)
        stream_accuracy(spark, stream, out_dir=str(base), history=True, partial="partial")
    for name in ("1", ".1.crc"):
        (base / "_checkpoint" / "commits" / name).unlink(missing_ok=True)
    totals, history = stream_accuracy(spark, spark.readStream.schema(RESULTS).parquet(src), out_dir=str(base),
                                      history=True, partial="partial")
    assert {(r.batch_id, r.key): r.n for r in history.collect()} == {
        (0, "a"): 1, (0, "average"): 1, (1, "a"): 2, (1, "average"): 2}
    assert {r.key: (r.n, r.full) for r in totals.collect()} == {"a": (2, 0.5), "average": (2, 0.5)}


SAMPLES = "sample_id long, text string, language string"
MEMORY = "src_text string, language string, translated string"


def _memory_case(spark):
    samples = spark.createDataFrame(
        [(0, "x", "en"), (1, "x", "de"), (2, "y", "de"), (3, None, "de"), (4, "x", None), (5, "", "fr"),
         (6, "x", "de"), (7, "y", "de"), (8, None, "fr")], SAMPLES)
    memory = spark.createDataFrame(
        [("x", "de", "X2"), ("x", "de", "X1"), (None, "de", "never"), ("", "fr", "leer"), ("y", "fr", "Y")], MEMORY)
    return samples, memory


def test_localize_by_digest(spark):
    got = D.localize(*_memory_case(spark))
    assert got.columns == ["sample_id", "text", "language"]
    assert {r.sample_id: r.text for r in got.collect()} == {
        0: "x", 1: "X1", 2: None, 3: None, 4: None, 5: "leer", 6: "X1", 7: None, 8: None}


def test_pending_by_digest(spark):
    got = D.pending_translations(*_memory_case(spark))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("y", "de"), (None, "de"), (None, "fr")], key=str)


def test_no_text_is_a_sort_or_shuffle_key(spark):
    samples, memory = _memory_case(spark)
    for df in (D.localize(samples, memory), D.pending_translations(samples, memory)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys = [line for line in plan.splitlines() if "hashpartitioning" in line or " Sort [" in line]
        assert keys and not any("text#" in line or "src_text#" in line for line in keys)


def test_unknown_words(spark):
    vocab = TK.build_vocab(spark.createDataFrame([(["a", "b", "a"],)], "tokens array<string>"))
    new = spark.createDataFrame([(1, ["a", "zz", "b"]), (2, [])], "sample_id long, tokens array<string>")
    ids = TK.encode(new, vocab)
    assert {r.sample_id: list(r.ids) for r in ids.collect()} == {1: [4, TK.UNK, 5], 2: []}
    text = TK.decode(ids.select("sample_id", "ids"), vocab, skip_specials=False, escape_unk=True)
    assert {r.sample_id: r.decoded for r in text.collect()}[1] == "a <<unk>> b"


def test_prefixes_compute_the_tokens_once(spark):
    """No filter at the scan computes the target again; rows without tokens give no prefix."""
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None)], "sample_id long, text string").select(
        "sample_id", F.array(F.lit("en")).alias("src_tokens"),
        F.filter(F.split("text", " "), lambda x: x != "").alias("tgt_tokens"))
    out = TK.expand_prefixes(df, horizon=2, end="</s>")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted((r.sample_id, r.prefix_len, r.tokens) for r in out.collect()) == [
        (1, 1, ["en", "a", "</s>"]), (1, 2, ["en", "a", "b", "</s>"]), (1, 3, ["en", "b", "c", "</s>"])]
