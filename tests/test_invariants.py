
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexmetric import standins as S
from lexmetric.operators import metrics as E
from lexmetric.operators import ranking as R
from lexmetric.operators import shape as D
from lexmetric.operators import tokens as TK
from lexmetric.operators.sequence import running, with_position
from lexmetric.session import shared_dir
from lexmetric.sources import files as A


def _expanded_fixture(spark, n_samples=600):
    base = spark.range(n_samples).select(F.col("id").alias("sample_id"), F.col("id").alias("pos"),
                                         F.concat(F.lit("t"), F.col("id")).alias("text"))
    return D.expand_languages(base)


def test_expand_multiplies_by_six(spark):
    assert _expanded_fixture(spark, 100).count() == 600


def test_rotating_sample_keeps_the_language_on_duty(spark):
    exp = _expanded_fixture(spark, 600)
    kept = D.rotating_sample(exp).collect()
    # Seven samples by hand: positions 0-4 fall to the first language, 5-10 to the
    # second and so on, so the duty changes one row before each sample ends; the
    # fifth sample meets its language twice and the sixth not at all.
    first = {(r.sample_id, r.pos) for r in kept if r.sample_id < 7}
    assert first == {(0, 0), (1, 7), (2, 14), (3, 21), (4, 28), (4, 29), (6, 36)}
    assert len(kept) == 600
    per_lang = {}
    for r in kept:
        per_lang[r.language] = per_lang.get(r.language, 0) + 1
    assert set(per_lang.values()) == {100}
    per_sample = {}
    for r in kept:
        per_sample[r.sample_id] = per_sample.get(r.sample_id, 0) + 1
    assert sorted(per_sample.values()).count(2) == 100
    assert len(per_sample) == 500


def test_decode_of_encode_returns_known_tokens(spark):
    s = S.samples(spark, SF_SMALL)
    vocab = TK.build_vocab(s, min_count=1)
    back = TK.decode(TK.encode(s, vocab), vocab).select("sample_id", "label", "decoded")
    assert back.filter(F.col("label") != F.col("decoded")).count() == 0


def test_prediction_batches_round_trip(spark):
    preds = D.batches(S.predictions(spark, SF_SMALL), 32)
    path = shared_dir(spark, "t-a8") + "/p.jsonl"
    A.write_prediction_batches(preds, path)
    back = A.read_prediction_batches(spark, path)
    a = {(r.pos, r.generated) for r in preds.select("pos", "generated").collect()}
    b = {(r.pos, r.generated) for r in back.collect()}
    assert a == b
    with pytest.raises(ValueError):     # a file of single batches does not grow
        A.read_prediction_batches(spark, path, cumulative=True)


def test_log_softmax_sums_to_one(spark):
    out = R.log_softmax(S.candidates(spark, SF_SMALL), ["sample_id", "step"], temperature=0.7)
    sums = out.groupBy("sample_id", "step").agg(F.sum(F.exp("log_prob")).alias("p")).collect()
    assert all(math.isclose(r.p, 1.0, rel_tol=1e-9) for r in sums)


def test_position_scores_sum_back(spark):
    h = running(S.hypotheses(spark, SF_SMALL), ["sample_id"], ["beam", "tie1", "tie2", "score"],
                {"cum_score": ("sum", "score")})
    for strategy in ("window", "chunked"):
        out = R.position_scores(h, "sample_id", ["beam", "tie1", "tie2", "score"], strategy=strategy)
        bad = out.filter(F.abs(F.col("pos_score") - F.col("score")) > 1e-9).count()
        assert bad == 0


def test_stream_final_state_equals_batch(spark):
    import __spark_entry__ as ent
    streamed = {r.code: (r.n_correct, r.n) for r in ent.queries()["i1_stream_accuracy"](spark, SF_SMALL).collect()}
    ev = S.table(spark, SF_SMALL, "events").select(F.col("event_type").alias("code"),
                                                   (F.col("value") > 50).cast("int").alias("correct"))
    batch = {r.code: (r.n_correct, r.n) for r in E.accuracy_by_code(ev).collect()}
    assert streamed == batch


def test_token_budget_batches_respect_limits(spark):
    s = S.samples(spark, SF_SMALL).withColumn("n_tokens", F.size("tokens"))
    packed = D.token_budget_batches(s, max_tokens=2048, max_sentences=16)
    rows = packed.collect()
    assert sorted(r.sample_id for r in rows) == sorted(r.sample_id for r in s.collect())
    groups = {}
    for r in rows:
        groups.setdefault(r.batch_id, []).append(r.n_tokens)
    for lens in groups.values():
        assert len(lens) <= 16
        assert len(lens) == 1 or len(lens) * max(lens) <= 2048


def test_seeded_shuffle_batches_are_stable(spark):
    s = S.samples(spark, SF_SMALL).select("sample_id", "pos")
    a = {r.sample_id: r.batch_id for r in D.batches(s, 64, shuffle=True, seed=7).collect()}
    b = {r.sample_id: r.batch_id for r in D.batches(s, 64, shuffle=True, seed=7).collect()}
    assert a == b
    sizes = {}
    for v in a.values():
        sizes[v] = sizes.get(v, 0) + 1
    assert max(sizes.values()) <= 64 and sum(sizes.values()) == len(a)


def test_strict_reader_quarantines_bad_lines(spark):
    path = shared_dir(spark, "t-a3") + "/x.tsv"
    lines = ["idx\ttext\tlabel\tsem_type\tlanguage", "0\ta\tb\tc\tfr", "1\tbroken", "2\ta\tb\tc\td\te"]
    spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "pos long, line string") \
        .transform(lambda d: A.write_lines(d, path) or d)
    good, bad = A.read_strict_tsv(spark, path)
    assert [tuple(r) for r in good.collect()] == [("0", "a", "b", "c", "fr")]
    assert sorted(r.n_fields for r in bad.collect()) == [2, 6]
    with pytest.raises(ValueError):
        A.read_strict_tsv(spark, path, on_bad="raise")


def test_report_refuses_to_overwrite(spark):
    path = shared_dir(spark, "t-a10") + "/r.txt"
    lines = spark.createDataFrame([(0, "x")], "line_no long, line string")
    A.write_report(lines, path)
    with pytest.raises(Exception):
        A.write_report(lines, path)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_partition_independence(spark, parts):
    docs = S.table(spark, SF_SMALL, "documents").select("doc_id", "n_chars").repartition(parts)
    pos = {r.doc_id: r.pos for r in with_position(docs, ["n_chars", "doc_id"], num_partitions=parts).collect()}
    ref = sorted(docs.collect(), key=lambda r: (r.n_chars, r.doc_id))
    assert pos == {r.doc_id: i for i, r in enumerate(ref)}
    hyps = S.hypotheses(spark, SF_SMALL).repartition(parts)
    ranked = R.rank_hypotheses(hyps, tie=("beam", "tie1", "tie2"), strategy="chunked")
    windowed = R.rank_hypotheses(hyps, tie=("beam", "tie1", "tie2"), strategy="window")
    a = {(r.sample_id, r.beam, r.tie1, r.tie2): r.rank for r in ranked.collect()}
    b = {(r.sample_id, r.beam, r.tie1, r.tie2): r.rank for r in windowed.collect()}
    assert a == b
    # D5 on a repartitioned expansion, F3 on a repartitioned log.
    exp = _expanded_fixture(spark, 120).repartition(parts)
    kept = sorted(r.pos for r in D.rotating_sample(exp).collect())
    assert kept == sorted(r.pos for r in D.rotating_sample(_expanded_fixture(spark, 120)).collect())
    log = S.training_log(spark, SF_SMALL).repartition(parts)
    best = {(r.split, r.epoch): r.improved for r in R.best_checkpoints(E.epoch_loss(log)).collect()}
    base = {(r.split, r.epoch): r.improved
            for r in R.best_checkpoints(E.epoch_loss(S.training_log(spark, SF_SMALL))).collect()}
    assert best == base


def test_chunked_running_survives_a_hot_group(spark):
    # One key holds half of all rows; a null key is a group of its own.
    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 == 1, F.lit(None))
        .otherwise((F.col("id") % 5).cast("string")).alias("g"),
        F.col("id").alias("t"), (F.col("id") % 13).cast("double").alias("v"))
    specs = {"s": ("sum", "v"), "c": ("count", "v"), "mn": ("min", "v"), "mx": ("max", "v"),
             "lg": ("lag", "v")}
    for exclusive in (False, True):
        a = running(df, ["g"], ["t"], specs, exclusive=exclusive, num_chunks=16, strategy="chunked")
        b = running(df, ["g"], ["t"], specs, exclusive=exclusive, strategy="window")
        ka = {r.t: (r.s, r.c, r.mn, r.mx, r.lg) for r in a.collect()}
        kb = {r.t: (r.s, r.c, r.mn, r.mx, r.lg) for r in b.collect()}
        assert ka == kb


def test_scan_dir_reads_only_matching_entries(spark):
    base = shared_dir(spark, "t-a4")
    s = S.samples(spark, SF_SMALL).select("pos", "text", "label", "sem_type", "language")
    A.write_samples(s, f"{base}/gen_translated.tsv")
    A.write_samples(s.limit(3), f"{base}/dev.tsv")
    got = A.scan_dir(spark, base, "translated", A.read_translated)
    assert got.count() == s.count()
    assert got.filter(~F.col("source_file").contains("translated")).count() == 0


def test_parallel_lines_stop_at_the_shortest(spark):
    base = shared_dir(spark, "t-a5")
    a = spark.createDataFrame([(i, f"a{i}") for i in range(5)], "pos long, line string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(3)], "pos long, line string")
    A.write_lines(a, f"{base}/x.src")
    A.write_lines(b, f"{base}/x.tgt")
    rows = A.read_parallel_lines(spark, [f"{base}/x.src", f"{base}/x.tgt"], ["src", "tgt"]).collect()
    assert sorted((r.pos, r.src, r.tgt) for r in rows) == [(0, "a0", "b0"), (1, "a1", "b1"), (2, "a2", "b2")]


def test_evaluation_plan_report_has_average_first(spark):
    import __spark_entry__ as ent
    lines = sorted(ent.queries()["evaluate_hypotheses"](spark, SF_SMALL).collect(), key=lambda r: r.line_no)
    assert lines[0].line.strip().startswith("full") and lines[0].line.rstrip().split(":")[0].endswith("average")
    assert [r.line_no for r in lines] == list(range(len(lines)))


def test_chunks_agree_with_the_window_on_a_hot_group(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("string").alias("g"),
                                  F.col("id").alias("t"), F.lit(1.0).alias("v"))
    a = running(df, ["g"], ["t"], {"s": ("sum", "v")})
    b = running(df, ["g"], ["t"], {"s": ("sum", "v")}, strategy="window")
    assert {r.t: r.s for r in a.collect()} == {r.t: r.s for r in b.collect()}


def _brute_force_packing(rows, max_tokens, max_sentences):
    """Row by row over each length bucket in order of (length, key)."""
    out, held, k, last = {}, 0, 0, None
    for bucket, n, key in sorted((max(n - 1, 0).bit_length(), n, key) for key, n in rows):
        if bucket != last:
            last, held, k = bucket, 0, 0
        elif held + 1 > max_sentences or (held + 1) * n > max_tokens:
            held, k = 0, k + 1
        held += 1
        out[key] = f"{bucket}-{k}"
    return out


def test_token_budget_batches_match_brute_force(spark):
    s = S.samples(spark, SF_SMALL).withColumn("n_tokens", F.size("tokens"))
    got = {r.sample_id: r.batch_id for r in
           D.token_budget_batches(s, max_tokens=3000, max_sentences=8, num_chunks=5).collect()}
    rows = [(r.sample_id, r.n_tokens) for r in s.select("sample_id", "n_tokens").collect()]
    assert got == _brute_force_packing(rows, 3000, 8)


def test_stream_totals_over_several_micro_batches(spark):
    from lexmetric.streaming import stream_accuracy
    src = shared_dir(spark, "t-stream-src")
    ev = S.table(spark, SF_SMALL, "events")
    ev.repartition(3).write.parquet(src)            # three files -> three micro-batches
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
              .select(F.col("event_type").alias("code"), (F.col("value") > 50).alias("ok")))
    totals, trail = stream_accuracy(spark, stream, history=True)
    got = {r.code: (r.n_correct, r.n) for r in totals.collect()}
    epochs = sorted({r.batch_id for r in trail.select("batch_id").collect()})
    assert len(epochs) == 3
    last = {r.code: (r.n_correct, r.n) for r in trail.filter(F.col("batch_id") == epochs[-1]).collect()}
    assert last == got
    sizes = [trail.filter(F.col("batch_id") == e).agg(F.sum("n")).first()[0] for e in epochs]
    assert sizes == sorted(sizes) and sizes[-1] == ev.count()
    batch = ev.select(F.col("event_type").alias("code"), (F.col("value") > 50).cast("int").alias("correct"))
    want = {r.code: (r.n_correct, r.n) for r in E.accuracy_by_code(batch).collect()}
    assert got == want


def test_score_predictions_plan(spark):
    from lexmetric.catalog import _reverse_words_predictor
    from lexmetric.plans.evaluation import score_predictions
    s = S.samples(spark, SF_SMALL).select("sample_id", "text", "label", "language", "sem_type")
    out = score_predictions(s, _reverse_words_predictor)
    rows = s.collect()
    fn = _reverse_words_predictor()
    want = sum(1 for r in rows if fn([r.text])[0] == r.label) / len(rows)
    assert math.isclose(out["exact_match"].first().exact_match, want)
    cube = out["breakdown"].filter("level = 3").first()
    assert cube.n == len(rows)
