"""Round 4: whole texts in growing prediction files; sources and sinks that move and write less."""

from __future__ import annotations

import gzip
import itertools
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from lexmetric.functions.columns import STRIP_CHARS, STRIP_CLASS
from lexmetric.llm import jaccard
from lexmetric.sources import files as A

QUERIES = entry.queries()


@pytest.fixture
def documents(spark, tmp_path):
    rows = [(i, f'word{i} "a"\tb\nc{i % 3} d e f g h', "web", "en") for i in range(600)] + [(600, "", "web", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(
        f"{tmp_path}/documents.parquet")
    return str(tmp_path), {r[0]: r[1] for r in rows}


def test_growing_predictions_hold_whole_texts(spark, documents):
    sf, texts = documents
    got = QUERIES["a8_growing_predictions"](spark, sf).collect()
    assert {r["pos"]: r["text"] for r in got} == texts and len(got) == len(texts)
    assert {(r["pos"], r["batch_id"]) for r in got} == {(i, i // 256) for i in texts}
    assert "md5" not in entry.oracle_sql()["a8_growing_predictions"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


SAMPLE = "pos long, text string, label string, sem_type string, language string"


def _samples(n=40):
    return [(i, t, "l", None, "fr") for i, t in enumerate(["", None, 'a\t"b"\n\nc', "d\r", "\r\ne", "plain"] * n)]


def test_writers_run_the_work_behind_their_rows_once(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch
    rows = _samples()
    df = spark.createDataFrame(rows, SAMPLE).repartition(3)
    A.write_samples(df.mapInArrow(count, SAMPLE), f"{tmp_path}/s", compression="gzip")
    assert ran.value == len(rows)
    A.write_plain_tsv(df.mapInArrow(count, SAMPLE).withColumnRenamed("pos", "idx"), f"{tmp_path}/p", compression="gzip")
    assert ran.value == 2 * len(rows)
    assert sorted(tuple(r) for r in A.read_translated(spark, f"{tmp_path}/s").collect()) == rows


def test_files_that_cannot_be_split_are_read_once(spark, tmp_path):
    with gzip.open(tmp_path / "a_translated.tsv.gz", "wt", encoding="utf-8", newline="") as f:
        f.write('\ttext\tlabel\tsem_type\tlanguage\r\n0\t"x\r\ny"\t\t""\tfr\r\n\n1\t"z""\tw"\ta\tb\t"open\nto the end')
    with gzip.open(tmp_path / "b_translated.tsv.gz", "wt", encoding="utf-8", newline="") as f:
        f.write("\ttext\tlabel\tsem_type\tlanguage\n2\ta\tb\tc\td")
    got = A.scan_dir(spark, str(tmp_path), "translated", A.read_translated)
    assert "Join" not in _plan(got) and _plan(got).count("Scan text") == 1
    assert sorted(tuple(r)[:4] for r in got.collect()) == [
        (0, "x\r\ny", None, ""), (1, 'z"\tw', "a", "b"), (2, "a", "b", "c")]


def test_strict_lines_are_stripped_and_counted_once(spark, tmp_path):
    data = ("idx\ttext\tlabel\tsem_type\tlanguage\n" + "　\x1c 0\ta\tb\tc\td\x85 \n" + "\n" + "1\ta​\n").encode()
    (tmp_path / "t.tsv").write_bytes(data + b"2\t\xff\tb\tc\td\n")
    good, bad = A.read_strict_tsv(spark, str(tmp_path / "t.tsv"))
    assert "regexp_replace" not in _plan(good) + _plan(bad)
    assert sorted(map(tuple, good.collect())) == [("0", "a", "b", "c", "d"), ("2", "�", "b", "c", "d")]
    assert sorted(map(tuple, bad.collect())) == [("", 1), ("1\ta​", 2)]
    as_python = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", STRIP_CLASS)
    assert re.findall(as_python, "".join(map(chr, range(0x3100)))) == list(STRIP_CHARS)


def test_rebuilt_output_is_zstd(spark, tmp_path):
    A.rebuild_output(spark.range(5).toDF("a"), f"{tmp_path}/o")
    A.rebuild_output(spark.range(3).toDF("a"), f"{tmp_path}/o")
    assert [r.a for r in spark.read.parquet(f"{tmp_path}/o").orderBy("a").collect()] == [0, 1, 2]
    assert all(".zstd." in f.name for f in (tmp_path / "o").glob("*.parquet"))


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_predictions_move_once(spark, tmp_path, compression):
    rows = [(i // 4, i, f"t{i}\n", None, "g") for i in range(50)] + [(None, 50, "n", "l", "g")]
    df = spark.createDataFrame(rows, "batch_id long, pos long, text string, label string, generated string")
    A.write_prediction_batches(df.repartition(5), f"{tmp_path}/p", compression=compression)
    assert all(f.name.endswith(".gz") == (compression == "gzip") for f in (tmp_path / "p").glob("part-*"))
    got = A.read_prediction_batches(spark, f"{tmp_path}/p")
    assert "Exchange hashpartitioning" not in _plan(got) and "Sort" not in _plan(got)
    # The rows of no batch are the file's first line, so the others' batches are one further.
    want = [(0, "n", "l", "g", 0)] + [(b + 1, t, l, g, i + 1) for b, i, t, l, g in rows[:50]]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[-1]) == want


@pytest.mark.parametrize("few", [0, 64])
def test_units_give_the_pairs_their_points_allow(few):
    """Small units at once and leaves of large ones: every pair of close points across components, no other."""
    r, rule = random.Random(few), jaccard.Rule(80, 100)
    sizes = [3, 40, 2] if few else [150]
    base = {k: [r.getrandbits(64) for _ in range(k)] for k in (40, 120, 1700)}
    sets, starts = [], [0]
    for size in sizes:
        for _ in range(size):
            whole = base[r.choice(list(base))]
            sets.append(np.array(sorted(whole[:len(whole) - r.randint(0, len(whole) // 3)]), dtype=np.uint64))
        starts.append(len(sets))
    node, comp = np.arange(len(sets)) + 100, np.array([r.randint(0, 9) for _ in sets])
    n, vec = np.array([len(s) for s in sets]), [jaccard.point(s) for s in sets]
    want, linked = set(), set()
    for a, b in zip(starts, starts[1:]):
        for i, j in itertools.combinations(range(a, b), 2):
            if comp[i] != comp[j]:
                p, q = (jaccard._fold(vec[k]).astype(int) for k in (i, j))
                w = min(len(p), len(q))
                same = np.minimum(p.reshape(-1, w).sum(0), q.reshape(-1, w).sum(0)).sum()
                want |= {(i + 100, j + 100)} if 180 * same >= 80 * (n[i] + n[j]) else set()
                linked |= {(i + 100, j + 100)} if rule.linked(n[i], n[j], len(np.intersect1d(sets[i], sets[j]))) else set()
    if few:
        tile = np.zeros(len(sets), dtype=int)
        x, y = jaccard._few(np.array(starts[:-1]), np.array(starts[1:]), {
            "node": node, "comp": comp, "n": n, "tile": tile, "t": tile, "u": tile, "data": vec}, rule)
        got = set(zip(x.tolist(), y.tolist()))
        assert got == want
    else:
        leaves = jaccard.Leaves(node, comp, n, [jaccard._fold(v) for v in vec])
        got = {tuple(sorted(p)) for p in jaccard._surviving(leaves, leaves, rule)}
        assert got >= want      # points of one unit have the groups of its smallest set
    assert linked and linked <= got
