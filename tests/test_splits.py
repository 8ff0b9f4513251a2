"""Files cut into splits read as whole files do."""

import random

import pytest

from lexmetric.session import shared_dir
from lexmetric.sources import files as A
from lexmetric.sources import splits

PIECES = ["word", " ", "\t", "\n", '"', '""', "\r", "\r\n", "é", "", "line\n\n\nafter", "\\", "a,b", '"\n"']


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices(PIECES, k=r.randint(0, 12))) for _ in range(n)] + [None, "x" * 3000 + "\n" * 5 + '"' * 4 + "y" * 3000]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)),
                     spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("split_bytes", [10_000_000, 4000, 700, 97])
def test_quoted_records_over_split_borders(spark, small_splits, split_bytes):
    rows = [(t, f"l{i}", t) for i, t in enumerate(texts(split_bytes, 150))]
    path = shared_dir(spark, "tsv")
    A.write_headerless(spark.createDataFrame(rows, "text string, label string, sem_type string").coalesce(2), path)
    small_splits(split_bytes)
    if split_bytes < 1000:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
    got = [tuple(x) for x in A.read_samples(spark, path).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("split_bytes", [10_000_000, 300])
def test_header_of_every_file_goes(spark, small_splits, split_bytes):
    rows = [(i, t, "a", "b", "fr") for i, t in enumerate(texts(3, 60))]
    path = shared_dir(spark, "tsv")
    df = spark.createDataFrame(rows, "pos long, text string, label string, sem_type string, language string")
    A.write_samples(df.repartition(3), path)
    small_splits(split_bytes)
    got = A.read_translated(spark, path, source_file="file").collect()
    assert sorted(tuple(x)[:5] for x in got) == sorted(rows, key=lambda r: r[0])
    assert len({x.file for x in got}) == len({f.split("/")[-1] for f in spark.read.text(path).inputFiles()})


@pytest.mark.parametrize("split_bytes", [10_000_000, 500, 61])
def test_line_numbers_over_splits(spark, small_splits, split_bytes):
    lines = [f"line {i} " + "x" * (i % 40) for i in range(500)]
    path = shared_dir(spark, "lines")
    A.write_lines(spark.createDataFrame(list(enumerate(lines)), "pos long, line string"), path)
    small_splits(split_bytes)
    got = A.read_lines(spark, path)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.pos, r.line) for r in got.collect()) == list(enumerate(lines))
    assert plan.count("FileScan text") == 1 and "Sort" not in plan


def test_changed_splits_are_noticed(spark, small_splits):
    path = shared_dir(spark, "lines")
    A.write_lines(spark.createDataFrame([(i, "word " * 50) for i in range(200)], "pos long, line string").coalesce(1), path)
    lines = splits.scan_lines(spark, path)
    table = splits.splits(lines)
    small_splits(333)
    again = splits.numbered_in_split(splits.scan_lines(spark, path))
    with pytest.raises(Exception, match="splits changed"):
        splits._with_splits(again, table, "before").collect()


def test_empty_file_and_no_trailing_line_feed(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("")
    (tmp_path / "b.tsv").write_text('x\ty\tz\r\n\n"one\r\ntwo"\t\t""')
    got = sorted((tuple(r) for r in A.read_samples(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("x", "y", "z"), ("one\r\ntwo", None, "")], key=str)
