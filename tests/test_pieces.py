"""Packed outcome lists, growing files, vectors in pieces, n-grams by hashes."""

import random
from collections import Counter, defaultdict

import pytest

from lexmetric.operators import metrics as E
from lexmetric.operators import tokens as TK
from lexmetric.sources import files as A


def test_packed_lists_come_back(spark):
    rnd = random.Random(4)
    rows = [(p, rnd.choice(["a", "a", "b", None]), rnd.choice([0, 1, None])) for p in range(700)]
    df = spark.createDataFrame(rows, "pos long, code string, correct int")
    bits = E.outcome_bits(df, chunk=64)
    assert max(r.n for r in bits.collect()) == 64
    got = defaultdict(list)
    for r in E.outcomes_of_bits(bits).orderBy("code", "chunk").collect():
        got[r.code] += r.outcomes
    want = defaultdict(list)
    for _, code, ok in rows:
        want[code].append(ok or 0)
    assert got == want
    assert {r.code: (r.n, r.n_correct) for r in E.accuracy_of_bits(bits).collect()} \
        == {c: (len(v), sum(v)) for c, v in want.items()}
    assert E.outcome_bits(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        E.outcome_bits(df, chunk=100)


def _row(x):
    return '{"text":"%s","label":"l","generated":"]"}' % x


def _growing(tmp_path, *lines):
    path = tmp_path / "grown.jsonl"
    path.write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
    return str(path)


def test_growing_file_by_differences(spark, tmp_path):
    a, b, c = _row("a"), _row("b ü"), _row("c")
    path = _growing(tmp_path, "[]", f"[{a}]", f"[{a}]", f"[{a}, {b},{c}]")
    got = A.read_prediction_batches(spark, path, cumulative=True).orderBy("pos").collect()
    assert [(r.batch_id, r.text, r.pos) for r in got] == [(1, "a", 0), (3, "b ü", 1), (3, "c", 2)]


@pytest.mark.parametrize("last", ["[{b}]", "[{b},{a}]", "[{a}{b}]", "[]"])
def test_file_that_does_not_grow(spark, tmp_path, last):
    path = _growing(tmp_path, f"[{_row('a')}]", last.format(a=_row("a"), b=_row("b")))
    with pytest.raises(ValueError):
        A.read_prediction_batches(spark, path, cumulative=True)


@pytest.mark.parametrize("max_bytes", [1 << 26, 0])
def test_vectors_in_pieces(spark, max_bytes):
    rnd = random.Random(2)
    ids = {k: [rnd.choice([1, 4, 5, 6, 99, None]) for _ in range(n)] for k, n in enumerate([0, 1, 3, 4, 5, 41])}
    vec = {1: [9.0, 9.0], 4: [1.0, 2.0], 5: [3.0, 4.0], 6: [5.0, 6.0]}
    df = spark.createDataFrame(list(ids.items()), "sample_id long, ids array<int>")
    table = spark.createDataFrame(list(vec.items()), "token_id int, vec array<double>")
    got = {(r.sample_id, r.piece): r.vectors
           for r in TK.embed_pieces(df, table, piece=4, scale=2.0, max_bytes=max_bytes).collect()}
    want = {(k, i // 4): [[2 * x for x in vec[t]] if t in (4, 5, 6) else [0.0, 0.0] for t in v[i:i + 4]]
            for k, v in ids.items() for i in range(0, len(v), 4)}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_ngrams_by_hashes(spark, n):
    rnd = random.Random(n)
    texts = {k: [rnd.choice("ab") for _ in range(size)] for k, size in enumerate([0, 1, 2, 3, 7, 8, 9, 60])}
    df = spark.createDataFrame(list(texts.items()), "sample_id long, tokens array<string>")
    want = {(k, g): c for k, t in texts.items()
            for g, c in Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1)).items() if c > 1}
    assert {(r.sample_id, tuple(r.ngram)): r.n for r in TK.repeated_ngrams(df, n).collect()} == want
    if n > 1:
        banned = {(k, t[i + n - 1]) for k, t in texts.items() if len(t) >= n
                  for i in range(len(t) - n + 1) if t[i:i + n - 1] == t[len(t) - n + 1:]}
        rows = TK.banned_next_tokens(df, n).collect()
        assert {(r.sample_id, r.token) for r in rows} == banned and len(rows) == len(banned)


def test_vectors_of_repeated_and_null_keys(spark):
    """Rows alike in key become one, by position and vector; with every column kept each row has them all."""
    df = spark.createDataFrame([(1, "a", [4, 5, 1]), (1, "b", [5, None, 9, 4]), (None, "c", [4]), (2, "d", [4, 4, 7]),
                                (3, "e", None), (4, "f", [])], "sample_id long, name string, ids array<int>")
    table = spark.createDataFrame([(4, [1.0, 2.0]), (5, [3.0, None]), (7, [5.0, 6.0]), (7, [5.0, -6.0]), (1, [9.0, 9.0]), (8, None)],
                                  "token_id int, vec array<double>")
    zero, four, five = [0.0, 0.0], [2.0, 4.0], [6.0, None]
    want = {1: [four, five, zero, five, zero, zero, four], None: [four], 2: [four, four, [10.0, -12.0], [10.0, 12.0]], 3: [], 4: []}
    got = TK.embed_tokens(df, table, scale=2.0, dim=2, keep=[]).collect()
    assert {r.sample_id: r.vectors for r in got} == want and len(got) == 5
    got = {r.name: (r.sample_id, r.vectors) for r in TK.embed_tokens(df, table, scale=2.0, dim=2).collect()}
    assert got == {"a": (1, want[1]), "b": (1, want[1]), "c": (None, None), "d": (2, want[2]), "e": (3, []), "f": (4, [])}


def test_vectors_are_never_dealt_by_token(spark):
    """Only a chunk's distinct ids meet the vectors: no join carries a row per token."""
    df = spark.createDataFrame([(k, [4, 5] * 2000) for k in range(40)], "sample_id long, ids array<int>")
    table = spark.createDataFrame([(4, [1.0]), (5, [2.0])], "token_id int, vec array<double>")
    for emb in (TK.embed_tokens(df, table, dim=1, keep=[], max_bytes=0), TK.embed_pieces(df, table, dim=1, piece=8, max_bytes=0)):
        plan = emb._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(ids" not in plan and "posexplode(_ids" not in plan and "collect_list" not in plan
        assert emb.selectExpr("sum(size(vectors)) n").first().n == 160_000
