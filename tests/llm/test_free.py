"""Operators 1, 2, 4 and 7 to 10 against plain Python, and their edge cases."""

import itertools
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from lexmetric.llm import chat, extraction, graph, hilbert, jaccard, lines, tiling, toxicity


# ---- 1
@pytest.fixture(scope="module")
def chain():
    prose = [" ".join(random.Random(i).choices("the of house tree green runs and falls over water".split(), k=9)).capitalize() + "."
             for i in range(200)]
    return extraction.train(extraction.labelled_pages(prose, 400)), prose


def test_held_out_labelled_pages(chain):
    model, prose = chain
    right = total = 0
    for rows, labels in [p for s in range(5000, 5100) for p in [_labelled(prose, s)] if p]:
        got = model.decode(rows)
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.95


def _labelled(prose, seed):
    page, main = extraction.render_labelled(prose, seed)
    found, labels, i = extraction.blocks(page), [], 0
    for text, *_ in found:
        hit = i < len(main) and text == main[i]
        labels.append(int(hit))
        i += hit
    return (extraction.features(found), labels) if found and i == len(main) else None


def test_viterbi_is_the_best_path(chain):
    model, prose = chain
    for seed in range(6000, 6010):
        rows = (_labelled(prose, seed) or ([], []))[0][:10]
        def value(path):
            x = sum(sum(model.weights.get(f, 0) for f in r) for r, y in zip(rows, path, strict=True) if y)
            return x + sum(model.steps[a][b] for a, b in itertools.pairwise(path))
        best = max(itertools.product((0, 1), repeat=len(rows)), key=value)
        assert value(model.decode(rows)) == pytest.approx(value(best))


def test_extract_edges(spark, chain):
    page = ("<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a href=/x>Home</a></nav>"
            "<article><h1>Fish &amp; chips</h1><p><b>One   line.<br><p>Two&nbsp;lines, and the tree falls over.</article>"
            "<div class='comments'><p>The house is green and falls over.</p></div><footer>&copy; me</footer>")
    df = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 1), (None, "v", "", 1), (4, "w", "<p", 1),
                                (5, "x", "<article>" + "<p>The tree is green.</p>" * 5000, 1)],
                               "page_id long, url string, html string, n_chars long")
    got = {r.page_id: r for r in extraction.extract(df, chain[0]).collect()}
    assert got[1].text == "Fish & chips\n\nOne line.\n\nTwo lines, and the tree falls over."
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" and got[None].text == ""
    assert got[5].text.count("\n\n") == 4999
    assert extraction.extract(df.limit(0), chain[0]).count() == 0


# ---- 2
def test_line_dedup(spark):
    rows = [(i, f"http://A.example/{i}", f"<p>Same line</p><p>own {i}</p>") for i in range(5)]
    rows += [(10, "http://b.example/", "<p>Same line</p>"), (11, None, None), (12, "x", ""), (13, "http://A.example/9", "<p>Same line</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in lines.dedup(df).collect()}
    assert got[0].text == "own 0" and got[0].n_dropped == 1 and got[13].text == ""
    assert got[10].text == "Same line" and got[11].n_lines == 0
    assert lines.dedup(df.limit(0)).count() == 0


def test_line_dedup_on_hosts_of_all_sizes(spark):
    """Hosts of one to five pages and every count of a line, against plain counting."""
    from collections import Counter
    rows, page = [], 0
    for pages in range(1, 6):
        for i in range(pages):
            shown = [f"on {n} pages" for n in range(1, pages + 1) if i < n]
            rows.append((page, f"http://h{pages}.example/{i}", "<br>".join([*shown, *shown, f"own {page}"])))
            page += 1
    per_host = Counter(r[1].split("/")[2] for r in rows)
    seen = Counter((r[1].split("/")[2], x) for r in rows for x in set(r[2].split("<br>")))
    want = {}
    for key, url, html in rows:
        host = url.split("/")[2]
        want[key] = "\n".join(x for x in html.split("<br>") if seen[host, x] < 2 or 2 * seen[host, x] <= per_host[host])
    got = {r.page_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert "on 2 pages" not in got[1] and "on 1 pages" in got[0]


# ---- 4
def _least(roles):
    """Brute force over all legal outputs by shortest path."""
    costs = {chat.START: 0}
    for r in roles:
        new = {}
        for s, c in costs.items():
            for m in range(chat.STATES):
                if m == s or (s, m) in chat.INSERTS:
                    chain = [] if m == s else chat.INSERTS[s, m]
                    base = c + chat.INSERT * len(chain)
                    opts = [(q, 0 if q == r else chat.RELABEL) for q in chat._NEXT[m]]
                    if m != chat.START and not chain:
                        opts.append((m, chat.MERGE if m == r else chat.MERGE_OTHER))
                    for q, x in opts:
                        new[q] = min(new.get(q, 10 ** 9), base + x)
        costs = new
    return min(c + chat.INSERT * len(chat.closing(s)) for s, c in costs.items())


def test_chat_repair_costs_and_borders(spark):
    r = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "tool", None, " User"]), r.choice(["hi", "", None])))
    rows += [(1000, t, r.choice(["user", "assistant"]), "z") for t in range(3000)]
    rows += [(None, None, "user", "n"), (None, 1, "assistant", "m"), (2000, 0, "user", "same"), (2000, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.repair(df).collect()
    assert len(got) == len(rows)
    want, cost = {}, {}
    for c, t, role, text in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
        want.setdefault(c, []).append(chat.code(role))
    for x in got:
        cost[x.conv_id] = cost.get(x.conv_id, 0) + x.cost
    assert cost == {c: _least(v) for c, v in want.items()}
    one = chat.repair(df.where("conv_id = 2000")).orderBy("new_role", "action").collect()
    assert "".join(x.piece for x in one) == "<|user|>\nsame\nsame<|end|>\n<|assistant|>\n<|end|>\n"
    assert chat.repair(df.limit(0)).count() == 0


# ---- 7
def _tile(a, b, k):
    am, bm, tiles = set(), set(), []
    while True:
        best = (0,)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in am and j + n not in bm:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            return sum(tiles)
        n, i, j = best
        am.update(range(i, i + n))
        bm.update(range(j, j + n))
        tiles.append(n)


def test_tiles_equal_plain_greedy_tiling():
    r = random.Random(5)
    for _ in range(150):
        a, b = [r.randrange(4) for _ in range(r.randint(1, 30))], [r.randrange(4) for _ in range(r.randint(1, 40))]
        got = tiling.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert max((t[2] for t in got), default=0) == _longest(a, b, 3)
        assert not tiling.tile(np.array([], np.uint64), np.array(b, np.uint64), 3)
        assert sum(t[2] for t in got) == _tile(a, b, 3)


def test_tiles_of_repeated_words():
    same = np.full(8_000, 17, np.uint64)
    start = time.perf_counter()
    assert tiling.tile(same[:602], same) == [(0, 0, 602)]
    assert len(tiling.tile(np.tile(same[:7] + np.arange(7, dtype=np.uint64), 80), same)) == 0
    assert time.perf_counter() - start < 1


def _longest(a, b, k):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= k else 0


def test_decontamination(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(24))
    words = item.split()
    moved = " ".join(["x y", *words[12:], "in between", *words[:12]])
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    docs = docs_of([(1, "a b c " + item.upper() + " d", "s"), (2, moved, "s"), (3, " ".join(words[:6]), "s"),
                    (4, None, "s"), (5, "", "s"), (None, item, "s"), (6, "z " * 100_000 + item, "s"), (7, "clean text", "s")])
    for block in (10, 2_000_000):
        got = {(r.doc_id, r.item_id, round(r.coverage, 3)) for r in tiling.coverage(docs, bench, block_tokens=block).collect()}
        assert got == {(1, 1, 1.0), (2, 1, 1.0), (None, 1, 1.0), (6, 1, 1.0)}
    left = tiling.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 7]
    assert tiling.coverage(docs.limit(0), bench).count() == 0 and tiling.coverage(docs, bench.limit(0)).count() == 0


# ---- 8
def test_toxicity(spark, docs_of):
    r = random.Random(6)
    base = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join(r.choices(base, k=30) + (["scum", "Idiot"] if bad else [])), "s"))
        labels.append((i, int(bad), 1))
    rows += [(9000, None, "s"), (9001, "", "s"), (None, "idiot!", "s"), (9003, "scum " * 20_000, "s")]
    docs = docs_of(rows)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    index = toxicity.fit(docs, lab)
    got = {x.doc_id: x for x in toxicity.score(docs, index).collect()}
    assert all((got[i].score >= 0.5) == (i % 5 == 0) for i in range(600))
    assert got[9000].score == got[9001].score < 0.5 and got[9003].score > 0.5 and got[None].score > 0.5
    kept = toxicity.keep_clean(docs, index)
    assert kept.columns == docs.columns and kept.count() == 482
    none = toxicity.fit(docs, lab.limit(0))
    assert {x.score for x in toxicity.score(docs, none).collect()} == {0.0}


def test_terms_of_both_labels_and_all_examples(spark, docs_of):
    """A term of 8 toxic texts (chi-squared 32) and one of clean texts (30) are evidence; no example is left out."""
    bad, rows = range(0, 600, 5), []
    for i in range(600):
        rows.append((i, f"plain{i % 7}" + (" scum" if i in bad and i < 40 else "") + (" thanks" if i % 5 == 1 and i < 500 else ""), "s"))
    docs = docs_of(rows)
    sample = docs.withColumn("y", (docs.doc_id % 5 == 0).cast("int")).select("doc_id", "y", "text")
    assert {"scum", "thanks"} <= set(toxicity.choose_terms(sample))
    labels = [(i, int(i % 5 == 0)) for i in range(600)]
    index = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = docs.select(toxicity.held_out(docs.doc_id)).collect()
    assert len(index.ids) == sum(not r[0] for r in held)


def test_nearest_is_exact():
    r = random.Random(7)
    names = [f"t{i}" for i in range(20)]
    rows = [(i, r.randrange(2), {t: r.randint(1, 3) for t in r.sample(range(20), r.randint(0, 4))}) for i in range(1500)]
    index = toxicity.Index(names, np.linspace(1, 3, 20), rows, k=7)
    dense = np.zeros((1500, 20))
    for i, (_, _, c) in enumerate(rows):
        at, w = index.vector(c)
        dense[i, at] = w
    for _ in range(50):
        q = {t: r.randint(1, 3) for t in r.sample(range(20), 3)}
        at, w = index.vector(q)
        cos = np.round(dense[:, at] @ w, 12)
        want = sorted((-c, i) for i, c in enumerate(cos.tolist()) if c > 0)
        want = [x for x in want if x[0] <= want[:7][-1][0]]     # all that tie with the seventh
        got = index.nearest(q)
        assert [i for _, i in want] == [int(index.ids[e]) for _, e in got]
        assert [c for c, _ in got] == pytest.approx([-c for c, _ in want])


def test_score_does_not_hang_on_ids():
    r = random.Random(8)
    rows = [(i, r.randrange(2), {t: 1 for t in r.sample(range(6), r.randint(0, 2))}) for i in range(900)]
    names, idf = [f"t{i}" for i in range(6)], np.linspace(1, 3, 6)
    one = toxicity.Index(names, idf, rows)
    other = toxicity.Index(names, idf, [(r.random() * 2 ** 40 // 1, y, c) for _, y, c in r.sample(rows, len(rows))])
    for a in range(6):
        for b in range(6):
            q = {a: 1, b: 2}
            assert one.score(q)[0] == other.score(q)[0]


def test_index_takes_little_room_on_the_driver(spark, docs_of):
    """Examples of many terms come to the driver as arrays, not as Python numbers and pairs."""
    r = random.Random(9)
    pool = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(1200)]
    rows = [(i, " ".join(r.sample(pool[i % 2 * 600:][:600], 150)), "s") for i in range(1000)]
    docs, labels = docs_of(rows), spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, toxic int")
    tracemalloc.start()
    index = toxicity.fit(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = sum(map(len, index.who))
    assert held > 250_000 and held == sum(map(len, index.weight))
    assert peak < 80 * held


# ---- 9
def test_hilbert_curve_visits_every_cell_once_in_unit_steps():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    at = hilbert.hilbert_index(cells, 3)
    assert sorted(at) == list(range(512))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards(docs_of):
    rows = [(i, "x" * (i % 37), f"src{i % 3}") for i in range(100)]
    rows += [(None, None, None), (5, "x" * 5, "src2"), (5, "x" * 5, "src2"), (200, "é" * 100_000, "a")]
    docs = docs_of(rows)
    got = hilbert.assign(docs, shards=16).collect()
    assert len(got) == 104
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {len(v) for v in by.values()} == {6, 7}
    wide = hilbert.shard_rows(docs, shards=16)
    assert wide.columns == [*docs.columns, "shard", "slot"]
    assert sorted((r.shard, r.slot) for r in wide.collect()) == sorted((r.shard, r.slot) for r in got)
    assert hilbert.assign(docs.limit(0)).count() == 0


def test_long_common_beginnings_are_told_apart(docs_of):
    """Sources that share their first bytes fall into bins of their own, in order."""
    rows = [(i, "same", f"https://host/{i % 16:02}") for i in range(320)] + [(1000 + i, "same", None) for i in range(20)]
    docs = docs_of(rows)
    source = [(docs.source, docs.schema["source"].dataType)]
    got = docs.select("source", hilbert.curve(docs, source, 4).alias("cell")).distinct().collect()
    by = sorted((r.source or "", r.cell) for r in got)
    assert len(by) == 17 and [c for _, c in by] == sorted(c for _, c in by) and len({c for _, c in by}) >= 15


# ---- 10
def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (10, 11), (12, 11), (20, 20), *((100 + i, 101 + i) for i in range(30))]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, **{100 + i: 100 for i in range(31)}}


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80)])
def test_join_equals_all_pairs(docs_of, k, num):
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = r.choices(vocab, k=r.choice([1, 3, 6, 20, 60, 200]))
        for _ in range(r.randint(1, 6)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 30))):
                t[r.randrange(len(t))] = r.choice(vocab)
            texts.append(" ".join(t))
    common = " ".join(vocab[:60])
    texts += [common + " " + " ".join(r.choices(vocab, k=8)) for _ in range(30)]
    texts += [None, "", " \t\n", texts[0].upper(), texts[0], "one", "ONE", "two words", "w " * 30_000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[1], "s")]
    sets = []
    for _, t, _ in rows:
        w = [x for x in (t or "").lower().split()]
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= num * len(s | t):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted(((d, len(s), least.get(find(i), d) if s else d) for i, ((d, _, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)
    docs = docs_of(rows)
    got = jaccard.join(docs, k, num, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    if k == 5:
        kept = jaccard.keep_first(docs, k, num, 100)
        n = len({find(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)
        assert kept.columns == docs.columns and kept.count() == n
        assert jaccard.join(docs.limit(0), k, num, 100).count() == 0


@pytest.mark.parametrize("tile", [512, 4])
def test_join_counts_all_links(docs_of, monkeypatch, tile):
    """Links inside a component count as well, rows of equal texts each."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    r = random.Random(10)
    texts = []
    for size in (30, 60, 120):
        base = [f"b{size}x{i}" for i in range(size)]
        for j in range(12):
            t = list(base)
            for _ in range(r.randint(0, size // 25)):
                t[r.randrange(size)] = f"n{r.randrange(10 ** 6)}"
            texts += [" ".join(t)] * (1 + j % 3)
    texts += [None, "", "alone", "alone", "quite another text with some words"]
    sets = [{tuple(w[i:i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()) for w in ((t or "").split() for t in texts)]
    want = {i: sum(100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets) if a and b and i != j) for i, a in enumerate(sets)}
    got = {x.doc_id: x.n_links for x in jaccard.join(docs_of([(i, t, "s") for i, t in enumerate(texts)]), 4, 85, 100).collect()}
    assert got == want and 0 in want.values() and max(want.values()) > 5


def test_entries_meet_for_every_linked_pair():
    r = random.Random(9)
    rule = jaccard.Rule(85, 100)
    for _ in range(400):
        n = r.choice([7, 12, 40, 90, 180, 500])
        base = [r.getrandbits(64) for _ in range(n)]
        a = set(base)
        b = set(base[r.randint(0, n // 14):]) | {r.getrandbits(64) for _ in range(r.randint(0, n // 14))}
        if a != b and rule.linked(len(a), len(b), len(a & b)):
            x, y = (jaccard.entries(np.array(sorted(s), np.uint64), rule) for s in (a, b))
            assert np.intersect1d(x, y).size


@pytest.mark.parametrize("num", [20, 40, 50, 60, 70, 75])
def test_entries_meet_at_low_thresholds(num):
    """Subsets of as few elements as may link lie up to several size ranges below."""
    r = random.Random(12)
    rule = jaccard.Rule(num, 100)
    for m in [*range(2, 60), 90, 181, 182, 257, 363]:
        whole = [r.getrandbits(64) for _ in range(m)]
        for n in {-(-m * num // 100), (m + -(-m * num // 100)) // 2}:
            assert n == m or rule.linked(n, m, n)
            x, y = (jaccard.entries(np.array(sorted(s), np.uint64), rule) for s in (whole, whole[:n]))
            assert n == m or set(x.tolist()) & set(y.tolist()), (num, n, m)


def test_points_bound_the_overlap():
    r = random.Random(10)
    for n in (5, 150, 3000):
        a = {r.getrandbits(64) for _ in range(n)}
        b = set(list(a)[: n // 2]) | {r.getrandbits(64) for _ in range(n // 2)}
        p, q = (jaccard._fold(jaccard.point(np.array(sorted(s), np.uint64))) for s in (a, b))
        w = min(len(p), len(q))
        assert np.minimum(p.reshape(-1, w).sum(0), q.reshape(-1, w).sum(0)).sum() >= len(a & b)


def test_toxicity_words_and_terms_by_their_definition():
    r = random.Random(3)
    letters = "aBc_ 9.\x1c\t-'éÉßİ²Ⅷ»。漢字😀"
    names = ["ab", "^abcd", "^abcda", "abcda", "^éaaa", "9"]
    vocabulary = toxicity.Vocabulary(names)
    for i in range(3000):
        text = "".join(r.choice(letters if i % 2 else "aabcd 9") for _ in range(r.randint(0, 30)))
        counts = Counter(re.findall(r"[^\W_]+", text.lower()))
        assert toxicity.words(text) == counts
        want = Counter()
        for w, n in counts.items():
            for t in [w, *("^" + w[:k] for k in range(4, min(7, len(w)) + 1))]:
                if t in names:
                    want[names.index(t)] += n
        assert toxicity.terms(counts, vocabulary) == want


def test_toxicity_searches_only_pieces_that_are_not_ascii(monkeypatch):
    searched = []
    word = toxicity._WORD
    monkeypatch.setattr(toxicity, "_WORD", type("W", (), {"findall": staticmethod(lambda t: searched.append(t) or word.findall(t))}))
    assert toxicity.words("Plain words, and «één» more_words") == Counter("plain words and één more words".split())
    assert not any(t.isascii() for t in searched) and sum(map(len, searched)) < 10
