"""Operators 11 to 13 against plain Python, and their edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexmetric.llm import licenses, phrases, spelling

LONG = "Wanderer wondered about the wanderers of Wunderland. " * 20_000


def plain_variants(rows, min_chars=6, min_count=5, times=5, every=199):
    lower = str.maketrans(spelling.UPPER, spelling.UPPER.lower())
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= times * n[w] else None, n[w], len(others))
    for w, (form, c, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        yield w, (form, root, c, k, n[form] if form else None)


def corpus(seed, every_word=4):
    r = random.Random(seed)
    words = ["".join(w) for w in itertools.product(["wan", "won", "ään"], ["der", "dre", "dder"], ["ing", "er", "ers"])]
    return [(i, " ".join(r.choices(words, weights=[2.0 ** -(j % 13) for j in range(len(words))], k=60)))
            for i in range(60)] + [(None, "Wandering"), (None, None), (5, ""), (5, "wandering wandering")]


@pytest.mark.parametrize("every", [199, 3])
def test_variants_equal_all_pairs(docs_of, every):
    rows = corpus(1)
    got = spelling.variants(docs_of([(i, t, "a") for i, t in rows]), every=every).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == dict(plain_variants(rows, every=every))
    assert len(got) == len({r.word for r in got})


def test_variants_follow_chains(docs_of):
    text = "wanders " * 5 + "wonders " * 25 + "wonderd " * 125 + "yonderd " * 625
    got = {r.word: r for r in spelling.variants(docs_of([(0, text, "a")])).collect()}
    assert got["wanders"].form == "wonders" and got["wanders"].root == "yonderd"
    assert got["yonderd"].form is None and got["yonderd"].root == "yonderd"


@pytest.mark.parametrize("rows", [[], [(1, None, "a")], [(1, "", None)], [(1, "short words only now", "a")]])
def test_variants_none(docs_of, rows):
    assert spelling.variants(docs_of(rows)).collect() == []


def test_variants_long_text_and_clashing_columns(spark):
    rows = [(i, LONG if i == 1 else "wanderer wonderer", "r", "w", 1, "p") for i in (1, 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run string, word string, n int, prefix string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == dict(plain_variants([(r[0], r[1]) for r in rows]))


def plain_collocations(rows, min_count, max_words, top, covered=100):
    lower = str.maketrans(spelling.UPPER, spelling.UPPER.lower())
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, max_words + 1) for i in range(len(words) - k + 1))
    often = {p for p, c in f.items() if c >= min_count and len(p[1]) > 1}
    out = {}
    for lang, p in often:
        a = f[lang, p]
        inside = [q for x, q in often if x == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * f[lang, q] >= covered * a for q in inside):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((" ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], s))
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        yield from ((lang, i, *x) for i, x in enumerate(found[:top], 1))


def phrase_docs(spark, rows):
    return spark.createDataFrame([(t, g, "x", 1, [2], 3) for t, g in rows],
                                 "text string, lang string, phrase string, n int, ids array<int>, shard int")


@pytest.mark.parametrize("shards,covered,top", [(1, 100, 2000), (3, 100, 7), (8, 60, 2000)])
def test_collocations_equal_plain_counting(spark, shards, covered, top):
    r = random.Random(shards)
    words = ["The", "the", "of", "é", "Zoë x", "new", "york", "\x00", "a b"]
    weights = [5, 5, 4, 3, 1, 2, 2, 1, 2]
    rows = [("".join(w + r.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "\x0b", "  "])
                     for w in r.choices(words, weights, k=r.randint(0, 60))), r.choice(["en", "fr", None, "und"]))
            for _ in range(150)] + [(None, "en"), ("", None), ("the new york " * 3000, "en")]
    docs = phrase_docs(spark, rows).repartition(5)
    got = [tuple(x) for x in phrases.collocations(docs, min_count=6, shards=shards, covered=covered, top=top).collect()]
    assert sorted(got) == sorted(plain_collocations(rows, 6, 5, top, covered)) and got


def test_collocations_exact_beyond_64_bits(spark):
    a, n, part = 3_000_000_000, 9_000_000_000_000, 7_000_000_001
    row = spark.createDataFrame([(a, n, part, part)], "a long, n long, l long, r long")
    big = "cast({} as decimal(19,0))".format
    got = row.selectExpr(f"({big('1000')} * {big('a')} * {big('n')}) div ({big('l')} * {big('r')}) AS s").first().s
    assert got == 1000 * a * n // (part * part)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("", "en")], [("one two", "en")]])
def test_collocations_none(spark, rows):
    assert phrases.collocations(phrase_docs(spark, rows), min_count=2).collect() == []


def test_filter_never_loses_a_gram(spark):
    r = random.Random(3)
    grams = [r.randint(0, 2 ** 32 - 1) for _ in range(3000)] + [0, 2 ** 32 - 1]
    bits = phrases.bit_filter(spark.createDataFrame([(g,) for g in grams], "gram long"))
    assert phrases.maybe(bits, np.array(grams, dtype=np.uint64)).all()
    other = np.array([r.randint(0, 2 ** 32 - 1) for _ in range(3000)], dtype=np.uint64)
    assert phrases.maybe(bits, other).mean() < 0.05


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_licenses(text):
    low = (text or "").translate(str.maketrans(spelling.UPPER, spelling.UPPER.lower()))
    plain = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(plain))
                    if plain[i:i + len(phrase.split())] == phrase.split())
    return plain, places


def noisy_notice(r):
    n = r.choice(licenses.NOTICES)
    s = list(n.text)
    for _ in range(r.randint(0, n.errors + 1)):
        i = r.randrange(len(s))
        kind = r.randint(0, 2)
        s[i:i + 1] = [] if kind == 0 else [r.choice("abelx ")] if kind == 1 else [s[i], r.choice("abelx")]
    return "".join(s)


@pytest.mark.parametrize("seed", range(6))
def test_notices_equal_edit_distance_of_every_span(seed):
    r = random.Random(seed)
    find = licenses.Finder()
    for _ in range(15):
        filler = r.choices("the of license licensed under public gnu cc by general mit software".split(), k=r.randint(0, 6))
        words = " ".join([*filler, noisy_notice(r), *filler[:2], noisy_notice(r)]).split()
        norm = " " + " ".join(words) + " "
        got = {}
        for i, start, end, edits in find.notices_in(norm):
            assert norm[start - 1] == norm[end] == " "
            assert edit_distance(norm[start:end], licenses.NOTICES[i].text) == edits
            got[i] = min(edits, got.get(i, 99))
        want = {}
        for i, n in enumerate(licenses.NOTICES):
            spans = (" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1))
            near = [edit_distance(s, n.text) for s in spans if abs(len(s) - len(n.text)) <= n.errors]
            if near and min(near) <= n.errors:
                want[i] = min(near)
        assert got == want


def license_docs(spark, texts):
    return spark.createDataFrame([(i, t, "n", 1, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, norm string, n_words int, found string")


def test_licenses_of_documents(spark):
    texts = [None, "", "Released under the MIT License.", "under the MIT-License; cc_by, CC BY. GNU General Public License!",
             "Relaesed under the MTI Licence", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY.",
             "the GNU Lesser Genral Public License", "é the mit licénse", "submit license", "the emit licensee",
             "plain words of nothing", "mit license " * 30_000, "the mit  license of", "APACHE LICENSE", "APACHE LICENSE",
             "ẞİ Mit\tLicense", "license " * 20_000]
    got = {r.doc_id: r for r in licenses.scan(license_docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        plain, places = plain_licenses(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (len(plain), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == sorted({x for _, x in places}) and set(r.base_labels) <= set(r.labels)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert all(0 <= s.start < s.end <= len(t) and 0 <= s.first_word < r.n_words for s in r.spans)
    assert got[5].labels == ["cc-by", "cc-by-nc"] and got[6].labels == ["cc-by"] and got[7].labels == ["lgpl"]
    span = got[7].spans[0]
    assert texts[7][span.start:span.end] == "GNU Lesser Genral Public License" and span.edits == 1
    assert got[8].labels == ["mit"] and not got[9].labels and not got[11].labels
    assert licenses.scan(license_docs(spark, texts).where("doc_id < 0")).collect() == []


def test_seeds_are_in_every_text_with_labels():
    r = random.Random(9)
    find, pieces = licenses.Finder(), licenses.seeds()
    for _ in range(300):
        text = f"a {noisy_notice(r)} b"
        if find(text)["labels"]:
            assert any(p in f" {text} " for p in pieces)
