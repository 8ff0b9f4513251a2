"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags) with
their ancestors.  Each block has binary features of its ancestor tags, of the
words in ancestors' class, id and role attributes, and of its text; a chain of
two labels (main, other) is trained by conditional likelihood on labelled
pages and decoded by Viterbi.  Pages are independent, so nothing is shuffled.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages whose text the labelled pages are made from, at most, and labelled pages made.
TRAIN_PAGES, LABELLED = 400, 600
#: Passes of training.
STEPS = 200

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|\bhidden\b|aria-hidden\s*=\s*[\"']?true", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav
ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul""".split())
#: An opening tag ends an open one of the same row, up to the tags after the colon.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"})}
_KEEPS_P = frozenset("button label option select textarea td th caption title head html body".split())
#: Words of class, id and role attributes that tell what a part of a page is for.
_WORDS = {w: g for g, ws in {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "comment": "comment comments reply replies disqus discussion respond responses feedback thread",
    "side": "sidebar side aside widget widgets related recommended recommendations complementary teaser more rail",
    "foot": "footer foot bottom copyright contentinfo colophon legal imprint",
    "head": "header masthead topbar top logo branding tagline",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay message privacy disclaimer warning dialog toast",
    "form": "form newsletter subscribe subscription signup login search register contact",
    "share": "share sharing social follow tags tag meta byline author",
    "main": "content article post entry story main body text page blog maincontent articlebody",
}.items() for w in ws.split()}
_TAGS = frozenset("""article main nav header footer aside form section ul ol li dl table td th head title figure
figcaption blockquote pre h1 h2 h3 h4 h5 h6 p dialog button select option textarea label fieldset legend menu
address details summary caption""".split())
_COMMON = frozenset("the of and to in is a that for der die und das den le la les de et un une que el los y en".split())


def blocks(page: str | None) -> list[tuple[str, frozenset[str], float, str]]:
    """(text, marks of the ancestors, share of linked characters, own tag) of every leaf block in page order.

    Character references are decoded and white space runs become one space;
    comments, scripts and styles are no text; unclosed p, li, dt, dd, tr, td,
    th and option end where HTML ends them; text after a bare "<" is text."""
    out: list[tuple[str, frozenset[str], float, str]] = []
    if not page:
        return out
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    links, at, linked, held = 0, 0, 0, None

    def flush():
        nonlocal parts, linked, held
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                own = next((t for t, _ in reversed(held) if t in _BLOCK), "")
                marks = frozenset().union(*(m for _, m in held))
                out.append((text, marks, min(1.0, linked / max(1, len(text))), own))
            parts, linked, held = [], 0, None

    def add(piece: str):
        nonlocal linked, held
        if piece:
            if held is None and not piece.isspace():
                held = list(stack)
            if held is not None:
                parts.append(piece)
                if links:
                    linked += len(piece)

    for m in _TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in _BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            if tag == "a" and links:
                links -= 1
            continue
        if tag == "br":
            add(" ")
        if tag in _BLOCK:
            flush()
            if tag not in _KEEPS_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in ("button", "td", "th", "table"):
                        break
            if tag in _CLOSES:
                ends, stops = _CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] in stops:
                        break
        if tag in _VOID or m.group(4).endswith("/"):
            continue
        if tag == "a":
            links += 1
        marks = set()
        if tag in _TAGS:
            marks.add("<" + tag)
        attrs = m.group(4)
        if attrs:
            for a in _ATTR.finditer(attrs):
                for w in _NAME.findall(a.group(2) or a.group(3) or a.group(4) or ""):
                    g = _WORDS.get(w.lower())
                    if g:
                        marks.add("." + g)
            if _HIDDEN.search(attrs):
                marks.add(".hidden")
        stack.append((tag, frozenset(marks)))
    add(page[at:])
    flush()
    return out


def features(found: list[tuple[str, frozenset[str], float, str]]) -> list[list[str]]:
    """Names of the active features of each block."""
    out, n = [], len(found)
    for i, (text, marks, linked, own) in enumerate(found):
        words = text.lower().split()
        names = ["bias", "own " + own, "len " + str(min(6, len(words).bit_length())),
                 "linked" if linked > 0.5 else "some links" if linked > 0 else "no links"]
        names += marks
        bad = sum(1 for x in marks if x[0] == "." and x != ".main")
        names.append("bad marks " + str(min(2, bad)))
        names.append("in main" if "<article" in marks or "<main" in marks or ".main" in marks else "not in main")
        if not marks & {"<article", "<main", ".main"} and not bad:
            names.append("bare " + own)
        names.append("common " + str(min(3, sum(w in _COMMON for w in words[:60]).bit_length())))
        if text[-1:] in ".!?…\"'”":
            names.append("ends")
        if "©" in text or "copyright" in text.lower():
            names.append("copyright")
        if i == 0:
            names.append("first")
        if i == n - 1:
            names.append("last")
        out.append(names)
    return out


class Chain:
    """Two labels (0 other, 1 main): weights of label 1 by feature, and of steps."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]]):
        self.weights, self.steps = weights, steps

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi; ties go to label 0."""
        if not rows:
            return []
        w, ((s00, s01), (s10, s11)) = self.weights, self.steps
        a = b = 0.0
        back = []
        for i, names in enumerate(rows):
            x = sum(w.get(f, 0.0) for f in names)
            if i == 0:
                a, b = 0.0, x
                continue
            back.append((0 if a + s00 >= b + s10 else 1, 0 if a + s01 >= b + s11 else 1))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + x
        label = 0 if a >= b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, penalty: float = 0.002) -> Chain:
    """Maximum conditional likelihood (forward-backward, Adam, L2) over labelled pages."""
    names = sorted({f for rows, _ in pages for r in rows for f in r})
    at = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(y) for _, y in pages)
    x = np.zeros((n, longest, len(names)), dtype=np.float32)
    y, mask = np.zeros((n, longest), dtype=np.int64), np.zeros((n, longest))
    for i, (rows, labels) in enumerate(pages):
        for t, r in enumerate(rows):
            x[i, t, [at[f] for f in r]] = 1
        y[i, :len(labels)] = labels
        mask[i, :len(labels)] = 1
    seen = np.zeros((2, 2))
    both = (mask[:, 1:] * mask[:, :-1]).astype(bool)
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    w, s = np.zeros(len(names)), np.zeros((2, 2))
    flat = np.concatenate((w, s.ravel()))
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        w, s = flat[:-4], flat[-4:].reshape(2, 2)
        emit = np.stack([np.zeros((n, longest)), x @ w], axis=2)
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = emit[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(fwd[:, t - 1, 0, None] + s[0], fwd[:, t - 1, 1, None] + s[1]) + emit[:, t]
            fwd[:, t] = np.where(mask[:, t, None] > 0, nxt, fwd[:, t - 1])
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            z = bwd[:, t + 1] + emit[:, t + 1]
            prev = np.logaddexp(z[:, 0, None] + s[:, 0], z[:, 1, None] + s[:, 1])
            bwd[:, t] = np.where(mask[:, t + 1, None] > 0, prev, 0.0)
        p = np.exp(fwd + bwd - total[:, None, None])[:, :, 1] * mask
        grad_w = np.einsum("nt,ntf->f", (y * mask - p).astype(np.float32), x)
        pair = np.exp(fwd[:, :-1, :, None] + s + (emit + bwd)[:, 1:, None, :] - total[:, None, None, None])
        grad_s = seen - (pair * both[:, :, None, None]).sum((0, 1))
        grad = np.concatenate((grad_w, grad_s.ravel())) / n - penalty * flat
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        flat = flat + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Chain(dict(zip(names, flat[:-4].tolist(), strict=True)), flat[-4:].reshape(2, 2).tolist())


def render_labelled(prose: list[str], seed: int) -> tuple[str, list[str]]:
    """A page of known make-up out of given sentences: (html, its main blocks)."""
    r = random.Random(seed)
    main: list[str] = []

    def text(low=1, high=3):
        return " ".join(r.choice(prose) for _ in range(r.randint(low, high)))

    def short():
        return " ".join(r.choice(prose).split()[:r.randint(1, 4)])

    def esc(t):
        return html_lib.escape(t, quote=False)

    def keep(t):
        main.append(" ".join(t.split()))
        return esc(t)

    def links(k):
        return "".join(f'<li><a href="/{i}">{esc(short())}</a></li>' for i in range(k))

    def other(inside: bool) -> str:
        kind = r.randrange(12 if inside else 14)
        t, u = esc(text(1, 2)), esc(text(1, 3))
        return ("" if r.random() < 0.2 else "\n") + [
            f'<div class="{r.choice(["ad", "ads", "advert", "sponsored", "ad-slot", "promo-box"])}">{t}</div>',
            f'<aside>{"<h3>" + esc(short()) + "</h3>" if r.random() < 0.5 else ""}<p>{t}</p><ul>{links(3)}</ul></aside>',
            f'<div class="{r.choice(["cookie-notice", "notice", "alert", "gdpr-consent", "disclaimer"])}"><p>{t}</p></div>',
            f'<form action="/s"><label>{esc(short())}</label><input name="q"><button>{esc(short())}</button><p>{t}</p></form>',
            f'<div class="{r.choice(["related", "recommended", "widget", "sidebar", "teaser-list"])}"><h4>{esc(short())}</h4><ul>{links(3)}</ul><p>{u}</p></div>',
            f'<section id="{r.choice(["comments", "responses", "disqus_thread"])}"><h3>{esc(short())}</h3>'
            + "".join(f'<div class="comment"><b>{esc(short())}</b><p>{esc(text(1, 4))}</p></div>' for _ in range(r.randint(1, 4))) + "</section>",
            f'<div class="{r.choice(["comment-list", "replies", "comments"])}"><ul>'
            + "".join(f"<li><p>{esc(text(1, 3))}</p></li>" for _ in range(r.randint(1, 4))) + "</ul></div>",
            f'<nav><ul>{links(r.randint(2, 6))}</ul></nav>',
            f'<div class="{r.choice(["share", "social", "tags", "byline"])}">{esc(short())} <a href="/x">{esc(short())}</a></div>',
            f'<div class="{r.choice(["newsletter", "subscribe", "signup"])}"><p>{u}</p><button>{esc(short())}</button></div>',
            f'<div role="{r.choice(["complementary", "navigation", "alert", "dialog"])}"><p>{t}</p></div>',
            f'<div style="display:none"><p>{t}</p></div>',
            f'<header><p>{t}</p></header>',
            f'<div id="{r.choice(["footer", "header", "menu", "sidebar"])}"><p>{t}</p><a href="/">{esc(short())}</a></div>',
        ][kind]

    def body() -> str:
        out = []
        if r.random() < 0.85:
            out.append(f"<h1>{keep(short())}</h1>")
        for _ in range(r.randint(1, 9)):
            kind = r.randrange(14)
            if kind < 7:
                out.append(f"<p>{keep(text())}</p>" if r.random() < 0.8 else f"<p>{keep(text())}")
            elif kind == 7:
                out.append(f"<h2>{keep(short())}</h2>")
            elif kind == 8:
                out.append("<ul>" + "".join(f"<li>{keep(text(1, 1))}</li>" for _ in range(r.randint(1, 3))) + "</ul>")
            elif kind == 9:
                out.append(f"<blockquote>{keep(text(1, 2))}</blockquote>")
            elif kind == 10:
                out.append(f"<div>{keep(text())}</div>")
            elif kind == 11:
                out.append("<table><tr>" + "".join(f"<td>{keep(short())}</td>" for _ in range(2)) + "</tr></table>")
            elif kind == 12:
                out.append(f"<pre>{keep(short())}</pre>")
            else:
                out.append(f"<p>{keep(short())}</p>")
            if r.random() < 0.12:
                out.append(other(True))
        return "".join(out)

    opening, closing = r.choice([
        ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
        ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>"),
        ('<section class="entry">', "</section>"), ('<div class="article-text">', "</div>"), ("<div>", "</div>"),
        ('<div class="page"><div class="story">', "</div></div>")])
    top = "".join(other(False) for _ in range(r.randint(0, 3)))
    if r.random() < 0.8:
        top = f"<nav><ul>{links(r.randint(2, 7))}</ul></nav>" + top
    if r.random() < 0.4:
        top = f"<header><h2>{esc(short())}</h2><p>{esc(text(1, 1))}</p></header>" + top
    middle = opening + body() + closing
    bottom = "".join(other(False) for _ in range(r.randint(0, 3)))
    if r.random() < 0.85:
        bottom += f"<footer>{r.choice(['&copy; ', ''])}{esc(short())} &middot; {esc(text(1, 2))}</footer>"
    head = f"<head><title>{esc(short())}</title><style>p{{}}</style></head>" if r.random() < 0.9 else ""
    return f"<!DOCTYPE html><html>{head}<body>{top}{middle}{bottom}</body></html>", main


def labelled_pages(prose: list[str], count: int = LABELLED) -> list[tuple[list[list[str]], list[int]]]:
    """Feature rows and labels of pages rendered with known parts."""
    out = []
    for seed in range(count):
        page, main = render_labelled(prose, seed)
        found, labels, i = blocks(page), [], 0
        for text, *_ in found:
            hit = i < len(main) and text == main[i]
            labels.append(int(hit))
            i += hit
        if found and i == len(main):
            out.append((features(found), labels))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
        max_pages: int = TRAIN_PAGES, count: int = LABELLED) -> Chain:
    """Train on pages rendered from the sentences of at most ``max_pages``
    pages (smallest hashed ids; at most 20 sentences of 60 words from each)."""
    def sentences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page in frame["html"]:
                out += [" ".join(t.split()[:60]) for t, *_ in blocks(page) if len(t.split()) >= 4][:20]
            yield pd.DataFrame({"t": out})
    ids = (pages.where(F.col(id_col).isNotNull() & F.col(html_col).isNotNull()).select(F.col(id_col).alias("i"))
           .orderBy(F.xxhash64("i"), "i").limit(max_pages))
    # At most max_pages ids: the broadcast is bounded by the parameter.
    sample = pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("html")).join(F.broadcast(ids), "i", "left_semi")
    prose = sorted({r[0] for r in sample.select("html")
                    .mapInPandas(sentences, "t string").collect()})
    return train(labelled_pages(prose or ["The text of the page is here and goes on for a while."], count))


def extract(pages: DataFrame, model: Chain, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One row per row: page_id, url, text (main blocks joined by a blank line), n_chars, n_blocks.

    Null, empty and text-less pages give the empty text; null ids and urls
    stay null; repeated rows give repeated results; other columns are not read.
    """
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, counts = [], []
            for page in frame["html"]:
                found = blocks(page)
                labels = model.decode(features(found))
                texts.append("\n\n".join(b[0] for b, y in zip(found, labels, strict=True) if y))
                counts.append(len(found))
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts,
                                "n_chars": [len(t) for t in texts], "n_blocks": counts})
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))
    return rows.mapInPandas(work, "page_id long, url string, text string, n_chars long, n_blocks long")
