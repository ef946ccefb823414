"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A lenient scanner turns the page into leaf blocks (runs of text between block-level tags) with the
tags of their ancestors and the classes and ids of the nearest ``NEAR`` ones but ``html`` and ``body``, whose names describe
the page and not a part of it. The field's two labels are article and rest; its features
are ancestor tags, ancestor name tokens, block tag, length, link share, punctuation and place. It is
trained by gradient ascent on the conditional likelihood over labelled pages (``training_pages``
writes them from a grammar of page layouts, with the label on each element) and decoded by Viterbi.

Scale: each page is decoded by itself in an Arrow UDF; the model is a few KB.

Edge cases: null or empty html and pages without text blocks give the empty text; broken or cut markup
is read as far as it goes (an unclosed comment or script hides the rest, as in browsers; an unclosed head
ends where something follows that may not stand in it; other unclosed hidden elements hide nothing); equal
rows give equal results; labels that score alike count as rest; very long and deeply nested pages take time
in proportion to their size; other columns are kept by ``extract``; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_of

#: HTML's block-level, hidden, raw-text and void elements.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN = set("head noscript template svg math object iframe canvas audio video map datalist".split())
RAW = set("script style textarea title xmp noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What may stand in a head; any other start tag, or text, ends it.
IN_HEAD = set("html head title meta link base basefont bgsound style script noscript template noframes".split())
#: Open elements that a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMIT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
_TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
DIMENSION = 1 << 12
#: Ancestors whose names count.
NEAR = 16


class Block:
    __slots__ = ("text", "tag", "tags", "names", "linked", "label")

    def __init__(self, text, tag, tags, names, linked, label):
        self.text, self.tag, self.tags, self.names, self.linked, self.label = text, tag, tags, names, linked, label


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    #: open elements: tag, and of it and its ancestors tags, names (of the nearest) and nearest label
    stack: list[tuple[str, frozenset[str], tuple[tuple[str, ...], ...], str | None]] = []
    closes: dict[str, int] = {}
    ends: dict[str, int] = {}
    pieces: list[str] = []
    state = {"hidden": None, "link": 0, "linked": 0, "depth": 0}

    def flush():
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                tag, tags, names, label = stack[-1] if stack else ("", frozenset(), (), None)
                out.append(Block(text, tag, tags, frozenset().union(*names), min(1.0, state["linked"] / len(text)), label))
        state["linked"] = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if state["hidden"] == "head" and page[at:end].strip():
            state["hidden"] = None
        if end > at and state["hidden"] is None:
            piece = page[at:end]
            pieces.append(piece)
            if state["link"]:
                state["linked"] += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if state["hidden"] is not None:
            if tag == state["hidden"]:
                state["depth"] += -1 if m[1] else 1
                if state["depth"] == 0:
                    state["hidden"] = None
                continue
            if tag in RAW and not m[1]:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else n
                continue
            if state["hidden"] == "head" and tag in ("noscript", "template") and not m[1]:
                if tag not in ends:  # the last one, so that many without an end cost no search each
                    ends[tag] = max((x.start() for x in re.compile(rf"</{tag}\s*>", re.I).finditer(page)), default=-1)
                at = re.compile(rf"</{tag}\s*>", re.I).search(page, at).end() if ends[tag] >= at else at
                continue
            if state["hidden"] != "head" or m[1] or tag in IN_HEAD:
                continue
            state["hidden"] = None
        if m[1]:
            if tag == "a":
                state["link"] = max(0, state["link"] - 1)
            if tag in BLOCK:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag in HIDDEN:
            if tag not in closes:
                closes[tag] = max((x.start() for x in re.compile(rf"</{tag}\b", re.I).finditer(page)), default=-1)
            # without an end tag an element other than the head hides nothing
            if not m[3].rstrip().endswith("/") and (tag == "head" or closes[tag] >= at):
                state["hidden"], state["depth"] = tag, 1
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            state["link"] = 1
        if tag in BLOCK:
            flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in _LIMIT[tag]:
                        break
                    if stack[k][0] in CLOSES[tag]:
                        del stack[k:]
                        break
            if tag not in VOID:
                names, label = [], None
                for a in _ATTR.finditer(m[3]):
                    key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if key in ("class", "id", "role") and tag not in ("html", "body"):
                        names += _NAME.findall(value.lower())
                    elif key == "data-y":
                        label = value
                _, tags, above, marked = stack[-1] if stack else ("", frozenset(), (), None)
                stack.append((tag, tags if tag in tags else tags | {tag}, (*above, tuple(names))[-NEAR:], label or marked))
    flush()
    return out


@lru_cache(maxsize=50_000)
def _place(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % DIMENSION


def _features(b: Block, k: int, n: int) -> list[int]:
    size = len(b.text)
    words = b.text.count(" ") + 1
    out = ["bias", f"tag {b.tag}", f"length {min(7, words.bit_length())}", f"links {int(4 * b.linked)}", f"place {int(4 * k / n)}"]
    if k == 0:
        out.append("first")
    if k == n - 1:
        out.append("last")
    if b.text[-1] in ".!?\"'”»…":
        out.append("sentence")
    if "," in b.text or ". " in b.text:
        out.append("punctuation")
    if "©" in b.text or "all rights" in b.text.lower():
        out.append("copyright")
    if size and sum(map(str.isdigit, b.text[:200])) > 0.2 * min(size, 200):
        out.append("digits")
    out += [f"in {t}" for t in b.tags]
    out += [f"name {x}" for x in b.names]
    if "article" in b.tags or "main" in b.tags:
        out.append(f"inner {b.tag}")
    return [_place(f) for f in out]


def _scores(weights: np.ndarray, bs: list[Block]) -> np.ndarray:
    return np.stack([weights[_features(b, k, len(bs))].sum(axis=0) for k, b in enumerate(bs)])


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """The best labelling for emission scores (blocks x 2) and transition scores (2 x 2)."""
    best, back = emit[0].tolist(), []
    (m00, m01), (m10, m11) = move.tolist()
    for e0, e1 in emit[1:].tolist():
        a, b = (best[0] + m00, best[1] + m10), (best[0] + m01, best[1] + m11)
        back.append((int(a[1] > a[0]), int(b[1] > b[0])))
        best = [max(a) + e0, max(b) + e1]
    y = [int(best[1] > best[0])]
    for step in reversed(back):
        y.append(step[y[-1]])
    return y[::-1]


def fit(pages: list[str], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and transitions (2 x 2) from pages whose elements carry data-y labels."""
    data = []
    for page in pages:
        bs = [b for b in blocks(page) if b.label]
        if bs:
            data.append(([np.array(_features(b, k, len(bs))) for k, b in enumerate(bs)], np.array([int(b.label == "article") for b in bs])))
    weights, move = np.zeros((DIMENSION, 2)), np.zeros((2, 2))
    seen_w, seen_m = np.full((DIMENSION, 2), 1e-6), np.full((2, 2), 1e-6)
    order = list(range(len(data)))
    for r in range(rounds):
        random.Random(r).shuffle(order)
        for d in order:
            features, y = data[d]
            emit = np.stack([weights[f].sum(axis=0) for f in features])
            n = len(y)
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = emit[0]
            for k in range(1, n):
                forward[k] = np.logaddexp(forward[k - 1][0] + move[0], forward[k - 1][1] + move[1]) + emit[k]
            for k in range(n - 2, -1, -1):
                x = move + (emit[k + 1] + backward[k + 1])[None, :]
                backward[k] = np.logaddexp(x[:, 0], x[:, 1])
            total = np.logaddexp(*forward[-1])
            gain = -np.exp(forward + backward - total)
            gain[np.arange(n), y] += 1
            step = np.zeros((2, 2))
            for k in range(1, n):
                step -= np.exp(forward[k - 1][:, None] + move + (emit[k] + backward[k])[None, :] - total)
                step[y[k - 1], y[k]] += 1
            sums: dict[int, np.ndarray] = {}
            for f, g in zip(features, gain):
                for p in f.tolist():
                    sums[p] = sums.get(p, 0) + g
            at = np.array(list(sums))
            g = np.array(list(sums.values())) - decay * weights[at]
            seen_w[at] += g * g
            weights[at] += rate * g / np.sqrt(seen_w[at])
            seen_m += step * step
            move += rate * step / np.sqrt(seen_m)
    return weights, move


#: Names that pages give to parts, by what the part is.
NAMES = {
    "article": "article post entry content main story body text articlebody postcontent",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc topnav tabs pagination pager",
    "header": "header masthead banner top site branding logo",
    "footer": "footer bottom colophon copyright legal imprint",
    "side": "sidebar aside side widget related recommended popular trending more links tags",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp",
    "notice": "cookie consent notice gdpr alert popup modal newsletter subscribe paywall signup",
    "form": "form search login contact feedback poll",
    "comments": "comments comment discussion replies reply respond disqus responses",
    "share": "share social sharing buttons follow author byline meta",
}
_SYLLABLES = "ka mi to re la su ne vo di pa chu ger ost ent ion and the les que der ung ado".split()


def training_pages(n: int = 260, seed: int = 7) -> list[str]:
    """Labelled pages in many layouts; every labelled element says so in data-y."""
    r = random.Random(seed)
    names = {k: v.split() for k, v in NAMES.items()}

    def word():
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def sentence(a=4, b=18):
        s = " ".join(word() for _ in range(r.randint(a, b)))
        return s[0].upper() + s[1:] + r.choice("....!?")

    def paragraph(a=1, b=6):
        if r.random() < 0.2:
            return sentence(1, 3)  # articles have very short paragraphs too
        return " ".join(sentence(r.choice((1, 4)), 18) for _ in range(r.randint(a, b)))

    def attr(kind):
        if r.random() < 0.2:
            return ""
        name = r.choice(names[kind]) + r.choice(("", "", "-" + r.choice(("box", "wrap", "inner", "area", "list"))))
        return f' {r.choice(("class", "id"))}="{name}"'

    def items(linked=True):
        ws = [" ".join(word() for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 9))]
        return "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' if linked else f"<li>{w}</li>" for w in ws) + "</ul>"

    def part(kind, inner, tags):
        tag = r.choice(tags)
        bare = tag in ("div", "section", "ul")
        a = attr(kind)
        if bare and not a:
            a = f' class="{r.choice(names[kind])}"'
        return f'<{tag}{a} data-y="rest">{inner}</{tag}>'

    def rest(kind):
        if kind == "menu":
            return part(kind, items(), ("nav", "nav", "div"))
        if kind == "header":
            return part(kind, r.choice((f"<h1>{word()}</h1>", f"<a href=/>{word()}</a>", f"<p>{sentence(2, 6)}</p>")) + r.choice(("", items())), ("header", "header", "div"))
        if kind == "footer":
            return part(kind, r.choice((f"&copy; {word()}.example &middot; {sentence()}", f"<p>&copy; 2024 {word()}</p>", items(), f"<p>{paragraph(1, 2)}</p>")), ("footer", "footer", "div"))
        if kind == "side":
            return part(kind, r.choice(("", f"<h3>{word()}</h3>")) + r.choice((items(), f"<p>{paragraph(1, 2)}</p>")), ("aside", "aside", "div", "section"))
        if kind == "advert":
            return part(kind, r.choice((sentence(), f"<p>{paragraph(1, 2)}</p>", f'<a href="/x">{sentence()}</a>')), ("div", "div", "aside", "section"))
        if kind == "notice":
            return part(kind, r.choice((paragraph(1, 2), f"<p>{paragraph(1, 2)}</p><button>{word()}</button>")), ("div", "section"))
        if kind == "form":
            return f'<form{attr(kind)} data-y="rest"><label>{word()}</label> <input name=q><p>{sentence()}</p><button>{word()}</button></form>'
        if kind == "comments":
            inner = "".join(f'<{t}{attr("comments")}><p>{paragraph(1, 3)}</p></{t}>' for t in r.choices(("div", "li", "article"), k=r.randint(1, 4)))
            return part(kind, r.choice((f"<h3>{sentence(1, 3)}</h3>", f"<h2>{word()}</h2>", "")) + inner, ("section", "div", "div"))
        return part(kind, r.choice((items(), f"<p>{sentence(1, 4)}</p>")), ("div", "ul", "section"))

    pages = []
    for _ in range(n):
        body = [f"<h1>{sentence(2, 9)}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.2:
            body = [f"<header>{''.join(body)}</header>"] if body else []
        for _ in range(r.choice((0, 1, 2, 4, 6, 10, 16))):
            kind = r.random()
            if kind < 0.62:
                p = paragraph()
                if r.random() < 0.25:
                    p = f'{sentence()} <a href="/a">{word()} {word()}</a> {paragraph(1, 2)}'
                body.append(r.choice((f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}<br>", f"<p>{p}<br>{paragraph(1, 2)}</p>")))
            elif kind < 0.72:
                body.append(f"<h2>{sentence(1, 6)}</h2>")
            elif kind < 0.80:
                body.append(items(r.random() < 0.15))
            elif kind < 0.86:
                body.append(f"<blockquote><p>{paragraph(1, 3)}</p></blockquote>")
            elif kind < 0.90:
                body.append(f"<pre>{paragraph(1, 2)}</pre>")
            elif kind < 0.93:
                body.append(f"<table><tr><td>{word()}</td><td>{sentence()}</td></tr></table>")
            else:
                body.append(rest(r.choice(("advert", "share", "side", "notice", "form"))))
        if not body:
            body = [f"<p>{paragraph()}</p>"]
        if r.random() < 0.2:
            body.append(rest(r.choice(("comments", "share"))))
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        a = attr("article") if tag in ("article", "main") else f' class="{r.choice(names["article"])}"'
        article = f'<{tag}{a} data-y="article">{"".join(body)}</{tag}>'
        if r.random() < 0.25:
            article = f"<main>{article}</main>"
        above = [rest(k) for k in ("notice", "header", "menu", "advert", "side", "form") if r.random() < 0.45]
        below = [rest(k) for k in ("share", "comments", "side", "advert", "form", "menu") if r.random() < 0.3]
        r.shuffle(above)
        tail = rest("footer") if r.random() < 0.85 else ""
        wrap = r.choice(("{}", "{}", '<div id="page">{}</div>', '<div class="container"><div class="row">{}</div></div>'))
        pages.append("<html><head><title>" + sentence() + "</title></head><body>" + wrap.format("".join(above) + article + "".join(below)) + tail + "</body></html>")
    return pages


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    return fit(training_pages())


def main_text(page: str | None, weights: np.ndarray, move: np.ndarray) -> tuple[str, int, int]:
    """The main text, and how many blocks of how many it has."""
    bs = blocks(page or "")
    if not bs:
        return "", 0, 0
    y = viterbi(_scores(weights, bs), move)
    kept = [b.text for b, one in zip(bs, y) if one]
    return "\n".join(kept), len(kept), len(bs)


def extract(pages: DataFrame, html: str = "html", into: str = "main") -> DataFrame:
    """``pages`` with a struct column ``into`` (a new name): text, n_kept, n_blocks."""
    if into in pages.columns:
        raise ValueError(f"the pages have a column {into} already")
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast(model())

    @F.pandas_udf("text string, n_kept int, n_blocks int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            yield pd.DataFrame([main_text(p, *shared.value) for p in some], columns=["text", "n_kept", "n_blocks"])

    return pages.withColumn(into, run(text_of(html)))


def query(pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "main.text", "main.n_kept", "main.n_blocks").withColumn("n_chars", F.length("text").cast("long"))
