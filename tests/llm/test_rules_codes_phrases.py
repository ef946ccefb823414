"""URL filters, vector codes and phrase mining against brute force, and their edge cases."""

import collections
import itertools
import math
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from memspark.llm import phrases, urlrules, vectorcodes
from memspark.llm.queries import ORACLE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clash(df, *names):
    for c in names:
        df = df.withColumn(c, F.lit("clash"))
    return df


# --- 11


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def verdict(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, None, default) if best is None else (host, path, best[2], best[3])


def run_rules(spark, urls, rules, **options):
    pages = clash(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "host", "path", "rule", "key", "bucket", "verdict")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(pages, urlrules.rules_table(spark, rules), **options).collect()}


def test_url_rules_of_the_query(spark):
    urls = [None, "", "no scheme", "http://", "https:///x", "HTTP://A.Example.ORG/en/12?x", "http://example.org/en/2", "http://example.org", "http://x.com/fr/", "http://x.com/fr", "http://com/de/1#a", "http://notcom/de/1", "x://y://org/", "http://org?/es/", "http://b.example.org/es/ü", "http://a.org./", "http://.org/", "a\n://org/\nb"]
    got = run_rules(spark, urls * 2, urlrules.RULES)
    assert got == {k: verdict(u, urlrules.RULES) for k, u in enumerate(urls * 2)}
    assert got[5][2:] == ("example.org/en/1", "block") and got[7][2] is None


def test_url_rules_fuzz(spark):
    """Nested rules on hosts and paths, many more than there are ranges."""
    r = random.Random(3)
    label = lambda: r.choice(("a", "b", "aa", "c-d", "é"))
    host = lambda: ".".join(label() for _ in range(r.randint(1, 3)))
    path = lambda: r.choice(("", "/")) and "/" + "".join(r.choice(("x", "y", "/", "xy", "\U0010ffff")) for _ in range(r.randint(0, 6)))
    rules = list({(h, p): (r.choice(("allow", "block")), h, p) for h, p in ((host(), path()) for _ in range(400))}.values())
    urls = [f"http://{host()}{path()}{r.choice(('', '?q', '#f'))}" for _ in range(1500)] + ["http://a.b/xy"] * 300
    got = run_rules(spark, urls, rules, default="block")
    for k, u in enumerate(urls):
        want = verdict(u, rules, "block")
        assert got[k] == want, (u, got[k], want)


def test_url_rules_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [tuple(r) for r in urlrules.judge(pages, none).collect()] == [(1, "a.org", "/x", None, "allow")]
    odd = urlrules.rules_table(spark, [("allow", None, "/"), (None, "a.org", "/x"), ("block", "", "/"), ("block", "a/b", ""), ("allow", "A.org", None), ("block", "a.org", "")])
    assert [tuple(r) for r in urlrules.judge(pages, odd).collect()] == [(1, "a.org", "/x", "a.org", "block")]
    assert urlrules.query(pages.where("page_id > 1")).count() == 0
    twice = spark.createDataFrame([(None, "http://a.org/x"), (None, "http://a.org/x")], "page_id long, url string")
    assert [r["rule"] for r in urlrules.query(twice).collect()] == ["org/", "org/"]


def test_url_rules_are_native(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    rules = urlrules.rules_table(spark)
    plan = urlrules.asked(pages.select(urlrules.host_of(F.col("url")).alias("host"), urlrules.path_of(F.col("url")).alias("path")), urlrules.clean_rules(rules))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


# --- 12


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label); plain Python integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return [], []
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    ends = [0, *itertools.accumulate(d // parts + (k < d % parts) for k in range(parts))]
    cut = lambda v: [v[a:b] for a, b in zip(ends, ends[1:])]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for _, v, _ in kept:
                held[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(col) // len(held[j]) for col in zip(*held[j])] if held[j] else c for j, c in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        found = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{j:02x}" for _, j in found), min(sum(e for e, _ in found), vectorcodes.MOST), lab))
    return out, books


def check_codes(spark, rows):
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "code", "error", "q", "part")
    got = vectorcodes.query(df).collect()
    want, books = brute_codes(rows)
    sums = collections.Counter()
    for _, _, e, lab in want:
        sums[lab] += e
    expect = sorted(((i, c, e, min(sums[lab], vectorcodes.MOST)) for i, c, e, lab in want), key=repr)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=repr) == expect
    if got:
        assert {r["codebooks_sha256"] for r in got} == {vectorcodes.digest([np.array(b, object) for b in books])}


def test_vector_codes(spark):
    r = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in r.normal(0, 0.05, 8).astype(np.float32)], int(k % 3) if k % 7 else None) for k in r.permutation(420)]
    rows += [(k, rows[5][1], 1) for k in range(1000, 1060)]  # copies: ties between entries
    rows += [(2000, None, 1), (2001, [float("nan")] + [0.0] * 7, 1), (2002, [float("inf")] + [0.0] * 7, 1), (2003, [None] + [0.0] * 7, 1), (2004, [1.0] * 4, 1), (None, [0.5] * 8, 2), (3, [0.25] * 8, 2)]
    check_codes(spark, rows)


def test_vector_codes_few_rows_and_wide_values(spark):
    check_codes(spark, [(1, [0.5] * 6, None), (2, [0.25] * 6, None)])
    check_codes(spark, [(k, [(-1.0) ** k * 1e30 * (k + 1), 3.0, -2e9, 0.1 * k], 1) for k in range(9)])
    check_codes(spark, [(1, [], 1), (2, [], 1)])
    assert vectorcodes.query(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("size", [1, 300, 3_000_000])
def test_screening_is_exact(size):
    """Entries that float32 can't tell apart, ties and far-off values."""
    r = np.random.default_rng(size)
    entries = r.integers(-size, size + 1, (256, 16))
    entries[100:120] = entries[:20]  # equal entries
    entries[200:230] = entries[30] + r.integers(-1, 2, (30, 16))
    x = np.concatenate([entries[r.integers(0, 256, 500)] + r.integers(-2, 3, (500, 16)), r.integers(-size, size + 1, (2500, 16))])
    index, error = vectorcodes.nearest(x, entries)
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_codes_decode(spark):
    rows = [(k, [k / 64, -k / 64, 0.5, 0.25], 0) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    plan, books = vectorcodes.train(df)
    back = vectorcodes.decode(vectorcodes.encode(df, plan, books), plan, books).collect()
    assert all(r["decoded"] == rows[r["vec_id"]][1] for r in back) and len(back) == 40


# --- 13


def brute_phrases(rows, max_words=3, least=10, covered=50, top=2000):
    f = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, max_words + 1):
                for i in range(len(w) - n + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, c in f.items():
        total = sum(v for k, v in c.items() if len(k) == 1)
        cand = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        found = []
        for k, a in cand.items():
            if any(100 * b >= covered * a and any(o[i : i + len(k)] == k for i in range(len(o) - len(k) + 1)) for o, b in cand.items() if len(o) > len(k)):
                continue
            score, _, l, r = min((1_000_000 * a * a // (c[k[:j]] * c[k[j:]]), j, c[k[:j]], c[k[j:]]) for j in range(1, len(k)))
            found.append((-score, -a, " ".join(k).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total, -s))
    return sorted(out)


def phrase_rows(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "new", "york", "city", "of", "é", "x\u00a0y", "a\0b", "run"]
    return [(k, "".join(r.choice(words) + r.choice((" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b")) for _ in range(r.randint(0, 60))), r.choice(("en", "de", None, "und"))) for k in range(n)]


@pytest.mark.parametrize("bits", [16, None])
def test_phrases(spark, bits):
    rows = phrase_rows(1, 300) + [(None, None, "en"), (None, "", None), (7, "new york city " * 50, "fr"), (7, "new york city " * 50, "fr")]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "phrase", "n", "f", "block", "hash")
    got = sorted(tuple(r) for r in phrases.mine(docs, bits=bits).collect())
    assert got == brute_phrases(rows) and any(r[0] == "fr" for r in got)


def test_phrases_of_four_words_and_top(spark):
    rows = phrase_rows(2, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(tuple(r) for r in phrases.mine(docs, max_words=4, min_count=4, top=30).collect())
    assert got == brute_phrases(rows, 4, 4, 50, 30)


def test_phrases_small_chunks(spark, monkeypatch):
    """Chunks far smaller than texts: no phrase is lost or counted twice at their borders."""
    rows = phrase_rows(3, 40) + [(99, "one two three, " * 200, "en"), (100, "no end here " * 100, "en")]
    want = collections.Counter()
    for lang, text in ((r[2] or "und", r[1] or "") for r in rows):
        grams = phrases.Grams(lang, [text.encode().lower().translate(phrases.ENDS)])
        grams.longer()
        for t, c in zip(grams.texts(np.arange(len(grams.counts))), grams.counts):
            want[lang, t] += int(c)
    import pyarrow as pa

    got = collections.Counter()
    batch = pa.record_batch([pa.array([r[2] or "und" for r in rows]), pa.array([r[1] or "" for r in rows])], names=["lang", "text"])
    for lang, parts in phrases.chunks([batch], limit=64):
        grams = phrases.Grams(lang, parts)
        grams.longer()
        for t, c in zip(grams.texts(np.arange(len(grams.counts))), grams.counts):
            got[lang, t] += int(c)
    assert got == want


def test_phrase_counts_beyond_64_bits(spark):
    """The score's products pass 64 bits: counts of 10^7 squared, times a million."""
    a, l, r = 30_000_000, 40_000_000, 50_000_000
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(*[F.col(c).cast("decimal(19,0)") for c in "alr"])
    got = row.select((F.col("a") * F.col("a") * F.lit(1000000).cast("decimal(7,0)")).alias("t"), (F.col("l") * F.col("r")).alias("u")).selectExpr("t div u AS s").first()["s"]
    assert got == 1_000_000 * a * a // (l * r)


def test_phrases_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.query(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and phrases.query(none).count() == 0


def test_new_queries_have_sql():
    assert {"op11_url_filters", "op12_vector_codes", "op13_phrase_mining"} <= set(ORACLE)


# --- 4: names of the page, and depth


@pytest.mark.parametrize("state", ["", "has-sidebar", "right-sidebar", "no-comments", "menu-open"])
def test_names_of_the_body_say_nothing(state):
    from memspark.llm import htmlcrf

    weights, move = _html_model()
    paragraph = "<p>This is a sentence that talks about things, and goes on for a while. It stands in an article.</p>"
    for wrap in ("<article>{}</article>", "<div class=content>{}</div>"):
        page = f"<html class='{state}'><body class='{state}'><nav><ul><li><a href=/>Home</a></li></ul></nav>{wrap.format(paragraph * 6)}<footer>&copy; 2024 name</footer></body></html>"
        found = htmlcrf.blocks(page)
        labels = htmlcrf.viterbi(htmlcrf._scores(weights, found), move)
        assert labels == [0, *[1] * 6, 0]


_models = []


def _html_model():
    from memspark.llm import htmlcrf

    if not _models:
        _models.append(htmlcrf.fit(htmlcrf.training_pages()))
    return _models[0]


def test_deep_pages_take_linear_time():
    import time

    from memspark.llm import htmlcrf

    for page in ("".join(f"<div class=n{k}>" for k in range(30_000)) + "text" + "</div>" * 30_000, "<head>" + "<noscript>" * 30_000 + "x"):
        begun = time.process_time()
        htmlcrf.blocks(page)
        assert time.process_time() - begun < 3
