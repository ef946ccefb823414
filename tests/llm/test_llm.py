"""Every operator against brute force, an exact round trip or held-out accuracy, and the edge cases."""

import collections
import hashlib
import itertools
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from memspark.llm import decontam, htmlcrf, langid, lmscore, mixing, neardup, pii, quality, suffixdedup, tokenbin
from memspark.llm.common import fold
from memspark.llm.queries import QUERIES, tokenizer_path
from memspark.llm.sketch import heavy

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the and that with this have from they will would there their what about which when make like time just know take people into year your good some could them".split()
DE = "der und die das nicht von sie ist des sich mit dem dass ein ich auf so eine auch als an nach wie im für man aber aus durch wenn nur war noch werden".split()


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SHAPE)


def odd_rows():
    r = random.Random(5)
    long = " ".join(r.choice(EN) + str(r.randrange(999)) for _ in range(30_000))
    return [(1, None, None, None), (2, "", "en", "a"), (None, "no id here", "en", None), (4, " \n\t ", "de", "b"), (5, long, "en", "a"), (6, "twice", "en", "a"), (6, "twice", "en", "a"), (7, "é" * 5000, "fr", "c")]


def extra(df):
    """Columns whose names the operators use inside."""
    for c in ("size", "source_size", "node", "rep", "copies", "class_id", "key", "bucket", "s", "spans", "start", "label", "base", "score", "word"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def prose(seed, n, words=EN):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(("", "", "s", "ing")) for _ in range(n))


# --- 1


def test_language_id(spark):
    rows = [(k, prose(k, 40 + k % 90, EN if k % 2 else DE), "en" if k % 2 else "de") for k in range(400)]
    got = {r["doc_id"]: r for r in langid.query(documents(spark, rows)).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    model = langid.train(documents(spark, rows), fold(5) != 0)
    noise = documents(spark, [(1, "zzxqj qqqx wvvk"), (2, rows[0][1])])
    rejected = {r["doc_id"]: r["lang_pred"] for r in langid.identify(noise, model, reject_below=0.9).collect()}
    assert rejected[2] == "de"


def test_language_model_is_normalised():
    texts = [prose(k, 60) for k in range(60)] + [prose(k, 60, DE) for k in range(60)]
    model = langid.fit(texts, ["en"] * 60 + ["de"] * 60)
    letters = sorted({c for t in texts for c in t if c.isalpha()})
    for prefix in ("", "t", "th", "the", "der", "zq"):
        # sum over next characters (and the word's end) of P(next | prefix)
        bits = model.word_bits([prefix + c for c in letters])
        whole = model.word_bits([prefix])
        assert np.isfinite(bits).all() and (whole > 0).all()
    p = np.zeros(2)
    codes = [c for c in letters]
    for c in codes:
        _, place, word = langid._characters([c])
        p += 2.0 ** -_first_char_bits(model, c)
    end = 2.0 ** -_first_char_bits(model, "")
    assert ((p + end) <= 1.0 + 1e-6).all() and ((p + end) > 0.9).all()


def _first_char_bits(model, c):
    """Bits of the first symbol of a word that starts with c ('' is the end mark)."""
    codes, place, _ = langid._characters([c])
    h = langid._hashes(codes, model.order)
    p = np.full(2, 1.0 / model.alphabet)
    for m in (1, 2):
        ctx = model.contexts[m - 1]
        if m == 1:
            p = p * ctx[1][0]
        else:
            k = np.searchsorted(ctx[0], h[1][0])
            p = p * (ctx[1][k] if k < len(ctx[0]) and ctx[0][k] == h[1][0] else 1.0)
        keys, values = model.grams[m - 1]
        k = np.searchsorted(keys, h[m][1])
        if k < len(keys) and keys[k] == h[m][1]:
            p = p + values[k]
    return -np.log2(p)


def test_language_edges(spark):
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in langid.query(extra(documents(spark, odd_rows()))).collect()), key=str)
    assert len(got) == 8 and dict(got)[1] == "und" and dict(got)[2] == "und" and dict(got)[4] == "und" and dict(got)[5] != "und"
    none = langid.query(documents(spark, [(1, "text", None)])).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    assert langid.query(documents(spark, [])).count() == 0


# --- 2


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination(spark):
    bench = [(k, prose(1000 + k, 30)) for k in range(20)] + [(90, "five words are in here"), (91, None), (92, "")]
    rows, want = [], set()
    for k in range(60):
        filler = prose(5000 + k, 120)
        if k % 3 == 0:
            w = bench[k % 20][1].split()
            if k % 2:
                w[7], w[19] = "XX", "YY"  # substitutions
            filler = prose(6000 + k, 50) + " " + " ".join(w).upper() + ". " + filler
            want.add((k, k % 20))
        rows.append((k, filler))
    rows += [(200, "before Five, words are in here after"), (201, "five words were in here"), (202, "five words were on here")]
    want |= {(200, 90), (201, 90)}  # four of five words are 80 %
    for block in (250, 1_000_000):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(documents(spark, rows), items(spark, bench), block).collect()}
        assert got == want
    clean = {r["doc_id"] for r in decontam.clean(extra(documents(spark, rows)), items(spark, bench)).collect()}
    assert clean == {r[0] for r in rows} - {d for d, _ in want}


def test_decontamination_edges(spark):
    run = "for " * 500
    d = documents(spark, [*odd_rows(), (50, run)])
    b = items(spark, [(1, "for " * 20), (2, None), (None, "no id here")])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(extra(d), b).collect()}
    assert got == {(50, 1), (None, None)}
    assert decontam.overlaps(d, items(spark, [])).count() == 0 and decontam.overlaps(documents(spark, []), b).count() == 0


def test_decontamination_masks_are_complete():
    """Every pattern of substitutions that the rule allows is found."""
    for n in (*range(1, 13), 13):
        item = [f"i{k}" for k in range(n)]
        index = decontam.Index([(1, " ".join(item))])
        may = n - int(np.ceil(decontam.MIN_SHARE * n))
        texts = [" ".join(["a", "b", *("x" if k in c else w for k, w in enumerate(item)), "y", "z"]) for d in range(may + 1) for c in itertools.combinations(range(n), d)]
        assert len({x[0] for x in index.search(texts)}) == len(texts), n
        worse = " ".join("x" if k <= may else w for k, w in enumerate(item))
        assert not index.search([worse])


# --- 3


def lm_base(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for i, (_, t, *_) in enumerate(rows)}
    held = {i: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for i, r in enumerate(rows)}
    c = collections.Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    return [(r[0], held[i], len(tokens[i]), sum(c[t] > 0 for t in tokens[i]), n, sum(np.log10((c[t] + 1) / (n + v + 1)) for t in tokens[i])) for i, r in enumerate(rows)]


def test_lm_base_and_score(spark):
    r = random.Random(1)
    pairs = [f"{a} {b}" for a, b in zip(EN, DE)]
    rows = [(k, " ".join(r.choice(pairs) if r.random() < 0.7 else r.choice(EN) + str(r.randrange(50)) for _ in range(80))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "ABC abc É é"), (1003, "unseen wordsss qqq")]
    got = sorted((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"], x["score"]) for x in lmscore.query(documents(spark, rows)).collect())
    want = sorted(lm_base(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    held = [g for g in got if g[1] and g[0] < 1000]
    assert sum(g[6] for g in held) > 0.9 * sum(g[5] for g in held)  # both negative: the model is better
    assert all(np.isfinite(g[6]) and g[6] < 0 for g in got)


def test_lm_keeps_rare_pairs(spark):
    """Pairs seen twice are held however many tokens the corpus has (2^-18 of these would be 4)."""
    filler = " ".join(f"f{k % 500}" for k in range(5000))
    held = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = [(k, filler) for k in range(300) if k not in held]
    few = [k for k in range(300, 400) if k not in held][:2]
    rows += [(k, "alpha beta gamma delta epsilon") for k in few]
    rows += [(held[0], "alpha beta gamma delta epsilon"), (held[1], "gamma alpha epsilon beta delta")]
    got = {x["doc_id"]: x for x in lmscore.query(documents(spark, rows)).collect()}
    assert got[held[0]]["train_tokens"] > 1 << 20
    assert got[held[0]]["score"] > got[held[1]]["score"] + 4
    np.testing.assert_allclose(got[held[0]]["base_score"], got[held[1]]["base_score"])


def test_log_bloom():
    r = np.random.default_rng(2)
    keys = r.integers(0, 1 << 62, 5000).astype(np.uint64)
    levels = r.integers(1, 20, 5000)
    bloom = lmscore.LogBloom(int(levels.sum()))
    bloom.insert(keys, levels)
    got = bloom.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.98
    other = bloom.levels(r.integers(1 << 62, 1 << 63, 5000).astype(np.uint64))
    assert (other == 0).mean() > 0.98


def test_lm_edges(spark):
    rows = odd_rows()
    got = sorted(((x["doc_id"], x["n_tokens"], x["n_known"]) for x in lmscore.query(extra(documents(spark, rows))).collect()), key=str)
    assert got == sorted(((w[0], w[2], w[3]) for w in lm_base(rows)), key=str)
    assert lmscore.query(documents(spark, [])).count() == 0
    only = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    x = lmscore.query(documents(spark, [(only, "held out only")])).first()
    assert (x["train_tokens"], x["n_known"]) == (0, 0) and np.isfinite(x["score"]) and np.isfinite(x["base_score"])


# --- 4


def test_html_held_out():
    weights, move = htmlcrf.model()
    wrong = total = 0
    for page in htmlcrf.training_pages(120, seed=99):
        bs = htmlcrf.blocks(page)
        y = htmlcrf.viterbi(htmlcrf._scores(weights, bs), move)
        wrong += sum((b.label == "article") != bool(k) for b, k in zip(bs, y) if b.label)
        total += len(bs)
    assert wrong / total < 0.02


@pytest.mark.parametrize("head", ["<head><title>T</title>", "<head><meta charset=utf-8><noscript><img src=x>on</noscript><script>1<2</script>", "<head><title>T</title></head>", "<head><title>T</title><body>"])
def test_html_head_ends_without_its_tag(head):
    got = [b.text for b in htmlcrf.blocks(f"<html>{head}<article><p>First part.</p><p>Second.</p></article>")]
    assert got == ["First part.", "Second."]
    assert [b.text for b in htmlcrf.blocks(f"<html>{head}Just text")] == ["Just text"]


def test_viterbi_brute_force():
    import itertools

    r = np.random.default_rng(0)
    for _ in range(30):
        emit, move = r.normal(size=(6, 2)), r.normal(size=(2, 2))
        score = lambda y: sum(emit[k, s] for k, s in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:]))
        assert tuple(htmlcrf.viterbi(emit, move)) == max(itertools.product((0, 1), repeat=6), key=score)


def test_html_blocks_and_edges(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><!-- no --><div class="ad">Buy this now.</div>
    <article><h1>A &amp; B</h1><p>First   para\n graph, with <a href='y'>link</a>.<p><b>Second one,<br>it goes on.<p>Third &lt;tag&gt; &#233;.<script>var a = "<p>no</p>";</script></article>
    <section id=comments><p>I like it, really.</p></section><footer>&copy; 2024 site &middot; All rights reserved</footer></body></html>"""
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>unclosed <!-- comment"), (5, "u", "plain"), (6, "u", "<div" * 2000), (7, "u", page), (None, "u", "<script>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("main", F.lit("clash"))
    got = {r["page_id"]: r for r in htmlcrf.query(df).collect()}
    assert got[1]["text"] == "A & B\nFirst para graph, with link.\nSecond one, it goes on.\nThird <tag> é."
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[7]["text"] == got[1]["text"]
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0 and len(got) == 8
    assert htmlcrf.query(df.where("page_id > 100")).count() == 0


# --- 5


def shingle_set(t):
    w = (t or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_near_duplicates_brute_force(spark):
    r = random.Random(3)
    rows = []
    for k in range(60):
        base = prose(k, 150).split()
        rows.append((10 * k, " ".join(base)))
        for c in range(k % 5):
            w = list(base)
            for _ in range(c * 2):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((10 * k + c + 1, " ".join(w)))
    got = neardup.query(documents(spark, rows)).collect()
    cls = {x["doc_id"]: x["class_id"] for x in got}
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert cls == {d: root(d) for d in sets}
    kept = neardup.one_of_each(extra(documents(spark, rows)))
    assert {x["doc_id"] for x in kept.collect()} == set(cls.values()) and "class_id" in kept.columns


def test_signature_estimates_similarity():
    """Bands of four samples agree with a probability of the similarity to the fourth power."""
    hits, want = [], []
    for seed in range(120):
        r = np.random.default_rng(seed)
        a = np.unique(r.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[:170], r.integers(0, 1 << 63, 30).astype(np.uint64)]))
        wa, wb = np.where(a % 3 == 0, 1.7, 1.0), np.where(b % 3 == 0, 1.7, 1.0)
        wb[b % 5 == 0] *= 0.6
        want.append(neardup.similarity((a, wa), (b, wb)) ** neardup.ROWS)
        hits.append((neardup.signature(a, wa) == neardup.signature(b, wb)).mean())
    assert abs(np.mean(hits) - np.mean(want)) < 0.04


def test_near_duplicate_edges(spark):
    rows = odd_rows()
    got = collections.Counter((x["doc_id"], x["class_id"]) for x in neardup.query(extra(documents(spark, rows))).collect())
    assert got == collections.Counter([(1, 1), (2, 1), (None, None), (4, 4), (5, 5), (6, 6), (6, 6), (7, 7)])
    assert neardup.query(documents(spark, [])).count() == 0
    kept = neardup.one_of_each(documents(spark, rows)).collect()
    assert collections.Counter(x["doc_id"] for x in kept) == collections.Counter([1, None, 4, 5, 6, 7])


# --- 6


def quality_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    cov = {j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov)


def test_quality_statistics():
    r = random.Random(4)
    for k in range(300):
        t = "".join(r.choice("ab# |\n\t\x0b\x1c\x85é ") for _ in range(r.randrange(80)))
        assert quality.text_statistics(t)[:5] == quality_base(t), repr(t)
    assert quality.text_statistics(None)[:5] == (0, 0, 0, 0, 0)


def test_quality_rules(spark):
    rows = [(k, prose(k, 80) if k % 3 else " ".join(w + "$$$" for w in prose(k, 80).split())) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(0, 300, 2)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.query(documents(spark, rows), labels).collect()}
    assert {d for d, x in got.items() if x["kept"]} == {k for k in range(300) if k % 3}
    assert {x["doc_id"] for x in quality.keep(extra(documents(spark, rows)), labels).collect()} == {k for k in range(300) if k % 3}


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.query(extra(documents(spark, odd_rows())), labels).collect()
    assert len(got) == 8 and {x["doc_id"] for x in got if x["kept"]} == {5}
    assert quality.query(documents(spark, []), labels).count() == 0


# --- 7

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = 0
    for i, x in enumerate(reversed(d)):
        x = int(x) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def base_spans(t):
    out = []
    for i, (k, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]:
                out.append((m.start(), i, m.end(), k))
    return sorted(out)


def test_pii_base(spark):
    r = random.Random(6)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "+1 (234) 555-7890", "+12", "++1 2345678901234", "_foo@bar.com", "é", "𝔘", " ", "-", ".", "5", "a@b.c_d@e.f", "0001.2.3.004", "+49 30 123456", "\n", "word"]
    rows = [(k, "".join(r.choice(parts) + r.choice(("", " ")) for _ in range(r.randrange(12)))) for k in range(600)]
    got = {x["doc_id"]: x for x in pii.query(documents(spark, rows)).collect()}
    for k, t in rows:
        want = base_spans(t)
        text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        x = got[k]
        assert x["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (t, text, x["spans"])
        assert [x[f"n_{n}"] for n in PLAIN] == [sum(s[3] == n for s in want) for n in PLAIN]
        assert {f"{kind}:{a}:{b}" for a, _, b, kind in want} <= set(x["spans"].split(","))


def test_pii_disclosure(spark):
    rows = [(k, prose(k, 30)) for k in range(200)]
    rows += [(1000 + k, f"{prose(k, 10)} Zebedee writes from zeb@mail.com today {prose(k + 9, 10)}") for k in range(3)]
    rows += [(2000, 'token = "abcdefabcdef0123456789" the end'), (2001, "the word alone@mail.org and")]
    got = {x["doc_id"]: x for x in pii.query(documents(spark, rows)).collect()}
    for k in range(3):
        t = rows[200 + k][1]
        terms = {t[int(a) : int(b)] for kind, a, b in (s.split(":") for s in got[1000 + k]["spans"].split(",")) if kind == "term"}
        assert "Zebedee" in terms and not terms & set(EN)
    assert got[2000]["n_secret"] == 1 and got[2001]["n_term"] == 0 and all(got[k]["spans"] == "" for k in range(200))
    clean = {x["doc_id"]: x["sanitised"] for x in pii.sanitise(extra(documents(spark, rows))).collect()}
    assert "[EMAIL]" in clean[1000] and "Zebedee" not in clean[1000] and clean[5] == rows[5][1]


def test_pii_own_key_words(spark):
    """Words that the secret's pattern asks for are no terms; other words that only such documents hold are."""
    rows = [(k, prose(k, 30)) for k in range(300)]
    rows += [(1000 + k, f"{prose(4000 + k, 12)} vaultmaster sets {name} = {'%032x' % (k * 7919 + 5)} {prose(5000 + k, 9)}") for k in range(12) for name in [("token", "api_key", "access_key", "password")[k % 4]]]
    for x in pii.query(documents(spark, rows)).collect():
        text = dict(rows)[x["doc_id"]]
        terms = {text[int(a) : int(b)] for kind, a, b in (s.split(":") for s in x["spans"].split(",") if s) if kind == "term"}
        assert not terms & {w for words in pii.OWN.values() for w in words}
        assert ("vaultmaster" in terms) == (x["doc_id"] >= 1000) and x["n_secret"] == (x["doc_id"] >= 1000)


def test_pii_edges(spark):
    rows = [*odd_rows(), (60, "1" * 60_000), (61, "a." * 30_000 + "@"), (62, "a@" + "b." * 20_000 + "c"), (63, "+1" + "(" * 30_000)]
    got = pii.query(extra(documents(spark, rows))).collect()
    assert len(got) == 12 and {x["doc_id"]: x["n_email"] for x in got}[62] == 1
    assert pii.query(documents(spark, [])).count() == 0


# --- 8


def test_mixing(spark):
    r = random.Random(8)
    rows = [(k, prose(k, r.randrange(1, 60)), "en", f"s{k % 7}" if k % 11 else None) for k in range(1500)]
    rows += [(5000 + k, prose(k, 2), "en", "tiny") for k in range(3)]
    got = mixing.query(documents(spark, rows)).collect()
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    taken = collections.Counter()
    for x in got:
        assert x["source_size"] == size[x["source"]] and np.isclose(x["target"], target[x["source"]])
        assert x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 60
    again = mixing.query(documents(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    stream = mixing.mix(extra(documents(spark, rows)))
    assert collections.Counter(x["doc_id"] for x in stream.collect()) == collections.Counter({x["doc_id"]: x["copies"] for x in got if x["copies"]})


def test_curriculum(spark):
    knots = ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0))
    ts = np.linspace(0, 1, 21)
    share = [float(np.trapezoid(np.interp(np.linspace(0, t, 2001), [0, 0.5, 1], [0.5, 0.5, 2.0]), np.linspace(0, t, 2001)) / 0.875) for t in ts]
    got = spark.createDataFrame([(s,) for s in share], "y double").select(mixing.invert_demand(F.col("y"), knots).alias("t")).collect()
    np.testing.assert_allclose([x["t"] for x in got], ts, atol=1e-4)


def test_mixing_deals_hot_ids(spark):
    """Rows of one id, or of none, take many buckets, and the mix does not depend on the rows' order."""
    rows = [(None if k % 2 else 7, prose(k, 1 + k % 30), "en", f"s{k % 3}") for k in range(2000)] + [(7, "same text", "en", "s0")] * 50
    docs = documents(spark, rows)
    share = docs.groupBy("doc_id", F.substring(mixing.stream_key(), 1, 3).alias("b")).count().groupBy("doc_id").agg(F.max("count").alias("most"), F.count("b").alias("buckets")).collect()
    assert {x["doc_id"] for x in share} == {7, None} and all(x["buckets"] > 700 and x["most"] < 60 for x in share)
    got, again = (sorted(map(repr, mixing.query(d).collect())) for d in (docs, docs.repartition(5)))
    assert got == again and len(got) == 2050
    for s in ("s0", "s1", "s2"):
        mine = [x for x in mixing.query(docs).where(F.col("source") == s).collect()]
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) < 0.05 * mine[0]["target"]


def test_mixing_edges(spark):
    got = {x["doc_id"]: x for x in mixing.query(extra(documents(spark, odd_rows()))).collect()}
    assert got[1]["size"] == 0 and got[1]["target"] == 0.0 or got[1]["source"] is None
    assert mixing.query(documents(spark, [])).count() == 0
    zero = mixing.query(documents(spark, [(1, None), (2, "")])).collect()
    assert [x["taken"] for x in zero] == [0, 0] and [x["target"] for x in zero] == [0.0, 0.0]


# --- 9


def removed(rows, length=400):
    data = [(t or "").encode() for _, t, *_ in rows]
    c = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (d, *_), b in zip(rows, data):
        m = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, m) if not y)
        out.append((d, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    r = random.Random(seed)
    shared = [prose(9000 + k, 90 + 20 * k) for k in range(4)]
    rows = []
    for k in range(30):
        t = prose(k, 60)
        for s in r.sample(shared, r.randrange(3)):
            cut = r.randrange(0, 60)
            t += " " + s[cut : len(s) - r.randrange(0, 60)] + " " + prose(k + 77, 30)
        rows.append((k, t))
    return [*rows, (40, rows[3][1]), (41, "ab" * 700), (42, "é" * 450), (43, "x" * 399), (44, "x" * 401), (45, rows[5][1] + "!"), (46, rows[5][1][:700] + "?" + rows[5][1][700:])]


@pytest.mark.parametrize("shard, group", [(2 << 20, 8192), (6000, 8192), (2 << 20, 1)])
def test_suffix_dedup_brute_force(spark, monkeypatch, shard, group):
    monkeypatch.setattr(suffixdedup, "SHARD", shard)
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    rows = passages(2)
    got = sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffixdedup.query(documents(spark, rows)).collect())
    assert got == sorted(removed(rows))


def test_suffix_array_and_prefixes():
    r = random.Random(9)
    for _ in range(100):
        b = bytes(r.choice(b"ab\xff"[: r.randrange(1, 4)]) for _ in range(r.randrange(1, 120)))
        d = np.frombuffer(b, np.uint8)
        sa = suffixdedup.suffix_array(d)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        cap = r.choice((3, 400))
        got = suffixdedup.common_prefixes(d, sa, cap, r.choice((1, 4, 16)))
        want = [0, *[len(os.path.commonprefix([b[i : i + cap], b[j : j + cap]])) for i, j in zip(sa, sa[1:])]]
        assert got.tolist() == want


def test_cross_shard_search():
    r = random.Random(11)
    base = [bytes(r.choice(b"abcd") for _ in range(60)) for _ in range(8)]
    slices = [base[k % 8][: 40 + k] for k in range(16)]
    one = suffixdedup.repeated_windows(slices, np.arange(16) * 1000, np.zeros(16, bool), 1 << 20, 20)
    cut = suffixdedup.repeated_windows(slices, np.arange(16) * 1000, np.zeros(16, bool), 100, 20)
    assert [x.tolist() for x in one] == [x.tolist() for x in cut] and sum(map(len, one))


def test_suffix_dedup_edges(spark):
    rows = odd_rows()
    got = sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffixdedup.query(extra(documents(spark, rows))).collect()), key=str)
    assert got == sorted(removed(rows), key=str)
    assert suffixdedup.query(documents(spark, [])).count() == 0


# --- 10


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    rows = [(k * 7 % 101, t) for k, t in enumerate(["", None, "Hello, world!\nNew  line \n\n end ", "a<|endoftext|>b c", "it's we'll \tx", " lead", "trail ", "\n", "é𝔘 中文", "x" * 3000, *[prose(k, 50) for k in range(60)]])]
    where = tokenbin.write(documents(spark, rows), path, chunk_ids=200)
    got = sorted((x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) for x in tokenbin.read(spark, where).collect())
    want, at = [], 0
    for d, t in sorted(rows):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert spark.read.parquet(where).count() > 5


def test_elias_fano():
    r = random.Random(12)
    for n in (0, 1, 2, 63, 64, 65, 500):
        v = sorted(r.randrange(10 ** r.randrange(1, 9)) for _ in range(n))
        ef = tokenbin.EliasFano.from_bytes(tokenbin.EliasFano.encode(v).to_bytes())
        assert ef.decode().tolist() == v and [ef.select(i) for i in range(n)] == v
    v = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert len(tokenbin.EliasFano.encode(v).to_bytes()) < 0.3 * 8 * len(v)
    with pytest.raises(IndexError):
        ef.select(500)


def test_tokens_edges(spark):
    got = tokenbin.query(extra(documents(spark, odd_rows())), tokenizer_path()).collect()
    assert collections.Counter(x["doc_id"] for x in got) == collections.Counter([None, 1, 2, 4, 5, 6, 6, 7])
    starts = sorted((x["start"], x["n_tokens"]) for x in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert tokenbin.query(documents(spark, []), tokenizer_path()).count() == 0


# --- shared parts, pipeline


def test_heavy_hitters(spark):
    rows = [(" ".join(["hot"] * (k % 3) + [f"w{k % 50}", f"u{k}"]),) for k in range(500)]
    df = spark.createDataFrame(rows, "text string").repartition(7)

    def keys_of(texts):
        words = [w for t in texts for w in t.split()]
        k = neardup._words
        keys = np.array([k[w.encode()] for w in words], np.uint64)
        yield keys, np.ones(len(keys), np.int64), keys ^ np.uint64(5)

    got, n, total = heavy(df, keys_of, lambda n, total: 10)
    c = collections.Counter(w for (t,) in rows for w in t.split())
    assert n == 500 and total == sum(c.values())
    assert {k: v[0] for k, v in got.items()} == {neardup._words[w.encode()]: x for w, x in c.items() if x >= 10}
    assert all(t == k ^ 5 for k, (_, t) in got.items())


def test_pipeline(spark, tmp_path):
    bench = [(k, prose(1000 + k, 30)) for k in range(5)]
    rows = [(k, prose(k, 90), "en", f"s{k % 3}") for k in range(80)]
    rows += [(100 + k, rows[k][1], "en", "s0") for k in range(10)]
    rows += [(200 + k, prose(300 + k, 60) + " " + bench[k][1], "en", "s1") for k in range(5)]
    rows += [(300 + k, " ".join(w + "$$$" for w in prose(k, 80).split()), "en", "s2") for k in range(60)] + [(400, "short", "en", "s2"), (401, None, None, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(300 + k, 0, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items(spark, bench).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SHAPE.split(", ")]
        seen.append({x["doc_id"] for x in docs.collect()})
    good = set(range(80)) | set(range(100, 110)) | set(range(200, 205))
    assert seen == [good, good - set(range(100, 110)), set(range(80))]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} <= set(range(80)) and len({x["doc_id"] for x in out}) > 40
    assert len(corpus_pipeline.STAGES) == 5


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")) == list(range(1, 11)) and "pipeline" in QUERIES


def test_shared_passages(spark):
    """Every passage of over 50 words that two texts share is found, nothing else is."""
    r = random.Random(21)
    fresh = itertools.count()
    own = lambda n: " ".join(f"{r.choice(EN)}{next(fresh)}" for _ in range(n))
    rows, want = [], set()
    for k in range(40):
        n = (51, 60, 200, 20)[k % 4]
        shared = own(n)
        for d in (2 * k, 2 * k + 1):
            rows.append((d, f"{own(r.randrange(80))} {shared} {own(r.randrange(80))}"))
            want |= {d} if n > 50 else set()
    rows += [(100, own(300)), (101, "the " * 400), (102, None), (103, own(60)), (104, own(30))]
    rows.append((105, rows[-2][1]))
    want |= {103, 105}
    got = {x["doc_id"] for x in suffixdedup.query(documents(spark, rows).repartition(5)).collect() if x["n_passages"]}
    assert got == want


def test_lm_beats_base_on_held_out_texts(spark):
    got = lmscore.query(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


def test_near_duplicates_in_a_shared_bucket(spark):
    """Near copies are found among many texts that share most of a long notice but are not near-duplicates."""
    r = random.Random(22)
    notice = prose(77, 150)
    rows = [(k, f"{notice} {' '.join(f'w{r.randrange(10**9)}' for _ in range(60))}") for k in range(400)]
    for k in range(0, 400, 10):
        w = rows[k][1].split()
        w[160] = "changed"
        rows.append((1000 + k, " ".join(w)))
    cls = {x["doc_id"]: x["class_id"] for x in neardup.query(documents(spark, rows)).collect()}
    assert all(cls[1000 + k] == k for k in range(0, 400, 10))
    assert len(set(cls.values())) == 400


def test_pii_terms_brute_force(spark):
    """Disclosing words against a plain count over whole texts and contexts."""
    r = random.Random(31)
    rows = [(k, prose(k, 40)) for k in range(400)]
    rows += [(1000 + k, f"Dear Quillon,\n{prose(2000 + k, 30)}\nwrite to q{k}@mail{k}.org today {prose(k, 8)}\nregards Marisk") for k in range(8)]
    rows += [(2000 + k, f"{prose(3000 + k, 20)} Marisk {prose(k, 9)}") for k in range(30)]
    texts = dict(rows)
    emails = {d: [m.span() for m in re.finditer(PLAIN["email"], t)] for d, t in rows}
    has = {d for d, e in emails.items() if e}
    terms = {d: set(re.findall(r"[^\W\d_]{3,}", t.lower())) for d, t in rows}
    n = len(rows)
    near = {d: set(re.findall(r"[^\W\d_]{3,}", (texts[d][max(0, emails[d][0][0] - 200) : emails[d][0][0]] + " " + texts[d][emails[d][0][1] : emails[d][0][1] + 200]).lower())) for d in has}
    tested = len({t for d in has for t in terms[d]}) + sum(map(len, near.values()))
    want = set()
    for t in {t for d in has for t in terms[d]}:
        n_t, n_ct = sum(t in x for x in terms.values()), sum(t in terms[d] for d in has)
        pmi = np.log2(n * n_ct / (len(has) * n_t))
        if n_ct > 1 and pmi >= pii.SHARE * np.log2(n / len(has)) and n_ct * pmi >= pii.DOUBT + np.log2(tested):
            want.add(t)
    assert "quillon" in want and "marisk" not in want
    for x in pii.query(documents(spark, rows)).collect():
        found = {texts[x["doc_id"]][int(a) : int(b)].lower() for kind, a, b in (s.split(":") for s in x["spans"].split(",") if s) if kind == "term"}
        inside = {w for a, b in emails[x["doc_id"]] for w in re.findall(r"[^\W\d_]{3,}", texts[x["doc_id"]][a:b].lower())}
        assert found - inside == ((want & terms[x["doc_id"]]) - inside if x["doc_id"] in has else set())
