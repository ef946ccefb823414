"""Language identification with interpolated Kneser-Ney character models.

A model per language over the characters of lower-cased letter words (word ends marked, contexts
stay inside a word). N-grams of all languages share one sorted array of 64-bit hashes per order; a
row holds each language's discounted probability, a second sorted array each context's back-off
weight. A text's cross-entropy is the mean over its characters, so lengths compare; the lowest
wins. A logistic model of margin and length, fitted on training documents that the n-gram counts
did not use, turns the margin into a probability; ``reject_below`` refuses unsure answers.

Training uses a bounded sample: about ``max_docs`` documents of each language, chosen by hash. The
model has at most a few MB and goes to workers by broadcast. Words are scored once per worker (a
bounded memo), so a text costs a count of its words.

Edge cases: null text or a text without a letter is ``und`` with score 0; without any training
document everything is ``und``; null languages teach nothing; ties go to the first language by
name; repeated rows are judged alike; very long texts are counted whole; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, prepare, text_of

ORDER = 4
#: Training documents of each language, about; languages beyond this count would each add as many.
MAX_DOCS = 800
MEMO_WORDS = 400_000
UND = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def letter_words(text: str) -> list[str]:
    words = _WORDS.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``^word$`` one after another; place in its word, and word, of each."""
    joined = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    return codes, np.arange(len(codes)) - starts[word], word


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For m = 0..order: hash of the m characters that end at each place (garbage before place m - 1)."""
    out = [np.zeros(len(codes), np.uint64)]
    h, power = np.zeros(len(codes), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for m in range(order):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[m:] = codes[: len(codes) - m] if m else codes
            h = h + (shifted + np.uint64(7)) * power
            power = power * _MULT
            out.append(_mix(h + np.uint64(m + 1) * np.uint64(0xD1B54A32D192ED03)))
    return out


class Model:
    """Languages; per order the sorted hashes of n-grams and contexts with a column per language."""

    def __init__(self, languages: list[str], order: int, alphabet: int):
        self.languages, self.order, self.alphabet = languages, order, alphabet
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.calibration = np.array([0.0, 8.0, 0.3])

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word (its end included) under each language: words x languages."""
        if not words:
            return np.zeros((0, len(self.languages)))
        codes, place, word = _characters(words)
        hashes = _hashes(codes, self.order)
        at = np.flatnonzero(place > 0)
        p = np.full((len(at), len(self.languages)), 1.0 / self.alphabet)
        for m in range(1, self.order + 1):
            ok = np.flatnonzero(place[at] >= m - 1)
            where = at[ok]
            q = p[ok]
            if m > 1:
                keys, values = self.contexts[m - 1]
                back = np.ones_like(q)
                k = np.minimum(np.searchsorted(keys, hashes[m - 1][where - 1]), max(len(keys) - 1, 0))
                hit = keys[k] == hashes[m - 1][where - 1] if len(keys) else np.zeros(len(where), bool)
                back[hit] = values[k[hit]]
                q = q * back
            else:
                q = q * self.contexts[0][1][0]
            keys, values = self.grams[m - 1]
            k = np.minimum(np.searchsorted(keys, hashes[m][where]), max(len(keys) - 1, 0))
            hit = keys[k] == hashes[m][where] if len(keys) else np.zeros(len(where), bool)
            q[hit] += values[k[hit]]
            p[ok] = q
        bits = -np.log2(np.maximum(p, 1e-12))
        out = np.zeros((len(words), len(self.languages)))
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(word[at], bits[:, j], minlength=len(words))
        return out

    def judge(self, entropies: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, calibrated probability and margin of each row of entropies."""
        best = np.argmin(entropies, axis=1)
        if entropies.shape[1] > 1:
            two = np.partition(entropies, 1, axis=1)
            margin = two[:, 1] - two[:, 0]
        else:
            margin = np.ones(len(entropies))
        a, b, c = self.calibration
        z = a + b * margin + c * np.log1p(chars)
        return best, 1 / (1 + np.exp(-np.clip(z, -30, 30))), margin


def fit(texts: list[str], langs: list[str], order: int = ORDER) -> Model | None:
    """Count on four documents of five, calibrate on the fifth."""
    names = sorted(set(langs))
    if not names:
        return None
    counted = [i for i in range(len(texts)) if i % 5 or len(texts) < 50]
    words = {name: Counter() for name in names}
    for i in counted:
        words[langs[i]].update(letter_words(texts[i]))
    alphabet = len({c for w in words.values() for x in w for c in x}) + 2
    model = Model(names, order, alphabet)
    parts = []  # for each language, per order: (gram hashes, discounted probability, context hashes, back-off)
    for name in names:
        types = sorted(words[name])
        per = []
        if types:
            codes, place, word = _characters(types)
            hashes = _hashes(codes, order)
            times = np.array([words[name][t] for t in types], np.float64)[word]
        for m in range(1, order + 1):
            if not types:
                per.append(None)
                continue
            at = np.flatnonzero(place >= max(m - 1, 1))
            gram, context = hashes[m][at], hashes[m - 1][at - 1] if m > 1 else np.zeros(len(at), np.uint64)
            g, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
            count = np.bincount(inverse, times[at])
            if m < order:  # continuation counts, except for n-grams that start a word
                inner = place[at] >= m
                left = np.unique(np.stack([gram[inner], hashes[m + 1][at[inner]]]), axis=1)[0]
                g2, c2 = np.unique(left, return_counts=True)
                starts = place[at][first] == m - 1
                cont = np.zeros(len(g))
                cont[np.searchsorted(g, g2)] = c2
                count = np.where(starts, count, np.maximum(cont, 1.0))
            n1, n2 = float((count == 1).sum()), float((count == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            ctx = context[first]
            c, back = np.unique(ctx, return_inverse=True)
            total, followers = np.bincount(back, count), np.bincount(back)
            per.append((g, np.maximum(count - discount, 0) / total[back], c, discount * followers / total))
        parts.append(per)
    for m in range(order):
        have = [p[m] for p in parts if p[m] is not None]
        empty = np.zeros(0, np.uint64)
        g = np.unique(np.concatenate([x[0] for x in have])) if have else empty
        c = np.unique(np.concatenate([x[2] for x in have])) if have else np.zeros(1, np.uint64)
        alpha, gamma = np.zeros((len(g), len(names))), np.ones((len(c), len(names)))
        for j, p in enumerate(parts):
            if p[m] is not None:
                alpha[np.searchsorted(g, p[m][0]), j] = p[m][1]
                gamma[np.searchsorted(c, p[m][2]), j] = p[m][3]
        model.grams.append((g, alpha.astype(np.float32)))
        model.contexts.append((c, gamma.astype(np.float32)))
    rest = [i for i in range(len(texts)) if i % 5 == 0] if len(counted) < len(texts) else []
    if len(names) > 1 and len(rest) >= 10:
        scorer = Scorer(model)
        e, chars = scorer.entropies([texts[i] for i in rest])
        ok = chars > 0
        best, _, margin = model.judge(e[ok], chars[ok])
        right = np.array([names[b] == langs[i] for b, i in zip(best, np.array(rest)[ok])], float)
        model.calibration = _logistic(np.stack([np.ones(len(margin)), margin, np.log1p(chars[ok])], 1), right)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, prior=(0.0, 8.0, 0.3), weight: float = 0.05) -> np.ndarray:
    """Newton steps towards the penalised optimum; the prior keeps it finite when all answers are right."""
    w, prior = np.array(prior), np.array(prior)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + weight * (w - prior)
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + weight * np.eye(len(w)), gradient)
    return w if np.isfinite(w).all() and w[1] > 0 else prior


class Scorer:
    """Cross-entropies of texts, with a memo of words."""

    def __init__(self, model: Model):
        self.model, self.memo, self.bits = model, {}, np.zeros((0, len(model.languages)))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character (texts x languages) and characters counted; 0 characters: no letter."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.bits = {}, self.bits[:0]
        counts = [Counter(letter_words(t)) if t else Counter() for t in texts]
        fresh = list({w for c in counts for w in c if w not in self.memo})
        blocks = [self.bits]
        for k in range(0, len(fresh), 50_000):
            some = fresh[k : k + 50_000]
            self.memo.update(zip(some, range(len(self.memo), len(self.memo) + len(some))))
            blocks.append(self.model.word_bits(some))
        if len(blocks) > 1:
            self.bits = np.concatenate(blocks)
        get = self.memo.__getitem__
        out, chars = np.full((len(texts), len(self.model.languages)), np.inf), np.zeros(len(texts))
        for i, c in enumerate(counts):
            if c:
                n = np.fromiter(c.values(), np.float64, len(c))
                chars[i] = sum((len(w) + 1) * k for w, k in c.items())
                out[i] = n @ self.bits[np.fromiter(map(get, c), np.int64, len(c))] / chars[i]
        return out, chars


_scorers: dict[int, Scorer] = {}


def train(docs: DataFrame, keep, max_docs: int = MAX_DOCS, order: int = ORDER) -> Model | None:
    """Fit on a bounded sample of the labelled rows of ``docs`` where ``keep`` holds."""
    prepare(docs.sparkSession)
    rows = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return None
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, max_docs / n) * (1 << 30))))])
    got = rows.where(place < share[F.col("lang")]).select("lang", "text", place.alias("place")).toPandas().sort_values(["place", "lang", "text"])
    return fit(got["text"].tolist(), got["lang"].tolist(), order)


def identify(docs: DataFrame, model: Model | None, reject_below: float | None = None) -> DataFrame:
    """doc_id, lang_pred, score, entropy (bits a character), rejected of every row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, entropy double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        if m is not None and id(m) not in _scorers:
            _scorers.clear()
            _scorers[id(m)] = Scorer(m)
        for texts in batches:
            n = len(texts)
            lang, score, bits = np.full(n, UND, object), np.zeros(n), np.full(n, None, object)
            if m is not None and n:
                e, chars = _scorers[id(m)].entropies(texts.tolist())
                ok = np.flatnonzero(chars > 0)
                if len(ok):
                    best, p, _ = m.judge(e[ok], chars[ok])
                    lang[ok] = np.array(m.languages, object)[best]
                    score[ok] = p
                    bits[ok] = e[ok, best]
            yield pd.DataFrame({"lang_pred": lang, "score": score, "entropy": bits})

    out = docs.select("doc_id", predict(text_of()).alias("p")).select("doc_id", "p.*")
    limit = F.lit(-1.0 if reject_below is None else reject_below)
    out = out.withColumn("rejected", (F.col("lang_pred") != UND) & (F.col("score") < limit))
    return out if reject_below is None else out.withColumn("lang_pred", F.when(F.col("rejected"), UND).otherwise(F.col("lang_pred")))


#: Below this probability the query flags an answer as rejected (its language still shows).
REJECT_BELOW = 0.6


def query(docs: DataFrame) -> DataFrame:
    model = train(docs, fold(5) != 0)
    out = identify(docs, model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "entropy", ((F.col("lang_pred") != UND) & (F.col("score") < REJECT_BELOW)).alias("rejected"))
