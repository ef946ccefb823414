"""Quality rules: a decision list learned by sequential covering.

Statistics of whole texts (an Arrow UDF) are joined with labels; a bounded sample of labelled rows
(``max_labels``, chosen by a hash of the id) trains the list on the driver. Each rule is a
conjunction of thresholds, grown by information gain on two thirds of the sample (by a hash of the id)
and pruned on the rest. A rule that is not precise enough is left out and the rows it was grown for are
not grown for again; after ``PATIENCE`` such rules in a row the list ends. The list becomes one ordered
Spark conditional expression, so applying it is JVM-side.

Edge cases: null text has no words and fails the base rule; without labels (or with one class only)
the list is empty and only the base rule rejects; null quality is no label; repeated labels of an
id count once (the lowest); repeated documents are judged each by its own text, of a labelled id the
longest text trains; equal gains take the first feature and least threshold; very long texts are read
whole; other columns are carried by ``keep`` whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, takes_over

#: At most about this many labelled rows train the list.
MAX_LABELS = 20_000
#: Conditions of a rule at most, precision and rows a rule needs, and rejected rules in a row that end the list.
MAX_CONDITIONS, MIN_PRECISION, MIN_COVER, PATIENCE = 4, 0.97, 5, 5
MIN_WORDS, MAX_REPEAT = 50, 50

_SPACE = " \t\n\v\f\r"
_STRIP = str.maketrans("", "", _SPACE)

#: What rules may test; each is a column of ``statistics``.
FEATURES = ("mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "exclaim_per_word", "bar_per_word", "top_word_share", "distinct_share", "n_words")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, mean_word_chars double, symbol_share double, dup_line_share double, repeat_share double, upper_share double, digit_share double, exclaim_per_word double, bar_per_word double, top_word_share double, distinct_share double"


def repeated_words(ids: np.ndarray, n_types: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    if n_types < 1 << 20:
        codes = (ids[:-2] * n_types + ids[1:-1]) * n_types + ids[2:]
    else:
        _, pair = np.unique(ids[:-2] * n_types + ids[1:-1], return_inverse=True)
        codes = pair * n_types + ids[2:]
    order = np.argsort(codes, kind="stable")
    s = codes[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(codes), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= twice
    return int(covered.sum())


def text_statistics(text: str | None) -> tuple:
    """One text's row of ``SCHEMA``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text.translate(_STRIP)) if n else 0
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    types: dict[bytes, int] = {}
    ids = np.array([types.setdefault(w, len(types)) for w in words], np.int64)
    repeat = repeated_words(ids, len(types)) if n else 0
    upper = len(_UPPER.findall(text))
    digits = len(_DIGIT.findall(text))
    top = int(np.bincount(ids).max()) if n else 0
    d = max(n, 1)
    return (n, chars, symbols, dup, repeat, chars / d, symbols / max(chars, 1), dup / max(len(lines), 1), repeat / d, upper / max(chars, 1), digits / max(chars, 1), text.count("!") / d, text.count("|") / d, top / d, len(types) / d)


_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile("[0-9]")


def statistics(text: Column) -> Column:
    """Struct column of ``SCHEMA`` for a text column."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        takes_over("quality")
        return pd.DataFrame([text_statistics(t) for t in texts], columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return run(text)


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _covers(x: np.ndarray, rule: list[tuple[int, bool, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, above, at in rule:
        hit &= x[:, f] >= at if above else x[:, f] < at
    return hit


def _grow(x: np.ndarray, bad: np.ndarray) -> list[tuple[int, bool, float]]:
    rule: list[tuple[int, bool, float]] = []
    while len(rule) < MAX_CONDITIONS:
        hit = _covers(x, rule)
        xs, ys = x[hit], bad[hit]
        p0, n0 = int(ys.sum()), int((~ys).sum())
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f in range(x.shape[1]):
            order = np.argsort(xs[:, f], kind="stable")
            v, y = xs[order, f], ys[order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            below = np.cumsum(y)[cut - 1]
            p, n = below, cut - below
            for above, g in ((False, _gain(p0, n0, p, n)), (True, _gain(p0, n0, p0 - p, n0 - n))):
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (float(g[k]), (f, above, float((v[cut[k]] + v[cut[k] - 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def learn(x: np.ndarray, bad: np.ndarray, ids: np.ndarray, min_precision: float = MIN_PRECISION) -> list[list[tuple[str, bool, float]]]:
    """Rules (feature, at least?, threshold) of what is bad, in order; ``ids`` split the rows."""
    held = np.array([xxhash.xxh64_intdigest(str(i)) % 3 == 2 for i in ids.tolist()], bool)
    left, seek, rules, poor = np.ones(len(x), bool), bad.copy(), [], 0
    while poor < PATIENCE:
        grown = left & ~held & (seek | ~bad)
        rule = _grow(x[grown], bad[grown])
        if not rule:
            break
        xp, yp = x[left & held], bad[left & held]

        def worth(r, xp=xp, yp=yp):
            hit = _covers(xp, r)
            p = int((hit & yp).sum())
            n = int(hit.sum()) - p
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        both = _covers(x, rule) & left
        test = both & held
        seek &= ~both
        if both.sum() < MIN_COVER or bad[both].mean() < min_precision or not test.any() or bad[test].mean() < min_precision:
            poor += 1
            continue
        rules.append([(FEATURES[f], above, at) for f, above, at in rule])
        left &= ~both
        poor = 0
    return rules


def expression(rules, field) -> Column:
    """Number of the first rule that holds (from 1), or 0; ``field`` gives a feature's column."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = None
        for name, above, at in rule:
            one = field(name) >= at if above else field(name) < at
            test = one if test is None else test & one
        out = F.when(test, k) if out is None else out.when(test, k)
    return (out.otherwise(0) if out is not None else F.lit(0)).cast("int")


def base_failed(field) -> Column:
    return (field("n_words") < MIN_WORDS) | (100 * field("n_repeat_words") > MAX_REPEAT * field("n_words"))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> list:
    """Learn the list from labelled documents of ``docs``."""
    prepare(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    n = known.count()
    share = min(1.0, max_labels / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most about max_labels rows
    # a repeated id counts once, so that the driver gets no more rows than labels
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    rows = rows.select("doc_id", "quality", statistics(F.col("text")).alias("s")).select("doc_id", "quality", *[F.col(f"s.{f}").cast("double").alias(f) for f in FEATURES])
    got = rows.toPandas().sort_values(["doc_id", *FEATURES])
    x, bad = got[list(FEATURES)].to_numpy(np.float64), (got["quality"] == 0).to_numpy()
    return learn(x, bad, got["doc_id"].to_numpy()) if bad.any() and not bad.all() else []


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = train(docs, labels)
    rows = docs.select("doc_id", statistics(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")
    failed, rule = base_failed(F.col), expression(rules, F.col)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    rules = train(docs, labels)
    judged = docs.withColumn("__statistics", statistics(F.col("text").cast("string")))
    field = lambda name: F.col(f"__statistics.{name}")
    return judged.where(~base_failed(field) & (expression(rules, field) == 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
