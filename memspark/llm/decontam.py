"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased words. Every mask is a fixed pattern over successive tokens of which it reads
some and ignores the rest, so a seed survives a substitution at an ignored place. The masks are complete:
whatever places of a window differ within the rule, some mask misses them all (a test tries every case). Seeds of
the test items are hashed; training texts are hashed with the same masks and joined on the hash. A
hit fixes a diagonal (item place against text place); the whole diagonal is then compared token by
token, and the overlap counts if some window of ``WINDOW`` tokens (the whole item if it is shorter)
agrees in ``MIN_SHARE`` of its places. Items shorter than ``WINDOW`` are sought whole, with masks of
their own length; 80 % of up to four words are all of them.

Scale: the test side is cut into blocks of at most ``BLOCK_TOKENS`` tokens by item hash; each
block's seed table has a proven size and is broadcast, one pass over the texts for each block.
Training texts are never shuffled and no seed of theirs leaves its task.

Edge cases: null or word-less texts and items match nothing; items without an id are reported with a
null id; repeated items and repeated documents are each reported; a seed that recurs in an item or a very
long text counts at all its places; of overlaps of one pair the one with most agreeing tokens is reported,
then the longest, then the last; other columns are carried by ``clean`` whatever their names; an empty
side gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, takes_over, text_of

#: Which successive tokens each mask reads.
MASKS = ("11101111", "11010010111", "1110110011")
WINDOW, MIN_SHARE = 13, 0.8
BLOCK_TOKENS = 1_000_000
#: Hits that are held at once before equal diagonals are united.
HITS = 1 << 20
_FILTER_BITS = 22
_WORDS = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2D358DCCAA6C78A5, 0x8BB84B93962EACC9], np.uint64)


class Tokens(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_tokens = Tokens()


def begin() -> None:
    takes_over("decontam", _tokens.clear)


def hashes(text: str | None) -> np.ndarray:
    words = _WORDS.findall(text.lower()) if text else []
    return np.fromiter(map(_tokens.__getitem__, words), np.uint64, len(words))


def seeds(tokens: np.ndarray, places: tuple[int, ...], salt: int) -> np.ndarray:
    """The hash of the places read, at every position where the span fits."""
    n = len(tokens) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, (salt * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k, p in enumerate(places):
            t = tokens[p : p + n]
            h += (t ^ (t >> np.uint64(31))) * _ODD[k % len(_ODD)] * np.uint64(2 * (k // len(_ODD)) + 1)
        return h ^ (h >> np.uint64(28))


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Places read in a whole item of ``n`` tokens: of d + 2 parts, all but d, where d may differ."""
    d = n - int(np.ceil(MIN_SHARE * n))
    parts = np.array_split(np.arange(n), d + 2)
    return [tuple(np.concatenate([x for k, x in enumerate(parts) if k not in c]).tolist()) for c in combinations(range(d + 2), d)] if d else [tuple(range(n))]


class Index:
    """Seeds of some items, sorted."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in items]
        self.tokens = [hashes(t) for _, t in items]
        full = [tuple(k for k, c in enumerate(m) if c == "1") for m in MASKS]
        short = sorted({len(t) for t in self.tokens if 0 < len(t) < WINDOW})
        #: (places, span, salt, length of the items it is for: 0 for those of WINDOW and more)
        self.masks = [(places, places[-1] + 1, k + 1, 0) for k, places in enumerate(full)] + [(places, n, 100 * n + k, n) for n in short for k, places in enumerate(short_masks(n))]
        keys, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, t in enumerate(self.tokens):
            for places, span, salt, length in self.masks:
                if len(t) == length or (not length and len(t) >= WINDOW):
                    s = seeds(t, places, salt)[: len(t) - span + 1]
                    keys.append(s)
                    item.append(np.full(len(s), i))
                    place.append(np.arange(len(s)))
        keys, item, place = np.concatenate(keys), np.concatenate(item), np.concatenate(place)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], item[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, agreeing tokens, tokens compared, first and past-last token in the text) of
        the best overlap of each pair that has one."""
        docs = [hashes(t) for t in texts]
        lengths = np.array([len(d) for d in docs], np.int64)
        if not len(self.keys) or not lengths.sum():
            return []
        tokens, starts = np.concatenate(docs), np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(docs)), lengths)
        hits = []
        for places, span, salt, _ in self.masks:
            s = seeds(tokens, places, salt)[: max(0, len(tokens) - span + 1)]
            maybe = np.flatnonzero(self.filter[(s >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            maybe = maybe[doc[maybe] == doc[maybe + span - 1]]
            lo = np.searchsorted(self.keys, s[maybe], "left")
            many = np.searchsorted(self.keys, s[maybe], "right") - lo
            maybe, lo, many = maybe[many > 0], lo[many > 0], many[many > 0]
            step = np.cumsum(many) // HITS  # repetitive texts and items hit each other often
            for cut in np.split(np.arange(len(maybe)), np.flatnonzero(np.diff(step)) + 1) if len(maybe) else ():
                n = many[cut]
                at = np.repeat(maybe[cut], n)
                entry = np.repeat(lo[cut] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hits.append(np.unique(np.stack([doc[at], self.item[entry], at - starts[doc[at]] - self.place[entry]], 1), axis=0))
        if not hits:
            return []
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for d, i, shift in np.unique(np.concatenate(hits), axis=0).tolist():
            a, b = docs[d], self.tokens[i]
            begin, end = max(0, shift), min(len(a), shift + len(b))
            same = a[begin:end] == b[begin - shift : end - shift]
            need = min(WINDOW, len(b))
            if len(same) < need:
                continue
            total = np.concatenate([[0], np.cumsum(same)])
            inside = total[need:] - total[:-need]
            good = np.flatnonzero(inside >= MIN_SHARE * need)
            if len(good):
                found = (int(same.sum()), len(same), begin + int(good[0]), begin + int(good[-1]) + need)
                best[d, i] = max(best.get((d, i), found), found)
        return [(d, i, *x) for (d, i), x in sorted(best.items())]


def indexes(items: DataFrame, block_tokens: int = BLOCK_TOKENS):
    """The items' seed tables, block by block; each holds about ``block_tokens`` tokens."""
    spark = prepare(items.sparkSession)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // (5 * block_tokens)))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        part = sorted(((r["item_id"], r["text"]) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield spark.sparkContext.broadcast(Index(part))


def _found(shared, text: Column) -> Column:
    @F.pandas_udf("array<struct<item_id: bigint, n_match: int, n_compared: int, start_token: int, end_token: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        begin()
        for texts in batches:
            rows: list[list] = [[] for _ in range(len(texts))]
            for d, i, m, n, a, b in shared.value.search(texts.tolist()):
                rows[d].append({"item_id": shared.value.ids[i], "n_match": m, "n_compared": n, "start_token": a, "end_token": b})
            yield pd.Series(rows, dtype=object)

    return run(text)


def _leaks(shared, text: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        begin()
        for texts in batches:
            hit = np.zeros(len(texts), bool)
            hit[[x[0] for x in shared.value.search(texts.tolist())]] = True
            yield pd.Series(hit)

    return run(text)


def overlaps(docs: DataFrame, items: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, item_id, n_match, n_compared, start_token, end_token of every overlap found."""
    out = None
    for shared in indexes(items, block_tokens):
        some = docs.select("doc_id", F.explode(_found(shared, text_of())).alias("o")).select("doc_id", "o.*")
        out = some if out is None else out.unionAll(some)
    return out


def clean(docs: DataFrame, items: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents without an overlap, with all their columns."""
    for shared in indexes(items, block_tokens):
        docs = docs.where(~_leaks(shared, text_of()))
    return docs
