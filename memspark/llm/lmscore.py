"""Language-model scoring with a log-frequency Bloom filter.

The model is an interpolated bigram over words. It holds every word and every pair of the training
texts, from one occurrence on. Counts sit in a Bloom filter in quantised logarithmic form: an n-gram of
level q is inserted under levels 1..q, and a lookup probes levels upwards until one is missing, so a
false alarm can only raise a count by a level. Smoothing interpolates bigram and unigram. Words that the
training texts do not hold share the Good-Turing mass n1 / N (n1: words seen once) evenly over as many
new words as Chao's estimator expects, n1 (n1 - 1) / (2 (n2 + 1)); so a new word is one event, as in the
base score, and gibberish scores low.

Scale: texts are tokenised once, into packs of about ``PACK_TOKENS`` tokens in coded form. The filter
grows with the corpus and is cut by key hash into blocks of about ``BLOCK_TOKENS`` training tokens. A
pack sends each block its distinct words and pairs with their training counts (hot ones weigh nothing);
the task of a block sums them, fills the filter and answers with the levels it probes, and with the
words' exact counts for the base score (words are told apart by 64-bit hashes). The answers meet their
pack again in a second shuffle. Both shuffles are in proportion to the input, no worker holds more than
a block or a pack, and the driver sees only a few totals.

Edge cases: null text is empty and scores its end alone; null or repeated ids are ordinary rows; a row
with a null id is not held out; a very long text is a pack of its own; equal texts score alike (ties
need no order); other columns are not read; with no training text N = V = 0 and the base gives 0; an
empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, prepare, text_of, written

#: What pairs get after a word seen c times: PAIR_WEIGHT x c / (c + PAIR_DOUBT).
PAIR_WEIGHT, PAIR_DOUBT = 0.8, 4.0
#: Training tokens for each block of the filter, and tokens of a pack.
BLOCK_TOKENS, LEAST_BLOCKS, PACK_TOKENS = 1 << 22, 64, 1 << 20
BITS_PER_ENTRY, PROBES = 12, 4
#: The least count of each level: two levels an octave, but none between successive integers.
LEAST = np.unique(np.ceil(2.0 ** (np.arange(96) / 2)))
#: What a count of each level stands for: the middle of its range on the logarithmic scale.
MIDDLE = np.concatenate([[0.0], np.sqrt(LEAST * (np.append(LEAST[1:], 2 * LEAST[-1]) - 1))])
#: The end of a text; no UTF-8 text has this byte.
END = b"\xff"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MEMO = 400_000
_CHUNK = 1 << 17


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words."""
    with np.errstate(over="ignore"):
        k = (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
        k ^= k >> np.uint64(30)
        k *= np.uint64(0xBF58476D1CE4E5B9)
        return k ^ (k >> np.uint64(31))


class LogBloom:
    """Quantised counts in a Bloom filter."""

    def __init__(self, entries: int):
        self.size = max(64, 1 << int(np.ceil(np.log2(max(1, entries) * BITS_PER_ENTRY))))
        self.bits = np.zeros(self.size >> 3, np.uint8)
        self.top = 0

    def _cells(self, keys: np.ndarray, level: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            a = (keys + np.uint64(level)) * np.uint64(0xD6E8FEB86659FD93)
            a ^= a >> np.uint64(32)
            b = (a * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
            b ^= b >> np.uint64(33)
            steps = np.arange(PROBES, dtype=np.uint64)
            return ((a[:, None] + steps * (b[:, None] | np.uint64(1))) & np.uint64(self.size - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray, levels: np.ndarray) -> None:
        self.top = max(self.top, int(levels.max()) if len(levels) else 0)
        flags = np.unpackbits(self.bits, bitorder="little")
        order = np.argsort(levels, kind="stable")[::-1]
        keys = keys[order]
        ends = np.searchsorted(-levels[order], -np.arange(1, self.top + 1), "right")
        for q, end in enumerate(ends.tolist(), 1):
            for at in range(0, end, _CHUNK):
                flags[self._cells(keys[at : min(end, at + _CHUNK)], q).ravel()] = 1
        self.bits = np.packbits(flags, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: 0 if it is not held."""
        out = np.zeros(len(keys), np.int64)
        for begin in range(0, len(keys), _CHUNK):
            part = keys[begin : begin + _CHUNK]
            live = np.arange(len(part))
            for q in range(1, self.top + 1):
                if not len(live):
                    break
                c = self._cells(part[live], q)
                held = ((self.bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1).all(axis=1)
                live = live[held]
                out[begin + live] = q
        return out


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, "right")


def count_of(levels: np.ndarray) -> np.ndarray:
    """What a count of each level stands for, 0 for level 0."""
    return MIDDLE[levels]


def by_block(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys' places in the order of their blocks, and where each block begins in it (and the end)."""
    b = ((keys & np.uint64(0xFFFFFF)) % np.uint64(blocks)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(blocks + 1))


def planes(values: np.ndarray, size: int) -> bytes:
    """The ``size`` low bytes of the values, byte by byte (like ones next to each other, as they compress)."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def unplaned(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return out.view("<u8").ravel()


def tokenised(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All tokens of some texts as an Arrow array, cut out of the joined bytes, and how many each has."""
    data = np.frombuffer(b" " + b"".join([t + b" " + END + b" " for t in texts]), np.uint8)
    ink = ~_BLANK[data]
    edges = np.flatnonzero(ink[1:] != ink[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[ink])])
    return tokens, np.diff(np.flatnonzero(data[begin] == END[0]), prepend=-1)


class Pack:
    """Some texts in coded form: distinct words' hashes, each token's place among them, tokens of each text."""

    def __init__(self, h: np.ndarray, at: np.ndarray, sizes: np.ndarray):
        self.h, self.at, self.sizes = h, at.astype(np.int64), sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        #: Tokens that begin a pair, the distinct pairs' hashes, and each such token's pair among them.
        self.begins = np.flatnonzero(self.doc[:-1] == self.doc[1:])
        codes, self.pair = np.unique(self.at[self.begins] * len(h) + self.at[self.begins + 1], return_inverse=True)
        n = max(len(h), 1)
        self.pairs = pair_keys(h[codes // n], h[codes % n])

    def summed(self, tokens: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, tokens, minlength=len(self.sizes))


class Model:
    """What workers need besides the filter: a few totals."""

    def __init__(self, n: int, held: float, once: int, twice: int):
        #: The share of tokens that new words get, that of one of them, and a held word's for each of its quantised occurrences.
        self.rest = (once + 1) / (n + 2)
        self.new = self.rest / max(1.0, once * (once - 1) / (2 * (twice + 1)))
        self.scale = (1 - self.rest) / held if held else 0.0

    def scores(self, pack: Pack, word_levels: np.ndarray, pair_levels: np.ndarray) -> np.ndarray:
        """log10 probability of each text (its end included)."""
        count = count_of(word_levels)
        p = np.where(count > 0, count * self.scale, self.new)
        before = count[pack.at[pack.begins]]
        joint = np.minimum(count_of(pair_levels)[pack.pair] / np.maximum(before, 1e-9), 1.0)
        weight = PAIR_WEIGHT * before / (before + PAIR_DOUBT)
        each = p[pack.at]
        each[pack.begins + 1] = weight * joint + (1 - weight) * each[pack.begins + 1]
        return pack.summed(np.log10(each))


def coded(docs: DataFrame, training) -> DataFrame:
    """A row for each pack: its texts' ids, sizes and training flags, the words' hashes and the coded tokens."""

    def rows_of(ids, learnt, texts):
        tokens, sizes = tokenised(texts)
        words = tokens.dictionary_encode()
        at = words.indices.to_numpy()
        learnt = np.array(learnt, bool)
        return pd.DataFrame({
            "pack": [uuid.uuid4().hex], "ids": [ids], "n_train": [int(sizes[learnt].sum())], "words": [hashed(words.dictionary.to_pylist()).tobytes()],
            "tokens": [planes(at, 4)], "sizes": [planes(sizes, 5)], "training": [learnt.tobytes()],
        })

    def pack(batches):
        ids, learnt, texts, size = [], [], [], 0
        for pdf in batches:
            for key, train, text in zip(pdf["doc_id"].tolist(), pdf["training"].tolist(), pdf["text"].tolist()):
                ids.append(key)
                learnt.append(train)
                texts.append(text.encode("utf-8", "surrogatepass").translate(_LOWER))
                size += len(texts[-1]) + 6
                if size >= 6 * PACK_TOKENS:
                    yield rows_of(ids, learnt, texts)
                    ids, learnt, texts, size = [], [], [], 0
        if ids:
            yield rows_of(ids, learnt, texts)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    return written(rows.mapInPandas(pack, "pack string, ids array<string>, n_train long, words binary, tokens binary, sizes binary, training binary"), "coded", compression="zstd")


def _unpacked(words: bytes, tokens: bytes, sizes: bytes) -> Pack:
    return Pack(np.frombuffer(words, np.uint64), unplaned(tokens, 4), unplaned(sizes, 5).astype(np.int64))


#: Bytes sent of a key, of a training count in a pack and of a count in the corpus. Words are sent by their whole
#: hashes; of pairs the block is known, which leaves 40 bits.
WORD_BYTES, PAIR_BYTES, TIMES_BYTES, COUNT_BYTES = 8, 5, 4, 6


def asked(packs: DataFrame, blocks: int) -> DataFrame:
    """A row for each pack and block that it has n-grams of: their keys and training counts."""

    def ask(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                pack = _unpacked(row.words, row.tokens, row.sizes)
                learnt = np.frombuffer(row.training, bool)[pack.doc]
                times = np.bincount(pack.at[learnt], minlength=len(pack.h)), np.bincount(pack.pair[learnt[pack.begins]], minlength=len(pack.pairs))
                out: dict = {}
                for kind, keys, c, size in (("word", pack.h, times[0], WORD_BYTES), ("pair", pack.pairs, times[1], PAIR_BYTES)):
                    order, starts = by_block(keys, blocks)
                    sent, c = (keys if size == 8 else keys >> np.uint64(24))[order], c[order]
                    cuts = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
                    out[kind] = [planes(sent[a:b], size) for a, b in cuts]
                    out[f"{kind}_times"] = [planes(c[a:b], TIMES_BYTES) for a, b in cuts]
                frame = pd.DataFrame({"block": np.arange(blocks), "pack": row.pack, **out})
                yield frame[(frame["word"].str.len() > 0) | (frame["pair"].str.len() > 0)]

    return packs.select("pack", "words", "tokens", "sizes", "training").mapInPandas(ask, "block int, pack string, word binary, word_times binary, pair binary, pair_times binary")


def answered(questions: DataFrame) -> DataFrame:
    """Levels and word counts for each question, and (pack null) a row of totals for each block."""

    def answer(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for pdf in pdfs for row in pdf.itertuples(index=False)]
        found = []
        for kind, size in (("word", WORD_BYTES), ("pair", PAIR_BYTES)):
            each = [unplaned(getattr(r, kind), size) for r in rows]
            keys, back = np.unique(np.concatenate(each), return_inverse=True)
            counts = np.bincount(back, np.concatenate([unplaned(getattr(r, f"{kind}_times"), TIMES_BYTES) for r in rows]), minlength=len(keys)).astype(np.int64)
            found.append((keys if kind == "word" else keys ^ np.uint64(1 << 63), counts, back, np.cumsum([len(x) for x in each])[:-1]))
        bloom = LogBloom(int(sum(level_of(counts).sum() for _, counts, _, _ in found)))
        for keys, counts, _, _ in found:
            bloom.insert(keys[counts > 0], level_of(counts[counts > 0]))
        counts = found[0][1]
        yield pd.DataFrame({
            "pack": [None], "block": [int(key[0])], "word": [None], "count": [None], "pair": [None], "types": [int((counts > 0).sum())],
            "once": [int((counts == 1).sum())], "twice": [int((counts == 2).sum())], "held": [float(count_of(level_of(counts)).sum())],
        })
        levels = [np.split(bloom.levels(keys).astype(np.uint8)[back], cuts) for keys, _, back, cuts in found]
        words = np.split(counts[found[0][2]], found[0][3])
        for at in range(0, len(rows), 64):
            some = slice(at, at + 64)
            yield pd.DataFrame({
                "pack": [r.pack for r in rows[some]], "block": int(key[0]), "word": [x.tobytes() for x in levels[0][some]], "count": [planes(x, COUNT_BYTES) for x in words[some]],
                "pair": [x.tobytes() for x in levels[1][some]], "types": 0, "once": 0, "twice": 0, "held": 0.0,
            })

    shape = "pack string, block int, word binary, count binary, pair binary, types long, once long, twice long, held double"
    return written(questions.groupBy("block").applyInPandas(answer, shape), "answers", compression="zstd")


def score(docs: DataFrame, training) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    packs = coded(docs, training)
    n = packs.agg(F.sum("n_train")).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK_TOKENS))
    answers = answered(asked(packs, blocks))
    sums = answers.where("pack is null").agg(F.sum("types").alias("v"), F.sum("once").alias("once"), F.sum("twice").alias("twice"), F.sum("held").alias("held")).first()
    v = sums["v"] or 0
    model = Model(n, sums["held"] or 0.0, sums["once"] or 0, sums["twice"] or 0)

    def finish(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        pack = _unpacked(row["words"], row["tokens"], row["sizes"])
        got = []
        for kind, keys in (("word", pack.h), ("pair", pack.pairs)):
            order, starts = by_block(keys, blocks)
            levels, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for b, q, c in zip(right["block"], right[kind], right["count"]):
                levels[order[starts[b] : starts[b + 1]]] = np.frombuffer(q, np.uint8)
                if kind == "word":
                    counts[order[starts[b] : starts[b + 1]]] = unplaned(c, COUNT_BYTES)
            got.append((levels, counts))
        (word_levels, counts), (pair_levels, _) = got
        return pd.DataFrame({
            "doc_id": row["ids"], "n_tokens": pack.sizes, "n_known": pack.summed((counts > 0)[pack.at]).astype(np.int64), "base": pack.summed(np.log10(counts + 1.0)[pack.at]),
            "score": model.scores(pack, word_levels, pair_levels),
        })

    left, right = packs.select("pack", "ids", "words", "tokens", "sizes").groupBy("pack"), answers.where("pack is not null").select("pack", "block", "word", "count", "pair").groupBy("pack")
    out = left.cogroup(right).applyInPandas(finish, "doc_id string, n_tokens long, n_known long, base double, score double")
    each = float(np.log10(n + v + 1)) if n else 0.0  # N + 1 * (V + 1)
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score")


def query(docs: DataFrame) -> DataFrame:
    out = score(docs, fold(7) != 2)
    return out.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
