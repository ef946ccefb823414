"""Phrase collocation mining by hashed bucket counts (PCY, DHP) and Apriori pruning, per language.

Pass n over the texts counts the n-grams that may be frequent and, in the same pass, adds every (n+1)-gram that
may follow to one of 2^bits buckets. Before pass n + 1 the workers get three kinds of bitmaps: the buckets that
reached ``min_count``, and for each shorter length the hashes of the phrases that did (Apriori: all parts of a
frequent phrase are frequent). Both only ever let too much through, so that what is counted is counted exactly,
by its words and not by hashes.

A task cuts its texts into chunks of ``CHUNK`` bytes, numbers the words of a chunk and counts n-grams with numpy;
what leaves a task is a row for each distinct phrase of a chunk and, for the buckets, packed pairs (place, count
up to 255) for each block of ``WIDTH`` buckets. Block counts are summed as a sorted stream, a block at a time. A
pass's table is dropped as soon as its counts are summed. Ranks are taken inside hash parts of a language first, so the last
window reads at most ``RANK_PARTS`` x ``top`` rows of one.

Bounds: a bitmap takes 2^bits / 8 bytes; ``bits`` follows the bytes of all texts (a bucket for 8 bytes) up to
``MAX_BITS`` (256 MB a bitmap). Beyond that buckets are shared by more n-grams, more of them are counted, and the
result stays the same. A task holds one chunk, or one piece of a text (between two punctuation marks) where that is longer.

Scores are exact: products are decimals of 38 digits, which a^2 * 1000000 fits up to a = 10^16.

Edge cases: null text counts as empty and null lang as ``und`` (one language with texts marked so); repeated rows
and ids count each time; ties end with the phrase in UTF-8 byte order; a word may be any character but space and
tab, so also a lone symbol; very long texts are cut at piece boundaries only, so no phrase is lost; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, prepare, scratch, written

MAX_WORDS = 3
MIN_COUNT = 10
#: A phrase goes if a longer candidate around it has this share (percent) of its occurrences.
COVERED = 50
TOP = 2000
#: Bytes of text that a task counts at a time.
CHUNK = 16 << 20
#: Bytes that are words of their own at a time; the rest of a chunk is held as numbers.
SLICE = 1 << 20
#: Buckets of a block: a place takes two bytes.
WIDTH = 1 << 16
RANK_PARTS = 64
MIN_BITS, MAX_BITS = 16, 31
#: Piece ends: ``.,;:!?``, line feed, vertical tab, form feed, carriage return.
ENDS = bytes.maketrans(b".,;:!?\n\v\f\r", b"." * 10)
OUT = "lang string, phrase string, n long, block int, places binary, counts binary"
SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("block", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Bitmap:
    """Membership of 64-bit hashes by their first ``bits`` bits."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def __contains__(self, hashed: int) -> bool:
        return bool(self.of(np.array([hashed], np.uint64))[0])

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def follow(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of the first words and of the last word."""
    x = (first * _ODD) ^ last
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    salt = lang.encode() + b"\0"
    return np.array([xxhash.xxh3_64_intdigest(salt + w) for w in words], np.uint64)


def cut(text: bytes, limit: int) -> Iterator[bytes]:
    """Parts of about ``limit`` bytes, cut at piece ends. text: with ``.`` at all piece ends."""
    begin = 0
    while len(text) - begin > limit:
        at = text.rfind(b".", begin, begin + limit)
        at = at if at >= 0 else text.find(b".", begin + limit)
        if at < 0:
            break
        yield text[begin : at + 1]
        begin = at + 1
    yield text[begin:]


def chunks(batches, limit: int = CHUNK) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, parts of texts), parts of all languages together up to about ``limit`` bytes."""
    held, size = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            for part in cut(text.lower().translate(ENDS), min(limit, SLICE)):
                held[lang].append(part)
                size += len(part)
                if size >= limit:
                    for k in list(held):
                        yield k, held.pop(k)
                    size = 0
    yield from held.items()


class Grams:
    """The n-grams of one chunk. words: by number, 0 is a piece end; ids: the chunk's numbers in order."""

    def __init__(self, lang: str, parts: list[bytes]):
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        numbers[b"."]
        ids, held, size = [], [], 0
        for k, part in enumerate(parts, 1):
            held.append(part)
            size += len(part)
            if size >= SLICE or k == len(parts):
                tokens = b".".join(held).replace(b".", b" . ").split()
                ids.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                ids.append(np.zeros(1, np.int32))
                held, size = [], 0
        self.ids = np.concatenate(ids)
        self.words = list(numbers)
        hashes = word_hashes(lang, self.words)
        counts = np.bincount(self.ids, minlength=len(self.words))
        # level 1: number, hash and count of each distinct gram, the gram that begins at each place (-1: none)
        self.n, self.parts = 1, [np.arange(len(self.words))]
        self.word_hashes, self.hashes, self.counts = hashes, hashes, counts
        self.at = np.where(self.ids == 0, np.int32(-1), self.ids)

    def keep(self, marks: np.ndarray) -> None:
        """Grams not marked are taken out of all places."""
        if len(marks):
            self.at = np.where((self.at >= 0) & marks[self.at], self.at, np.int32(-1))

    def longer(self) -> None:
        """To the grams that are one word longer, both of whose parts are still there."""
        V = len(self.words)
        here = np.flatnonzero((self.at[:-1] >= 0) & (self.at[1:] >= 0))
        found, back, counts = np.unique(self.at[here].astype(np.int64) * V + self.ids[here + self.n], return_inverse=True, return_counts=True)
        at = np.full(max(len(self.at) - 1, 0), -1, np.int32)
        at[here] = back
        before, last = found // V, found % V
        self.hashes = follow(self.hashes[before], self.word_hashes[last])
        self.parts = [p[before] for p in self.parts] + [last]
        self.at, self.counts, self.n = at, counts, self.n + 1

    def texts(self, which: np.ndarray) -> list[bytes]:
        w = self.words
        return [b" ".join(x) for x in zip(*([w[k] for k in p[which].tolist()] for p in self.parts))]


def pack(hashes: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, places, counts up to 255) of each block."""
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at, counts = at[order], np.minimum(counts[order], 255).astype(np.uint8)
    block, places = at // WIDTH, (at % WIDTH).astype("<u2")
    ends = np.flatnonzero(np.diff(block, append=-1)) + 1 if len(block) else []
    begin = 0
    for end in ends:
        yield int(block[begin]), places[begin:end].tobytes(), counts[begin:end].tobytes()
        begin = end


def count_pass(n: int, longest: int, bits: int, frequent: list, buckets):
    """mapInArrow function of pass n. frequent: broadcast bitmaps of the frequent phrases of 1, 2, ... words;
    buckets: that of the n-grams' buckets (None in pass 1)."""

    def run(batches):
        known = [Bitmap(bits, np.frombuffer(b.value, np.uint8)) for b in frequent]
        marked = Bitmap(bits, np.frombuffer(buckets.value, np.uint8)) if buckets is not None else None
        for lang, parts in chunks(batches):
            grams = Grams(lang, parts)
            for shorter in known:
                grams.keep(shorter.of(grams.hashes))
                grams.longer()
            which = np.arange(1, len(grams.words)) if n == 1 else np.flatnonzero(marked.of(grams.hashes))
            if not len(which):
                continue
            yield pa.record_batch([pa.array([lang] * len(which)), pa.array(grams.texts(which), pa.binary()).cast(pa.string()), pa.array(grams.counts[which]), *[pa.nulls(len(which), t) for t in (pa.int32(), pa.binary(), pa.binary())]], schema=SCHEMA)
            if n < longest:
                if n > 1:
                    grams.keep(marked.of(grams.hashes))
                grams.longer()
                if rows := list(pack(grams.hashes, grams.counts, bits)):
                    block, places, counts = zip(*rows)
                    yield pa.record_batch([*[pa.nulls(len(rows), t) for t in (pa.string(), pa.string(), pa.int64())], pa.array(block, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], schema=SCHEMA)

    return run


def bitmap(packed: DataFrame, bits: int, least: int):
    """Broadcast bitmap of the places whose counts sum up to ``least``. packed: (block, places, counts)."""

    def total(batches):
        now, sums, held, size = None, np.zeros(WIDTH, np.int64), [], 0

        def added():
            nonlocal held, size
            if held:
                places, counts = (b"".join(x) for x in zip(*held))
                sums[:] += np.bincount(np.frombuffer(places, "<u2"), np.frombuffer(counts, np.uint8), WIDTH).astype(np.int64)
            held, size = [], 0
            return sums

        for batch in batches:
            for block, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if now not in (None, block):
                    yield now, added()
                    sums = np.zeros(WIDTH, np.int64)
                now = block
                held.append((places, counts))
                size += len(counts)
                if size >= SLICE:
                    added()
        if now is not None:
            yield now, added()

    def run(batches):
        for block, sums in total(batches):
            marks = np.packbits(sums >= least, bitorder="little").tobytes()
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([marks], pa.binary())], names=["block", "marks"])

    # the sums are taken by all tasks at once and written; a local iterator over them would run one task after another
    rows = written(packed.select("block", "places", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, marks binary"), "phrasemarks", compression="zstd")
    whole = bytearray((1 << bits) // 8)
    for block, marks in rows.toLocalIterator(prefetchPartitions=True):
        whole[block * (WIDTH // 8) : (block + 1) * (WIDTH // 8)] = marks
    return packed.sparkSession.sparkContext.broadcast(bytes(whole))


def hashes_packed(frequent: DataFrame, bits: int) -> DataFrame:
    """(block, places, counts) with a count of 1 for each phrase's hash."""

    def run(batches):
        for batch in batches:
            groups = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                groups[lang].append(phrase.split(b" "))
            for lang, split in groups.items():
                hashes, *more = (word_hashes(lang, list(w)) for w in zip(*split))
                for last in more:
                    hashes = follow(hashes, last)
                rows = zip(*pack(hashes, np.ones(len(hashes), np.int64), bits))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.binary(), pa.binary()))], names=["block", "places", "counts"])

    return frequent.select("lang", "phrase").mapInArrow(run, "block int, places binary, counts binary")


def table_bits(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(MAX_BITS, max(MIN_BITS, (size // 8).bit_length()))


def counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, bits: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(n of each lang, [frequent phrases of 1, 2, ... words with lang, phrase, f]); tables in the scratch block around."""
    bits = bits or table_bits(docs)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sums, levels, known, buckets, sent = None, [], [], None, []
    for n in range(1, max_words + 1):
        path = fresh_path(docs.sparkSession, "phrasepass")
        texts.mapInArrow(count_pass(n, max_words, bits, list(known), buckets), OUT).write.option("compression", "zstd").parquet(path)
        rows = docs.sparkSession.read.schema(OUT).parquet(path)
        phrases = rows.where("block IS NULL")
        if n == 1:
            sums = written(phrases.groupBy("lang").agg(F.sum("n").alias("n")), "phrasesums")
        level = phrases.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        levels.append(written(level, "phrases"))
        if n < max_words:
            known.append(bitmap(hashes_packed(levels[-1], bits), bits, 1))
            buckets = bitmap(rows.where("block IS NOT NULL"), bits, min_count)
            sent += [known[-1], buckets]
        drop_path(docs.sparkSession, path)
    for b in sent:
        b.unpersist()
    return sums, levels


def mine(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, covered: int = COVERED, top: int | None = TOP, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best phrases (all with ``top=None``)."""
    spark = prepare(docs.sparkSession)
    with scratch(spark):
        sums, levels = counts(docs, max_words, min_count, bits)
        found = []
        for n in range(2, max_words + 1):
            rows = levels[n - 1].withColumn("w", F.split("phrase", " ")).withColumnRenamed("f", "a")
            for k in range(1, n):
                first, rest = levels[k - 1], levels[n - k - 1]
                rows = rows.withColumn("first", F.array_join(F.slice("w", 1, k), " ")).withColumn("rest", F.array_join(F.slice("w", k + 1, n - k), " "))
                rows = rows.join(first.select("lang", F.col("phrase").alias("first"), F.col("f").alias(f"l{k}")), ["lang", "first"])
                rows = rows.join(rest.select("lang", F.col("phrase").alias("rest"), F.col("f").alias(f"r{k}")), ["lang", "rest"])
                wide = [F.col(c).cast("decimal(19,0)") for c in ("a", f"l{k}", f"r{k}")]
                rows = rows.withColumn("_top", wide[0] * wide[0] * F.lit(1000000).cast("decimal(7,0)")).withColumn("_under", wide[1] * wide[2])
                rows = rows.withColumn(f"s{k}", F.expr("_top div _under"))
            best = F.array_min(F.array(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, n)]))
            found.append(rows.select("lang", "phrase", "a", best.alias("b"), "w").select("lang", "phrase", "a", "b.l", "b.r", "b.score", "w"))
        every = reduce(DataFrame.unionByName, found)
        # what stands inside longer candidates: their parts of 2 words and more
        inside = []
        for n in range(3, max_words + 1):
            for m in range(2, n):
                parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n - m + 1)), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, F.lit(m)), " ")))
                inside.append(levels[n - 1].select("lang", F.explode(parts).alias("phrase"), "f"))
        if inside:
            around = reduce(DataFrame.unionByName, inside).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
            every = every.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * covered))
        order = (F.desc("score"), F.desc("a"), "phrase")
        if top is not None:
            part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
            every = every.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
        return written(ranked.join(sums, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)


def query(docs: DataFrame) -> DataFrame:
    return mine(docs)


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS s(m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
sums AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
halves AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
cuts AS (SELECT h.lang, h.phrase, h.a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * h.a * h.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.first JOIN f y ON y.lang = h.lang AND y.phrase = h.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, part, max(a) AS f FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS part FROM c WHERE m = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.part = b.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sums USING (lang) WHERE rank <= 2000
"""
