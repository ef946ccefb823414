"""Token-ID / binary output with Elias-Fano document boundaries.

Documents are range-partitioned by id, so chunk files follow each other in ascending id order.
A chunk is a bounded run of documents: ids concatenated in one array (16 or 32 bits each), the
documents' end offsets as an Elias-Fano sequence, and the document ids (ascending, so another such
sequence, from the first id on). Offsets are read back by select on the sequence itself. Chunks are stored as rows
(part, seq, blob) of a Parquet table in the shared folder: Spark's commit protocol then makes a
lost executor harmless, and any store that Spark can write will do.

Chunk layout, little-endian: ``MSTB``, u8 version, u8 id width, u64 n_docs, u64 n_ids, u64 documents
without an id (they come first), i64 first id, u64 lengths of the two sequences, the sequences of end
offsets and of ids less the first one, ids. A sequence: u64 n, u8 low bits, u64 lengths of its three
parts, low bits, high bits in unary, u32 place of every 64th one among the high bits.

Speed: most texts are split at single spaces and newlines between non-spaces, where the tokenizer
always starts a new piece; each distinct chunk of text is encoded once by the library and remembered in a bounded
memo. Texts that hold a special token go to the library whole.

Edge cases: null and empty texts are encoded as the end id alone; null ids sort first; null or repeated
ids keep all their rows, ordered (and dealt over tasks) by input split, then by content hash; a very long text makes a chunk
larger than the bound; other columns are not read; an empty table gives no chunks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, prepare, takes_over, text_of

END_ID = 0
#: A chunk is closed at this many ids (it may exceed it by one document).
CHUNK_IDS = 1 << 21
#: Distinct text chunks that a worker remembers.
MEMO_ENTRIES = 700_000
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of n integers up to u in about n * (2 + log2(u / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        bits = max(0, int(np.log2(max(1.0, float(v[-1]) / n))))
        ones = (v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones.astype(np.int64)] = 1
        low = np.zeros(0, np.uint8)
        if bits:
            low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value: from the sampled one-bit before it, count on to its own."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) & (0xFF << (at & 7))
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = (byte << 3) + (word & -word).bit_length() - 1
        p = i * self.low_bits
        window = int.from_bytes(self.low[p >> 3 : (p + self.low_bits + 7) >> 3].tobytes(), "little") >> (p & 7)
        return (one - i) << self.low_bits | window & ((1 << self.low_bits) - 1)

    def decode(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            b = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (b.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b, c = struct.unpack_from("<QBQQQ", data)
        at = struct.calcsize("<QBQQQ")
        return cls(n, bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", c, at + a + b))


_HEAD = "<BBQQQqQQ"


def pack(doc_ids: list, lengths: list[int], ids: bytes) -> bytes:
    """One chunk from ascending document ids (None first), token counts and all ids as u32."""
    wide = np.frombuffer(ids, "<u4")
    width = 2 if not len(wide) or int(wide.max()) < 1 << 16 else 4
    bounds = EliasFano.encode(np.cumsum(lengths)).to_bytes()
    nulls = sum(d is None for d in doc_ids)
    first = doc_ids[nulls] if nulls < len(doc_ids) else 0
    keys = EliasFano.encode([d - first for d in doc_ids[nulls:]]).to_bytes()
    return b"MSTB" + struct.pack(_HEAD, 2, width, len(doc_ids), len(wide), nulls, first, len(bounds), len(keys)) + bounds + keys + wide.astype(f"<u{width}").tobytes()


def unpack(blob: bytes) -> tuple[list, EliasFano, np.ndarray]:
    """Document ids, end offsets and ids of a chunk."""
    if blob[:4] != b"MSTB":
        raise ValueError("not a token chunk")
    _, width, docs, n, nulls, first, a, b = struct.unpack_from(_HEAD, blob, 4)
    at = 4 + struct.calcsize(_HEAD)
    bounds, keys = EliasFano.from_bytes(blob[at : at + a]), EliasFano.from_bytes(blob[at + a : at + a + b])
    return [None] * nulls + [first + k for k in keys.decode().tolist()], bounds, np.frombuffer(blob, f"<u{width}", n, at + a + b)


class Encoder:
    """The tokenizers library behind a memo of text chunks.

    Chunks are marked by what stands before them: NEW at the start of a text, LINE after a newline, no mark
    after a space. Splitting, and finding the different chunks of a batch, is done by Arrow."""

    NEW, LINE = "\x01", "\x00"
    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.marks = {c: self.whole(c) for c in _STOPS}
        self.newline = self.whole("\n")
        self.newline_id = int.from_bytes(self.newline[:4], "little")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.bytelevel = [x.id for x in self.model.tokenize("\u0120the")] == self.tokenizer.encode(" the", add_special_tokens=False).ids
        self.splits = '"ByteLevel"' in str(self.tokenizer.pre_tokenizer.__getstate__()) and self.tokenizer.normalizer is None

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as u32 bytes."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        for k, t in enumerate(texts):
            if not self.splits or any(x in t for x in self.special) or self.NEW in t or self.LINE in t:
                out[k] = self.whole(t)
            elif t and len(t.split()) == t.count(" ") + t.count("\n") + 1:
                plain.append(k)
            elif t:  # white space beside white space: split at the single spaces only
                parts = _SPACE.split(t)
                parts[0] = self.NEW + parts[0]
                out[k] = b"".join(self.ids_of(parts))
        if plain:
            lists = pc.split_pattern(pa.array([self.NEW + texts[k].replace("\n", " " + self.LINE) for k in plain], pa.large_string()), " ")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            chunks = lists.flatten().dictionary_encode()
            del lists
            known, index = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
            del chunks
            vals = self.ids_of(known)
            size = np.fromiter(map(len, vals), np.int64, len(vals)) // 4
            begin = np.cumsum(size) - size
            lengths = size[index]
            ends = np.cumsum(lengths)
            bounds = np.concatenate([[0], ends])[offsets]
            at = np.repeat(begin[index] - (ends - lengths), lengths)
            at += np.arange(len(at))
            ids = np.frombuffer(b"".join(vals), "<u4")[at]
            del at
            for k, x, y in zip(plain, bounds.tolist(), bounds[1:].tolist()):
                out[k] = ids[x:y].tobytes()
        if len(self.memo) > MEMO_ENTRIES:  # what these texts use is kept
            self.memo = dict(zip(known, vals)) if plain else {}
        return out

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        vals = list(map(self.memo.get, chunks))
        fresh = {c for c, v in zip(chunks, vals) if v is None}
        if not fresh:
            return vals
        self.learn(fresh)
        return [self.memo[c] if v is None else v for c, v in zip(chunks, vals)]

    def learn(self, fresh: set[str]) -> None:
        """Encode chunks: those without white space many at a time, between newlines, each a piece of its
        own; a comma or full stop after a letter is a piece of its own too."""
        memo, new, line, tokenize = self.memo, self.NEW, self.LINE, self.model.tokenize
        tails, other = [], set()
        for c in fresh:
            if c[-1:] in _STOPS and c[-2:-1].isalpha():
                tails.append(c)
                c = c[:-1]
                if c in memo:
                    continue
            head = c[:1] == new or c[:1] == line
            word = c[1:] if head else c
            if not self.bytelevel or not word.isalpha() or not (word.isascii() or max(word) < "\u0250"):
                if word and _ANY.search(word) is None:
                    other.add(c)
                continue
            # a word of letters is one piece: straight to the library's merge model
            shown = ("" if head else "\u0120") + (word if word.isascii() else "".join(map(_PIECES.__getitem__, word)))
            ids = array("I", [x.id for x in tokenize(shown)]).tobytes()
            memo[c] = self.newline + ids if c[0] == line else ids
        plain = list(other)
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            joined = "\n".join([c[1:] if c[0] == new or c[0] == line else " " + c for c in part])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.newline_id)
            if len(ends) != len(part) - 1:
                raise ValueError("the tokenizer joins pieces across newlines")
            data, bounds = ids.tobytes(), [-4, *(4 * ends).tolist(), 4 * len(ids)]
            for c, a, b in zip(part, bounds, bounds[1:]):
                memo[c] = self.newline + data[a + 4 : b] if c[0] == line else data[a + 4 : b]
        for c in tails:
            if (stem := memo.get(c[:-1])) is not None:
                memo[c] = stem + self.marks[c[-1]]
        for c in fresh - memo.keys():
            memo[c] = self.newline + self.whole(c[1:]) if c[:1] == line else self.whole(c[1:] if c[:1] == new else " " + c)


#: How a byte-level model shows bytes: printable Latin-1 as itself, the others from U+0100 on.
_SHOWN = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: The same for the characters up to U+024F, whose UTF-8 bytes may be two.
_PIECES = {chr(c): "".join(_SHOWN.get(b, chr(b)) for b in chr(c).encode()) for c in range(0x250)}
_ANY = re.compile(r"\s")
#: Marks that are a piece of their own after a letter.
_STOPS = (",", ".")
_SPACE = re.compile(r"(?<=\S) (?=\S)")


def gathered(batches, chars: int = 8 << 20):
    """Join Arrow batches up to some characters of text: the larger, the fewer different chunks."""
    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += int(pdf["text"].str.len().sum())
        if size >= chars:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def write(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS) -> str:
    """Encode ``docs`` and write the chunk table; returns its path."""
    spark = prepare(docs.sparkSession)
    path = path or fresh_path(spark, "tokens")
    end = struct.pack("<I", end_id)

    def chunks(batches):
        from pyspark import TaskContext

        takes_over("tokenbin", Encoder._loaded.clear)
        part, seq = TaskContext.get().partitionId(), 0
        encoder = Encoder.at(tokenizer_path)
        keys: list = []
        lengths: list[int] = []
        held: list[bytes] = []
        size = 0
        for pdf in gathered(batches):
            texts = pdf["text"].tolist()
            for key, null, ids in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), encoder.encode(texts)):
                keys.append(None if null else int(key))
                lengths.append(len(ids) // 4 + 1)
                held += [ids, end]
                size += lengths[-1]
                if size >= chunk_ids:
                    yield pd.DataFrame({"part": [part], "seq": [seq], "n_ids": [size], "blob": [pack(keys, lengths, b"".join(held))]})
                    keys, lengths, held, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield pd.DataFrame({"part": [part], "seq": [seq], "n_ids": [size], "blob": [pack(keys, lengths, b"".join(held))]})

    # null or repeated ids are dealt over tasks by the split they come from, which a task run again shares
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.spark_partition_id().alias("split"))
    order = F.col("doc_id").asc_nulls_first(), F.col("split")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.xxhash64("text"))
    ranged = ranged.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    out = ranged.mapInPandas(chunks, "part int, seq int, n_ids long, blob binary")
    out.write.option("compression", "zstd").parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """Read a chunk table back: doc_id, start, n_tokens, ids_crc32 of every document."""
    table = spark.read.schema("part int, seq int, n_ids long, blob binary").parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("part_start"))
    at = table.select("part", "seq", "n_ids")
    at = at.withColumn("start", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))
    at = at.join(parts, "part").select("part", "seq", (F.col("start") + F.col("part_start")).alias("chunk_start"))

    def documents(batches):
        takes_over("tokenbin", Encoder._loaded.clear)
        for pdf in batches:
            for part, seq, blob in zip(pdf["part"], pdf["seq"], pdf["blob"]):
                keys, bounds, ids = unpack(blob)
                ends = np.array([bounds.select(i) for i in range(len(keys))], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                wide = ids.astype("<u4").tobytes()
                yield pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "part": part, "seq": seq, "offset": starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts, ends)]})

    docs = table.select("part", "seq", "blob").mapInPandas(documents, "doc_id long, part int, seq int, offset long, n_tokens long, ids_crc32 long")
    return docs.join(at, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("chunk_start")).alias("start"), "n_tokens", "ids_crc32")


def query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = write(docs, tokenizer_path)
    return read(docs.sparkSession, path)
