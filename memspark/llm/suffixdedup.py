"""Exact removal of repeated passages with per-shard suffix arrays.

Every byte covered by a string of ``LENGTH`` (400) bytes that also starts anywhere else, in another
text or in the same one, is removed; strings are judged on the input and never cross texts.

1. Equal texts are collapsed (a text with copies repeats as a whole).
2. Winnowing picks, in every stretch of 400 bytes, the 64-byte gram of least hash; equal stretches pick
   equal grams. Around each picked gram lies its neighbourhood, which holds every 400-byte string
   that picks it. Only (gram hash, neighbourhood hash, text, place) rows are shuffled, and
   counted with partial aggregation.
3. A neighbourhood that occurs twice is repeated throughout. Where a gram has several different
   neighbourhoods, one of each is cut from its text, and those that share no 358 bytes around the gram
   with another are set aside; the others are packed into shards by gram, a shard's
   suffix array is built by Larsson-Sadakane refinement in numpy, common prefixes come from Kasai's
   rule, and runs with a common prefix of 400 bytes are the repeated strings. A group larger than a
   shard is cut into several shards, merged by binary search of each one's suffixes in the others.
   A group beyond ``GROUP`` neighbourhoods is merged by a 128-bit hash of each 400-byte string
   instead, which is as exact and has no hot task.
4. Repeated stretches go back to all places of their neighbourhood and are united in each text.

Passages of over 50 words may be shorter than 400 bytes. ``shared_passages`` counts for each text the
runs of 26 words, picked by winnowing so that every 51 words hold one, that another text (or a copy)
picks too; the query reports the count beside the contract's columns.

Edge cases: null text is empty; texts under 400 bytes lose nothing; null or repeated ids are ordinary
rows (a repeated row is a repeated text); equal strings have no order, all of them go; a very long text
is read in blocks of 1 MB; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, scratch, text_of, written
from .lmscore import END, hashed, tokenised

LENGTH, GRAM = 400, 64
SHARD = 2 << 20
#: Different neighbourhoods of a gram that one task merges by suffix arrays.
GROUP = 8192
#: Words of a fingerprint, and words of which every run holds one.
PASSAGE_GRAM, PASSAGE = 26, 51
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _BLOCK + LENGTH), _powers(_BACK, _BLOCK + LENGTH)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of each ``size`` bytes of at most a block."""
    with np.errstate(over="ignore"):
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _DOWN[: len(data)], out=s[1:])
        h = (s[size:] - s[:-size]) * _UP[: len(data) - size + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def winnowed(v: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` successive values the place of the least; the low 21 bits of a value are its place."""
    padded = np.full(-(-len(v) // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - width + 1
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0x1FFFFF)).astype(np.int64)


def _marked(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFFFFE00000)) | np.arange(len(h), dtype=np.uint64)


def picked(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the grams picked by the strings of ``data``, and the first and last string
    that picks each (every string picks one: the leftmost of least hash in it)."""
    places, hashes, firsts, lasts = [], [], [], []
    for begin in range(0, len(data) - length + 1, _BLOCK - length + 1):
        part = np.frombuffer(data, np.uint8)[begin : begin + _BLOCK]
        h = gram_hashes(part, gram)
        chosen = winnowed(_marked(h), length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        at = chosen[first]
        places.append(at + begin)
        hashes.append(h[at])
        firsts.append(first + begin)
        lasts.append(np.append(first[1:], len(chosen)) - 1 + begin)
    if not places:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    return tuple(np.concatenate(x) for x in (places, hashes, firsts, lasts))


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of each ``size`` successive hashes, put together from runs of doubling length."""
    out, done, power, k = None, 0, h, 1
    while True:
        if size & k:
            if out is None:
                out = power
            else:
                n = len(h) - done - k + 1
                out = out[:n] * np.uint64(pow(_BASE, k, 1 << 64)) + power[done : done + n]
            done += k
        if done == size:
            return out.copy()
        power = power[:-k] * np.uint64(pow(_BASE, k, 1 << 64)) + power[k:]
        k *= 2


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of the runs of ``PASSAGE_GRAM`` words picked in some texts."""
    out_text, out_hash = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    tokens, sizes = tokenised([_bytes(t) for t in texts])
    words = tokens.dictionary_encode()
    h = hashed(words.dictionary.to_pylist())[words.indices.to_numpy()]
    text = np.repeat(np.arange(len(texts)), sizes)
    last = np.flatnonzero(h == hashed([END])[0])
    width, step = PASSAGE - PASSAGE_GRAM + 1, 1 << 20
    for begin in range(0, len(h) - PASSAGE + 1, step):
        part = h[begin : begin + step + PASSAGE - 1]
        with np.errstate(over="ignore"):
            g = _runs(part, PASSAGE_GRAM)
            g ^= g >> np.uint64(29)
            g *= np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(32)
        chosen = np.unique(winnowed(_marked(g), width))
        whole = np.searchsorted(last, chosen + begin) == np.searchsorted(last, chosen + begin + PASSAGE_GRAM)  # no end inside
        chosen = chosen[whole]
        out_text.append(text[chosen + begin])
        out_hash.append(g[chosen])
    return np.concatenate(out_text), np.concatenate(out_hash)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions in order of their suffixes, by Larsson-Sadakane refinement: ranks double their reach,
    sorted groups are left alone."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = data.astype(np.uint64) + np.uint64(0)
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven bytes and how many of them there are
        key = (key << np.uint64(8)) | wide[k : n + k]
    key = (key << np.uint64(8)) | np.minimum(np.uint64(7), np.arange(n, 0, -1).astype(np.uint64))
    sa = np.argsort(key)
    new = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    reach = 7
    while True:
        single = new & np.concatenate([new[1:], [True]])
        todo = np.flatnonzero(~single)
        if not len(todo):
            break
        at = sa[todo]
        ahead = at + reach
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[at]
        both = group * (n + 1) + second + 1  # groups of the array are in order, so one sort does for all
        order = np.argsort(both)
        sa[todo] = at[order]
        both = both[order]
        starts = np.concatenate([[True], both[1:] != both[:-1]])
        new[todo] = starts
        rank[sa[todo]] = np.maximum.accumulate(np.where(starts, todo, 0))
        reach *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int = LENGTH, step: int = 16) -> np.ndarray:
    """Common prefix, up to ``cap``, of each suffix of the array with the one before it. Kasai's rule
    (at the next place of the text at most one byte is lost) gives every ``step``-th place in turn and
    bounds the places between, which numpy then completes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    raw = data.tobytes()
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    prefix = np.zeros(n, np.int64)
    l = 0
    for i in range(0, n, step):
        j = int(before[i])
        l = max(0, l - step)
        if j < 0:
            l = 0
            continue
        while l < cap:
            x, y = raw[i + l : i + l + 64], raw[j + l : j + l + 64]
            if x == y and len(x) == 64:
                l += 64
                continue
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "little") ^ int.from_bytes(y[:m], "little")
            l += ((d & -d).bit_length() - 1) // 8 if d else m
            break
        l = min(l, cap)
        prefix[i] = l
    at = np.arange(n)
    prefix = np.maximum(prefix[at // step * step] - at % step, 0)
    prefix[before < 0] = 0
    padded = np.concatenate([data, np.zeros(cap + 16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(), (n + cap + 8, 8), (1, 1))
    live = np.flatnonzero((before >= 0) & (prefix < cap))
    while len(live):
        i, j = live + prefix[live], before[live] + prefix[live]
        ok = (i < n) & (j < n)
        live, i, j = live[ok], i[ok], j[ok]
        x = words[i].view("<u8").ravel() ^ words[j].view("<u8").ravel()
        same = np.full(len(x), 8)
        odd = x != 0
        same[odd] = np.log2((x[odd] & (~x[odd] + np.uint64(1))).astype(np.float64)).astype(np.int64) // 8
        room = n - np.maximum(i, j)
        prefix[live] += np.minimum(same, room)
        live = live[(same == 8) & (room > 8) & (prefix[live] < cap)]
    return np.minimum(prefix, cap)[sa]


class Shard:
    """Neighbourhoods side by side, with their suffix array and runs of equal strings."""

    def __init__(self, slices: list[bytes], length: int = LENGTH):
        self.length = length
        self.data = np.frombuffer(b"\xff".join(slices) + b"\xff", np.uint8)  # no UTF-8 text has 0xFF
        sizes = np.array([len(s) for s in slices], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.slice = np.repeat(np.arange(len(slices), dtype=np.int32), sizes + 1)
        self.offset = (np.arange(len(self.data)) - self.starts[self.slice]).astype(np.int32)
        self.whole = self.offset + length <= sizes[self.slice]
        sa = suffix_array(self.data)  # in full: Kasai's rule needs the order of ties too
        self.runs = np.cumsum(common_prefixes(self.data, sa, length) < length, dtype=np.int32)
        self.sa = sa.astype(np.int32)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of whole strings in suffix order, number of the run of equal strings of each)."""
        ok = self.whole[self.sa]
        return self.sa[ok], self.runs[ok]

    def search(self, other: Shard, places: np.ndarray) -> np.ndarray:
        """For strings of ``other``, the place here of an equal one or -1, by binary search."""
        at, _ = self.windows()
        if not len(at) or not len(places):
            return np.full(len(places), -1)
        lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(at))
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            less = _less(self.data, at[mid], other.data, places[live], self.length)
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        inside = lo < len(at)
        found = np.full(len(places), -1)
        cand = at[np.minimum(lo, len(at) - 1)]
        same = inside & ~_less(self.data, cand, other.data, places, self.length) & ~_less(other.data, places, self.data, cand, self.length)
        found[same] = cand[same]
        return found


def _less(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Is the string of ``length`` at i in a before that at j in b?"""
    out, live = np.zeros(len(i), bool), np.arange(len(i))
    for k in range(0, length, 8):
        size = min(8, length - k)
        x, y = np.zeros(len(live), np.uint64), np.zeros(len(live), np.uint64)
        for m in range(size):
            x = (x << np.uint64(8)) | a[i[live] + k + m]
            y = (y << np.uint64(8)) | b[j[live] + k + m]
        out[live] = x < y
        live = live[x == y]
        if not len(live):
            break
    return out


def repeated_windows(slices: list[bytes], origin: np.ndarray, twice: np.ndarray, shard_bytes: int = SHARD, length: int = LENGTH) -> list[np.ndarray]:
    """For each slice the offsets of its strings that start elsewhere too. ``origin`` is each slice's
    absolute place (slices that overlap in a text share places); ``twice`` says that it occurs at other places."""
    shards, members, held, size = [], [], [], 0
    for k, s in enumerate(slices):
        held.append(k)
        size += len(s) + 1
        if size >= shard_bytes or k == len(slices) - 1:
            shards.append(Shard([slices[x] for x in held], length))
            members.append(np.array(held))
            held, size = [], 0
    out: list[list[np.ndarray]] = [[] for _ in slices]
    for a, (shard, own) in enumerate(zip(shards, members)):
        at, run = shard.windows()
        if not len(at):
            continue
        owner = own[shard.slice[at]]
        place = origin[owner] + shard.offset[at]
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        counts = np.diff(np.append(first, len(run)))
        low, high = np.minimum.reduceat(place, first), np.maximum.reduceat(place, first)
        many = (low != high) | np.logical_or.reduceat(twice[owner], first)
        if len(shards) > 1:  # one string of each run is sought in the other shards
            for b, (other, theirs) in enumerate(zip(shards, members)):
                if a != b:
                    hit = other.search(shard, at[first])
                    ok = np.flatnonzero(hit >= 0)
                    whose = theirs[other.slice[hit[ok]]]
                    elsewhere = (origin[whose] + other.offset[hit[ok]] != low[ok]) | twice[whose] | (low[ok] != high[ok])
                    many[ok] |= elsewhere
        good = np.flatnonzero(np.repeat(many, counts))
        good = good[np.argsort(owner[good], kind="stable")]
        whose, begin = np.unique(owner[good], return_index=True)
        for k, part in zip(whose.tolist(), np.split(shard.offset[at[good]], begin[1:])):
            out[k].append(part)
    return [np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in out]


def stretches(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte stretches covered by strings at sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + length).tolist()))


#: A string reaches left of its gram by 0 to 336 bytes; keys are taken at every STEP of them.
STEP = 42


def candidates(group: list[tuple[bytes, int]]) -> list[tuple[int, int] | None]:
    """For neighbourhoods (bytes, place of the gram in them) of one gram: the part of each that can hold
    strings of another, or None. Equal strings agree in all bytes around the gram, so for the step of
    their reach to the left they share the key of the bytes that every such string holds."""
    reach = LENGTH - GRAM
    seen: dict[tuple[int, int], int] = {}
    keys: list[list[tuple[int, int]]] = []
    for data, at in group:
        own = []
        for k in range(0, reach, STEP):
            least, most = max(k, at - (len(data) - LENGTH)), min(k + STEP - 1 if k + STEP < reach else reach, at)
            if least <= most:  # some string here reaches that far
                key = (k, xxhash.xxh3_64_intdigest(data[at - k : at + GRAM + max(0, reach - STEP - k)]))
                seen[key] = seen.get(key, 0) + 1
                own.append((key, least, most))
        keys.append(own)
    out: list[tuple[int, int] | None] = []
    for (data, at), own in zip(group, keys):
        hit = [(a, b) for key, a, b in own if seen[key] > 1]
        out.append((at - max(b for _, b in hit), at - min(a for a, _ in hit) + LENGTH) if hit else None)
    return out


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


_PIECE = "gram long, hood long, low int, high int"


def repeats(texts: DataFrame) -> DataFrame:
    """(node, text, copies) -> (node, stretches): byte stretches repeated elsewhere, of the texts that have any."""

    def pick(batches):
        for pdf in batches:
            nodes, out = [], []
            for node, text, copies in zip(pdf["node"], pdf["text"], pdf["copies"]):
                data = _bytes(text)
                at, h, first, last = picked(data)
                for p, g, a, b in zip(at.tolist(), h.view(np.int64).tolist(), first.tolist(), (last + LENGTH).tolist()):
                    out.append((g, _signed(xxhash.xxh3_64_intdigest(data[a:b], p - a)), p, a - p, b - p, copies > 1))
                nodes += [node] * len(at)
            if out:
                frame = pd.DataFrame(out, columns=["gram", "hood", "place", "low", "high", "copied"])
                frame["node"] = nodes
                yield frame

    places = written(texts.mapInPandas(pick, "gram long, hood long, place int, low int, high int, copied boolean, node string"), "places", compression="zstd")
    hoods = places.groupBy("gram", "hood").agg(F.min(F.struct("node", "place", "low", "high")).alias("r"), ((F.count(F.lit(1)) > 1) | F.max("copied")).alias("twice"))
    hoods = written(hoods.select("gram", "hood", "twice", "r.*"), "hoods", compression="zstd")
    whole = hoods.where("twice").select("gram", "hood", "low", "high")
    groups = hoods.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = hoods.join(groups, "gram").select("gram", "n", "hood", "twice", "node", "place", "low", "high")
    wanted = several.groupBy("node").agg(F.collect_list(F.struct("gram", "n", "hood", "twice", "place", "low", "high")).alias("w"))
    cuts = texts.select("node", "text").join(wanted, "node")

    def cut(batches):
        for pdf in batches:
            rows = []
            for node, text, w in zip(pdf["node"], pdf["text"], pdf["w"]):
                data = _bytes(text)
                base = xxhash.xxh3_64_intdigest(node.encode()) >> 2  # far apart for different texts
                for x in w:
                    a, b = x["place"] + x["low"], x["place"] + x["high"]
                    rows.append((x["gram"], x["n"], x["hood"], x["twice"], base + a, x["low"], data[a:b]))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=["gram", "n", "hood", "twice", "origin", "low", "data"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["gram", "n", "hood", "twice", "origin", "low", "data"])

    cuts = written(cuts.mapInPandas(cut, "gram long, n long, hood long, twice boolean, origin long, low int, data binary"), "cuts", compression="zstd")

    def shards(batches):
        held: list[list[tuple]] = []
        size = 0

        def done(groups):
            rows = []
            for group in groups:
                for r, part in zip(group, candidates([(r[6], -r[5]) for r in group])):
                    if part:
                        rows.append((*r[:4], r[4] + part[0], r[5] + part[0], r[6][part[0] : part[1]]))
            out: list[tuple] = []
            found = repeated_windows([r[6] for r in rows], np.array([r[4] for r in rows], np.int64), np.array([r[3] for r in rows], bool))
            for r, starts in zip(rows, found):
                out += [(r[0], r[2], r[5] + a, r[5] + b) for a, b in stretches(starts)]
            return pd.DataFrame(out, columns=["gram", "hood", "low", "high"])

        for pdf in batches:
            for r in pdf[["gram", "n", "hood", "twice", "origin", "low", "data"]].itertuples(index=False, name=None):
                if not held or r[0] != held[-1][-1][0]:
                    if size >= SHARD:  # equal strings pick equal grams, so groups need not meet
                        yield done(held)
                        held, size = [], 0
                    held.append([])
                held[-1].append(r)
                size += len(r[6])
        if held:
            yield done(held)

    def strings(batches):  # of groups beyond GROUP: each string by itself
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                n = len(r.data) - LENGTH + 1
                h = [xxhash.xxh3_128_digest(r.data[k : k + LENGTH]) for k in range(n)]
                yield pd.DataFrame({"gram": r.gram, "hood": r.hood, "twice": r.twice, "place": r.origin + np.arange(n), "at": r.low + np.arange(n), "string": h})

    packed = cuts.where(F.col("n") <= GROUP).repartition("gram").sortWithinPartitions("gram", "hood").mapInPandas(shards, _PIECE)
    large = cuts.where(F.col("n") > GROUP).select("gram", "hood", "twice", "origin", "low", "data").mapInPandas(strings, "gram long, hood long, twice boolean, place long, at int, string binary")
    common = large.groupBy("string").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("twice").alias("t")).where("a <> b or t").select("string")
    dealt = large.join(common, "string").select("gram", "hood", F.col("at").alias("low"), (F.col("at") + LENGTH).alias("high"))
    pieces = written(whole.unionAll(packed).unionAll(dealt), "pieces", compression="zstd")
    spread = places.select("gram", "hood", "node", "place").join(pieces, ["gram", "hood"])
    return spread.groupBy("node").agg(F.collect_set(F.struct((F.col("place") + F.col("low")).alias("a"), (F.col("place") + F.col("high")).alias("b"))).alias("stretches"))


def shared_passages(texts: DataFrame) -> DataFrame:
    """(node, text, copies) -> (key, n_passages), key being 60 bits of the node, of the texts that share a fingerprint with another."""

    def pick(batches):
        for pdf in batches:
            which, h = fingerprints(pdf["text"].tolist())
            order = np.lexsort((h, which))
            which, h = which[order], h[order].view(np.int64)
            new = np.concatenate([[True], (which[1:] != which[:-1]) | (h[1:] != h[:-1])])[: len(h)]
            at = which[new]
            yield pd.DataFrame({"gram": h[new], "key": pdf["key"].to_numpy()[at], "copied": pdf["copies"].to_numpy()[at] > 1})

    keyed = texts.select(F.conv(F.substring("node", 1, 15), 16, 10).cast("long").alias("key"), "text", "copies")
    grams = written(keyed.mapInPandas(pick, "gram long, key long, copied boolean"), "grams", compression="zstd")
    # copied texts share all they have; of the others a gram's texts are told apart by counting
    common = grams.groupBy("gram").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("copied").alias("copied")).where("a <> b or copied").select("gram")
    return grams.join(common, "gram").groupBy("key").agg(F.count(F.lit(1)).alias("n_passages"))


def united(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicate(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and per distinct text: node, kept_bytes, n_bytes, n_removed, n_spans, kept_sha256, n_passages."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", text_of().alias("text"))
    keyed = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("node"), "text")
    texts = written(keyed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")), "texts", compression="zstd")
    passages = written(shared_passages(texts), "passages")
    joined = texts.join(repeats(texts), "node", "left")

    @F.pandas_udf("kept_bytes binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def remove(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for some in batches:
            out = []
            for text, copies, parts in zip(*some):
                data = _bytes(text)
                spans = [] if parts is None else united([(p["a"], p["b"]) for p in parts])
                if copies > 1 and len(data) >= LENGTH:
                    spans = [(0, len(data))]
                ends = [0, *[x for s in spans for x in s], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                out.append((kept, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["kept_bytes", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    members = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("node"))
    out = joined.select("node", remove("text", "copies", "stretches").alias("r")).select("node", "r.*", F.conv(F.substring("node", 1, 15), 16, 10).cast("long").alias("key"))
    return members, out.join(passages, "key", "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)).cast("long")).drop("key")


def query(docs: DataFrame) -> DataFrame:
    with scratch(docs.sparkSession):
        members, texts = deduplicate(docs)
        digest = written(texts.select("node", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"), "digest", keep=True)
    return members.join(digest, "node").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")
