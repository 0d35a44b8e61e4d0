"""Scoring by an n-gram model kept in sharded Elias-Fano tries.

The model is a bigram model with Dirichlet smoothing towards the unigram base:

    p(w | u) = (c(u, w) + mu * p(w)) / (c(u) + mu),   p(w) = (c(w) + a) / (N + a (V + 1))

``u`` is the previous token, or the end token before a text's first word, so that c(u)
is u's own count. Every context is kept: the model's tables grow with the corpus.

1. Blocks of documents are tokenised and their distinct training tokens counted; the
   counts meet in one shuffle (word hash, count).
2. Blocks are tokenised again. To every shard a block sends its distinct pairs (word
   hash, context hash) and their training counts, as one row. Words that make at least
   1 / ``FREQUENT`` of the training tokens are dealt by word and context, the others by
   word, so a very common word doesn't fill one shard; those words are at most
   ``FREQUENT`` whatever the corpus, and with their counts go to every task. One more row
   has the block's texts as numbers of its words, from which the pairs follow again.
3. A shard adds the counts of all blocks, builds its trie - level one the words, level
   two the contexts below each word, with pointers between - and answers the blocks'
   pairs from the memory-mapped levels: a row of quantised codes for each block. What it
   keeps is the smoothed numerator, c(u, w) + mu * p(w); beside it goes the word's count.
4. A block's answers meet its texts. Every context is also a word of its block, so its
   count is among the answers; the block divides by c(u) + mu and takes its documents'
   sums. What moves grows with the distinct pairs of blocks and with the text.

A trie's monotone sequences (word hashes, context hashes, pointers, contexts offset by
their word's place) are Elias-Fano coded; the logarithms of the smoothed numerators are
quantised to 16 bits between the shard's extremes. A lookup finds the word, follows its
pointers and searches the successor within the word's own range of contexts. Pairs that
training lacks have the numerator mu * p(w), exactly.

Edge cases: null and empty texts have the end token alone; a null id counts as the
empty text for the hold-out rule; repeated rows are scored once each and, unless
held out, learnt once each; without training tokens every score is the uniform base.
Words are told apart by 64-bit hashes, the contexts of one word by 40 bits of
theirs, frequent contexts exactly.
"""

from __future__ import annotations

import io
import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, checkpointed, ship, texts_of

FREQUENT, MU, ALPHA, SEED = 1 << 16, 300.0, 0.1, 42
#: Bits of its hash that a rarer context goes without; frequent ones have their place in the list.
SHORT = np.uint64(24)
BLOCK_CHARS, BLOCK_DOCS = 8 << 20, 50_000
#: Codes of the quantised probabilities run from 0 to LEVELS; LACKING marks a pair that training lacks.
LEVELS, LACKING = (1 << 16) - 2, (1 << 16) - 1


class EliasFano:
    """A non-decreasing sequence of uint64: low bits packed, high bits in unary, both flat arrays."""

    def __init__(self, values: np.ndarray, folder: str, name: str):
        values = values.astype(np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = l = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        high = (values >> np.uint64(l)).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if n else 0
        bits = np.zeros((n + self.buckets + 63) // 64 * 64 + 64, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        # Low parts: whole bytes, then the rest bit-packed into a second array.
        low = values & np.uint64((1 << l) - 1)
        self.whole, rest = l // 8, l % 8
        self.rest = rest
        parts = [packed]
        for k in range(self.whole):
            parts.append(((low >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8))
        if rest:
            over = (low >> np.uint64(8 * self.whole)).astype(np.uint8)
            parts.append(np.packbits(np.unpackbits(over[:, None], axis=1, bitorder="little")[:, :rest].ravel(), bitorder="little"))
            parts[-1] = np.r_[parts[-1], np.zeros(2, np.uint8)]
        at = os.path.join(folder, name)
        with open(at, "wb") as f:
            for p in parts:
                f.write(p.tobytes())
        size = [len(p) for p in parts]
        whole = np.memmap(at, dtype=np.uint8, mode="r", shape=(sum(size),))
        ends = np.cumsum([0, *size])
        self.high, self.low = whole[: size[0]], [whole[a:b] for a, b in zip(ends[1:-1], ends[2:], strict=True)]
        words = np.frombuffer(packed.tobytes(), dtype="<u8")
        zeros = 64 - np.bitwise_count(words).astype(np.int64)
        self.zeros = np.r_[0, np.cumsum(zeros)]  # zeros before each 64-bit word
        self.ones = np.arange(len(self.zeros)) * 64 - self.zeros

    @staticmethod
    def nth(bits: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The place of the set bit with ``need`` set ones below it, by halving each 64-bit word."""
        pos = np.zeros(len(bits), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            go = need >= ones
            need = np.where(go, need - ones, need)
            bits = np.where(go, bits >> np.uint64(width), bits)
            pos += go * width
        return pos

    def bucket(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``h``: the ones before zero number h."""
        out = np.zeros(len(h), dtype=np.int64)
        some = np.flatnonzero(h > 0)
        k = h[some] - 1  # the k-th zero, from 0
        word = np.searchsorted(self.zeros, k, side="right") - 1
        out[some] = word * 64 + self.nth(~self.high.view("<u8")[word], k - self.zeros[word]) - k
        return out

    def low_at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.uint64)
        for k in range(self.whole):
            out |= self.low[k][i].astype(np.uint64) << np.uint64(8 * k)
        if self.rest:
            bit = i * self.rest
            byte = bit >> 3
            two = self.low[-1][byte].astype(np.uint64) | (self.low[-1][byte + 1].astype(np.uint64) << np.uint64(8))
            out |= ((two >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.rest) - 1)) << np.uint64(8 * self.whole)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        high = word * 64 + self.nth(self.high.view("<u8")[word], i - self.ones[word]) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.low_at(i)

    def successor(self, x: np.ndarray, within: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value not below each ``x``, and whether it equals it; in the places ``within`` if given."""
        x = x.astype(np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        inside = (h < self.buckets) & (x >> np.uint64(self.low_bits) < np.uint64(1 << 62))
        h = np.where(inside, h, self.buckets - 1)
        lo, hi = self.bucket(h), self.bucket(h + 1)
        lo = np.where(inside, lo, self.n)
        hi = np.where(inside, hi, self.n)
        if within:
            lo, hi = np.clip(lo, *within), np.clip(hi, *within)
        end = hi.copy()
        want = x & np.uint64((1 << self.low_bits) - 1)
        while True:
            go = np.flatnonzero(lo < hi)
            if not len(go):
                break
            mid = (lo[go] + hi[go]) // 2
            less = self.low_at(mid) < want[go]
            lo[go] = np.where(less, mid + 1, lo[go])
            hi[go] = np.where(less, hi[go], mid)
        found = np.zeros(len(x), bool)
        some = np.flatnonzero(lo < end)
        found[some] = self.low_at(lo[some]) == want[some]
        return lo, found


class Trie:
    """Words, the contexts below each, and the pairs' quantised logarithms."""

    def __init__(self, words: np.ndarray, word_of: np.ndarray, contexts: np.ndarray, logs: np.ndarray, folder: str):
        """words: sorted hashes; word_of, contexts: the pairs in order; logs: their values."""
        self.words = EliasFano(words, folder, "words")
        known, place = np.unique(contexts, return_inverse=True)
        self.contexts, self.span = EliasFano(known, folder, "contexts"), np.uint64(max(len(known), 1))
        self.pointers = EliasFano(np.r_[0, np.cumsum(np.bincount(word_of, minlength=len(words)))], folder, "pointers")
        self.pairs = EliasFano(word_of.astype(np.uint64) * self.span + place.astype(np.uint64), folder, "pairs")
        self.least = float(logs.min()) if len(logs) else 0.0
        self.step = max((float(logs.max()) - self.least) / LEVELS, 1e-12) if len(logs) else 1.0
        at = os.path.join(folder, "logs")
        np.rint((logs - self.least) / self.step).astype("<u2").tofile(at)
        self.logs = np.memmap(at, dtype="<u2", mode="r", shape=(len(logs),)) if len(logs) else np.zeros(0, "<u2")

    def lookup(self, words: np.ndarray, sizes: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's place and whether it is known, and its ``sizes`` contexts' codes, ``LACKING`` where the trie lacks one."""
        codes = np.full(len(contexts), LACKING, dtype=np.uint16)
        place, known = self.words.successor(words)
        if not known.any():
            return np.zeros(len(words), np.int64), known, codes
        place = np.where(known, place, 0)
        begin, end = self.children(place)
        spread = np.repeat(np.arange(len(words)), sizes)
        some = np.flatnonzero(known[spread])
        own, seen = self.contexts.successor(contexts[some])
        some, own, spread = some[seen], own[seen], spread[some[seen]]
        at, found = self.pairs.successor(place[spread].astype(np.uint64) * self.span + own.astype(np.uint64), (begin[spread], end[spread]))
        codes[some[found]] = self.logs[at[found]]
        return place, known, codes

    def children(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of pairs below each word."""
        return self.pointers.get(places).astype(np.int64), self.pointers.get(places + 1).astype(np.int64)


def held(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in doc_ids], dtype=bool)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(doc ids, words of each document) of about ``BLOCK_CHARS`` bytes, and ``BLOCK_DOCS`` documents at most."""
    ids, rows, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
            raw = t.encode("utf-8", "surrogatepass").lower()
            ids.append(i)
            rows.append(raw.split())
            size += len(raw)
            if size >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                yield ids, rows
                ids, rows, size = [], [], 0
    if ids:
        yield ids, rows


def numbered(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes (the end token first), each token's place in them, each token's document."""
    seen: dict[bytes, int] = {b"": 0}
    at = [seen.setdefault(w, len(seen)) for row in rows for w in (*row, b"")]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in seen], dtype=np.uint64)
    return hashes, np.array(at, dtype=np.int64), np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, c): training tokens' hashes and counts."""

    def run(batches):
        for ids, rows in blocks(batches):
            rows = [r for r, out in zip(rows, held(ids), strict=True) if not out]
            if rows:
                hashes, at, _ = numbered(rows)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.bincount(at, minlength=len(hashes)))], ["h", "c"])

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def planes(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes: the high bytes of small numbers cost next to nothing."""
    size = a.dtype.itemsize
    return zlib.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, size).T).tobytes(), 1)


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def bundle(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a)
    return zlib.compress(out.getvalue(), 1)


def unbundle(data: bytes, n: int) -> list[np.ndarray]:
    source = io.BytesIO(zlib.decompress(data))
    return [np.load(source) for _ in range(n)]


ASKED = {"shard": pa.int32(), "block": pa.string(), "start": pa.int64(), "words": pa.binary(), "contexts": pa.binary(), "counts": pa.binary()}
ANSWERED = {"block": pa.string(), "start": pa.int64(), "codes": pa.binary(), "about": pa.binary(), "counts": pa.binary(), "least": pa.float64(), "step": pa.float64()}


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def places(frequent: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's place in the sorted list of frequent ones, and whether it is there."""
    if not len(frequent):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return at, frequent[at] == hashes


class Pairs:
    """A block's distinct pairs in the order of their shards; tokens and shards give the same order anywhere.

    ``word`` and ``context`` (its word) of each pair, ``new`` where a pair's word or
    shard differs from the one before; ``number`` and ``before``: the pair and the
    context's word of each token. ``plain``: shards of the pairs by word and context.
    """

    def __init__(self, at: np.ndarray, doc: np.ndarray, words: int, deal):
        self.before = np.where(np.r_[True, doc[1:] != doc[:-1]], 0, np.r_[0, at[:-1]])
        pairs, of = np.unique(at * words + self.before, return_inverse=True)
        word, context = pairs // words, pairs % words
        self.plain = deal(word, context)
        by = np.argsort(self.plain, kind="stable")
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        self.word, self.context, self.shard, self.number = word[by], context[by], self.plain[by], number[of]
        self.new = np.r_[True, (self.word[1:] != self.word[:-1]) | (self.shard[1:] != self.shard[:-1])]


def listed(frequent: np.ndarray, hashes: np.ndarray) -> bytes:
    """Word hashes: frequent ones as their two-byte places."""
    place, common = places(frequent, hashes)
    return np.uint32(len(hashes)).tobytes() + np.packbits(common).tobytes() + place[common].astype("<u2").tobytes() + hashes[~common].tobytes()


def unlisted(frequent: np.ndarray, data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    mask = (n + 7) // 8
    common = np.unpackbits(np.frombuffer(data, np.uint8, mask, 4), count=n).astype(bool)
    k = int(common.sum())
    out = np.empty(n, np.uint64)
    out[common] = frequent[np.frombuffer(data, "<u2", k, 4 + mask)] if k else 0
    out[~common] = np.frombuffer(data, "<u8", n - k, 4 + mask + 2 * k)
    return out


def turned(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()


def coded(sizes: np.ndarray, contexts: np.ndarray) -> bytes:
    """How many contexts each word has, and the contexts: frequent ones as two bytes, others as five."""
    rare = contexts >= FREQUENT
    return zlib.compress(turned(sizes.astype("<u4")) + np.packbits(rare).tobytes() + turned(contexts[~rare].astype("<u2")) + turned((contexts[rare] - np.uint64(FREQUENT)).astype("<u8")), 1)


def decoded(data: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    data, at = zlib.decompress(data), 0

    def take(n: int, kind: str) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize
        at += n * size
        return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at - n * size).reshape(size, -1).T).view(kind).ravel()

    sizes = take(words, "<u4").astype(np.int64)
    n = int(sizes.sum())
    rare = np.unpackbits(take((n + 7) // 8, "u1"), count=n).astype(bool)
    contexts = np.empty(n, np.uint64)
    contexts[~rare] = take(n - int(rare.sum()), "<u2")
    contexts[rare] = take(int(rare.sum()), "<u8") + np.uint64(FREQUENT)
    return sizes, contexts


def requests(docs: DataFrame, frequent: np.ndarray, shards: int) -> DataFrame:
    """Rows (shard, block, start, words, contexts, counts): the pairs that a block asks of a shard.

    A block numbers its distinct pairs by shard; ``start`` is a row's first number. The
    row with start -1 has the pairs' shards, the block's tokens and its documents.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        for n, (ids, rows) in enumerate(blocks(batches)):
            block = f"{part}-{n}"
            hashes, at, doc = numbered(rows)
            place, common = places(frequent, hashes)
            keys = np.where(common, place.astype(np.uint64), (hashes >> SHORT) + np.uint64(FREQUENT))

            def deal(word, context, hashes=hashes, common=common, keys=keys):
                mixed = hashes[word] ^ np.where(common[word], (keys[context] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
                return (((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(shards)).astype(np.uint32)

            p = Pairs(at, doc, len(hashes), deal)
            counts = np.bincount(p.number, weights=~held(ids)[doc], minlength=len(p.word)).astype(np.uint32)
            owners, starts = np.unique(p.shard, return_index=True)
            out = []
            for s, a, b in zip(owners.tolist(), starts.tolist(), [*starts[1:].tolist(), len(p.word)], strict=True):
                new = np.flatnonzero(p.new[a:b])
                sizes = np.diff(np.r_[new, b - a])
                out.append((s, block, a, listed(frequent, hashes[p.word[a:b][new]]), coded(sizes, keys[p.context[a:b]]), planes(counts[a:b])))
                if len(out) >= 256:
                    yield _batch(out, ASKED)
                    out = []
            about = bundle(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids]), np.bincount(doc, minlength=len(ids)))
            # Words are numbered as they come, the end token first: a new one is marked, others are told by number.
            seen = np.maximum.accumulate(np.r_[0, at[:-1]])
            tokens = np.where(at > seen, 0, at + 1).astype(np.uint32)
            out.append((zlib.crc32(block.encode()) % shards, block, -1, planes(p.plain), planes(tokens), about))
            yield _batch(out, ASKED)

    return docs.mapInArrow(run, "shard int, block string, start long, words binary, contexts binary, counts binary")


def answers(asked: DataFrame, frequent: np.ndarray, counts: np.ndarray, total: int, distinct: int, mu: float, alpha: float) -> DataFrame:
    """Rows (block, start, codes, about, counts, least, step): each request's answer; rows of uses pass through.

    frequent, counts: sorted hashes and training counts of the frequent words.
    """
    floor = total + alpha * (distinct + 1)

    def pairs_of(words: bytes, contexts: bytes):
        words = unlisted(frequent, words)
        return words, *decoded(contexts, len(words))

    def counts_of(words: np.ndarray, own: np.ndarray):
        """Words' counts: frequent ones are dealt by context, so a shard's own sum is a part only."""
        at, there = places(frequent, words)
        return np.where(there, counts[at], own) if len(frequent) else own

    def merge(parts):
        w, c, k = (np.concatenate([p[j] for p in parts]) for j in range(3))
        order = np.lexsort((c, w))
        w, c, k = w[order], c[order], k[order]
        new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])]) if len(w) else np.zeros(0, np.int64)
        return w[new], c[new], np.add.reduceat(k, new) if len(new) else k

    def run(batches):
        with tempfile.TemporaryDirectory(prefix="millrace-lm-") as folder:
            spool = pa.OSFile(os.path.join(folder, "asked"), "wb")
            writer, parts, waiting = None, [], 0
            for batch in batches:
                through = pa.compute.less(batch.column("start"), 0)
                if through.true_count:
                    own = batch.filter(through)
                    none = pa.nulls(own.num_rows, pa.float64())
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("block", "start", "words", "contexts", "counts")), none, none], list(ANSWERED))
                batch = batch.filter(pa.compute.invert(through))
                writer = writer or pa.ipc.new_stream(spool, batch.schema)
                writer.write_batch(batch)
                for words, contexts, number in zip(batch.column("words"), batch.column("contexts"), batch.column("counts"), strict=True):
                    w, sizes, c = pairs_of(words.as_py(), contexts.as_py())
                    w = np.repeat(w, sizes)
                    k = unplanes(number.as_py(), "<u4").astype(np.int64)
                    some = k > 0
                    parts.append((w[some], c[some], k[some]))
                    waiting += int(some.sum())
                if waiting > 4_000_000 and len(parts) > 64:
                    parts = [merge(parts)]
                    waiting = len(parts[0][0]) // 2
            if writer is None:
                return
            writer.close()
            spool.close()
            w, c, k = merge(parts or [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))])
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
            words = w[first]
            sums = np.add.reduceat(k, first) if len(first) else k
            word_of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(w)]))
            sums = counts_of(words, sums)
            logs = np.log10(k + mu * ((sums + alpha) / floor)[word_of])
            trie = Trie(words, word_of, c, logs, folder)
            del w, k, logs, word_of, parts
            source = pa.memory_map(os.path.join(folder, "asked"))
            for batch in pa.ipc.open_stream(source):
                out = []
                for row in batch.to_pylist():
                    w, sizes, c = pairs_of(row["words"], row["contexts"])
                    place, known, codes = trie.lookup(w, sizes, c)
                    number = counts_of(w, np.where(known, sums[place] if len(sums) else 0, 0))
                    out.append((row["block"], row["start"], planes(codes), b"", planes(number.astype(np.int64)), trie.least, trie.step))
                if out:
                    yield _batch(out, ANSWERED)
            source.close()
            del trie

    return asked.mapInArrow(run, "block string, start long, codes binary, about binary, counts binary, least double, step double")


def sums_of(found: DataFrame, total: int, distinct: int, mu: float, alpha: float) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of every document, from its block's answers."""
    floor = total + alpha * (distinct + 1)
    kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        starts = table.column("start").to_pylist()
        order = sorted(range(len(starts)), key=starts.__getitem__)
        own = lambda k, *names: [table.column(c)[k].as_py() for c in names]
        if starts[order[0]] != -1 or starts.count(-1) != 1:
            raise ValueError("a block's texts came twice or not at all")
        shard, tokens, about = own(order[0], "codes", "about", "counts")
        tokens, (ids, null, lengths) = unplanes(tokens, "<u4").astype(np.int64), unbundle(about, 3)
        at = np.where(tokens == 0, np.cumsum(tokens == 0), tokens - 1)
        doc, words = np.repeat(np.arange(len(ids)), lengths), int(at.max()) + 1
        p = Pairs(at, doc, words, lambda word, context: unplanes(shard, "<u4"))
        value, number, done = np.empty(len(p.word)), [], 0
        for k in order[1:]:
            codes, counts, least, step = own(k, "codes", "counts", "least", "step")
            codes = unplanes(codes, "<u2")
            if starts[k] != done:
                raise ValueError("a block lacks answers")
            value[done : done + len(codes)] = np.where(codes == LACKING, np.nan, least + step * codes.astype(np.float64))
            number.append(unplanes(counts, "<i8"))
            done += len(codes)
        if done != len(value):
            raise ValueError("a block lacks answers")
        number = np.concatenate(number)[np.cumsum(p.new) - 1]
        gone = np.isnan(value)
        value[gone] = np.log10(mu * (number[gone] + alpha) / floor)
        count = np.empty(words, np.int64)
        count[p.word] = number
        score = value[p.number] - np.log10(count + mu)[p.before]
        base = np.log10((count + alpha) / floor)[at]
        known, first, score = (np.bincount(doc, weights=x, minlength=len(ids)) for x in ((count > 0)[at], base, score))
        own_ids = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        return pa.table([pa.array(own_ids, pa.int64()), pa.array(held(own_ids)), pa.array(lengths.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(first), pa.array(score)], schema=kinds)

    return found.groupBy("block").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mu: float = MU, alpha: float = ALPHA, shards: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    ship(spark)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = checkpointed(token_counts(own))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # At most FREQUENT rows, as each takes its share of the total.
    top = {r["h"]: r["c"] for r in counts.where(F.col("c") * FREQUENT >= total).collect()}
    order = sorted(top, key=lambda h: h & ((1 << 64) - 1))
    frequent = np.array([h & ((1 << 64) - 1) for h in order], dtype=np.uint64)
    number = np.array([top[h] for h in order], dtype=np.int64)
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = requests(own, frequent, 2 * parts).repartition(parts, "shard")
    found = sums_of(answers(asked, frequent, number, total, distinct, mu, alpha), total, distinct, mu, alpha)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
