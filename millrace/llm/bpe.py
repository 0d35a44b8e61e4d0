"""Byte-pair encoding and decoding for vocabularies with word ends.

``bpe_encode`` and ``bpe_decode`` reproduce what the tokenizers library does with
the same vocabulary file (added tokens matched in the raw text, NFC, per-character
lower case, split pattern, byte alphabet, merges, token strings joined by a space).

Merging works on many words at once. The symbols of all words lie in one flat
array; each round looks every adjacent pair up by binary search over the sorted
pair keys, takes the lowest rank of each word by a segmented minimum, and merges
all its occurrences. That equals one-at-a-time merging since every merge's parts
are made by earlier merges only, which is checked when a vocabulary is loaded.

Unicode tables differ: the library's letters and numbers are those of Unicode 16, this
Python's are older and the regex module's newer. Texts with a character that Python and
regex don't agree on, and texts that aren't in NFC, are normalised by the library itself
(its combining classes are older still) and split by a pattern held to Unicode 16.

The driver reads the vocabulary file and broadcasts it (2 MB); executors need no copy.

Edge cases: a null or empty text has no tokens and decodes to an empty text;
repeated rows give repeated results; ids outside the vocabulary and nulls are
skipped by the decoder; an existing column with an output's name is replaced.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import map_rows, texts_of

NO_RANK = np.int64(1 << 40)
SHIFT = np.int64(20)
#: Distinct words, and their symbols, that a worker remembers between batches.
CACHE_WORDS = 300_000
CACHE_IDS = 2_000_000
PART_CHARS = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


# Letters and numbers that Unicode 16 added, by first and last code point.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113B7), (0x113D1, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF),
    (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)


@lru_cache(maxsize=1)
def unsure_characters() -> frozenset[str]:
    """Characters that the regex module's tables call letters or numbers and Python's don't."""
    step, out = 1 << 12, set()
    for at in range(0, sys.maxunicode + 1, step):
        part = "".join(map(chr, range(at, at + step)))
        out.update(c for kind in "LN" for c in regex.findall(rf"\p{{{kind}}}", part) if unicodedata.category(c)[0] != kind)
    return frozenset(out)


class WordBpe:
    """A vocabulary's encoder and decoder; ``source`` is the JSON text of its file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.find = regex.compile(pattern, regex.V1).findall
        self.unsure = unsure_characters()
        codes = np.array(sorted(c for c in map(ord, self.unsure) if not any(a <= c <= b for a, b in UNICODE_16)))
        runs = np.split(codes, np.flatnonzero(np.diff(codes) != 1) + 1)
        strange = "[" + "".join(f"\\U{r[0]:08X}-\\U{r[-1]:08X}" for r in runs) + "]"
        self.strict = pattern.replace("[\\p{L}]", rf"[\p{{L}}--{strange}]").replace("[\\p{N}]", rf"[\p{{N}}--{strange}]").replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||{strange}]")
        self.source, self.normalise, self.find_strictly = source, None, None
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        letters = byte_alphabet()
        self.mid = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.end = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            if a + b in made or any(len(x) > 1 and x not in made and x.removesuffix(suffix) not in letters for x in (a, b)):
                raise ValueError("merges are not in the order in which their parts are made")
            made[a + b] = rank
        keys = np.array([(vocab[a] << int(SHIFT)) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        del spec, model, pairs, made
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1024, dtype=np.int32)
        self.offsets: list[int] = [0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of non-empty words in one flat array, and each word's end in it."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.mid[raw]
        last = np.cumsum(lengths) - 1
        sym[last] = self.end[raw[last]]
        own = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
        done_sym, done_own = [], []
        while len(sym):
            key = (sym[:-1] << SHIFT) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), NO_RANK)
            rank[:-1] = np.where((self.keys[at] == key) & (own[:-1] == own[1:]), self.ranks[at], NO_RANK)
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            least = np.minimum.reduceat(rank, starts)
            best = np.repeat(least, np.diff(np.r_[starts, len(sym)]))
            over = best == NO_RANK
            if over.any():
                done_sym.append(sym[over])
                done_own.append(own[over])
                go = ~over
                sym, own, rank, best = sym[go], own[go], rank[go], best[go]
                if not len(sym):
                    break
            take = np.flatnonzero(rank == best)
            # In a run of equal symbols the pairs overlap: every second one merges, from the left.
            fresh = np.r_[True, np.diff(take) != 1]
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(take)), 0))
            take = take[(np.arange(len(take)) - run_start) % 2 == 0]
            sym = sym.copy()
            sym[take] = self.merged[rank[take]]
            stay = np.ones(len(sym), dtype=bool)
            stay[take + 1] = False
            sym, own = sym[stay], own[stay]
        sym, own = np.concatenate(done_sym), np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        ends = np.cumsum(np.bincount(own, minlength=len(words)))
        return sym[order].astype(np.int32), ends

    def learn(self, words: list[str]) -> None:
        """Encode words not met before; their ids join the remembered ones."""
        if not words:
            return
        flat, ends = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        base = self.offsets[-1]
        if base + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (base + len(flat)))
        self.flat[base : base + len(flat)] = flat
        self.known.update(zip(words, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(words)), strict=True))
        self.offsets.extend((base + ends).tolist())

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or (unicodedata.is_normalized("NFC", text) and self.unsure.isdisjoint(text)):
            return self.find(text.replace("Σ", "σ").lower())
        if not self.normalise:
            from tokenizers import Tokenizer

            self.normalise = Tokenizer.from_str(self.source).normalizer.normalize_str
            self.find_strictly = regex.compile(self.strict, regex.V1).findall
        text = self.normalise(text)
        return self.find(text) if self.unsure.isdisjoint(text) else self.find_strictly(text)

    def split(self, text: str) -> list[str | int]:
        """Words, and the ids of added tokens, in order."""
        if not self.cut or not any(a in text for a in self.added):
            return self.pieces(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.pieces(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return out + self.pieces(text[at:])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and the offsets of each text."""
        if len(self.known) > CACHE_WORDS or self.offsets[-1] > CACHE_IDS:
            self.forget()
        rows = [self.split(t) for t in texts]
        known = self.known
        self.learn(list({w: None for row in rows for w in row if w not in known and not isinstance(w, int)}))
        top = len(self.offsets) - 1
        at = np.array([known[w] if not isinstance(w, int) else top + w for row in rows for w in row], dtype=np.int64)
        special = at >= top
        offsets = np.array(self.offsets, dtype=np.int64)
        begin = np.where(special, 0, offsets[np.where(special, 0, at)])
        size = np.where(special, 1, offsets[np.where(special, 0, at) + 1 if top else np.zeros_like(at)] - begin)
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        ids = self.flat[where].astype(np.int32)
        ids[(ends - size)[special]] = at[special] - top
        counts = np.cumsum([0, *(len(row) for row in rows)])
        return ids, np.r_[0, ends][counts].astype(np.int64)

    def decode(self, ids: list[int | None]) -> str:
        get = self.token.get
        return " ".join([t for i in ids if (t := get(i)) is not None])


_loaded: dict[str, WordBpe] = {}


def coder_of(source: str) -> WordBpe:
    """One coder of each vocabulary in a process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordBpe(source)
    return _loaded[key]


def read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(path: str) -> WordBpe:
    """The coder of a vocabulary file."""
    return coder_of(read(path))


def _shipped(docs: DataFrame, path: str):
    """The file's text, sent to each executor once."""
    return docs.sparkSession.sparkContext.broadcast(read(path))


def encode_parts(coder: WordBpe, texts) -> tuple[np.ndarray, np.ndarray]:
    """As ``WordBpe.encode``, about ``PART_CHARS`` characters at a time, so that few words are held at once."""
    flats, sizes, part, chars = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0

    def flush() -> None:
        flat, offsets = coder.encode(part)
        flats.append(flat)
        sizes.append(np.diff(offsets))

    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= PART_CHARS:
            flush()
            part, chars = [], 0
    if part:
        flush()
    return np.concatenate(flats), np.r_[0, np.cumsum(np.concatenate(sizes))]


def _lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, type=pa.int32()))


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the token ids of every whole text."""

    source = _shipped(docs, vocabulary)

    def make():
        coder = coder_of(source.value)
        return lambda batch: [_lists(*encode_parts(coder, texts_of(batch, text)))]

    return map_rows(docs, make, [(ids, T.ArrayType(T.IntegerType()))])


def bpe_decode(docs: DataFrame, vocabulary: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Add the text that the ids of every row decode to; null ids decode to an empty text."""

    source = _shipped(docs, vocabulary)

    def make():
        coder = coder_of(source.value)
        return lambda batch: [[coder.decode(x.as_py() or []) for x in batch.column(ids)]]

    return map_rows(docs, make, [(decoded, T.StringType())])


def bpe_round_trip(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Ids of every text and what they decode to, in one pass; the text itself is dropped."""

    source = _shipped(docs, vocabulary)

    def make():
        coder = coder_of(source.value)

        def step(batch):
            flat, offsets = encode_parts(coder, texts_of(batch, text))
            return [_lists(flat, offsets), [coder.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]]

        return step

    return map_rows(docs, make, [(ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType())], [c for c in docs.columns if c != text])
