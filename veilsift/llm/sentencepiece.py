"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Pieces and scores are read from a ``.model`` file. A text is normalised as the model asks for (spaces become U+2581, one is
put in front), cut into words where no piece can lie across (before a U+2581 that follows another character), and each
distinct word is segmented once: words of equal length advance together, substring hashes probe the sorted hashes of the
pieces, and a vectorised maximum keeps the best score and its backpointer at each place. A character that no piece covers
becomes its UTF-8 bytes (or the unknown id, if the model has no byte pieces).

The segmentation is the one of greatest total score, which is what the model's scores define for a unigram model; for a
model of another type the ids can differ from those that its own merge order gives, while decoding is exact either way.

Edge cases: a null or empty text has no ids; equal scores take the longer last piece; the unknown, control and byte
pieces never match text; repeated rows are encoded alike; an empty table gives an empty result; other columns are ignored,
whatever their names. A text that holds U+2581 comes back with a space in its place, so its ``round_trip`` is false. Long
texts are read whole; a word of n characters takes n steps over blocks of bounded size, and is not remembered beyond
``KEPT_CHARS`` characters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import mapped, slices

SPACE = "▁"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
UNKNOWN_PENALTY = 10.0
SLICE, CELLS = 2_000_000, 2_000_000
#: Words that a worker remembers: short ones, and so many of them (some 40 MB).
KEPT_CHARS, KEPT = 32, 150_000
_PRIME = np.uint64(0x100000001B3)
_models: dict[str, Pieces] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Pieces:
    """A model's pieces, their scores and the sorted hashes of those that match text."""

    texts: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    prefix: bool

    def __post_init__(self) -> None:
        usable = np.flatnonzero(np.isin(self.kinds, (1, 4)))  # normal and user-defined
        self.longest = max((len(self.texts[i]) for i in usable), default=1)
        keys = np.array([hash_of(self.texts[i]) for i in usable], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], usable[order].astype(np.int32)
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces share a hash")
        self.values = self.scores[self.ids]
        normal = self.scores[self.kinds == 1]
        self.unknown_score = (normal.min() if len(normal) else 0.0) - UNKNOWN_PENALTY
        self.unknown = int(np.flatnonzero(self.kinds == 2)[0]) if (self.kinds == 2).any() else 0
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == 6}
        self.raw = [bytes([int(t[3:5], 16)]) if k == 6 else b"" if k in (2, 3) else t.replace(SPACE, " ").encode() for t, k in zip(self.texts, self.kinds, strict=True)]
        self.known: dict[str, bytes] = {}

    @staticmethod
    def read(path: str) -> Pieces:
        """The pieces of a model file, read once a process."""
        if path not in _models:
            with open(path, "rb") as f:
                _models[path] = Pieces.parsed(f.read())
        return _models[path]

    @staticmethod
    def parsed(data: bytes) -> Pieces:
        texts, scores, kinds, prefix = [], [], [], True
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: np.float32(0).tobytes(), 3: 1} | dict(_fields(value))
                texts.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece[2], "<f4")[0]))
                kinds.append(piece[3])
            elif number == 3:  # the normaliser
                spec = dict(_fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models that keep characters and white space as they are can be used")
        return Pieces(texts, np.array(scores), np.array(kinds), prefix)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [WORDS.findall((SPACE if self.prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        wanted = set().union(*cut)
        new = [w for w in wanted if w not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known = {w: self.known[w] for w in wanted if w in self.known}  # those in use stay
        fresh = dict(zip(new, self.segmented(new), strict=True))
        self.known.update((w, fresh[w]) for w in new[: max(0, KEPT - len(self.known))] if len(w) <= KEPT_CHARS)
        held = {w: fresh[w] if w in fresh else self.known[w] for w in wanted}
        return [b"".join(map(held.__getitem__, words)) for words in cut]

    def segmented(self, words: list[str]) -> list[bytes]:
        """The best segmentation of each word; words of equal length are searched together."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        found: list[bytes] = [b""] * len(words)
        for n, rows in by_length.items():
            step = max(1, CELLS // (n * min(n, self.longest)))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                for i, ids in zip(some, self.viterbi([words[i] for i in some], n), strict=True):
                    found[i] = ids
        return found

    def viterbi(self, words: list[str], n: int) -> list[bytes]:
        """Segmentations of words of ``n`` characters: pieces are looked up for all substrings of a block of places at once."""
        count, width, last = len(words), min(n, self.longest), len(self.keys) - 1
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(count, n).T.astype(np.uint64)
        best = np.full((n + 1, count), -np.inf)
        best[0] = 0
        back, piece = np.zeros((n + 1, count), np.int32), np.full((n + 1, count), -1, np.int32)
        columns, step = np.arange(count), max(1, CELLS // (width * count))
        for low in range(0, n, step):
            high, first = min(n, low + step), max(0, low - width + 1)
            span = codes[first:high]
            found, value = np.full((width, len(span), count), -1, np.int32), np.full((width, len(span), count), -np.inf)
            state = np.full(span.shape, BASE, np.uint64)
            for k in range(1, min(width, len(span)) + 1):  # substrings of k characters, by their starts
                state = mixed(state[: len(span) - k + 1], span[k - 1 :])
                keys = finished(state)
                at = np.minimum(np.searchsorted(self.keys, keys), last)
                hit = self.keys[at] == keys
                found[k - 1, : len(keys)] = np.where(hit, self.ids[at], -1)
                value[k - 1, : len(keys)] = np.where(hit, self.values[at], -np.inf)
            for end in range(low + 1, high + 1):
                sizes = np.arange(min(width, end), 0, -1)
                own = found[sizes - 1, end - sizes - first]
                total = best[end - sizes] + value[sizes - 1, end - sizes - first]
                total[-1] = np.where(own[-1] >= 0, total[-1], best[end - 1] + self.unknown_score)  # no piece: one character
                pick = np.argmax(total, axis=0)
                best[end], back[end], piece[end] = total[pick, columns], end - sizes[pick], own[pick, columns]
        return self.traced(words, back, piece, n)

    def traced(self, words: list[str], back: np.ndarray, piece: np.ndarray, n: int) -> list[bytes]:
        """Follows the backpointers of all words at once, then writes the ids of each."""
        count = len(words)
        at, columns, marks = np.full(count, n), np.arange(count), np.full((n, count), -2, np.int32)
        step = 0
        while (at > 0).any():
            going = at > 0
            marks[n - 1 - step, going] = piece[at[going], columns[going]]
            at = np.where(going, back[at, columns], 0)
            step += 1
        marks = np.ascontiguousarray(marks[n - step :].T)
        plain = (marks != -1).all(axis=1)
        out = []
        for i in range(count):
            ids = marks[i][marks[i] != -2]
            out.append(ids.astype("<i4").tobytes() if plain[i] else self.spelled(words[i], ids))
        return out

    def spelled(self, word: str, ids: np.ndarray) -> bytes:
        """Ids with bytes, or the unknown id, in the place of characters without a piece."""
        found, at, before = [], 0, False
        for i in ids.tolist():
            if i >= 0:
                found.append(i)
                at += len(self.texts[i])
                before = False
                continue
            if self.bytes:
                found += [self.bytes[b] for b in word[at].encode()]
            elif not before:
                found.append(self.unknown)  # neighbours without a piece are one unknown
            before = True
            at += 1
        return np.array(found, "<i4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space put in front is taken away again."""
        text = b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


BASE = np.uint64(0xCBF29CE484222325)


def mixed(state: np.ndarray, code: np.ndarray) -> np.ndarray:
    """One step of a substring hash."""
    x = (state ^ code) * _PRIME
    return x ^ (x >> np.uint64(29))


def finished(state: np.ndarray) -> np.ndarray:
    return state * np.uint64(0x9E3779B97F4A7C15)


def hash_of(text: str) -> int:
    state = np.full(1, BASE, np.uint64)
    for c in text:
        state = mixed(state, np.array([ord(c)], np.uint64))
    return int(finished(state)[0])


ENCODED = "doc_id bigint, ids array<int>"


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.read(model)
        for batch in batches:
            for lo, texts in slices(batch.column(1), SLICE):
                raw = pieces.encode(texts.to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").transform(mapped, run, ENCODED)


SUMMARY = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, decoded_chars bigint, round_trip boolean"


def summaries(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number and crc32 of its ids, crc32 and length of the text decoded from them, and if it is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.read(model)
        for batch in batches:
            for lo, texts in slices(batch.column(1), SLICE):
                rows = []
                for doc, text, raw in zip(batch.column(0).slice(lo, len(texts)).to_pylist(), texts.to_pylist(), pieces.encode(texts.to_pylist()), strict=True):
                    again = pieces.decode(np.frombuffer(raw, "<i4"))
                    rows.append((doc, len(raw) // 4, zlib.crc32(raw), zlib.crc32(again.encode()), len(again), again == (text or "")))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SUMMARY.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text").transform(mapped, run, SUMMARY)

