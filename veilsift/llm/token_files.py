"""Token ids in Arrow IPC files of fixed-size-list batches: equal-length sequences and masks with random access.

Documents are dealt into ranges of doc_id; each range is encoded, packed end to end into sequences of ``length`` ids and
written as one file whose record batches hold ``tokens: fixed_size_list<uint16|uint32>[length]`` and
``mask: fixed_size_list<bool>[length]`` (false: padding), with an index file (doc_id, first, count) beside it. Memory-mapped,
any sequence and its mask are read without a copy: ``sequence(path, k)``.

A text is cut at single spaces between two characters that aren't white space; the tokenizer's pre-tokens never cross
such a place, so chunks are encoded once by the library and short ones remembered. A text that holds the string of an
added token is given to the library whole, so the ids are those of ``encode(text, add_special_tokens=False)`` for any text.

Ranges are about ``FILE_BYTES`` of the plan's size, and a task begins a new file after ``FILE_IDS`` ids, so neither files
nor tasks grow with the input.

Edge cases: a null or empty text gives the end id alone; null doc_ids come first; rows that repeat a doc_id keep a place
each, ordered by a hash of the text and the text; an empty table gives no files and an empty result; other columns are
ignored, whatever their names. A long text, with or without spaces, is encoded whole by the task that has its row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from veilsift.llm.common import mapped, settled, slices, text_key
from veilsift.llm.storage import new_folder, opened, own_name

LENGTH, GROUP, SLICE = 2048, 64, 4_000_000
#: Chunks that a worker remembers: short ones, and so many of them (some 30 MB).
KEPT_CHARS, KEPT = 32, 150_000
#: Size of a range by the plan's estimate, and ids after which a file is closed.
FILE_BYTES, FILE_IDS = 128 << 20, 1 << 26
#: White space in Unicode; a space beside any of it is no safe place to cut.
_WHITE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BESIDE_SPACE = f"{_WHITE} | {_WHITE}"
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[tuple[str, str], ChunkEncoder] = {}


class ChunkEncoder:
    """Encodes texts by a tokenizers file, chunk by chunk, with a bounded memory of chunks."""

    def __init__(self, path: str, kind: str) -> None:
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.known: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = "|".join(map(re.escape, added))
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith("\u0120")

    @staticmethod
    def of(path: str, kind: str) -> ChunkEncoder:
        if (path, kind) not in _encoders:
            _encoders[path, kind] = ChunkEncoder(path, kind)
        return _encoders[path, kind]

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        """Each text in pieces whose encodings, one after another, are the text's; each but the first begins with its space."""
        odd = pc.match_substring_regex(texts, BESIDE_SPACE)
        whole = pc.match_substring_regex(texts, self.added) if self.added else pa.array(np.zeros(len(texts), bool))
        cut = pc.split_pattern(texts, " ")
        odd = pc.or_(odd, whole)
        if not pc.any(odd).as_py():
            return cut
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        some = zip(texts.take(pa.array(where)).to_pylist(), whole.take(pa.array(where)).to_pylist(), strict=True)
        careful = pa.array([[t] if entire else SAFE_SPACE.split(t) for t, entire in some], cut.type)
        order = np.arange(len(texts))
        order[where] = len(texts) + np.arange(len(where))
        return pa.concat_arrays([cut, careful]).take(pa.array(order))

    def fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, each with a space before it, one after another, and the number of ids of each.

        Plain chunks go to the library many to a text: a token that begins with a space begins a chunk, as no plain
        chunk holds another space.
        """
        parts, sizes = [], []
        for run in (chunks[i : i + 4000] for i in range(0, len(chunks), 4000)):
            text = " ".join(run)
            if text.count(" ") == len(run) - 1 and "" not in run:
                ids = np.array(self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.kind)
                starts = np.flatnonzero(self.spaced[ids])
                if len(starts) == len(run):
                    parts.append(ids)
                    sizes.append(np.diff(np.r_[starts, len(ids)]))
                    continue
            each = [got.ids for got in self.tokenizer.encode_batch_fast([" " + x for x in run], add_special_tokens=False)]
            parts.append(np.array([i for ids in each for i in ids], self.kind))
            sizes.append(np.array([len(ids) for ids in each], np.int64))
        return np.concatenate([np.zeros(0, self.kind), *parts]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each followed by ``end`` if given, and the number of ids of each."""
        cut = self.chunks(texts.fill_null(""))
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        later = np.ones(len(codes), bool)
        later[offsets[:-1]] = False
        times = np.bincount(codes[later], minlength=len(coded.dictionary))  # of chunks that follow a space
        used = np.flatnonzero(times)
        words = coded.dictionary.take(pa.array(used)).to_pylist()
        heads = coded.dictionary.take(pa.array(codes[offsets[:-1]])).to_pylist()
        distinct = list(dict.fromkeys(heads))
        first = {x: np.array(got.ids, self.kind) for x, got in zip(distinct, self.tokenizer.encode_batch_fast(distinct, add_special_tokens=False), strict=True)}
        held = list(map(self.known.get, words))
        new = [i for i, x in enumerate(held) if x is None]
        fresh, sizes = self.fresh([words[i] for i in new])
        # All entries lie in one array: known chunks, fresh ones, heads, the end; places and lengths by entry.
        old = [i for i, x in enumerate(held) if x is not None]
        raw = [held[i] for i in old]
        tails = [first[x] for x in heads] + [np.zeros(0, self.kind) if end is None else np.array([end], self.kind)]
        blob = np.concatenate([np.frombuffer(b"".join(raw), self.kind), fresh, *tails])
        order = np.r_[np.array(old, np.int64), np.array(new, np.int64), len(words) + np.arange(len(tails))]
        lengths = np.r_[np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(self.kind).itemsize, sizes, np.fromiter(map(len, tails), np.int64, len(tails))]
        size, start = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        size[order], start[order] = lengths, np.cumsum(lengths) - lengths
        self.remember(words, new, times[used], start, size, blob)
        places = np.zeros(len(coded.dictionary), np.int64)
        places[used] = np.arange(len(used))
        codes = places[codes]
        codes[offsets[:-1]] = len(words) + np.arange(len(heads))
        codes = np.insert(codes, offsets[1:], len(order) - 1)
        each = size[codes]
        before = np.cumsum(each) - each
        ids = blob[np.repeat(start[codes] - before, each) + np.arange(int(each.sum()))]
        counts = np.add.reduceat(each, offsets[:-1] + np.arange(len(heads))) if len(heads) else np.zeros(0, np.int64)
        return ids, counts

    def remember(self, words: list[str], new: list[int], times: np.ndarray, start: np.ndarray, size: np.ndarray, blob: np.ndarray) -> None:
        """Keeps short chunks that occur more than once, as long as there is room; the memory begins anew when it is full."""
        if len(self.known) >= KEPT:
            self.known = {}
        for i in new:
            if times[i] > 1 and len(words[i]) <= KEPT_CHARS and len(self.known) < KEPT:
                self.known[words[i]] = blob[start[i] : start[i] + size[i]].tobytes()


def layout(kind: str, length: int) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(np.dtype(kind)), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Packs documents into sequences and writes batches of ``GROUP`` sequences."""

    def __init__(self, uri: str, kind: str, length: int) -> None:
        fs, path = opened(uri)
        self.sink = fs.open_output_stream(path, compression=None)
        self.schema, self.kind, self.length = layout(kind, length), kind, length
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.tokens, self.held, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.tokens.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * GROUP:
            self.write(self.held // (self.length * GROUP) * self.length * GROUP)

    def write(self, n: int) -> None:
        tokens = np.concatenate(self.tokens)
        for lo in range(0, n, self.length * GROUP):
            some = tokens[lo : min(n, lo + self.length * GROUP)]
            mask = np.arange(len(some)) < self.held - lo
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (some, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.tokens, self.held = [tokens[n:]], max(0, self.held - n)

    def close(self) -> None:
        if self.held:
            pad = -self.held % self.length
            self.tokens.append(np.zeros(pad, self.kind))
            self.write(self.held + pad)
        self.out.close()
        self.sink.close()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, kind: str | None = None, files: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files and returns their list, settled: part, place, path, index, documents, ids; in ascending doc_id order
    by part and place. ``kind``: the ids' type, by default the smallest of 16 and 32 bits that holds the vocabulary."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    kind = kind or ("<u2" if max(Tokenizer.from_file(tokenizer).get_vocab(True).values(), default=0) < 1 << 16 and end_id < 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place = ChunkEncoder.of(tokenizer, kind), TaskContext.get().partitionId(), 0
        out = None

        def closed() -> pa.RecordBatch:
            out.close()
            listed.close()
            sink.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32()), "path": [path], "index": [index], "documents": [documents], "ids": [out.total]})

        for batch in batches:
            for lo, texts in slices(batch.column(1), SLICE):
                if out is not None and out.total >= file_ids:
                    yield closed()
                    out, place = None, place + 1
                if out is None:
                    path, index, documents = own_name(folder, part, ".arrow"), own_name(folder, part, ".index"), 0
                    out, (fs, inner) = SequenceWriter(path, kind, length), opened(index)
                    sink = fs.open_output_stream(inner, compression=None)
                    listed = pa.ipc.new_file(sink, listed_schema())
                ids, counts = encoder.encode(texts, end_id)
                firsts = out.total + np.cumsum(counts) - counts
                out.add(ids)
                documents += len(texts)
                listed.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(firsts), pa.array(counts)], schema=listed_schema()))
        if out is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", text_key().alias("key"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, size // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return settled(ranged.transform(mapped, run, "part int, place int, path string, index string, documents bigint, ids bigint"), "token-list")


def listed_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("count", pa.int64())])


def sequence(uri: str, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of the k-th sequence of a file, as views of the mapped file."""
    fs, path = opened(uri)
    source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
    tokens, mask = (c.slice(k % GROUP, 1).flatten() for c in pa.ipc.open_file(source).get_batch(k // GROUP).columns)
    return tokens.to_numpy(), mask


def read_documents(path: str, index: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, first and ids of each document of a file, in its order; one batch is in memory at a time."""
    fs, inner = opened(path)
    data = pa.ipc.open_file(fs.open_input_file(inner))
    flat = (data.get_batch(i) for i in range(data.num_record_batches))
    held, done = np.zeros(0, np.uint16), 0
    places = pa.ipc.open_file(opened(index)[0].open_input_file(opened(index)[1]))
    for i in range(places.num_record_batches):
        listed = places.get_batch(i)
        for doc, first, count in zip(listed.column(0).to_pylist(), listed.column(1).to_pylist(), listed.column(2).to_pylist(), strict=True):
            more = []
            while done + len(held) + sum(map(len, more)) < first + count:
                more.append(next(flat).column(0).flatten().to_numpy())
            held = np.concatenate([held[first - done :], *more]) if more else held[first - done :]
            done = first
            yield doc, first, held[:count]


def read_token_files(listed: DataFrame, digest: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """Per document, read back from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    # One row for each file of some 128 MB: a running sum over these is no large group.
    files = listed.select("path", "index", (F.sum("ids").over(Window.orderBy("part", "place")) - F.col("ids")).alias("before"))
    count = listed.count()
    digest = digest or (lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for doc, first, ids in read_documents(path, index):
                    rows.append((doc, before + first, len(ids), digest(ids)))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, count)).transform(mapped, run, schema)
