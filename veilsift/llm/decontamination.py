"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits of any script, in lower case; whatever else stands between parts them. Documents are
read once: a filter of bounded size over the test items' seeds (``SEED_TOKENS`` tokens in a row) leaves of each the tokens
under seeds that an item may have, and these seeds are joined with the items'. A pair is tiled if the item's places whose
seeds the document has can reach the threshold at all: running Karp-Rabin matching finds the longest matches first and
marks them as tiles that don't overlap in either, down to the seed's length. An item counts as leaked into a document if
its tiles cover ``COVERAGE`` of its tokens or more, in whatever order they occur.

Tokens are told apart by 64-bit hashes. Edge cases: a null or empty text has no tokens; an item with fewer tokens than a
seed is never found; different texts under one item_id are items of their own, repeated ones count once; a null item_id
is ignored; repeated documents have a row each; empty tables give no hits; other columns are ignored, whatever their
names. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import few, mapped, settled, text_key, without

SEED_TOKENS, COVERAGE = 4, 0.6
#: The filter's size in bits, as a power of two: by the number of seeds, up to 16 MB. Beyond that more passes it and the
#: join sorts it out.
LEAST_BITS, MOST_BITS = 15, 27
#: Tokens of all items up to which the items are sent to the tasks.
SENT_TOKENS = 4_000_000
_PARTED = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(128)
_TOKEN = re.compile(r"[^\W_]+")
_BASE = 1_000_003
_MASK = (1 << 61) - 1


def tokens_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case, in UTF-8."""
    if not text:
        return []
    if text.isascii():
        return text.encode().lower().translate(_PARTED).split()
    return [t.encode() for t in _TOKEN.findall(text.lower())]


def token_hashes(text: str | None) -> np.ndarray:
    words = tokens_of(text)
    return np.maximum(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.uint64(1))  # zero is a gap


class RunningHash:
    """Karp-Rabin hashes of all windows of a token sequence, for any length, from one prefix pass."""

    def __init__(self, tokens: list[int]) -> None:
        self.prefix, self.power = [0], [1]
        for t in tokens:
            self.prefix.append((self.prefix[-1] * _BASE + t + 1) % _MASK)
            self.power.append(self.power[-1] * _BASE % _MASK)

    def window(self, at: int, size: int) -> int:
        return (self.prefix[at + size] - self.prefix[at] * self.power[size]) % _MASK


def unmarked_windows(marked: list[bool], size: int) -> Iterator[int]:
    """Starts of windows of ``size`` places none of which is marked."""
    free = 0
    for i, m in enumerate(marked):
        free = 0 if m else free + 1
        if free >= size:
            yield i - size + 1


def greedy_tiles(item: list[int], text: list[int], least: int = SEED_TOKENS) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length), longest first; tokens below zero match nothing."""
    done_item, done_text = [t < 0 for t in item], [t < 0 for t in text]
    hashed_item, hashed_text = RunningHash(item), RunningHash(text)
    tiles, size = [], max(least, min(len(item), len(text)))
    while size >= least:
        windows: dict[int, list[int]] = {}
        for t in unmarked_windows(done_text, size):
            windows.setdefault(hashed_text.window(t, size), []).append(t)
        matches, longer = [], 0
        for p in unmarked_windows(done_item, size):
            best, at = 0, 0
            for t in windows.get(hashed_item.window(p, size), ()):
                if item[p : p + size] != text[t : t + size]:
                    continue
                k = size
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and not done_item[p + k] and not done_text[t + k]:
                    k += 1
                if k > best:
                    best, at = k, t
                if p + k == len(item) or done_item[p + k]:
                    break  # none is longer
            if best:
                matches.append((best, p, at))  # the first of the longest at this place
                longer = max(longer, best)
        if longer > 2 * size:  # much longer than looked for: begin again from there
            size = longer
            continue
        for k, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if any(done_item[p : p + k]):
                continue
            if any(done_text[t : t + k]):
                break  # another place of the text may hold it: look again
            tiles.append((p, t, k))
            done_item[p : p + k] = done_text[t : t + k] = [True] * k
        if matches:  # what is left of matches that others cut into may still be this long
            continue
        size = size // 2 if size > 2 * least else least if size > least else 0
    return tiles


def coverage(item: np.ndarray, text: np.ndarray, least: int = SEED_TOKENS) -> float:
    """Share of the item's tokens under tiles; both are token hashes, zero a gap in the text."""
    if not len(item):
        return 0.0
    kinds, numbers = np.unique(np.concatenate([item, text]), return_inverse=True)
    numbers = np.where(kinds == 0, -1, np.arange(len(kinds)))[numbers].tolist()
    return sum(k for *_, k in greedy_tiles(numbers[: len(item)], numbers[len(item) :], least)) / len(item)


def seed_keys(tokens: np.ndarray) -> np.ndarray:
    """A hash of each run of ``SEED_TOKENS`` tokens."""
    n = len(tokens) - SEED_TOKENS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(SEED_TOKENS):
        key = key * np.uint64(0x100000001B3) + tokens[k : k + n] + np.uint64(7)
        key ^= key >> np.uint64(31)
    return key


def around(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The tokens under the seeds that start at ``starts``, in order; a zero stands for what lies between."""
    inside = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + SEED_TOKENS, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(tokens[at], gaps, np.uint64(0))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """64-bit arrays as a column of lists."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a number of its own), item_id, tokens and n, their count, of each distinct test item; settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), lists([token_hashes(t.as_py()) for t in batch.column(1)])], ["item_id", "tokens"])

    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    found = rows.transform(mapped, run, "item_id bigint, tokens array<bigint>").withColumn("n", F.size("tokens")).withColumn("item", F.monotonically_increasing_id())
    return settled(found.where(F.col("n") >= SEED_TOKENS), "items")


def seeds_of(items: DataFrame) -> DataFrame:
    """seed, item, n and weight: at how many places the item has the seed; settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [seed_keys(t.values.to_numpy(zero_copy_only=False).view(np.uint64)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists(keys)], ["item", "n", "seeds"])

    found = items.select("item", "n", "tokens").transform(mapped, run, "item bigint, n int, seeds array<bigint>")
    return settled(found.select("item", "n", F.explode("seeds").alias("seed")).groupBy("seed", "item", "n").agg(F.count(F.lit(1)).alias("weight")), "item-seeds")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Two bits of each seed in a table of bounded size, gathered by the tasks in bitmaps."""
    count = seeds.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * count).bit_length()))
    mask = F.lit((1 << bits) - 1).cast("bigint")
    places = seeds.select(F.explode(F.array(F.col("seed").bitwiseAND(mask), F.shiftrightunsigned("seed", 32).bitwiseAND(mask))).alias("at")).select((F.col("at") + 1).alias("at"))
    maps = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in maps.collect():  # at most 2^MOST_BITS bits
        table[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["map"], np.uint8)
    return table


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which seeds the filter lets through."""
    found, mask = np.ones(len(keys), bool), np.uint64(len(table) * 8 - 1)
    for at in (keys & mask, (keys >> np.uint64(32)) & mask):
        found &= (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def seeded(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """row, doc_id, text_key, the tokens under seeds that pass the filter and these seeds, of each document with any; settled."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens, seeds = [], [], []
            for i, text in enumerate(batch.column(2)):
                own = token_hashes(text.as_py())
                keys = seed_keys(own)
                at = np.flatnonzero(may_hold(shared.value, keys))
                if len(at):
                    ids.append(i)
                    tokens.append(around(own, at))
                    seeds.append(np.unique(keys[at]))
            if ids:
                some = pa.array(ids, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), lists(tokens), lists(seeds)], ["doc_id", "text_key", "tokens", "seeds"])

    rows = docs.select(F.col("doc_id").cast("bigint"), text_key().alias("text_key"), "text")
    found = rows.transform(mapped, run, "doc_id bigint, text_key bigint, tokens array<bigint>, seeds array<bigint>")
    return settled(found.withColumn("row", F.monotonically_increasing_id()), "seeded")


HITS = "doc_id bigint, text_key bigint, item_id bigint, coverage double"


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """doc_id, text_key (hash of the text), item_id and coverage of each leak, settled."""
    items = items_of(benchmark)
    seeds = seeds_of(items)
    found = seeded(docs, seed_filter(seeds.select("seed").distinct()))
    # Tiles that cover c tokens hold c / 4 whole seeds or more, so pairs with fewer can't reach the threshold.
    shared = found.select("row", F.explode("seeds").alias("seed")).join(few(seeds), "seed")
    pairs = shared.groupBy("row", "item", "n").agg(F.sum("weight").alias("places")).where(F.col("places") * SEED_TOKENS >= least * F.col("n") - 1e-9)
    pairs = settled(pairs.select("row", "item"), "seed-pairs")
    size = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = items.select("item", "item_id", F.col("tokens").alias("wanted"))
    tiled = pairs.join(found.drop("seeds"), "row").join(F.broadcast(held) if size <= SENT_TOKENS else held, "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [coverage(*(x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in pair)) for pair in zip(batch.column(4), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shares, pa.float64())], ["doc_id", "text_key", "item_id", "coverage"])

    hits = tiled.select("doc_id", "text_key", "item_id", "tokens", "wanted").transform(mapped, run, HITS)
    return settled(hits.where(F.col("coverage") >= least), "leaks")


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """``docs`` without those that a test item has leaked into; columns are kept."""
    return without(docs, leaks(docs, benchmark, least))


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """A row for each document: doc_id, leaked, items that have leaked into it (ascending) and best_coverage of these (0 if none)."""
    hits = leaks(docs, benchmark, least)
    each = hits.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("best_coverage"))
    each = few(settled(each.withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"}), "leaked"))
    rows = docs.select(F.col("doc_id").cast("bigint"), text_key().alias("key"))
    joined = rows.join(each, rows["doc_id"].eqNullSafe(each["hit_id"]) & (rows["key"] == each["hit_key"]), "left")
    return joined.select("doc_id", F.col("items").isNotNull().alias("leaked"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("best_coverage", F.lit(0.0)).alias("best_coverage"))
