"""SimHash fingerprints and near-duplicate components by tiled exact comparison.

Fingerprints are sorted into tiles by the population counts of their bit blocks. Two fingerprints that differ in r bits
have block counts whose absolute differences add up to r at most, so tile pairs beyond the radius are skipped without
loss; the others are compared in full by numpy exclusive-or and bit counts. A tile with more rows than ``CHUNK``, residents
and visitors alike, is cut into chunks that meet by twos in a task each, so memory is bounded and no comparison lost. Each
part returns a spanning star for each group that it connects, never all pairs, and the stars are merged by ``components``.

Edge cases: a null or blank text has fingerprint zero, linked like any other; a text with fewer words than a shingle is
one shingle; repeated rows and equal texts share a fingerprint; a null doc_id is no smallest identifier unless all of
a group are null; an empty table gives an empty result; other columns are ignored. Long texts are hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import components, few, looked_up, mapped, settled, text_key, without

CHUNK = 16_384
SLICE = 65_536
SEED = 42
_BITS = np.arange(64, dtype=np.uint64)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, A-Z in lower case and nothing else changed (as bytes lower and split do)."""
    return (text or b"").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words joined by a space; of the whole sequence if it is shorter."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.fromiter((digest(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)), np.uint64, len(words) - size + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        octets = hashes[i : i + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.where(2 * total > len(hashes), np.uint64(1) << _BITS, np.uint64(0))))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and its 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([majority_bits(shingle_hashes(words_of(t.as_py()), shingle)) for t in batch.column(1).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "mark"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").transform(mapped, run, "doc_id bigint, mark bigint")


#: Blocks of a tile's key, and how many times fewer pairs than all they leave for random fingerprints at radius 2.
PRUNED = {4: 60, 8: 2700}


def blocks_for(marks: int, most: int = 200_000) -> int:
    """Fewest blocks that leave each fingerprint ``most`` partners on average; the result doesn't depend on it."""
    return next((b for b, times in PRUNED.items() if marks / times <= most), max(PRUNED))


def half_ball(blocks: int, radius: int) -> np.ndarray:
    """Offsets of block counts, not farther than ``radius`` in sum, that come after zero in lexicographic order; zero first."""
    found, todo = [], [((), radius)]
    for _ in range(blocks):
        todo = [(x + (d,), left - abs(d)) for x, left in todo for d in range(-left, left + 1)]
    found = [x for x, _ in todo if x > (0,) * blocks]
    return np.array([(0,) * blocks, *sorted(found)], np.int64)


def tiles(marks: DataFrame, radius: int, blocks: int) -> DataFrame:
    """tile, mark, resident: each fingerprint in its own tile and as a visitor in those below it within the radius."""
    shifts, width = half_ball(blocks, radius), 64 // blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                own = batch.column(0).slice(lo, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
                mask = np.uint64((1 << width) - 1)
                counts = np.stack([np.bitwise_count((own >> np.uint64(i * width)) & mask) for i in range(blocks)], axis=1).astype(np.int64)
                for k, shift in enumerate(shifts):
                    near = counts - shift
                    fits = ((near >= 0) & (near <= width)).all(axis=1)
                    key = np.zeros(int(fits.sum()), np.int64)
                    for i in range(blocks):
                        key = key * (width + 1) + near[fits, i]
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[fits].view(np.int64)), pa.array(np.full(len(key), k == 0))], ["tile", "mark", "resident"])

    return marks.transform(mapped, run, "tile bigint, mark bigint, resident boolean")


def blocks(own: np.ndarray, home: np.ndarray, cells: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of the rows to compare, each with each: every pair that has a resident, in blocks of bounded size.

    ``own``: the chunk of each row; if there are two, only pairs across them are compared. ``home``: which are residents.
    """
    kinds = np.unique(own)
    if len(kinds) == 1:
        here, others = np.flatnonzero(home), np.flatnonzero(~home)
        step = max(1, cells // max(1, len(own)))
        for lo in range(0, len(here), step):
            yield here[lo : lo + step], np.r_[here[lo:], others]
        return
    a, b = (np.flatnonzero(own == k) for k in kinds)
    for left, right in ((a[home[a]], b), (b[home[b]], a[~home[a]])):
        step = max(1, cells // max(1, len(right)))
        for lo in range(0, len(left) if len(right) else 0, step):
            yield left[lo : lo + step], right


def linked(marks: np.ndarray, own: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Smallest index that each row is connected with. ``marks``: n rows of one or more 64-bit words."""
    label = np.arange(len(marks))
    for left, right in blocks(own, home):
        near = distances(marks[left], marks[right]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            met = np.unique(label[np.r_[left[i], right[near[i]]]])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return label


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of all rows of two tiles, by exclusive-or and bit counts of their words."""
    apart = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0]).astype(np.uint16)
    for w in range(1, left.shape[1]):
        apart += np.bitwise_count(left[:, None, w] ^ right[None, :, w])
    return apart


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole parts of tiles, and where each part starts and ends; rows come sorted by tile and part."""
    left: list[pa.Table] = []

    def ends_of(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        keys = np.stack([table.column(c).to_numpy() for c in ("tile", "part")], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(keys)]
        return table, starts[ends - starts > 1], ends[ends - starts > 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        last = tuple(batch.column(c)[-1].as_py() for c in ("tile", "part"))
        same = (batch.column("tile").to_numpy() == last[0]) & (batch.column("part").to_numpy() == last[1])
        cut = int(np.argmax(same))
        if cut or (left and tuple(left[0].column(c)[0].as_py() for c in ("tile", "part")) != last):
            left.append(pa.Table.from_batches([batch.slice(0, cut)]))
            yield ends_of(pa.concat_tables(left))
            left = []
        left.append(pa.Table.from_batches([batch.slice(cut)]))
    if left:
        yield ends_of(pa.concat_tables(left))


def words_in(table: pa.Table, words: tuple[str, ...]) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.stack([table.column(c).to_numpy().view(np.uint64) for c in words], axis=1)


def chunks_in(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The chunk of each row of a part, and if it is a resident of the tile."""
    return table.column("own").to_numpy(), table.column("resident").to_numpy(zero_copy_only=False).astype(bool)


def stars(batches: Iterator[pa.RecordBatch], radius: int, words: tuple[str, ...], node: str) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a spanning star for each group within a tile; rows come sorted by tile and part.

    ``words``: the columns of a fingerprint's 64-bit words; ``node``: the column of the names to put into edges.
    """
    for table, starts, ends in grouped(batches):
        marks, names, own, home = words_in(table, words), table.column(node).to_numpy(), *chunks_in(table)
        for lo, hi in zip(starts, ends, strict=True):
            label = linked(marks[lo:hi], own[lo:hi], home[lo:hi], radius)
            tied = np.flatnonzero(label != np.arange(hi - lo))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(names[lo + tied]), pa.array(names[lo + label[tied]])], ["a", "b"])


def dealt(placed: DataFrame, node: str) -> DataFrame:
    """``placed`` (tile, resident, ``node``, ...) with ``own``, the row's chunk of its tile, and ``part``, two chunks that meet,
    in the order that ``grouped`` takes. A tile of at most ``CHUNK`` rows is one chunk."""
    heavy = settled(placed.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select("tile", F.ceil(F.col("n") / CHUNK).alias("parts")), "heavy")
    if heavy.isEmpty():
        split = placed.withColumn("own", F.lit(0).cast("bigint")).withColumn("part", F.lit(0).cast("bigint"))
    else:
        split = placed.join(few(heavy), "tile", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        split = split.withColumn("own", F.pmod(F.xxhash64(node), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        split = split.withColumn("part", F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).drop("parts", "other")
    return split.repartition("tile", "part").sortWithinPartitions("tile", "part")


def compared(placed: DataFrame, radius: int, words: tuple[str, ...], node: str) -> DataFrame:
    """Edges (a, b) that connect the rows of ``placed`` (tile, resident, ``node``, ``words``) that share a tile and lie within ``radius``."""
    return dealt(placed, node).transform(mapped, lambda batches: stars(batches, radius, words, node), "a bigint, b bigint")


def near_edges(marks: DataFrame, radius: int = 2) -> DataFrame:
    """Edges that connect the distinct fingerprints of ``marks`` (column mark) within ``radius`` bits, exactly."""
    return compared(settled(tiles(marks, radius, blocks_for(marks.count())), "tiles"), radius, ("mark",), "mark")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, mark (signed 64-bit fingerprint), component_id: the smallest doc_id reachable by links."""
    marked = settled(fingerprints(docs, shingle), "marks")
    least = settled(marked.groupBy("mark").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_edges(least.select("mark"), radius))
    tied = least.join(roots, F.col("mark") == F.col("node"), "left").withColumn("root", F.coalesce("root", "mark"))
    tied = tied.select("mark", "least", "root")
    smallest = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    told = settled(tied.join(smallest, "root").select("mark", "component_id"), "told")
    return looked_up(marked, told, "mark").select("doc_id", "mark", "component_id")


def hex_mark(mark):
    """16 lower-case hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(mark)), 16, "0")



#: For similarity of word sets: shingles, 64-bit words of a fingerprint, bands of least hashes and hashes in a band.
WIDE_SHINGLE, WIDE_WORDS, BANDS, ROWS = 5, 4, 16, 4
_STRIDES = (np.random.default_rng(20).integers(1, 1 << 63, WIDE_WORDS + BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
WIDE = ("m0", "m1", "m2", "m3")


#: Sets of fewer shingles are counted whatever their bits: majorities of few hashes often tie, and differ more.
SHORT = 20
#: Most shingles of the rows that a block of a tile holds; a task has two blocks at once.
BLOCK = 1 << 20


def loose_for(similarity: float, bits: int = 64 * WIDE_WORDS) -> int:
    """Differing bits beyond which two sets aren't counted: the mean for equally large sets of that Jaccard similarity
    plus five standard deviations."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * share + 5 * np.sqrt(bits * share * (1 - share))))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the set of five-word shingles' hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                sets = [np.unique(shingle_hashes(words_of(t.as_py()), WIDE_SHINGLE)).view(np.int64) for t in some.column(2).cast(pa.binary())]
                ends = np.cumsum([0, *map(len, sets)])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([*some.columns[:2], held], ["doc_id", "text_key", "shingles"])

    return docs.select("doc_id", "text_key", "text").transform(mapped, run, "doc_id bigint, text_key bigint, shingles array<bigint>")


def sets_for(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks`` with the set of shingles of each row, made anew from the texts of these rows alone."""
    keys = few(marks.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), "text")
    rows = rows.join(keys, rows["doc_id"].eqNullSafe(keys["__id"]) & (rows["text_key"] == keys["__key"]), "left_semi")
    sets = shingle_sets(rows).dropDuplicates(["doc_id", "text_key"]).withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    return marks.join(sets, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))).drop("__id", "__key")


def near_pairs(marks: np.ndarray, sizes: np.ndarray, bands: np.ndarray, band: int, own: np.ndarray, similarity: float, loose: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (within a chunk i < j), in blocks and sorted by i: those whose sets may have the similarity and that
    share no band before ``band``, so that a pair is met in one tile only."""
    for left, right in blocks(own, np.ones(len(own), bool), 1_000_000):
        i, j = np.nonzero((distances(marks[left], marks[right]) <= loose) | (sizes[left][:, None] < SHORT) | (sizes[right][None] < SHORT))
        i, j = left[i], right[j]
        may = ((i < j) | (own[i] != own[j])) & (np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]))
        for b in range(band):
            may &= bands[i, b] != bands[j, b]
        if may.any():
            yield i[may], j[may]


def bands_in(table: pa.Table) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in table.column("bands").chunks]).reshape(-1, BANDS)


def meetings(batches: Iterator[pa.RecordBatch], similarity: float, loose: int) -> Iterator[pa.RecordBatch]:
    """tile, band, node of the rows that have a pair to be counted in the tile; rows come sorted by tile and part."""
    for table, starts, ends in grouped(batches):
        marks, bands, sizes = words_in(table, WIDE), bands_in(table), table.column("size").to_numpy()
        tile, band, names = (table.column(c).to_numpy() for c in ("tile", "band", "node"))
        own, met = chunks_in(table)[0], np.zeros(table.num_rows, bool)
        for lo, hi in zip(starts, ends, strict=True):
            for i, j in near_pairs(marks[lo:hi], sizes[lo:hi], bands[lo:hi], int(band[lo]), own[lo:hi], similarity, loose):
                met[lo + i] = met[lo + j] = True
        if met.any():
            yield pa.RecordBatch.from_arrays([pa.array(tile[met]), pa.array(band[met], pa.int32()), pa.array(names[met])], ["tile", "band", "node"])


def counted(batches: Iterator[pa.RecordBatch], similarity: float, loose: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of pairs whose sets of shingles have the similarity, counted; rows come sorted by tile and part.

    Every pair of a part is counted unless edges counted before connect it; a part of two blocks has pairs across them only.
    """
    for table, starts, ends in grouped(batches):
        marks, bands, band, own, names = words_in(table, WIDE), bands_in(table), *(table.column(c).to_numpy() for c in ("band", "own", "node"))
        shingles = table.column("shingles")
        for lo, hi in zip(starts, ends, strict=True):
            held = shingles.slice(lo, hi - lo)
            sizes = np.concatenate([c.value_lengths().to_numpy() for c in held.chunks]).astype(np.int64)
            ids = np.unique(np.concatenate([c.flatten().to_numpy() for c in held.chunks]), return_inverse=True)[1]
            at, flags, label = np.r_[0, np.cumsum(sizes)], np.zeros(len(ids), bool), np.arange(hi - lo)
            a, b = [], []
            for left, right in near_pairs(marks[lo:hi], sizes, bands[lo:hi], int(band[lo]), own[lo:hi], similarity, loose):
                cuts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else []
                for i, js in zip(left[cuts].tolist(), np.split(right, cuts[1:]), strict=True) if len(cuts) else ():
                    js = js[label[js] != label[i]]
                    if not len(js):
                        continue
                    mine = ids[at[i] : at[i + 1]]
                    flags[mine] = True
                    to = np.cumsum(sizes[js])
                    places = np.arange(to[-1]) + np.repeat(at[js] - to + sizes[js], sizes[js])
                    shared = np.diff(np.r_[0, np.cumsum(flags[ids[places]])][np.r_[0, to]])
                    flags[mine] = False
                    js = js[shared >= similarity * (sizes[i] + sizes[js] - shared)]
                    if len(js):
                        groups, first = np.unique(label[js], return_index=True)
                        a += [names[lo + i]] * len(first)
                        b += names[lo + js[first]].tolist()
                        label[np.isin(label, groups)] = label[i]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def similar_edges(met: DataFrame, held: DataFrame, similarity: float, loose: int) -> DataFrame:
    """Edges (a, b) between the rows that meet in a tile (``met``: tile, band, node), in blocks of bounded size that a task
    takes by twos. ``held``: node, its size, fingerprint, bands and shingles."""
    total = met.join(held.select("node", "size"), "node").groupBy("tile").agg(F.ceil(F.greatest(F.sum("size") / BLOCK, F.count(F.lit(1)) / CHUNK)).alias("parts"))
    split = met.join(total.where("parts > 1"), "tile", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("own", F.pmod(F.xxhash64("node"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    part = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
    split = split.select("tile", part.alias("part"), "band", "node", "own")
    rows = split.join(held.select("node", *WIDE, "bands", "shingles"), "node").repartition("tile", "part").sortWithinPartitions("tile", "part")
    return rows.transform(mapped, lambda batches: counted(batches, similarity, loose), "a bigint, b bigint")


def wide_marks(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, a 256-bit fingerprint (m0 to m3) of the set of five-word shingles, its size, its band keys and a
    128-bit digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, sizes, bands, sets = [], [], [], []
            for t in batch.column(2).cast(pa.binary()):
                own = np.unique(shingle_hashes(words_of(t.as_py()), WIDE_SHINGLE))
                sizes.append(len(own))
                sets.append(xxhash.xxh3_128_digest(own.tobytes()))
                marks.append([majority_bits(mixed(own * x)) for x in _STRIDES[:WIDE_WORDS]])
                least = [int(mixed(own * x).min()) if len(own) else 0 for x in _STRIDES[WIDE_WORDS:]]
                bands.append([hash((i, *least[i * ROWS : (i + 1) * ROWS])) for i in range(BANDS)])
            columns = np.array(marks, np.uint64).reshape(-1, WIDE_WORDS).view(np.int64).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "text_key", *WIDE, "size", "bands", "set"])

    return docs.select(F.col("doc_id").cast("bigint"), text_key().alias("text_key"), "text").transform(mapped, run, "doc_id bigint, text_key bigint, m0 bigint, m1 bigint, m2 bigint, m3 bigint, size bigint, bands array<bigint>, set binary")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the high bits of a product over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def surplus(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id and text_key of the documents that are similar to one with a smaller doc_id: sets of five-word shingles with a
    Jaccard similarity of ``similarity`` or more.

    Documents of one set of shingles are compared as one. They meet in tiles of those that share the least hashes of a band. Fingerprints far apart settle a pair of
    sets that aren't short; the sets of all other pairs are counted in the first tile where they meet, unless counted pairs of the tile connect them already.
    So every document of a group has a partner of counted similarity. All connected documents are a group. A null doc_id
    comes last; rows that repeat the one that stays stay with it.
    """
    every = settled(wide_marks(docs), "wide")
    marks = settled(every.dropDuplicates(["set"]).withColumn("node", F.monotonically_increasing_id()), "sets-of")
    placed = marks.select(F.posexplode("bands").alias("band", "key"), "node", "size", *WIDE, "bands")
    placed = placed.select(F.xxhash64("band", "key").alias("tile"), F.lit(True).alias("resident"), "band", "node", "size", *WIDE, "bands")
    loose = loose_for(similarity)
    met = settled(dealt(placed, "node").transform(mapped, lambda batches: meetings(batches, similarity, loose), "tile bigint, band int, node bigint").distinct(), "met")
    ends = settled(marks.join(met.select("node").distinct(), "node", "left_semi"), "ends")
    roots = components(settled(similar_edges(met, settled(sets_for(docs, ends), "shingles"), similarity, loose), "similar-edges"))
    # Sets with a root, and those of several rows: their rows are looked up, all others are alone.
    many = every.groupBy("set").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("set")
    rooted = marks.select("set", "node").join(roots, "node", "left").join(many.withColumn("again", F.lit(True)), "set", "left")
    rooted = settled(rooted.where("root is not null or again").select("set", F.coalesce("root", "node").alias("root")), "rooted")
    named = settled(looked_up(every.select("set", "doc_id", "text_key"), rooted, "set").where("root is not null"), "groups")
    first = settled(named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")), "firsts")
    others = looked_up(named, first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))))
    return others.select("doc_id", "text_key")


def without_similar(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of similar documents; columns are kept."""
    return without(docs, settled(surplus(docs, similarity), "similar"))
