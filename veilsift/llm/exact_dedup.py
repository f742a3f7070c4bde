"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Each text is hashed once, where it lies. Memtables (shares of the hashed rows) are combined and flushed as runs: files sorted
by digest, one for each bucket of digests, with Parquet's Bloom filter of their digests. Compaction merges two runs of a
level into one of the next; runs are bucketed alike, so the merge join reads bucket by bucket and shuffles nothing. It
keeps, for each digest, the smallest identifier under (most code points, then doc_id) and the number of rows. Digests with more
than one row are hits. A filter of bounded size over the hits tells which rows and texts can belong to one; only those are
looked up, and the texts behind each hit are compared byte by byte before the rows count as equal.

Edge cases: a null text counts as empty, and all empty texts are equal; a null doc_id is larger than any other; of rows
that repeat one doc_id and text, one stays; an empty table gives an empty result; columns other than doc_id and text
are ignored and may have any name. Texts of any length are hashed whole.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.llm.common import few, own_column, settled, text_key, without
from veilsift.shared import shared_path

#: Memtables.
RUNS = 3
#: Hits that are sent to all tasks, at some 400 bytes each in memory; more are joined by a shuffle.
SENT_HITS = 50_000
#: Bits of a filter as a power of two: by the number of keys, up to 16 MB.
LEAST_BITS, MOST_BITS = 15, 27
BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "65536"}


def squeezed(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def merged(entries: DataFrame) -> DataFrame:
    """The smallest order and the number of members of each digest."""
    return entries.groupBy("digest").agg(F.min("order").alias("order"), F.sum("members").alias("members"))


class MergeIndex:
    """Runs of (digest, order, members) in levels under ``path`` in the shared folder; ``close`` drops them."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or shared_path(spark, "lsm")
        self.buckets, self.levels = int(spark.conf.get("spark.sql.shuffle.partitions")), [[]]

    def flush(self, entries: DataFrame) -> None:
        """Combines a memtable's entries and writes them as a run of the lowest level."""
        self.put(merged(entries), 0)

    def put(self, run: DataFrame, level: int) -> None:
        """Writes a run; two of a level are merged into one of the next."""
        name = f"lsm_{uuid.uuid4().hex}"
        run.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").options(**BLOOM, path=f"{self.path}/{name}").saveAsTable(name)
        self.levels[level].append(name)
        if len(self.levels[level]) == 2:
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.put(self.of(full), level + 1)
            self.drop(full)

    def of(self, names: list[str]) -> DataFrame:
        """Some runs merged. The first two are bucketed alike and so meet where they lie."""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).select(F.col("digest").alias("digest2"), F.col("order").alias("order2"), F.col("members").alias("members2"))
            both = rows.join(more.hint("merge"), F.col("digest") == F.col("digest2"), "full")
            none = F.lit(0).cast("bigint")
            rows = both.select(F.coalesce("digest", "digest2").alias("digest"), F.least("order", "order2").alias("order"), (F.coalesce("members", none) + F.coalesce("members2", none)).alias("members"))
        return rows

    def live(self) -> list[str]:
        return [name for level in reversed(self.levels) for name in level]

    def entries(self) -> DataFrame:
        return self.of(self.live())

    def lookup(self, *digests: str) -> DataFrame:
        """Entries of a few digests. The comparison reaches the files, whose ranges and Bloom filters tell which row groups
        need no reading."""
        found = [self.spark.table(name).where(F.col("digest").isin(*digests)) for name in self.live()]
        return merged(reduce(DataFrame.unionByName, found))

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def close(self) -> None:
        self.drop(self.live())
        self.levels = [[]]


class Filter:
    """Which keys (longs) may be among those of a table: bitmaps of bounded size in all, made by the tasks that hold the keys."""

    def __init__(self, keys: DataFrame, count: int) -> None:
        """``keys``: a column ``key``; ``count``: how many there are about."""
        self.bits = min(MOST_BITS, max(LEAST_BITS, (16 * count).bit_length()))
        places = keys.select((self.place(F.col("key")) + 1).alias("at"))
        maps = places.groupBy(F.bitmap_bucket_number("at").alias("__page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__map"))
        self.maps = settled(maps, "filter")

    def place(self, key: Column) -> Column:
        return key.bitwiseAND(F.lit((1 << self.bits) - 1).cast("bigint"))

    def told(self, rows: DataFrame, key: Column) -> DataFrame:
        """``rows`` with ``__may``: false if the key is none of the table's."""
        at = self.place(key)
        own = rows.withColumns({"__at": (at % 32768).cast("int"), "__page": (F.floor(at / 32768) + 1).cast("bigint")})
        octet = F.conv(F.hex(F.substr("__map", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        joined = own.join(F.broadcast(self.maps), "__page", "left")  # at most 2^MOST_BITS bits
        bit = F.getbit(F.coalesce(octet, F.lit(0)), F.col("__at") % 8)
        return joined.withColumn("__may", bit == 1).drop("__at", "__page", "__map")


def exact_duplicates(docs: DataFrame, digest=sha256_of) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. ``digest``: Column -> Column, of the squeezed text."""
    return decided(docs, digest).drop("text_key")


def decided(docs: DataFrame, digest=sha256_of, runs: int = RUNS) -> DataFrame:
    """``exact_duplicates`` with text_key, the key of the row's own text."""
    spark = docs.sparkSession
    base = docs.select("doc_id", text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))

    def entries(texts: DataFrame) -> DataFrame:
        """digest and order of texts (with norm)."""
        order = F.struct((-F.length("text")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"), F.monotonically_increasing_id().alias("row"))
        return texts.select("digest", order.alias("order"), F.lit(1).cast("bigint").alias("members"))

    rows = settled(entries(base.withColumn("digest", digest(squeezed(F.col("text"))))), "digests")
    index, files = MergeIndex(spark), sorted(rows.inputFiles())
    for share in [files[r::runs] for r in range(runs) if files[r::runs]]:
        index.flush(spark.read.schema(rows.schema).parquet(*share))
    if files:
        hits = settled(index.entries().where("members > 1").select("digest", F.col("order").alias("best"), "members"), "hits")
    else:
        hits = rows.select("digest", F.col("order").alias("best"), "members")
    index.close()
    joined = resolved(rows, hits)
    unequal = differing(base, joined, hits, digest)
    if not unequal.isEmpty():  # texts that share a digest without being equal: their own bytes take the digest's place
        own = base.withColumn("norm", squeezed(F.col("text"))).withColumn("digest", digest(F.col("norm"))).join(unequal, "digest", "left_semi")
        rows = settled(rows.join(unequal, "digest", "left_anti").unionByName(entries(own.withColumn("digest", F.concat("digest", F.lit(":"), "norm")))), "split")
        joined = resolved(rows, settled(merged(rows).where("members > 1").withColumnRenamed("order", "best"), "split-hits"))
    return joined.select(
        F.col("order.doc_id").alias("doc_id"),
        F.col("best.doc_id").alias("keep_id"),
        F.col("members").alias("group_size"),
        (F.col("order.row") == F.col("best.row")).alias("kept"),
        F.substring_index("digest", ":", 1).alias("text_sha256"),
        F.col("order.text_key").alias("text_key"),
    )


def resolved(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """digest, order, best and members of each row: those that the hits' filter lets through are looked up, others are alone."""
    told = Filter(hits.select(F.xxhash64("digest").alias("key")), hits.count()).told(rows.select("digest", "order"), F.xxhash64("digest"))
    looked = told.where("__may").drop("__may").join(few(hits, SENT_HITS), "digest", "left")
    looked = looked.select("digest", "order", F.coalesce("best", "order").alias("best"), F.coalesce("members", F.lit(1).cast("bigint")).alias("members"))
    return looked.unionByName(told.where("not __may").select("digest", "order", F.col("order").alias("best"), F.lit(1).cast("bigint").alias("members")))


def differing(base: DataFrame, joined: DataFrame, hits: DataFrame, digest) -> DataFrame:
    """Digests of hits whose texts aren't all the same bytes: the least and the greatest differ. Only texts that the filter
    over the hits' text keys lets through are read again; partial aggregation sends each task's texts once."""
    keys = settled(joined.where("members > 1").select(F.col("order.text_key").alias("key")), "hit-keys")
    texts = Filter(keys, keys.count()).told(base, F.col("text_key")).where("__may").withColumn("norm", squeezed(F.col("text"))).withColumn("digest", digest(F.col("norm")))
    texts = texts.select("digest", "norm").join(few(hits.select("digest"), SENT_HITS), "digest", "left_semi")
    return settled(texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("digest"), "unequal")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    found = settled(decided(docs).select("doc_id", "text_key", "kept"), "decided")
    stay = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    again = found["doc_id"].eqNullSafe(stay["__id"]) & (found["text_key"] == stay["__key"])
    dropped = found.where("not kept").join(stay, again, "left_semi")  # rows that repeat one that stays
    gone = found.where("not kept").join(stay, again, "left_anti")
    out = without(docs, gone)
    if dropped.isEmpty():
        return out
    own = own_column(docs)
    return out.withColumn(own, text_key()).dropDuplicates(["doc_id", own]).drop(own)
