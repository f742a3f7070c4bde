"""Shared plumbing of the training-data operators: shared folders, settled tables, row removal, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.shared import shared_path

#: Ids or digests of at most this many rows are broadcast (16 bytes a row and more in memory); beyond it a shuffle join does it.
BROADCAST_ROWS = 200_000


def settled(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends at a table that outlives executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes that go to a Python worker at once. Spark copies each batch through buffers outside the heap that only a
#: garbage collection frees; with its 64 MB these can fill an executor before there is one.
BATCH_BYTES = "8m"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of bounded bytes. The bound is a setting of the session and stays."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows with about ``most`` bytes of text, and where each starts."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its row count has been checked to be at most ``limit``; else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Keys that more rows than this share, and more than one in ``HOT_SHARE`` of all, are hot: at most ``HOT_SHARE`` keys.
HOT_ROWS, HOT_SHARE = 10_000, 10_000


def looked_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a key) where the key is found, else nulls.

    The rows of hot keys stay where they are and look in a broadcast of at most ``HOT_SHARE`` rows, so no task gathers the
    rows of one key. ``left`` and ``right`` are read more than once: settled tables.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(HOT_ROWS, left.count() // HOT_SHARE))
    hot = settled(counts.select(key), "hot")
    if hot.isEmpty():
        return left.join(right, key, "left")
    told = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key, "left")
    return told.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left"))


def text_key(text: Column | str = "text") -> Column:
    """With doc_id it names a row even where ids are missing or repeat; rows that agree in both are copies of each other."""
    return F.xxhash64(text)


def own_column(df: DataFrame) -> str:
    """A name that no column of ``df`` has, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    return next(name for name in (f"__own{i}" for i in range(len(taken) + 1)) if name not in taken)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text's key are in ``dropped`` (doc_id, text_key; null equals null).

    A dropped set of checked size is broadcast, so that texts stay where they are; a larger one is shuffled. The columns
    of ``docs`` may have any name.
    """
    gone = few(dropped.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    own = own_column(docs)
    rows = docs.withColumn(own, text_key())
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows[own] == gone["gone_key"]), "left_anti").drop(own)


def lowest(edges: DataFrame) -> DataFrame:
    """u and m, its smallest neighbour, as a table of its own: sent to all tasks if few, else joined by a shuffle whose
    large side Spark can split where one node has very many edges."""
    return few(settled(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (long columns ``a``, ``b``): rows ``node``, ``root``, the smallest node reachable.

    Alternates large-star and small-star steps; each round is a map-side combined minimum and an equi-join, and is
    settled in the shared folder, so nothing is collected and lineage stays short. Self-loops and repeated edges have no
    effect; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = settled(e, "cc"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(lowest(large), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = settled(small.where("u <> v").distinct(), "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
