"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``VNODES`` points on a 64-bit ring; a key belongs to the first point clockwise of its hash. Keys arrive in
a fixed order; a key that meets a full shard continues clockwise to the next shard with room, so no shard exceeds its
capacity. All keys of one arc have one preference list, so a plan over cells (arrival bucket, arc) replaces the walk of
single keys: the plan is made on the driver from at most ``BUCKETS * shards * VNODES`` counts whatever the input's size,
and a key's rank in its cell tells its shard and slot.

``load_factor`` 1 gives capacities that differ by one at most and add up to the number of rows, so the counts of shards
do so too (law ``rows``); a larger one moves fewer keys off their first shard.

Edge cases: a null key is hashed as a key of its own; a null text has size 1 and crc 0; repeated rows get slots of their
own, and rows that repeat a key arrive in all buckets by their texts; an empty table gives an empty result; other columns
are ignored, whatever their names. Texts are measured whole.
"""

from __future__ import annotations

import bisect
import math

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilsift.llm.common import settled

VNODES, BUCKETS = 64, 16
RING = 1 << 63


class Ring:
    """The points of ``shards`` shards, sorted; arcs are numbered by the point that ends them."""

    def __init__(self, shards: int, vnodes: int = VNODES) -> None:
        points = sorted((xxhash.xxh64_intdigest(f"shard-{s}/{v}".encode()) % RING, s) for s in range(shards) for v in range(vnodes))
        self.places, self.owners, self.shards = [p for p, _ in points], [s for _, s in points], shards

    def arc(self, place: int) -> int:
        return bisect.bisect_left(self.places, place) % len(self.places)

    def preferences(self, arc: int) -> list[int]:
        """The shards in the order in which they are met clockwise from an arc."""
        return list(dict.fromkeys(self.owners[(arc + i) % len(self.owners)] for i in range(len(self.owners))))


def capacities(rows: int, shards: int, load_factor: float) -> list[int]:
    """Rows that each shard takes at most."""
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil(load_factor * rows / shards)] * shards


def ring_plan(cells: dict[tuple[int, int], int], shards: int, load_factor: float = 1.0, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int]]:
    """(bucket, arc, first rank, shard, first slot) of each run of keys, from the number of keys in each (bucket, arc)."""
    ring, plan = Ring(shards, vnodes), []
    room, load = capacities(sum(cells.values()), shards, load_factor), [0] * shards
    wishes: dict[int, list[int]] = {}
    for (bucket, arc), n in sorted(cells.items()):
        rank = 0
        for s in wishes.setdefault(arc, ring.preferences(arc)):
            take = min(n - rank, room[s] - load[s])
            if take > 0:
                plan.append((bucket, arc, rank, s, load[s]))
                load[s] += take
                rank += take
            if rank == n:
                break
    return plan


def assign_shards(docs: DataFrame, shards: int = 16, load_factor: float = 1.0, key: str = "doc_id", vnodes: int = VNODES) -> DataFrame:
    """One row per input row: ``key``, size, text_crc32, home (the shard without bounds), shard and slot (gapless from 0)."""
    spark, ring = docs.sparkSession, Ring(shards, vnodes)
    name = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    place = F.shiftrightunsigned(F.xxhash64(name), 1)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(name, F.lit("arrival"), F.crc32(F.encode(text, "utf-8")), F.octet_length(text)), F.lit(BUCKETS)).cast("int").alias("bucket"),
        place.alias("place"),
    )
    # The arc: how many points lie before the place, by a table of the points for each of the ring's 4096 sectors.
    sectors = [bisect.bisect_left(ring.places, i << 51) for i in range(4097)]
    edges = spark.createDataFrame([(i, ring.places[sectors[i] : sectors[i + 1]], sectors[i]) for i in range(4096)], "sector int, inside array<bigint>, before int")
    rows = rows.withColumn("sector", F.shiftrightunsigned("place", 51).cast("int")).join(F.broadcast(edges), "sector")  # 4096 rows, however large the input
    arc = (F.col("before") + F.size(F.filter("inside", lambda p: p < F.col("place")))) % len(ring.places)
    rows = settled(rows.select(key, "size", "text_crc32", "bucket", "place", arc.cast("int").alias("arc")), "ring")
    cells = {(r["bucket"], r["arc"]): r["n"] for r in rows.groupBy("bucket", "arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most BUCKETS * points
    plan, homes = {}, ring.owners
    for bucket, a, rank, shard, slot in ring_plan(cells, shards, load_factor, vnodes):
        plan.setdefault((bucket, a), []).append((rank, shard, slot))
    table = spark.createDataFrame([(b, a, homes[a], runs) for (b, a), runs in plan.items()], T.StructType.fromDDL("bucket int, arc int, home int, runs array<struct<first:bigint, shard:int, slot:bigint>>"))
    within = Window.partitionBy("bucket", "arc").orderBy("place", key, "text_crc32", "size")
    ranked = rows.withColumn("rank", (F.row_number().over(within) - 1).cast("bigint")).join(F.broadcast(table), ["bucket", "arc"])  # as many rows as cells, bounded above
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    out = ranked.withColumn("run", run)
    return out.select(key, "size", "text_crc32", "home", F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("rank") - F.col("run.first")).alias("slot"))
