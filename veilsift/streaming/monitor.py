"""The resident monitor: changed artifacts are scanned as they change, and state tables keep what is live.

Cursors say how far each artifact has been read. A file that only grew, of an agent whose files do so, is read from its
cursor on and its findings are added; any other change, also one of equal size, replaces them. An artifact that is gone takes its findings along.
Micro-batches run one at a time and gather what changes meanwhile.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from veilsift import model
from veilsift.engine import Engine
from veilsift.operators import detect, relational
from veilsift.operators.state import State
from veilsift.sources.datasource import register
from veilsift.sources.stores import ADAPTERS, SCANNED_BY_DEFAULT

SECONDS_BETWEEN = 3
WHOLE_EVERY = 15 * 60


class Progress(StreamingQueryListener):
    """Hands the progress of streaming queries on, at most once in ``LEAST_SECONDS``: batch, rows and seconds."""

    LEAST_SECONDS = 0.7

    def __init__(self, tell: Callable[[int, int, float], None]) -> None:
        self.tell, self.last = tell, float("-inf")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        now = time.monotonic()
        if now - self.last >= self.LEAST_SECONDS:
            self.last = now
            self.tell(event.progress.batchId, event.progress.numInputRows, event.progress.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Monitor:
    """Keeps the state of one home folder. ``on_new``: called with a table of secrets seen for the first time."""

    def __init__(self, engine: Engine, state: State, tiers: tuple[str, ...] = SCANNED_BY_DEFAULT, excluded: DataFrame | None = None, on_new: Callable[[DataFrame], None] | None = None) -> None:
        self.engine, self.state, self.tiers, self.excluded, self.on_new = engine, state, tiers, excluded, on_new
        self.spark, self.whole_at = engine.spark, time.monotonic()
        state.opened_with(engine.key)

    def reconcile(self, enforce: bool = True) -> int:
        """Lists everything, scans what changed, forgets what is gone, and then redacts what policies ask for, unless
        ``enforce`` is false. Returns the number of artifacts scanned."""
        _, artifacts, gaps = self.engine.listed()
        artifacts = artifacts.where(F.col("tier").isin(list(self.tiers)))
        if self.excluded is not None:
            artifacts = relational.outside(artifacts, self.excluded)
        artifacts = artifacts.persist()
        cursors = self.state.read("cursors")
        gone = relational.vanished(cursors, artifacts)
        self.forget(gone.select("path").union(self.state.read("findings").select("path").distinct().join(artifacts.select("path"), "path", "left_anti")).distinct())
        n = self.absorb(relational.changed(artifacts, self.state.read("cursors")))
        self.state.write("gaps", self.state.read("gaps").where("reason.tag in ('corruptRecord', 'truncatedTail', 'oversizeRecord', 'offsetsUnreliable', 'binaryArtifact', 'unsupportedSchema')").unionByName(gaps).distinct())
        artifacts.unpersist()
        if enforce:
            self.auto_redact()
        return n

    def changed(self, paths: list[str]) -> int:
        """Takes in files that the caller says have changed or gone, as a change feed would. Returns the number scanned."""
        _, artifacts, _ = self.engine.listed()
        told = self.spark.createDataFrame([(p,) for p in paths], "path string")
        now = artifacts.where(F.col("tier").isin(list(self.tiers))).join(told, "path", "left_semi").select(*artifacts.columns)
        if self.excluded is not None:
            now = relational.outside(now, self.excluded)
        now = now.persist()
        self.forget(told.join(now, "path", "left_anti"))
        n = self.absorb(relational.changed(now, self.state.read("cursors")))
        self.merge_secrets()
        now.unpersist()
        return n

    def forget(self, paths: DataFrame) -> None:
        """Drops findings, gaps and cursors of paths."""
        paths = paths.persist()
        if not paths.isEmpty():
            for name in ("findings", "gaps", "cursors"):
                table = self.state.read(name)
                self.state.write(name, table.join(paths, "path", "left_anti").select(*table.columns))
        paths.unpersist()

    def absorb(self, changed: DataFrame) -> int:
        """Scans changed artifacts from where their cursors let them, and merges the findings."""
        c = self.state.read("cursors").select("path", F.col("device").alias("__d"), F.col("inode").alias("__i"), F.col("size").alias("__s"), F.col("offset").alias("__o"))
        tailed = F.col("adapter").isin([a.name for a in ADAPTERS if a.delta]) & (F.col("kind") == "jsonl")
        grown = tailed & F.col("device").eqNullSafe(F.col("__d")) & F.col("inode").eqNullSafe(F.col("__i")) & (F.col("size") > F.col("__s"))
        todo = changed.join(c, "path", "left").withColumn("delta", F.coalesce(grown, F.lit(False))).withColumn("start", F.when(F.col("delta"), F.col("__o")).otherwise(F.lit(0).cast("bigint")))
        todo = todo.withColumn("delta", F.col("delta") | tailed).drop("__d", "__i", "__s", "__o").persist()
        n = todo.count()
        if not n:
            todo.unpersist()
            return 0
        scanned = detect.scan_artifacts(todo, self.engine.key, self.engine.rules).persist()
        found = relational.one_for_each_place(detect.findings(scanned)).select(*model.names(model.FINDING)).persist()
        before = self.state.read("secrets").select("fingerprint")
        fresh = relational.new_secrets(relational.identities(found), before).persist()
        fresh.count()  # before the tables change that it is made from
        first_seen = not self.state.read("cursors").isEmpty()
        whole = todo.where("start = 0").select("path")
        self.state.replace_paths("findings", whole, found)
        stale = self.state.read("gaps").join(todo.select("path").distinct(), "path", "left_anti")  # a tail that was cut off is read again
        self.state.write("gaps", stale.select(*model.names(model.GAP)).unionByName(detect.gaps(scanned)))
        reached = scanned.where("reached is not null").groupBy("path").agg(F.max("reached").alias("offset"))
        cursors = todo.join(reached, "path", "left").select(*[x for x in model.names(model.CURSOR) if x != "offset"], F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset"))
        self.state.write("cursors", relational.upsert(self.state.read("cursors"), cursors, ["path"]).select(*model.names(model.CURSOR)))
        self.merge_secrets()
        if not fresh.isEmpty():
            if first_seen:
                self.state.log(fresh.select(F.lit("newSecret").alias("kind"), F.lit(None).cast("string").alias("adapter"), F.lit(None).cast("string").alias("store"), F.left("fingerprint", F.lit(8)).alias("fp_prefix"), F.lit(None).cast("string").alias("path"), F.col("label").alias("message")))
            if self.on_new is not None:
                self.on_new(fresh)
        for x in (todo, scanned, found, fresh):
            x.unpersist()
        return n

    def merge_secrets(self) -> None:
        """Identities of all live findings; the first time that each was seen stays."""
        old = self.state.read("secrets").select("fingerprint", F.col("first_seen").alias("__first"))
        now = relational.identities(self.state.read("findings")).join(old, "fingerprint", "left")
        self.state.write("secrets", now.withColumn("first_seen", F.coalesce("__first", "first_seen")).drop("__first"))

    def snapshot(self, now: Column | None = None, paused: bool = False, verified: bool = False) -> DataFrame:
        """One row: status, headline, copies, secrets and blocking gaps at a time (seconds); expired tokens don't count."""
        live = relational.without_expired(self.state.read("findings"), F.unix_timestamp().cast("double") if now is None else now)
        counts = live.agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("fingerprint").alias("secrets"))
        blocking = self.state.read("gaps").agg(F.count_if("blocks_clean").alias("blocking_gaps"))
        row = counts.crossJoin(blocking)  # one row each
        state = relational.status(F.lit(paused), F.lit(True), F.col("copies"), F.col("blocking_gaps"), F.lit(verified))
        return row.withColumn("status", state).withColumn("headline", relational.headline(F.col("status"), F.col("copies"), F.col("blocking_gaps")))

    def auto_redact(self, now: Column | None = None) -> DataFrame | None:
        """Applies what policies want redacted, in artifacts that aren't in use."""
        from veilsift.operators.state import enforced

        due = enforced(self.state.read("policies"), F.current_timestamp() if now is None else now)
        wanted = self.state.read("findings").join(due, "fingerprint", "left_semi").select(*model.names(model.FINDING))
        if due.isEmpty() or wanted.isEmpty():
            return None
        outcomes = self.engine.apply(self.engine.plan(wanted))
        counts = {r["outcome"]: r["n"] for r in outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.state.counted(**counts)
        self.forget(outcomes.select("path").distinct())  # what has been edited is read anew as a whole
        self.reconcile(enforce=False)
        return outcomes

    def start(self, checkpoint: str, seconds: int = SECONDS_BETWEEN):
        """A streaming query that takes in changed artifacts every few seconds."""
        register(self.spark)
        options = {"home": self.engine.home or "", "tiers": ",".join(self.tiers)}
        stream = self.spark.readStream.format("agent_changes").options(**options).load()

        def take(batch: DataFrame, _: int) -> None:
            batch = batch.persist()
            self.forget(batch.where("kind = 'removed'").select("path"))
            listed = batch.where("kind <> 'removed'")
            if self.excluded is not None:
                listed = relational.outside(listed, self.excluded)
            self.absorb(relational.changed(relational.latest(listed, ["path"], ["modified", "size"]), self.state.read("cursors")))
            self.merge_secrets()
            batch.unpersist()
            if time.monotonic() - self.whole_at >= WHOLE_EVERY:  # what a change feed may have missed
                self.whole_at = time.monotonic()
                self.reconcile()

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
