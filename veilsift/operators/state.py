"""Tables that outlive a run: cursors, findings, identities, events, policies and counters, as versioned Parquet folders.

Each write makes a new version and then names it in ``CURRENT``, so a reader sees a whole version whatever happens.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift import model
from veilsift.operators.detect import fingerprint

SCHEMAS = {"cursors": model.CURSOR, "findings": model.FINDING, "gaps": model.GAP, "events": model.EVENT, "policies": model.POLICY, "meta": model.META, "secrets": "fingerprint string, kind string, label string, masked string, confidence string, first_seen timestamp, last_seen timestamp, copies bigint, alias string"}
PROBE_SPACE = "key-probe"
#: Versions kept beside the present one and the one before, for readers that began earlier.
KEPT = 3


class State:
    """State tables under one folder that the driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self, name: str) -> str | None:
        """The name of a table's present version."""
        path = self._path(f"{self.folder}/{name}/CURRENT")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        version = self.version(name)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/{version}")

    def write(self, name: str, rows: DataFrame) -> None:
        """Replaces a table; ``rows`` may be made from its present version."""
        before, version = self.version(name), f"v{time.time_ns():020d}-{uuid.uuid4().hex}"
        rows.select(*model.names(SCHEMAS[name])).write.parquet(f"{self.folder}/{name}/{version}")
        stream = self._fs.create(self._path(f"{self.folder}/{name}/CURRENT"), True)
        try:
            stream.write(bytearray(version.encode()))
        finally:
            stream.close()
        old = sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.folder}/{name}")))
        for x in [v for v in old if v.startswith("v") and v < (before or "")][: -KEPT or None]:
            self._fs.delete(self._path(f"{self.folder}/{name}/{x}"), True)  # a reader may still be at a newer one

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to a table's present version as files of their own; what is there isn't read or written again."""
        version = self.version(name)
        if version is None:
            self.write(name, rows)
        else:
            rows.select(*model.names(SCHEMAS[name])).write.mode("append").parquet(f"{self.folder}/{name}/{version}")

    def replace_paths(self, name: str, paths: DataFrame, rows: DataFrame) -> None:
        """Drops the rows of ``paths`` and adds ``rows``."""
        kept = self.read(name).join(paths.select("path").distinct(), "path", "left_anti")
        self.write(name, kept.select(*model.names(SCHEMAS[name])).unionByName(rows.select(*model.names(SCHEMAS[name]))))

    def clear(self) -> None:
        for name in ("cursors", "findings", "secrets", "gaps"):
            self.write(name, self.spark.createDataFrame([], SCHEMAS[name]))

    def meta(self, key: str) -> str | None:
        row = self.read("meta").where(F.col("key") == key).select("value").first()
        return row[0] if row else None

    def set_meta(self, key: str, value: str) -> None:
        rows = self.read("meta").where(F.col("key") != key)
        self.write("meta", rows.unionByName(self.spark.createDataFrame([(key, value)], model.META)))

    def opened_with(self, key: bytes) -> bool:
        """Remembers a digest of the key; with another key than before, findings and cursors are dropped. True if the key is as before."""
        probe = fingerprint(key, PROBE_SPACE, b"")
        before = self.meta("key_probe")
        if before is not None and before != probe:
            self.clear()
        if before != probe:
            self.set_meta("key_probe", probe)
        return before in (None, probe)

    def counted(self, **more: int) -> dict[str, int]:
        """Adds to the counters of a lifetime and returns them."""
        now = json.loads(self.meta("lifetime") or "{}")
        now = {k: now.get(k, 0) + more.get(k, 0) for k in {*now, *more}}
        self.set_meta("lifetime", json.dumps(now, sort_keys=True))
        return now

    def log(self, events: DataFrame) -> None:
        """Appends events (all columns but id and ts); ids go up."""
        before = self.read("events")
        last = before.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        numbered = events.withColumn("id", F.lit(last) + 1 + F.monotonically_increasing_id()).withColumn("ts", F.current_timestamp())
        self.append("events", numbered.select(*before.columns))

    def events(self, most: int = 100) -> DataFrame:
        """The newest events first."""
        return self.read("events").orderBy(F.col("id").desc()).limit(most)

    def set_policy(self, prefix_of: DataFrame, policy: str, until: datetime | None = None, label: str | None = None) -> None:
        """A policy for the fingerprints of a table."""
        if policy not in model.POLICIES:
            raise ValueError(f"no such policy: {policy}")
        rows = prefix_of.select("fingerprint").distinct().select("fingerprint", F.lit(policy).alias("policy"), F.lit(until).cast("timestamp").alias("until"), F.lit(label).cast("string").alias("label"), F.current_timestamp().alias("created_at"))
        kept = self.read("policies").join(rows.select("fingerprint"), "fingerprint", "left_anti")
        self.write("policies", kept.select(*rows.columns).unionByName(rows))

    def remove_policy(self, fingerprints: DataFrame) -> None:
        self.write("policies", self.read("policies").join(fingerprints.select("fingerprint"), "fingerprint", "left_anti"))


def enforced(policies: DataFrame, now) -> DataFrame:
    """Fingerprints that policies want redacted at ``now``."""
    due = F.col("policy").isin("alwaysRedact", "redactNow", "redactWhenSessionEnds") | ((F.col("policy") == "keepUntil") & (F.col("until") < now))
    return policies.where(due).select("fingerprint").distinct()


def read_policy_file(spark: SparkSession, path: str) -> DataFrame:
    """Policies of a JSON map from fingerprints to records; keys that aren't 64 hexadecimal digits are left out."""
    with open(path) as f:
        data = json.load(f)
    rows = [(k.lower(), v.get("policy"), v.get("until"), v.get("label"), v.get("createdAt")) for k, v in data.items() if len(k) == 64 and all(c in "0123456789abcdefABCDEF" for c in k)]
    raw = spark.createDataFrame(rows, "fingerprint string, policy string, until string, label string, created_at string")
    return raw.withColumn("until", F.col("until").cast("timestamp")).withColumn("created_at", F.col("created_at").cast("timestamp"))


def write_policy_file(policies: DataFrame, path: str) -> None:
    """Writes policies as such a map, at once and for the owner alone. Policies are set by hand and few."""
    rows = policies.select("fingerprint", "policy", F.date_format("until", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("until"), "label", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt")).collect()
    data = {r["fingerprint"]: {k: r[k] for k in ("policy", "until", "label", "createdAt") if r[k] is not None} for r in rows}
    temporary = f"{path}.{uuid.uuid4().hex}"
    fd = os.open(temporary, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    with os.fdopen(fd, "w") as f:
        json.dump(data, f, indent=1, sort_keys=True)
    os.replace(temporary, path)
