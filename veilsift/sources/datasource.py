"""Spark data sources: ``agent_history`` (text regions of agents' stores, batch) and ``agent_changes`` (changed artifacts, stream).

Register with ``register(spark)``. Options: adapter (one name, or all), home, tiers and stores (comma-separated). A region partition is
one artifact, so tasks read where files lie and long lists spread over them. What the options leave out is never opened;
filters of a query are applied by Spark (a reader that takes filters over keeps them for later queries of the same frame).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from veilsift import model
from veilsift.sources import listing
from veilsift.sources.extract import Region, items
from veilsift.sources.stores import ADAPTERS, BY_NAME, SCANNED_BY_DEFAULT


def artifacts_of(options: dict) -> list[tuple]:
    """Artifacts below the home folder of the options, in the tiers asked for."""
    adapters = [BY_NAME[options["adapter"]]] if options.get("adapter") else list(ADAPTERS)
    tiers = options.get("tiers", ",".join(SCANNED_BY_DEFAULT)).split(",")
    stores = options["stores"].split(",") if options.get("stores") else None
    home, environment = options.get("home") or os.path.expanduser("~"), {} if options.get("home") else dict(os.environ)
    return [a for adapter in adapters for root in listing.roots(adapter, home, environment) for a in listing.list_root(adapter, root)[1] if a[3] in tiers and (stores is None or a[2] in stores)]


class _Artifact(InputPartition):
    def __init__(self, adapter: str, store: str, path: str, kind: str) -> None:
        self.adapter, self.store, self.path, self.kind = adapter, store, path, kind


class RegionReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[_Artifact]:
        return [_Artifact(a[0], a[2], a[4], a[5]) for a in artifacts_of(self.options)] or [_Artifact("", "", "", "none")]

    def read(self, partition: _Artifact) -> Iterator[tuple]:
        if partition.kind == "none":
            return
        for x in items(partition.path, partition.kind, partition.adapter, partition.store):
            if isinstance(x, Region):
                yield (partition.adapter, partition.store, partition.path, *x)


class AgentHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "agent_history"

    def schema(self) -> str:
        return model.REGION

    def reader(self, schema) -> RegionReader:
        return RegionReader(dict(self.options))


class ChangeReader(SimpleDataSourceStreamReader):
    """An offset is the time of the newest change told and a number, however many files there are; what each file was like
    stays in the reader's process. After a restart all files that changed at that time or later are told once more (the
    monitor's cursors leave out what it has read), and files gone meanwhile are found when all is reconciled."""

    def __init__(self, options: dict) -> None:
        self.options, self.seen = options, None

    def initialOffset(self) -> dict:
        return {"since": 0, "round": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, now = [], {}
        for a in artifacts_of(self.options):
            now[a[4]] = (changed_at(a[4]), *a[6:10])
            if self.seen is None and now[a[4]][0] >= start["since"] or self.seen is not None and self.seen.get(a[4]) != now[a[4]]:
                rows.append(a)
        gone = [_removed(path) for path in self.seen or () if path not in now]
        self.seen = now
        if not rows and not gone:
            return iter([]), start
        return iter([*rows, *gone]), {"since": max([start["since"], *(x[0] for x in now.values())]), "round": start["round"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([a for a in artifacts_of(self.options) if changed_at(a[4]) >= start["since"]])


def changed_at(path: str) -> int:
    """When a file or its log last changed, in nanoseconds; 0 if it is gone."""
    times = [0]
    for p in (path, path + "-wal"):
        try:
            info = os.stat(p)
        except OSError:
            continue
        times.append(max(info.st_mtime_ns, info.st_ctime_ns))
    return max(times)


def _removed(path: str) -> tuple:
    return (None, None, None, None, path, "removed", None, None, None, None, None, None)


class AgentChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "agent_changes"

    def schema(self) -> str:
        return listing.ARTIFACT

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session."""
    spark.dataSource.register(AgentHistory)
    spark.dataSource.register(AgentChanges)
