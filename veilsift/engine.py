"""The engine's verbs over agent histories: coverage, scan, plan, apply, verify, enforce."""

from __future__ import annotations

import json
import os
import secrets as random_bytes
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift import model
from veilsift.operators import detect, redact, relational
from veilsift.operators.state import State, enforced
from veilsift.rules.catalogue import Rule
from veilsift.sources import listing
from veilsift.sources.stores import SCANNED_BY_DEFAULT


def installation_key(path: str) -> bytes:
    """The installation's 32-byte key, made on first use and readable by its owner alone."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError:
        key = random_bytes.token_bytes(32)
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(fd, "wb") as f:
            f.write(key)
        return key


@dataclass
class Report:
    """Tables of one scan. What was read is kept until ``release`` or the end of the session."""

    stores: DataFrame
    artifacts: DataFrame
    gaps: DataFrame
    findings: DataFrame
    secrets: DataFrame
    active: DataFrame
    kept: DataFrame | None = None

    def release(self) -> None:
        """Lets go of what the scan has read; a table that is used again afterwards is read anew."""
        if self.kept is not None:
            self.kept.unpersist()

    def is_clean(self) -> bool:
        return bool(relational.clean(self.findings, self.gaps).first()["is_clean"])

    def json_lines(self) -> DataFrame:
        """One JSON text for each secret with its occurrences' places; no plaintext. Occurrences are written as rows of their own."""
        s = self.secrets.select(F.lit("secret").alias("table"), F.to_json(F.struct(*self.secrets.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}).alias("json"))
        o = self.findings.select(F.lit("occurrence").alias("table"), F.to_json(F.struct(*sorted(self.findings.columns))).alias("json"))
        g = self.gaps.select(F.lit("gap").alias("table"), F.to_json(F.struct(*sorted(self.gaps.columns))).alias("json"))
        return s.unionByName(o).unionByName(g)

    def text(self, most_paths: int = 5) -> str:
        """A report for people. Only counts and a few lines for each secret come to the driver."""
        out = []
        stores = {}
        for r in relational.by_store(self.findings).collect():
            stores.setdefault(r["fingerprint"], []).append(f"    {r['adapter']}/{r['store']}: {r['copies']}")
        for s in relational.ordered(self.secrets).collect():
            out += [f"{s['alias']}  {s['label']}  {s['masked']}  {s['confidence']}, {s['copies']} copies", *stores.get(s["fingerprint"], [])]
        for g in relational.gap_counts(self.gaps, most_paths).collect():
            out += [f"{g['reason']}: {g['gaps']}", *(f"    {p}" for p in g["paths"])]
        return "\n".join(out)


class Engine:
    """Scans and redacts the histories below a home folder that all tasks can read."""

    def __init__(self, spark: SparkSession, key: bytes, home: str | None = None, environment: dict[str, str] | None = None, adapters: list[str] | None = None, rules: list[Rule] | None = None) -> None:
        self.spark, self.key, self.home, self.environment, self.adapters, self.rules = spark, key, home, environment, adapters, rules

    def listed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return listing.listed(self.spark, self.home, self.environment, self.adapters)

    def coverage(self) -> DataFrame:
        """Stores with tier, presence, number of artifacts and blocking gaps, and the version of their agent."""
        stores, artifacts, gaps = self.listed()
        roots = [(r["adapter"], r["root"]) for r in artifacts.select("adapter", "root").distinct().collect()]  # a few installations
        versions = self.spark.createDataFrame([(a, r, listing.version_of(a, r)) for a, r in roots if a in ("claude-code", "codex")], "adapter string, root string, version string")
        a = artifacts.groupBy("adapter", "store").agg(F.count(F.lit(1)).alias("artifacts"), F.sum("size").alias("bytes"))
        g = gaps.where("blocks_clean").groupBy("adapter", "store").agg(F.count(F.lit(1)).alias("blocking_gaps"))
        out = stores.join(a, ["adapter", "store"], "left").join(g, ["adapter", "store"], "left").join(F.broadcast(versions), ["adapter", "root"], "left")
        return out.fillna(0, ["artifacts", "bytes", "blocking_gaps"])

    def scan(self, tiers: tuple[str, ...] = SCANNED_BY_DEFAULT, excluded: DataFrame | None = None, now: Column | None = None) -> Report:
        """Findings, identities and gaps of all stores in some tiers. ``excluded``: a column folder."""
        stores, artifacts, gaps = self.listed()
        chosen = artifacts.where(F.col("tier").isin([t for t in tiers if t != "excluded"]))
        if excluded is not None:
            chosen = relational.outside(chosen, excluded)
        return self.report(stores, chosen, gaps, now)

    def report(self, stores: DataFrame, artifacts: DataFrame, gaps: DataFrame, now: Column | None = None) -> Report:
        scanned = detect.scan_artifacts(artifacts, self.key, self.rules).persist()  # read once for findings and gaps
        found = relational.one_for_each_place(detect.findings(scanned))
        found = relational.without_expired(found, F.unix_timestamp().cast("double") if now is None else now)
        all_gaps = gaps.unionByName(detect.gaps(scanned))
        return Report(stores, artifacts, all_gaps, found, relational.identities(found), self.active(artifacts, found), scanned)

    def active(self, artifacts: DataFrame, found: DataFrame) -> DataFrame:
        """path and reason of the artifacts with findings that are in use; asked for where the files are, on the driver."""
        hot = found.select("path").distinct().join(artifacts.select("adapter", "root", "path"), "path").collect()  # files of one home
        rows = [(r["path"], reason) for r in hot if (reason := listing.active_reason(r["adapter"], r["root"], r["path"]))]
        return self.spark.createDataFrame(rows, "path string, reason string")

    def plan(self, wanted: DataFrame, report: Report | None = None, **allowed: bool) -> DataFrame:
        """What can be redacted of the wanted findings and what must wait, against a fresh scan of their files."""
        stores, artifacts, _ = self.listed()
        artifacts = artifacts.join(wanted.select("path").distinct(), "path", "left_semi").select(*artifacts.columns)
        fresh = detect.findings(detect.scan_artifacts(artifacts, self.key, self.rules))
        return redact.plan(wanted, fresh, artifacts, stores, self.active(artifacts, wanted), self.key, rules=None if self.rules is None else tuple(self.rules), **allowed)

    def apply(self, planned: DataFrame) -> DataFrame:
        """Applies a plan once and returns the outcomes."""
        done = redact.apply(planned, self.key).collect()  # as many rows as the plan has targets, in files of one home
        return self.spark.createDataFrame(done, redact.OUTCOME)

    def verify(self, wanted: DataFrame, tiers: tuple[str, ...] = SCANNED_BY_DEFAULT) -> DataFrame:
        """Remaining copies of each wanted fingerprint in a fresh scan."""
        fresh = self.scan(tiers)
        return redact.verified(wanted, fresh.findings, fresh.gaps)

    def enforce(self, state: State, confirmed: bool = False, now: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
        """The plan for all findings that policies want redacted, and its outcomes if confirmed."""
        found = self.scan()
        due = enforced(state.read("policies"), F.current_timestamp() if now is None else now)
        wanted = found.findings.join(due, "fingerprint", "left_semi")
        planned = self.plan(wanted.select(*model.names(model.FINDING)))
        return planned, self.apply(planned) if confirmed else None


def main(arguments: list[str] | None = None) -> int:
    """Command line: coverage, scan, redact, verify, policy list|set|remove, enforce. Nothing is changed without ``--yes``."""
    import argparse

    parser = argparse.ArgumentParser(prog="veilsift")
    parser.add_argument("verb", choices=["coverage", "scan", "redact", "verify", "policy", "enforce"])
    parser.add_argument("words", nargs="*", help="a fingerprint's beginning; for policy: list, set PREFIX POLICY, remove PREFIX")
    parser.add_argument("--home")
    parser.add_argument("--adapter", action="append")
    parser.add_argument("--state", default=os.path.expanduser("~/.veilsift"))
    parser.add_argument("--extended", action="store_true")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--yes", action="store_true")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("veilsift").config("spark.speculation", "false").getOrCreate()
    engine = Engine(spark, installation_key(os.path.join(a.state, "key")), a.home, adapters=a.adapter)
    state = State(spark, os.path.join(a.state, "tables"))
    tiers = (*SCANNED_BY_DEFAULT, "extended") if a.extended else SCANNED_BY_DEFAULT
    if a.verb == "coverage":
        for r in engine.coverage().orderBy("adapter", "store").collect():
            print(json.dumps(r.asDict(True)) if a.json else f"{r['adapter']:12} {r['store']:22} {r['tier']:12} {r['artifacts']}")
        return 0
    if a.verb == "enforce":
        planned, outcomes = engine.enforce(state, a.yes)
        (planned if outcomes is None else outcomes).show(1000, False)
        return 0
    found = engine.scan(tiers)
    if a.verb == "scan":
        if a.json:
            for r in found.json_lines().orderBy("table", "json").toLocalIterator():
                print(r["json"])
        else:
            print(found.text())
        return 0 if found.is_clean() else 1
    if a.verb == "policy" and a.words[:1] != ["list"]:
        chosen = relational.by_prefix(found.secrets.unionByName(state.read("secrets"), allowMissingColumns=True), a.words[1])
        state.set_policy(chosen, a.words[2]) if a.words[0] == "set" else state.remove_policy(chosen)
    if a.verb == "policy":
        state.read("policies").show(1000, False)
        return 0
    chosen = relational.by_prefix(found.secrets, a.words[0])
    wanted = found.findings.join(chosen.select("fingerprint"), "fingerprint", "left_semi").select(*model.names(model.FINDING))
    if a.verb == "redact":
        planned = engine.plan(wanted)
        (engine.apply(planned) if a.yes else planned).show(1000, False)
    else:
        engine.verify(chosen, tiers).show(1000, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
