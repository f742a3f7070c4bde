"""Findings from regions of text, or straight from a table's text column. No plaintext leaves the tasks."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilsift import model
from veilsift.functions.batches import bounded
from veilsift.rules.catalogue import Rule
from veilsift.rules.matcher import Match, scanner
from veilsift.sources.extract import Gap, Region, items
from veilsift.sources.jsonwalk import feasibility, serialized

PREIMAGE = "preimage"


def fingerprint(key: bytes, namespace: str, value: bytes) -> str:
    """Hex of HMAC-SHA256 over namespace, a zero byte and the value."""
    return hmac.new(key, namespace.encode() + b"\0" + value, hashlib.sha256).hexdigest()


def expiry(token: str) -> float | None:
    """``exp`` of a JWT, or None."""
    import base64
    import json

    try:
        part = token.split(".")[1]
        claim = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))).get("exp")
        return float(claim) if isinstance(claim, (int, float)) and not isinstance(claim, bool) else None
    except (ValueError, IndexError, AttributeError):
        return None


def locator_of(tag: str, line_offset: int | None, pointer: str | None, table: str | None, rowid: int | None, column: str | None) -> str:
    """The place of a region in its artifact, as a key."""
    if tag == "cell":
        return f"cell:{table}:{rowid}:{column}:{pointer or ''}"
    return f"{tag}:{'' if line_offset is None else line_offset}:{pointer or ''}"


def findings_of(region: Region, key: bytes, rules: tuple[Rule, ...] | None, raw: bytes | None = None) -> Iterator[dict]:
    """Findings of one region; from text whose bytes aren't reliable only the sure ones count."""
    for m in scanner(rules).scan(region.text):
        if not region.reliable and m.confidence != "high":
            continue
        lo, hi = byte_range(region.text, m)
        start, end = serialized(region.base_offset, region.offset_map, lo, hi)
        yield {
            "tag": region.tag, "line": region.line, "line_offset": region.line_offset, "pointer": region.pointer, "table": region.table, "rowid": region.rowid, "column": region.column,
            "locator": locator_of(region.tag, region.line_offset, region.pointer, region.table, region.rowid, region.column),
            "rule": m.rule, "kind": m.kind, "label": m.label, "confidence": m.confidence, "masked": m.masked,
            "fingerprint": fingerprint(key, m.kind, m.canonical.encode()),
            "start": start, "end": end, "feasibility": feasibility(region.reliable, region.offset_map, lo, hi),
            "preimage": None if raw is None else fingerprint(key, PREIMAGE, raw[start:end]),
            "expires": expiry(m.secret) if m.kind == "jwt" else None,
        }


def byte_range(text: str, m: Match) -> tuple[int, int]:
    """UTF-8 range of a finding in its text."""
    if text.isascii():
        return m.start, m.end
    lo = len(text[: m.start].encode())
    return lo, lo + len(text[m.start : m.end].encode())


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out by path over a set number of tasks, several for each core, so that tasks which meet large files
    hold nothing up and adaptive execution doesn't put the few bytes of a listing into one task."""
    return rows.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")


def scan_artifacts(artifacts: DataFrame, key: bytes, rules: list[Rule] | None = None) -> DataFrame:
    """Findings and gaps of artifacts, each read once where it lies; rows have either ``finding`` or ``gap``, and ``reached``.

    Artifacts are dealt out by path over several tasks for each core.
    """
    chosen = None if rules is None else tuple(rules)
    finding, reason = StructType.fromDDL(model.FINDING), model.REASON
    schema = StructType.fromDDL(f"path string, finding struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in finding)}>, gap struct<adapter:string,store:string,path:string,reason:{reason},blocks_clean:boolean>, reached bigint, start bigint")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.to_pylist():
                rows = []
                own = {k: a[k] for k in ("adapter", "store", "path", "session", "project")}
                start, delta = a.get("start") or 0, bool(a.get("delta"))
                for x in items(a["path"], a["kind"], a["adapter"], a["store"], start, delta):
                    row = {"path": a["path"], "finding": None, "gap": None, "reached": None, "start": start}
                    if isinstance(x, Region):
                        rows += [row | {"finding": own | f} for f in findings_of(x, key, chosen)]
                    elif isinstance(x, Gap):
                        rows.append(row | {"gap": {"adapter": a["adapter"], "store": a["store"], "path": a["path"], "reason": x._asdict(), "blocks_clean": x.tag not in model.HARMLESS_GAPS}})
                    else:
                        rows.append(row | {"reached": x})
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    columns = ["adapter", "store", "path", "session", "project", "kind", *(c for c in ("start", "delta") if c in artifacts.columns)]
    return dealt(artifacts.select(*columns)).transform(bounded, run, schema)


def findings(scanned: DataFrame) -> DataFrame:
    return scanned.where("finding is not null").select("finding.*")


def gaps(scanned: DataFrame) -> DataFrame:
    return scanned.where("gap is not null").select("gap.*")


def scan_table(rows: DataFrame, id_column: str, text: Column | str, key: bytes, anchors: list[str] | None = None, rules: list[Rule] | None = None, source: str = "table") -> DataFrame:
    """Findings of a table's text: doc_id and the columns of findings. ``anchors`` are looked for in the JVM first, so that
    only rows with one of them go to Python."""
    chosen = None if rules is None else tuple(rules)
    schema = StructType.fromDDL(f"doc_id {rows.schema[id_column].dataType.simpleString()}, " + model.FINDING)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = value.as_py() or ""
                region = Region("plain", None, None, None, None, None, None, body, 0, None, True)
                own = {"doc_id": doc, "adapter": source, "store": source, "path": f"{source}/{doc}", "session": None, "project": None}
                out += [own | f for f in findings_of(region, key, chosen)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    column = F.col(text) if isinstance(text, str) else text
    picked = rows.select(F.col(id_column), F.coalesce(column, F.lit("")).alias("text"))
    if anchors:
        low = F.lower("text")
        hit = F.lit(False)
        for a in anchors:
            hit = hit | low.contains(a)
        picked = picked.where(hit)
    return picked.transform(bounded, run, schema)
