"""Redaction: a plan as one chain of conditions over joined tables, edits inside tasks, verification by a fresh scan.

A plan has no plaintext, only keyed digests of the bytes to be replaced. Tasks may be tried again: an edit whose bytes are
the replacement already counts as done, and any other change since planning refuses it.

Ranges found in text that isn't UTF-8 say nothing about bytes. Where ``allow_binary`` lets such records be edited, the
task that looks at them scans the record anew, and takes the range where the secret's own bytes lie, if there is just one;
every other condition holds for them as for all.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilsift.functions.columns import replacement
from veilsift.operators.detect import PREIMAGE, dealt, fingerprint
from veilsift.rules.catalogue import Rule
from veilsift.rules.matcher import scanner
from veilsift.sources.extract import quoted, schema_is_known
from veilsift.sources.jsonwalk import JSONError, string_values
from veilsift.sources.listing import REDACT_INACTIVE

TARGET = "path string, adapter string, store string, artifact_kind string, tag string, line_offset bigint, table string, rowid bigint, column string, start bigint, end bigint, fingerprint string, kind string, replacement string, preimage string, edit string, device bigint, inode bigint, size bigint"
OUTCOME = "path string, fingerprint string, start bigint, table string, rowid bigint, column string, outcome string, detail string"
PLACE = ["path", "cell", "start", "end", "fingerprint"]


def cell_key(frame: DataFrame) -> DataFrame:
    """``cell``: the database cell of a finding, or empty; line numbers are left out, as they may be counted from a tail."""
    cell = F.when(F.col("tag") == "cell", F.concat_ws(":", "table", F.col("rowid").cast("string"), "column")).otherwise("")
    return frame.withColumn("cell", cell)


def preimages(found: DataFrame, key: bytes, allow_binary: bool = False, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """``found`` with what lies in each range now, read where it is: ``preimage``, its keyed digest; ``exact_start`` and
    ``exact_end``, for records that aren't UTF-8; ``known``, if a database's schema is one that may be written."""
    schema = StructType([*found.drop("preimage").schema.fields, *StructType.fromDDL("preimage string, exact_start bigint, exact_end bigint, known boolean").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                exact = located(r, key, rules) if allow_binary and r["feasibility"] == "offsetsUnreliable" else None
                data = bytes_at(r if exact is None else r | {"start": exact[0], "end": exact[1]})
                r["preimage"] = None if data is None else fingerprint(key, PREIMAGE, data)
                r["exact_start"], r["exact_end"] = exact or (None, None)
                r["known"] = r["tag"] != "cell" or schema_is_known(r["path"], r["adapter"], r["store"])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return dealt(found.drop("preimage")).mapInArrow(run, schema)


def cell_at(place: dict) -> bytes | None:
    with sqlite3.connect(f"file:{place['path']}?mode=ro", uri=True) as db:
        row = db.execute(f"SELECT {quoted(place['column'])} AS c FROM {quoted(place['table'])} WHERE rowid = ?", (place["rowid"],)).fetchone()
    value = row[0] if row else None
    return value.encode() if isinstance(value, str) else value


def bytes_at(place: dict) -> bytes | None:
    """The bytes of a finding's range in its file or cell."""
    try:
        if place["tag"] == "cell":
            data = cell_at(place)
            return None if data is None else data[place["start"] : place["end"]]
        with open(place["path"], "rb") as f:
            f.seek(place["start"])
            return f.read(place["end"] - place["start"])
    except (OSError, sqlite3.Error):
        return None


def record_at(place: dict) -> tuple[int, bytes | None]:
    """Where a finding's record begins (a line, a cell or a whole file), and its bytes."""
    try:
        if place["tag"] == "cell":
            return 0, cell_at(place)
        with open(place["path"], "rb") as f:
            if place["line_offset"] is None:
                return 0, f.read()
            f.seek(place["line_offset"])
            return place["line_offset"], f.readline()
    except (OSError, sqlite3.Error):
        return 0, None


def located(place: dict, key: bytes, rules: tuple[Rule, ...] | None = None) -> tuple[int, int] | None:
    """Start and end of the secret's own bytes, if its record holds them just once; a guess is never made."""
    base, record = record_at(place)
    if not record:
        return None
    text = record.decode("utf-8", "replace")
    spelled = {text[m.start : m.end].encode() for m in scanner(rules).scan(text) if fingerprint(key, m.kind, m.canonical.encode()) == place["fingerprint"]}
    if len(spelled) != 1:
        return None
    needle = spelled.pop()
    at = record.find(needle)
    if at < 0 or record.find(needle, at + 1) >= 0:
        return None
    return base + at, base + at + len(needle)


def plan(wanted: DataFrame, fresh: DataFrame, artifacts: DataFrame, stores: DataFrame, active: DataFrame, key: bytes, allow_active: bool = False, allow_binary: bool = False, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """A row for each wanted occurrence: ``deferral`` says why it must wait, or is null and the row can be applied.

    ``wanted``: findings with the ``device`` and ``inode`` seen then (null: unknown); ``fresh``: a new scan's findings;
    ``artifacts`` and ``stores``: listed now; ``active``: path and reason of artifacts in use.
    """
    now = cell_key(fresh).select(*PLACE, F.lit(True).alias("__there")).distinct()
    files = artifacts.select("path", F.col("kind").alias("artifact_kind"), F.col("device").alias("__device"), F.col("inode").alias("__inode"), F.col("size").alias("__size"), F.lit(True).alias("__listed"))
    abilities = stores.groupBy("adapter", "store").agg(F.bit_or("capabilities").alias("capabilities"))
    busy = active.select("path", F.col("reason").alias("__active")).dropDuplicates(["path"])
    w = preimages(cell_key(wanted), key, allow_binary, rules)
    for c in ("device", "inode"):
        w = w if c in w.columns else w.withColumn(c, F.lit(None).cast("bigint"))
    joined = w.join(now, PLACE, "left").join(files, "path", "left").join(abilities, ["adapter", "store"], "left").join(busy, "path", "left")
    resized = F.col("feasibility") == "semanticRewrite"
    moved = ~(F.coalesce("device", "__device").eqNullSafe(F.col("__device")) & F.coalesce("inode", "__inode").eqNullSafe(F.col("__inode")))
    cell = F.col("tag") == "cell"
    deferral = (
        F.when(F.col("capabilities").isNull(), "missingStore")
        .when(F.col("capabilities").bitwiseAND(F.lit(REDACT_INACTIVE)) == 0, "readOnlyStore")
        .when((F.col("adapter") == "codex") & ~F.coalesce("known", F.lit(False)), "readOnlyStore")
        .when((F.col("adapter") == "vscode-chat") & cell & resized, "adapterConstraint")
        .when((F.col("feasibility") == "offsetsUnreliable") & F.col("exact_start").isNull(), "notRedactable")
        .when(F.col("__listed").isNull() | F.col("preimage").isNull() | moved, "artifactChanged")
        .when(~cell & (F.col("end") > F.col("__size")), "artifactChanged")
        .when(F.col("__active").isNotNull() & (F.lit(not allow_active) | resized), "sessionActive")
        .when(F.col("__there").isNull(), "noLongerPresent")
    )
    length = (F.col("end") - F.col("start")).cast("int")
    edit = F.when(cell, "cellOverwrite").when(resized, "resize").otherwise("sameLength")
    out = joined.withColumn("deferral", deferral).withColumn("edit", edit)
    out = out.withColumns({"start": F.coalesce("exact_start", "start"), "end": F.coalesce("exact_end", "end")})
    out = out.withColumn("replacement", replacement(length, F.col("kind"), F.col("fingerprint")))
    out = out.drop("device", "inode").withColumnsRenamed({"__device": "device", "__inode": "inode", "__size": "size"})
    return out.select(*[f.name for f in StructType.fromDDL(TARGET)], "deferral", F.col("__active").alias("active_reason")).distinct()


def targets(planned: DataFrame) -> DataFrame:
    return planned.where("deferral is null").drop("deferral", "active_reason")


def deferred(planned: DataFrame) -> DataFrame:
    """Number of occurrences put off, by reason."""
    return planned.where("deferral is not null").groupBy("deferral").agg(F.count(F.lit(1)).alias("n"))


def is_json(data: bytes) -> bool:
    try:
        for _ in string_values(data):
            pass
    except JSONError:
        return False
    return True


def still_parses(data: bytes, kind: str, edited: list[int]) -> bool:
    """JSON files and the edited lines of JSON-lines files must still be JSON; other text is free."""
    if kind == "json":
        return is_json(data)
    if kind == "jsonl":
        for at in edited:
            lo, hi = data.rfind(b"\n", 0, at) + 1, data.find(b"\n", at)
            if not is_json(data[lo : len(data) if hi < 0 else hi].strip()):
                return False
    return True


def apply_to_file(path: str, edits: list[dict], key: bytes) -> list[tuple[str, str | None]]:
    """Outcome of each edit. Overwrites of equal length are made in place, synced, read again and rolled back if the file
    no longer parses; if any edit changes the length, the whole file is replaced at once."""
    try:
        info = os.stat(path)
        with open(path, "rb") as f:
            data = f.read()
    except OSError as e:
        return [("failed", e.strerror)] * len(edits)
    outcomes: list[tuple[str, str | None]] = []
    todo: list[tuple[int, int, bytes]] = []
    for e in edits:
        now, new = data[e["start"] : e["end"]], e["replacement"].encode()
        if now == new:
            outcomes.append(("alreadyApplied", None))
        elif (e["device"], e["inode"]) != (info.st_dev, info.st_ino):
            outcomes.append(("artifactChanged", None))
        elif fingerprint(key, PREIMAGE, now) != e["preimage"]:
            outcomes.append(("preimageMismatch", None))
        else:
            outcomes.append(("applied", None))
            todo.append((e["start"], e["end"], new))
    if not todo:
        return outcomes
    edited = bytearray(data)
    for start, end, new in sorted(todo, reverse=True):  # the last first, so that places before it stay
        edited[start:end] = new
    kind, places = edits[0]["artifact_kind"], [start for start, _, _ in todo]
    if len(edited) != len(data):
        shift, moved = 0, []
        for start, end, new in sorted(todo):
            moved.append(start + shift)
            shift += len(new) - (end - start)
        places = moved
    if not still_parses(bytes(edited), kind, places) and still_parses(data, kind, [s for s, _, _ in todo]):
        return [(o if o[0] != "applied" else ("verificationFailed", "the result doesn't parse")) for o in outcomes]
    if len(edited) == len(data):
        with open(path, "r+b") as f:
            for start, _, new in todo:
                f.seek(start)
                f.write(new)
            f.flush()
            os.fsync(f.fileno())
        with open(path, "rb") as f:
            after = f.read()
        if after != bytes(edited):
            with open(path, "r+b") as f:
                for start, end, _ in todo:
                    f.seek(start)
                    f.write(data[start:end])
            return [(o if o[0] != "applied" else ("verificationFailed", "rolled back")) for o in outcomes]
        return outcomes
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(fd, "wb") as f:
        f.write(edited)
        f.flush()
        os.fsync(f.fileno())
    os.chmod(temporary, info.st_mode)
    os.replace(temporary, path)
    return outcomes


def apply_to_database(path: str, edits: list[dict], key: bytes) -> list[tuple[str, str | None]]:
    """Outcome of each edit of cells, all in one immediate transaction; types and lengths of cells stay."""
    outcomes: list[tuple[str, str | None]] = []
    try:
        info = os.stat(path)
        if any((e["device"], e["inode"]) != (info.st_dev, info.st_ino) for e in edits):
            return [("artifactChanged", None)] * len(edits)
        db = sqlite3.connect(path, isolation_level=None, timeout=1.5)
        db.execute("BEGIN IMMEDIATE")
    except (OSError, sqlite3.Error) as e:
        return [("failed", str(e))] * len(edits)
    try:
        written: list[tuple[str, tuple, int, bytes]] = []
        for e in edits:
            c, t = quoted(e["column"]), quoted(e["table"])
            row = db.execute(f"SELECT {c} AS c FROM {t} WHERE rowid = ?", (e["rowid"],)).fetchone()
            if row is None or not isinstance(row[0], (str, bytes)):
                outcomes.append(("artifactChanged", None))
                continue
            value = row[0]
            data = value.encode() if isinstance(value, str) else value
            now, new = data[e["start"] : e["end"]], e["replacement"].encode()
            if now == new:
                outcomes.append(("alreadyApplied", None))
                continue
            if fingerprint(key, PREIMAGE, now) != e["preimage"]:
                outcomes.append(("preimageMismatch", None))
                continue
            edited = data[: e["start"]] + new + data[e["end"] :]
            if is_json(data) and not is_json(edited):
                outcomes.append(("verificationFailed", "the cell is no longer JSON"))
                continue
            put = edited.decode() if isinstance(value, str) else edited
            done = db.execute(f"UPDATE {t} SET {c} = ? WHERE rowid = ? AND {c} = ?", (put, e["rowid"], value)).rowcount
            outcomes.append(("applied", None) if done == 1 else ("artifactChanged", None))
            if done == 1:
                written.append((f"SELECT {c} FROM {t} WHERE rowid = ?", (e["rowid"],), e["start"], new))
        wrong = None
        for sql, rowid, at, new in written:  # read again, and checked, while all can still be undone
            value = db.execute(sql, rowid).fetchone()[0]
            if (value.encode() if isinstance(value, str) else value)[at : at + len(new)] != new:
                wrong = "a cell doesn't hold the replacement"
        if written and wrong is None and db.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
            wrong = "integrity check"
        if wrong:
            db.execute("ROLLBACK")
            return [(o if o[0] != "applied" else ("verificationFailed", wrong)) for o in outcomes]
        db.execute("COMMIT")
        db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    except sqlite3.Error as e:
        if db.in_transaction:
            db.execute("ROLLBACK")
        return [("failed", str(e))] * len(edits)
    finally:
        db.close()
    return outcomes


def apply(planned: DataFrame, key: bytes, editor: Callable[[str, list[dict], bytes], list] | None = None) -> DataFrame:
    """Edits the files and databases of a plan's targets in place, one task for each, and returns the outcomes.

    The result is lazy: writing it somewhere runs the edits, and running them again changes nothing more.
    """
    arrow = to_arrow_schema(StructType.fromDDL(OUTCOME))

    def edit(path: str, rows: list[dict]) -> pa.RecordBatch:
        work = editor or (apply_to_database if rows[0]["tag"] == "cell" else apply_to_file)
        told = work(path, rows, key)
        out = [{k: r[k] for k in ("path", "fingerprint", "start", "table", "rowid", "column")} | {"outcome": o, "detail": d} for r, (o, d) in zip(rows, told, strict=True)]
        return pa.RecordBatch.from_pylist(out, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != path and rows:
                    yield edit(path, rows)
                    rows = []
                path = r["path"]
                rows.append(r)
        if rows:
            yield edit(path, rows)

    return dealt(targets(planned)).sortWithinPartitions("path", "start").mapInArrow(run, OUTCOME)


def redacted_text(text, spans, kinds=None):
    """A text with the ranges of ``spans`` (array of struct start, end, replacement; code points, or bytes if text and
    replacements are binary; ascending, apart) replaced."""
    step = F.aggregate(
        spans,
        F.struct(F.substr(text, F.lit(1), F.lit(0)).alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), s["replacement"]).alias("out"), s["end"].alias("at")),
    )
    return F.concat(step["out"], F.substr(text, step["at"] + 1, F.length(text)))


def verified(wanted: DataFrame, fresh: DataFrame, gaps: DataFrame) -> DataFrame:
    """For each fingerprint: copies that remain in a fresh scan, blocking gaps, and if it is verified clean."""
    left = fresh.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("remaining"))
    blocking = gaps.agg(F.count_if("blocks_clean").alias("blocking_gaps"))
    out = wanted.select("fingerprint").distinct().join(left, "fingerprint", "left").crossJoin(blocking)  # a single row
    return out.withColumn("remaining", F.coalesce("remaining", F.lit(0).cast("bigint"))).withColumn("is_verified_clean", (F.col("remaining") == 0) & (F.col("blocking_gaps") == 0))


def summary(outcomes: DataFrame, planned: DataFrame) -> DataFrame:
    """Counts by outcome, and by reason for what was put off."""
    done = outcomes.groupBy(F.col("outcome").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return done.unionByName(deferred(planned).select(F.concat(F.lit("deferred:"), "deferral").alias("name"), "n"))
