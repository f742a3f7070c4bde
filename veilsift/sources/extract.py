"""Text regions of artifacts, with the bytes that each stands for, and the gaps that reading finds.

Lines, chunks and cells are read one by one; a JSON document or cell is held whole, and an escaped string's map of places
has an entry for each of its bytes, so their memory is bounded by the stores' greatest sizes alone. All runs inside tasks.
"""

from __future__ import annotations

import fnmatch
import os
import sqlite3
from collections.abc import Iterator
from typing import NamedTuple

from veilsift.sources.jsonwalk import JSONError, string_values
from veilsift.sources.stores import CELL_COLUMNS, CHAT_KEYS, KEY_VALUE_TABLES, MOST_CELL_BYTES

READ_BYTES, MOST_RECORD, CHUNK, OVERLAP, BUSY_MS = 1 << 20, 64 << 20, 1 << 20, 16 << 10, 1500


class Region(NamedTuple):
    """A text and where it lies: ``tag`` jsonl, json, plain or cell."""

    tag: str
    line: int | None
    line_offset: int | None
    pointer: str | None
    table: str | None
    rowid: int | None
    column: str | None
    text: str
    base_offset: int
    offset_map: list[int] | None
    reliable: bool


class Gap(NamedTuple):
    tag: str
    detail: str | None = None
    line: int | None = None
    offset: int | None = None
    bytes: int | None = None
    limit: int | None = None


class Line(NamedTuple):
    index: int
    offset: int
    data: bytes | None
    ended: bool


def lossy(data: bytes) -> tuple[str, bool]:
    """Text with U+FFFD for what isn't UTF-8, and whether its bytes are as many as the data's."""
    text = data.decode("utf-8", "replace")
    return text, len(text.encode()) == len(data)


def lines(path: str, start: int = 0, most: int = MOST_RECORD) -> Iterator[Line]:
    """Lines with their byte offsets; one over ``most`` bytes has no data; the last may lack its end."""
    with open(path, "rb") as f:
        f.seek(start)
        index, offset, held, over = 0, start, bytearray(), 0
        while block := f.read(READ_BYTES):
            at = 0
            while (end := block.find(b"\n", at)) >= 0:
                if over or len(held) + end - at > most:
                    yield Line(index, offset, None, True)
                    offset += over + len(held) + end - at + 1
                else:
                    held += block[at:end]
                    yield Line(index, offset, bytes(held), True)
                    offset += len(held) + 1
                held, over, index, at = bytearray(), 0, index + 1, end + 1
            if over or len(held) + len(block) - at > most:
                over += len(held) + len(block) - at
                held = bytearray()
            else:
                held += block[at:]
        if over:
            yield Line(index, offset, None, False)
        elif held:
            yield Line(index, offset, bytes(held), False)


def chunks(path: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, bytes]]:
    """Pieces of a file that overlap and begin and end between characters, with their offsets."""
    with open(path, "rb") as f:
        offset, carry = 0, b""
        while True:
            data = carry + f.read(size - len(carry))
            if not data:
                return
            more = len(data) >= size
            if more:  # cut before a character that isn't whole
                end = len(data)
                while end > len(data) - 4 and data[end - 1] & 0xC0 == 0x80:
                    end -= 1
                if data[end - 1] >= 0xC0:
                    end -= 1
                if end <= len(data) - 4 or end < 1:
                    end = len(data)
                rest, data = data[end:], data[:end]
            yield offset, data
            if not more:
                return
            back = max(1, len(data) - overlap)
            while back < len(data) and data[back] & 0xC0 == 0x80:
                back += 1
            carry = data[back:] + rest
            offset += back


def json_regions(data: bytes, base: int, tag: str, **where) -> Iterator[Region]:
    """Regions of a JSON document that begins at byte ``base``."""
    place = {"line": None, "line_offset": None, "table": None, "rowid": None, "column": None} | where
    for v in string_values(data):
        shifted = None if v.offset_map is None else [o + base for o in v.offset_map]
        yield Region(tag, pointer=v.pointer, text=v.text, base_offset=base + v.start, offset_map=shifted, reliable=True, **place)


def raw_region(data: bytes, base: int, tag: str, **where) -> Region:
    place = {"line": None, "line_offset": None, "pointer": None, "table": None, "rowid": None, "column": None} | where
    text, reliable = lossy(data)
    return Region(tag, text=text, base_offset=base, offset_map=None, reliable=reliable, **place)


def jsonl_items(path: str, start: int = 0, delta: bool = False) -> Iterator[Region | Gap | int]:
    """Regions and gaps of a file of JSON lines; in delta mode a cut-off tail is a gap only. Last comes the offset reached."""
    reached = start
    for line in lines(path, start):
        if line.data is None:
            yield Gap("oversizeRecord", line=line.index, offset=line.offset, limit=MOST_RECORD)
            reached = line.offset if not line.ended else reached
            continue
        body = line.data.removesuffix(b"\r")
        if line.ended:
            reached = line.offset + len(line.data) + 1
        if not body.strip():
            continue
        where = {"line": line.index, "line_offset": line.offset}
        try:
            found = list(json_regions(body, line.offset, "jsonl", **where))
        except JSONError as e:
            if not line.ended:
                yield Gap("truncatedTail", line=line.index, offset=line.offset)
                if delta:
                    continue
            else:
                yield Gap("corruptRecord", str(e), line=line.index, offset=line.offset)
            yield raw_region(body, line.offset, "jsonl", pointer="", **where)
            continue
        if not line.ended:
            reached = line.offset + len(line.data)
        yield from found
    yield reached


def file_items(path: str, kind: str, start: int = 0, delta: bool = False) -> Iterator[Region | Gap | int]:
    """Regions and gaps of a file, then the offset up to which it has been read."""
    if kind == "binary":
        yield Gap("binaryArtifact")
    elif kind == "jsonl":
        yield from jsonl_items(path, start, delta)
        return
    elif kind == "json":
        with open(path, "rb") as f:
            data = f.read()
        try:
            found = list(json_regions(data, 0, "json"))
        except JSONError as e:
            yield Gap("corruptRecord", str(e), line=0)
            found = [raw_region(data, 0, "plain")]
        yield from found
    elif kind == "plainText":
        unreliable = False
        for offset, data in chunks(path):
            region = raw_region(data, offset, "plain")
            unreliable |= not region.reliable
            yield region
        if unreliable:
            yield Gap("offsetsUnreliable")
    yield os.path.getsize(path)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def open_database(path: str) -> tuple[sqlite3.Connection, bool]:
    """A connection that changes nothing, not even a log on closing; false if only a read-only one without the log could be had."""
    try:
        db = sqlite3.connect(f"file:{path}?mode=rw", uri=True, isolation_level=None)
        db.execute(f"PRAGMA busy_timeout = {BUSY_MS}")
        db.execute("PRAGMA query_only = ON")
        if hasattr(db, "setconfig"):
            db.setconfig(sqlite3.SQLITE_DBCONFIG_NO_CKPT_ON_CLOSE, True)
        db.execute("SELECT count(*) FROM sqlite_master").fetchone()
        return db, True
    except sqlite3.Error:
        wal = path + "-wal"
        live = os.path.exists(wal) and os.path.getsize(wal) > 32
        db = sqlite3.connect(f"file:{path}?mode=ro" + ("" if live else "&immutable=1"), uri=True, isolation_level=None)
        return db, not live


def signature(db: sqlite3.Connection) -> dict[str, list[tuple[str, str]]]:
    """Tables with the names and types of their columns."""
    tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    return {t: [(r[1], (r[2] or "").upper()) for r in db.execute(f"PRAGMA table_info({quoted(t)})")] for t in tables}


def cell_plan(adapter: str, store: str, tables: dict[str, list[tuple[str, str]]]) -> tuple[list[tuple[str, str, bool]], list[Gap]]:
    """(table, column, is JSON) of what is read, and a gap if the schema isn't one that is known."""
    if adapter == "vscode-chat":
        plan = [(t, "value", True) for t in KEY_VALUE_TABLES if any(c == "value" for c, _ in tables.get(t, []))]
        return plan, [] if plan else [Gap("unsupportedSchema", "no key-value table")]
    known = CELL_COLUMNS.get(store, {})
    plan, gaps = [], []
    if not any(t in tables for t in known):
        gaps.append(Gap("unsupportedSchema", ", ".join(sorted(tables))))
    for table, columns in tables.items():
        if table.startswith("_sqlx"):
            continue
        names = {c for c, _ in columns}
        if table in known:
            text, json = known[table]
            plan += [(table, c, c in json) for c in (*text, *json) if c in names]
        else:
            plan += [(table, c, False) for c, kind in columns if "TEXT" in kind]
            if known and any(t in tables for t in known):
                gaps.append(Gap("unsupportedSchema", table))
    return plan, gaps


def schema_is_known(path: str, adapter: str, store: str) -> bool:
    """Whether a database has a table that its store is known for; only such databases are ever written."""
    if adapter == "vscode-chat":
        return True  # key-value tables alone are read there
    try:
        db, _ = open_database(path)
        try:
            return any(t in CELL_COLUMNS.get(store, {}) for t in signature(db))
        finally:
            db.close()
    except sqlite3.Error:
        return False


def cells(db: sqlite3.Connection, adapter: str, table: str, column: str, keys: tuple[str, ...] = CHAT_KEYS) -> Iterator[tuple[int, str | bytes]]:
    """rowid and value of the cells that hold text or bytes; of editors' item tables only chats, chosen in the database."""
    sql = f"SELECT rowid AS __rowid, {quoted(column)} AS __cell FROM {quoted(table)} WHERE {quoted(column)} IS NOT NULL"
    values: tuple[str, ...] = ()
    if adapter == "vscode-chat" and table == "ItemTable":
        sql, values = sql + " AND (" + " OR ".join("key GLOB ?" for _ in keys) + ")", keys
    for rowid, value in db.execute(sql, values):
        if isinstance(value, (str, bytes)):
            yield rowid, value


def database_items(path: str, adapter: str, store: str) -> Iterator[Region | Gap | int]:
    """Regions and gaps of a database's cells."""
    try:
        db, whole = open_database(path)
    except sqlite3.Error as e:
        yield Gap("unreadable", str(e))
        yield 0
        return
    try:
        if not whole:
            yield Gap("unreadable", "its log can't be read")
        plan, gaps = cell_plan(adapter, store, signature(db))
        yield from gaps
        limit = MOST_CELL_BYTES.get(adapter, 64 << 20)
        for table, column, is_json in plan:
            for rowid, value in cells(db, adapter, table, column):
                data = value.encode() if isinstance(value, str) else value
                where = {"table": table, "rowid": rowid, "column": column}
                if len(data) > limit:
                    yield Gap("oversizeRecord", f"{table}.{column}", line=rowid, bytes=len(data), limit=limit)
                    continue
                if is_json:
                    try:
                        yield from list(json_regions(data, 0, "cell", **where))
                        continue
                    except JSONError:
                        pass
                yield raw_region(data, 0, "cell", **where)
    except sqlite3.Error as e:
        yield Gap("unreadable", str(e))
    finally:
        db.close()
    yield os.path.getsize(path)


def items(path: str, kind: str, adapter: str, store: str, start: int = 0, delta: bool = False) -> Iterator[Region | Gap | int]:
    """All of an artifact; what can't be read is a gap."""
    try:
        yield from database_items(path, adapter, store) if kind == "sqlite" else file_items(path, kind, start, delta)
    except OSError as e:
        yield Gap("unreadable", e.strerror or str(e))


def matches_any(key: str, globs: tuple[str, ...] = CHAT_KEYS) -> bool:
    """As SQLite's GLOB: in upper and lower case as written."""
    return any(fnmatch.fnmatchcase(key, g) for g in globs)
