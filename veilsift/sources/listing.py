"""What lies on disk: installations, stores, artifacts and the gaps that listing finds. Runs on the driver."""

from __future__ import annotations

import os
import re
import sqlite3
import stat
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from veilsift.sources.stores import ADAPTERS, AIDER_SKIPPED, BY_NAME, IGNORED, Adapter, claiming, store_named

ARTIFACT = "adapter string, root string, store string, tier string, path string, kind string, device bigint, inode bigint, size bigint, modified double, session string, project string"
GAP = "adapter string, store string, path string, reason struct<tag:string,detail:string,line:bigint,offset:bigint,bytes:bigint,limit:bigint>, blocks_clean boolean"
STORE = "adapter string, root string, store string, tier string, locations array<string>, present boolean, capabilities int, exclusion string"
HARMLESS = ("excludedByPolicy", "binaryArtifact")
DETECT, REDACT_ACTIVE, REDACT_INACTIVE, VERIFY = 1, 2, 4, 8
RECENT = 300.0


def gap(adapter: str, store: str | None, path: str, tag: str, detail: str | None = None, line: int | None = None, offset: int | None = None, size: int | None = None, limit: int | None = None) -> tuple:
    return adapter, store, path, (tag, detail, line, offset, size, limit), tag not in HARMLESS


def roots(adapter: Adapter, home: str, environment: dict[str, str]) -> list[str]:
    """Distinct existing folders of an agent, symbolic links resolved; a variable of the environment comes first."""
    named = environment.get(adapter.variable, "") if adapter.variable else ""
    wanted = named.split(os.pathsep) if named else [os.path.join(home, h) for h in adapter.home]
    if adapter.name == "cline" and not named:
        wanted += [os.path.join(home, "Library/Application Support", e, "User/globalStorage/saoudrizwan.claude-dev") for e in ("Code", "Cursor", "Code - Insiders", "Windsurf", "VSCodium")]
    if adapter.name == "gemini-cli" and not named and environment.get("GEMINI_CONFIG_DIR"):
        wanted = [environment["GEMINI_CONFIG_DIR"]]
    found = list(dict.fromkeys(os.path.realpath(os.path.expanduser(w)) for w in wanted if w))
    found = [r for r in found if os.path.isdir(r)]
    if adapter.name == "aider":
        return [d for r in found for d in aider_roots(r)]
    if adapter.name == "vscode-chat":
        return [r for r in found if os.path.isdir(os.path.join(r, "User"))]
    return found


def aider_roots(top: str, depth: int = 5) -> Iterator[str]:
    """Folders with one of aider's files, at most ``depth`` below; hidden and bulky folders are passed over."""
    stack = [(top, 0)]
    while stack:
        folder, level = stack.pop()
        try:
            entries = list(os.scandir(folder))
        except OSError:
            continue
        if any(e.name.startswith(".aider") for e in entries):
            yield folder
        if level < depth:
            stack += [(e.path, level + 1) for e in entries if e.is_dir(follow_symlinks=False) and not e.name.startswith(".") and e.name not in AIDER_SKIPPED]


def kind_of(path: str) -> str:
    name = os.path.basename(path)
    if ".jsonl" in name:
        return "jsonl"
    if name.lower().endswith(".json"):
        return "json"
    if name.endswith((".sqlite", ".vscdb")):
        return "sqlite"
    with open(path, "rb") as f:
        return "binary" if b"\0" in f.read(8192) else "plainText"


def walk(top: str) -> Iterator[tuple[str, os.stat_result]]:
    """Files below ``top`` (or it), links included and never followed."""
    info = os.lstat(top)
    if not stat.S_ISDIR(info.st_mode):
        yield top, info
        return
    stack = [top]
    while stack:
        for e in sorted(os.scandir(stack.pop()), key=lambda e: e.name):
            info = e.stat(follow_symlinks=False)
            if stat.S_ISDIR(info.st_mode):
                stack.append(e.path)
            else:
                yield e.path, info


def session_of(adapter: str, parts: list[str], path: str) -> tuple[str | None, str | None]:
    """Session and project that a path tells."""
    if adapter == "claude-code" and parts[:1] == ["projects"] and len(parts) >= 3:
        rest = parts[1:]
        return (rest[1][:36] if len(rest) == 2 else rest[1] if rest[1] != "memory" else None), rest[0]
    if adapter == "codex":
        m = re.search(r"rollout-.*?([0-9a-f]{8}-[0-9a-f-]{27})\.jsonl", path)
        return (m[1] if m else None), None
    if adapter == "pi":
        return None, next((p[2:-2] for p in parts if p.startswith("--") and p.endswith("--") and len(p) > 4), None)
    if adapter == "cline" and parts[:1] == ["tasks"] and len(parts) > 1:
        return parts[1], None
    return None, None


def list_root(adapter: Adapter, root: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Stores, artifacts and gaps of one installation."""
    places: dict[str, list[str]] = {s.name: [] for s in adapter.stores}
    artifacts, gaps = [], []
    entries = sorted(os.listdir(root))
    if adapter.name == "aider":
        entries = [e for e in entries if e.startswith(".aider")]
    if adapter.name == "pi" and "agent" not in entries and any(e.endswith(".jsonl") for e in entries):
        claims = [(root, "", "sessions")]  # a bare folder of sessions
        entries = []
        places["sessions"].append(root)
    else:
        claims = []
    for entry in entries:
        path, store = os.path.join(root, entry), claiming(adapter, entry)
        if store is None:
            if entry not in IGNORED:
                gaps.append(gap(adapter.name, None, path, "unknownStore"))
            continue
        places[store.name].append(path)
        claims.append((path, entry, store.name))
    for top, entry, primary in claims:
        split = adapter.split.get(entry)
        if store_named(adapter, primary).tier == "excluded" and split is None:
            continue
        for path, info in walk(top):
            parts = [p for p in os.path.relpath(path, root).split(os.sep) if p]
            owner = primary
            if stat.S_ISLNK(info.st_mode):
                gaps.append(gap(adapter.name, owner, path, "skippedSymlink", os.readlink(path)))
                continue
            if split is not None:
                owner = split(parts[1:])
                if owner is None:
                    gaps.append(gap(adapter.name, primary, path, "unknownStore"))
                    continue
            if path.endswith(("-wal", "-shm", "-journal")) or adapter.suffixes and not path.lower().endswith(adapter.suffixes):
                continue
            if adapter.name == "codex" and owner in ("rollouts", "archived-rollouts") and not re.match(r"rollout-.*\.jsonl", os.path.basename(path)):
                gaps.append(gap(adapter.name, owner, path, "unknownStore"))
                continue
            store = store_named(adapter, owner)
            if store.tier == "excluded":
                continue
            if path not in places[owner] and split is not None:
                places[owner].append(path)
            size, modified = info.st_size, info.st_mtime
            wal = path + "-wal"
            if path.endswith((".sqlite", ".vscdb")) and os.path.exists(wal) and os.path.getsize(wal) > 32:
                size, modified = size + os.path.getsize(wal), max(modified, os.path.getmtime(wal))  # what the log holds is content too
            if size > adapter.most_bytes:
                gaps.append(gap(adapter.name, owner, path, "oversizeArtifact", size=size, limit=adapter.most_bytes))
                continue
            try:
                kind = kind_of(path)
            except OSError as e:
                gaps.append(gap(adapter.name, owner, path, "unreadable", str(e)))
                continue
            session, project = session_of(adapter.name, parts, path)
            artifacts.append((adapter.name, root, owner, store.tier, path, kind, info.st_dev, info.st_ino, size, modified, session, project))
    if adapter.name == "claude-code" and os.path.exists(sibling := os.path.join(os.path.dirname(root), ".claude.json")):
        places["global-config"].append(sibling)
    able = DETECT | VERIFY | REDACT_INACTIVE
    stores = [(adapter.name, root, s.name, s.tier, places[s.name], bool(places[s.name]), 0 if s.tier == "excluded" else able, "not content" if s.tier == "excluded" else None) for s in adapter.stores]
    gaps += [gap(adapter.name, s.name, p, "excludedByPolicy") for s in adapter.stores if s.tier == "excluded" and s.name != "vscode-other" for p in places[s.name]]
    return stores, artifacts, gaps


def listed(spark: SparkSession, home: str | None = None, environment: dict[str, str] | None = None, adapters: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of stores, artifacts and gaps of all installations found."""
    environment = dict(os.environ) if environment is None else environment
    home = home or os.path.expanduser("~")
    stores, artifacts, gaps = [], [], []
    for adapter in ADAPTERS if adapters is None else [BY_NAME[a] for a in adapters]:
        for root in roots(adapter, home, environment):
            for target, more in zip((stores, artifacts, gaps), list_root(adapter, root), strict=True):
                target += more
    return spark.createDataFrame(stores, STORE), spark.createDataFrame(artifacts, ARTIFACT), spark.createDataFrame(gaps, GAP)


def version_of(adapter: str, root: str) -> str | None:
    """The agent's version: from the newest transcripts' beginnings, or from the newest thread of a state database."""
    if adapter == "codex":
        for name in sorted((n for n in os.listdir(root) if re.fullmatch(r"state_\d+\.sqlite", n)), reverse=True):
            with sqlite3.connect(f"file:{os.path.join(root, name)}?mode=ro", uri=True) as db:
                try:
                    row = db.execute("SELECT cli_version FROM threads WHERE cli_version <> '' ORDER BY updated_at DESC LIMIT 1").fetchone()
                except sqlite3.Error:
                    continue
                if row:
                    return row[0]
        return None
    found = sorted((p for p, i in walk(root) if p.endswith(".jsonl") and not stat.S_ISLNK(i.st_mode)), key=os.path.getmtime, reverse=True)[:10]
    for path in found:
        with open(path, "rb") as f:
            if m := re.search(rb'"version"\s*:\s*"([^"]+)"', f.read(65536)):
                return m[1].decode()
    return None


def active_reason(adapter: str, root: str, path: str, now: float | None = None, alive=None) -> str | None:
    """Why an artifact counts as in use, or None: changed within five minutes, with what else the agent tells."""
    now = time.time() if now is None else now
    wal = path + "-wal"
    changed = max(os.path.getmtime(p) for p in (path, wal) if os.path.exists(p)) if os.path.exists(path) else 0.0
    recent = now - changed < RECENT
    if adapter == "claude-code":
        return "a session is running and the file changed recently" if recent and any(map(alive or _alive, _session_pids(root))) else None
    if adapter in ("codex", "vscode-chat") and os.path.exists(wal) and os.path.getsize(wal) > 0 and recent:
        return "its log holds recent changes"
    if adapter == "codex" and recent and os.path.isdir(locks := os.path.join(root, "thread-writer-locks")) and any(map(_locked, (os.path.join(locks, n) for n in os.listdir(locks)))):
        return "a writer holds a lock"
    return "the file changed recently" if recent and adapter not in ("codex", "vscode-chat") else None


def _session_pids(root: str) -> list[int]:
    folder = os.path.join(root, "sessions")
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return [int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n))]


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


def _locked(path: str) -> bool:
    import fcntl

    try:
        with open(path, "rb") as f:
            fcntl.flock(f, fcntl.LOCK_SH | fcntl.LOCK_NB)
            fcntl.flock(f, fcntl.LOCK_UN)
    except BlockingIOError:
        return True
    except OSError:
        return False
    return False
