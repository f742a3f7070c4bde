"""Which stores each agent keeps, and which file belongs to which."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from typing import NamedTuple


class Store(NamedTuple):
    name: str
    tier: str
    entries: str


class Adapter(NamedTuple):
    """An agent family: where it lives, its stores, limits, and where one folder feeds several stores."""

    name: str
    variable: str
    home: tuple[str, ...]
    stores: tuple[Store, ...]
    most_bytes: int = 256 << 20
    delta: bool = False
    split: dict[str, Callable[[list[str]], str | None]] = {}
    suffixes: tuple[str, ...] = ()


TIERS = ("conversation", "memory", "extended", "excluded")
SCANNED_BY_DEFAULT = ("conversation", "memory")
IGNORED = {".DS_Store", ".continueignore"}


def _projects(c: list[str]) -> str | None:
    """claude-code, ``projects/<project>/...``."""
    if len(c) < 2:
        return None
    if (len(c), c[-1]) in ((2, "bridge-pointer.json"), (3, "ccr-tip.json")):
        return "project-metadata"
    if len(c) == 2 and ".jsonl" in c[1]:
        return "transcripts"
    if c[1] == "memory":
        return "memory"
    return {"subagents": "subagents", "tool-results": "tool-results"}.get(c[2]) if len(c) >= 4 else None


def _chats(c: list[str]) -> str | None:
    """gemini-cli, ``tmp/<project>/...``."""
    if len(c) >= 3 and c[1] == "chats" and c[2].endswith(".jsonl"):
        return "chats"
    if len(c) == 2 and c[1] == "logs.json":
        return "logs"
    return "checkpoints" if len(c) >= 3 and c[1] == "checkpoints" else None


def _json(c: list[str]) -> bool:
    return c[-1].endswith((".json", ".jsonl"))


def _tasks(c: list[str]) -> str | None:
    """cline, ``tasks/<task>/...``."""
    if len(c) < 2 or not _json(c):
        return None
    return "ui-messages" if c[-1] == "ui_messages.json" else "conversations"


def _data(c: list[str]) -> str | None:
    """cline, ``data/...``."""
    return "sessions" if len(c) >= 3 and c[0] == "sessions" and _json(c) else None


def _editor(c: list[str]) -> str | None:
    """Editors, ``User/...``."""
    if c[-1].startswith("state.vscdb"):
        if len(c) == 2 and c[0] == "globalStorage":
            return "vscode-global-db" if c[-1] == "state.vscdb" else "vscode-other"
        if len(c) == 3 and c[0] == "workspaceStorage":
            return "vscode-workspace-db" if c[-1] == "state.vscdb" else "vscode-other"
    if c[-1].endswith((".json", ".jsonl")):
        if c[:2] == ["globalStorage", "emptyWindowChatSessions"] or len(c) >= 4 and c[0] == "workspaceStorage" and c[2] in ("chatSessions", "chatEditingSessions"):
            return "vscode-chat-sessions"
    return "vscode-other"


# Agents, their stores, tiers and the entries that each store claims; "*" stands for anything.
ADAPTERS = (
    Adapter("claude-code", "CLAUDE_CONFIG_DIR", (".claude",), (
        Store("prompt-history", "conversation", "history.jsonl"),
        Store("transcripts", "conversation", "projects"),
        Store("subagents", "conversation", ""),
        Store("tool-results", "conversation", ""),
        Store("memory", "memory", "agent-memory"),
        Store("paste-cache", "conversation", "paste-cache"),
        Store("shell-snapshots", "conversation", "shell-snapshots"),
        Store("file-history", "conversation", "file-history"),
        Store("debug", "extended", "debug"),
        Store("plans", "extended", "plans"),
        Store("feedback", "extended", "feedback feedback-bundles"),
        Store("uploads", "extended", "uploads"),
        Store("downloads", "extended", "downloads"),
        Store("bridge-spawn", "extended", "bridge-spawn"),
        Store("todos", "extended", "todos"),
        Store("credentials", "excluded", ".credentials.json"),
        Store("session-markers", "excluded", "sessions"),
        Store("settings", "excluded", "settings.json settings.local.json CLAUDE.md keybindings.json settings.json.bak*"),
        Store("config-backups", "excluded", "backups"),
        Store("extensions", "excluded", "plugins skills hooks commands agents ide"),
        Store("project-metadata", "excluded", ""),
        Store("internal-state", "excluded", "state cache session-env statsig telemetry .last-cleanup .last-update-result.json"),
        Store("global-config", "excluded", ""),
    ), delta=True, split={"projects": _projects}),
    Adapter("codex", "CODEX_HOME", (".codex",), (
        Store("prompt-history", "conversation", "history.jsonl"),
        Store("rollouts", "conversation", "sessions"),
        Store("archived-rollouts", "conversation", "archived_sessions"),
        Store("session-index", "conversation", "session_index.jsonl"),
        Store("state-db", "conversation", "state_*.sqlite"),
        Store("thread-history-db", "conversation", "thread_history_*.sqlite"),
        Store("memories-db", "memory", "memories_*.sqlite"),
        Store("logs-db", "extended", "logs_*.sqlite"),
        Store("other-db", "extended", "goals_*.sqlite queue_*.sqlite"),
        Store("text-logs", "extended", "log"),
        Store("memories", "memory", "memories"),
        Store("credentials", "excluded", "auth.json"),
        Store("settings", "excluded", "config.toml config.json AGENTS.md instructions.md version.json models_cache.json notify.json"),
        Store("writer-locks", "excluded", "thread-writer-locks"),
        Store("extensions", "excluded", "skills prompts plugins rules hooks"),
        Store("internal-state", "excluded", "cache tmp .codex-global-state.json shell_snapshots bin sandbox cloud"),
    ), most_bytes=1 << 30),
    Adapter("gemini-cli", "GEMINI_DIR", (".gemini",), (
        Store("chats", "conversation", "tmp"),
        Store("logs", "conversation", ""),
        Store("checkpoints", "conversation", ""),
        Store("context", "memory", "GEMINI.md"),
        Store("settings", "excluded", "settings.json"),
        Store("credentials", "excluded", "oauth_creds.json google_accounts.json access_tokens.json installation_id user_id"),
        Store("extensions", "excluded", "extensions commands mcp"),
    ), delta=True, split={"tmp": _chats}),
    Adapter("cline", "CLINE_DIR", (".cline",), (
        Store("conversations", "conversation", "tasks"),
        Store("ui-messages", "conversation", ""),
        Store("task-history", "conversation", "state"),
        Store("checkpoints", "extended", "checkpoints"),
        Store("sessions", "conversation", "data"),
        Store("settings", "excluded", "settings.json config.json mcp.json mcpSettings.json cache"),
    ), split={"tasks": _tasks, "data": _data}),
    Adapter("aider", "AIDER_SEARCH_ROOTS", ("",), (
        Store("chat-history", "conversation", ".aider.chat.history.md"),
        Store("input-history", "conversation", ".aider.input.history"),
        Store("llm-history", "conversation", ".aider.llm.history"),
        Store("tags-cache", "excluded", ".aider.tags.cache.v3 .aider.tags.cache.v4"),
    )),
    Adapter("continue", "CONTINUE_GLOBAL_DIR", (".continue",), (
        Store("sessions", "conversation", "sessions"),
        Store("dev-data", "conversation", "dev_data"),
        Store("index", "excluded", "index"),
        Store("config", "excluded", "config.yaml config.json config.ts config.ts.backup .continuerc .continuerc.json config.yaml.backup assistants rules prompts models"),
    ), delta=True),
    Adapter("pi", "PI_CODING_AGENT_SESSION_DIR", (".pi",), (
        Store("sessions", "conversation", "agent"),
        Store("config", "excluded", "config.json config.yaml config.yml settings.json config settings"),
        Store("credentials", "excluded", "auth.json credentials.json credentials token tokens.json .credentials"),
    ), delta=True, suffixes=(".jsonl", ".json", ".html")),
    Adapter("vscode-chat", "", ("Library/Application Support/Cursor", "Library/Application Support/Code", "Library/Application Support/Code - Insiders", "Library/Application Support/Windsurf", "Library/Application Support/VSCodium"), (
        Store("vscode-global-db", "conversation", ""),
        Store("vscode-workspace-db", "conversation", ""),
        Store("vscode-chat-sessions", "conversation", "User"),
        Store("vscode-other", "excluded", "*"),
    ), split={"User": _editor}),
)
BY_NAME = {a.name: a for a in ADAPTERS}

# Columns of known database families that mirror what users see, and of editors' key-value tables the keys of chats.
CELL_COLUMNS = {
    "state-db": {"threads": (("title", "first_user_message", "preview", "name", "git_origin_url"), ()), "thread_attachments": ((), ("payload",)), "thread_artifacts": ((), ("payload",))},
    "thread-history-db": {"thread_items": ((), ("item_json",)), "thread_realtime_items": ((), ("item_json",)), "thread_turns": ((), ("error_json",))},
    "logs-db": {"logs": (("feedback_log_body", "message"), ())},
}
CHAT_KEYS = ("composer*", "bubbleId:*", "cascade*", "agentData:*", "flowData:*", "*chatdata", "*chatData", "cody-local-chatHistory-v2", "chat.*", "*aichat*", "*ChatHistory*", "*chatSession*")
KEY_VALUE_TABLES = ("ItemTable", "cursorDiskKV")
MOST_CELL_BYTES = {"codex": 64 << 20, "vscode-chat": 16 << 20}
AIDER_SKIPPED = {"node_modules", "Library", "Applications", "Pictures", "Music", "Movies", "vendor", "dist", "build", "target", "venv", "__pycache__"}


def claiming(adapter: Adapter, entry: str) -> Store | None:
    """The store that claims an entry of the root; a database's side files belong to its store."""
    base = entry
    for side in ("-wal", "-shm", "-journal"):
        if entry.endswith(".sqlite" + side):
            base = entry[: -len(side)]
    for store in adapter.stores:
        if any(p == base or "*" in p and fnmatch.fnmatchcase(base, p) for p in store.entries.split()):
            return store
    return None


def store_named(adapter: Adapter, name: str) -> Store:
    return next(s for s in adapter.stores if s.name == name)
