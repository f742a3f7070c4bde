"""Registered queries over agents' histories: the conversations table written as a home folder of eight agents, then listed,
scanned, redacted and watched by the engine.

Each conversation is a file of one agent (by conv_id modulo 8) in that agent's format; each turn ends in a made-up token
that some conversations share, so that SQL over the table tells what must be found and where.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift import model
from veilsift.engine import Engine, Report
from veilsift.operators import redact
from veilsift.operators.state import State
from veilsift.shared import shared_path
from veilsift.streaming.monitor import Monitor

KEY = hashlib.sha256(b"registered queries over trees").digest()
KIND = "anthropicKey"
#: Agent, store, path and form of the file of a conversation, by conv_id modulo 8.
FAMILIES = [
    ("claude-code", "transcripts", ".claude/projects/-work-app/00000000-0000-4000-8000-{:012d}.jsonl", "lines"),
    ("codex", "rollouts", ".codex/sessions/2026/01/02/rollout-2026-01-02T00-00-00-00000000-0000-4000-8000-{:012d}.jsonl", "lines"),
    ("gemini-cli", "chats", ".gemini/tmp/h/chats/{}.jsonl", "lines"),
    ("cline", "ui-messages", ".cline/tasks/t{}/ui_messages.json", "array"),
    ("aider", "chat-history", "code/app{}/.aider.chat.history.md", "text"),
    ("continue", "sessions", ".continue/sessions/{}.json", "array"),
    ("pi", "sessions", ".pi/agent/--work-app--/{}.jsonl", "lines"),
    ("vscode-chat", "vscode-chat-sessions", "Library/Application Support/Cursor/User/workspaceStorage/w{}/chatSessions/one.json", "array"),
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_BLOCK = KEY.ljust(64, b"\0")
_FP = f"sha256(from_hex('{bytes(b ^ 0x5C for b in _BLOCK).hex()}') || from_hex(sha256(from_hex('{bytes(b ^ 0x36 for b in _BLOCK).hex()}') || encode('{KIND}') || from_hex('00') || encode(token))))"
#: Conversations with agent, store and token of each turn.
TURNS = (
    "t AS (SELECT c.*, ['" + "', '".join(f[0] for f in FAMILIES) + "'][conv_id % 8 + 1] AS adapter, ['" + "', '".join(f[1] for f in FAMILIES) + "'][conv_id % 8 + 1] AS store, "
    f"'sk-ant-oat01-' || md5('token ' || (conv_id % 10) || '/' || turn) AS token FROM conversations c), f AS (SELECT *, {_FP} AS fingerprint FROM t)"
)


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {TURNS} {sql}"
        return f

    return add


def content(turns: list[tuple[str, str]], form: str) -> str:
    """A conversation's file."""
    if form == "text":
        return "".join(f"#### {role}\n{text}\n\n" for role, text in turns)
    records = [{"role": role, "content": [{"type": "text", "text": text}]} for role, text in turns]
    return json.dumps(records, ensure_ascii=False) if form == "array" else "".join(json.dumps(r) + "\n" for r in records)


def home_of(spark: SparkSession, sf_dir: str) -> str:
    """A new home folder below the shared folder with a file for each conversation, written by the tasks that hold them."""
    uri = shared_path(spark, "home")
    home = uri.removeprefix("file://").removeprefix("file:")
    if ":" in home:
        raise ValueError("agents' histories are files: spark.checkpoint.dir must be a mounted folder")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    token = lambda m: F.concat(F.lit(" sk-ant-oat01-"), F.md5(F.encode(F.concat(F.lit("token "), (F.col("conv_id") % 10).cast("string"), F.lit("/"), m["turn"].cast("string")), "utf-8")))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("turns"))
    each = each.select("conv_id", F.transform("turns", lambda m: F.struct(m["role"].alias("role"), F.concat(m["text"], token(m)).alias("text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, _, path, form = FAMILIES[conv % 8]
                full = os.path.join(home, path.format(conv))
                os.makedirs(os.path.dirname(full), exist_ok=True)
                draft = f"{full}.{os.getpid()}.part"
                with open(draft, "wb") as f:
                    f.write(content([(t["role"], t["text"]) for t in turns], form).encode())
                os.utime(draft, (1e9, 1e9))  # long out of use
                os.replace(draft, full)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["conv_id"])

    each.mapInArrow(run, "conv_id bigint").count()
    return home


def engine_for(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, KEY, home_of(spark, sf_dir), {})


def scanned(spark: SparkSession, sf_dir: str) -> tuple[Engine, Report]:
    engine = engine_for(spark, sf_dir)
    return engine, engine.scan()


def planted(found: DataFrame) -> DataFrame:
    """Findings of the tokens that the tree was written with."""
    return found.where(F.col("kind") == KIND)


@query("SELECT adapter, store, count(DISTINCT conv_id) AS artifacts FROM t GROUP BY ALL")
def store_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of each store, as they are listed."""
    _, artifacts, _ = engine_for(spark, sf_dir).listed()
    return artifacts.groupBy("adapter", "store").agg(F.count(F.lit(1)).alias("artifacts"))


@query("SELECT adapter, store, count(*) AS copies, count(DISTINCT fingerprint) AS secrets, count(DISTINCT conv_id) AS files FROM f GROUP BY ALL")
def store_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies, secrets and files with a copy in each store, from lines, documents and plain text."""
    found = planted(scanned(spark, sf_dir)[1].findings)
    return found.groupBy("adapter", "store").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("fingerprint").alias("secrets"), F.count_distinct("path").alias("files"))


@query("SELECT fingerprint, count(*) AS copies, left(any_value(token), 12) || repeat('•', 8) AS masked FROM f GROUP BY fingerprint")
def tree_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities over all agents with their copies and masks."""
    return planted(scanned(spark, sf_dir)[1].secrets).select("fingerprint", "copies", "masked")


@query("SELECT adapter, CASE WHEN conv_id % 16 = 1 THEN 'sessionActive' END AS deferral, 'sameLength' AS edit, count(*) AS n FROM t GROUP BY ALL")
def redaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of all copies can be redacted; rollouts of which every second one counts as in use must wait."""
    engine, report = scanned(spark, sf_dir)
    stores, artifacts, _ = engine.listed()
    number = F.regexp_extract("path", r"-(\d{12})\.jsonl$", 1).cast("bigint")
    active = artifacts.where((F.col("adapter") == "codex") & (number % 16 == 1)).select("path", F.lit("in use").alias("reason"))
    wanted = planted(report.findings).select(*model.names(model.FINDING))
    planned = redact.plan(wanted, report.findings, artifacts, stores, active, KEY)
    return planned.groupBy("adapter", "deferral", "edit").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT fingerprint, count(*) AS applied, 0::BIGINT AS remaining, count(DISTINCT conv_id) AS files FROM f GROUP BY fingerprint")
def redaction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies redacted in their files: edits applied by secret, and what a fresh scan of the files still finds of it."""
    engine, report = scanned(spark, sf_dir)
    wanted = planted(report.findings).select(*model.names(model.FINDING))
    outcomes = engine.apply(engine.plan(wanted))
    left = engine.scan().findings.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("remaining"))
    done = outcomes.where("outcome = 'applied'").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("applied"), F.count_distinct("path").alias("files"))
    return done.join(left, "fingerprint", "left").select("fingerprint", "applied", F.coalesce("remaining", F.lit(0).cast("bigint")).alias("remaining"), "files")


@query("""SELECT adapter, count(*) + count(DISTINCT CASE WHEN conv_id % 8 = 0 THEN conv_id END) AS copies, count(DISTINCT conv_id) AS cursors,
count(DISTINCT CASE WHEN conv_id % 8 = 0 THEN conv_id END) AS grown FROM t WHERE conv_id % 8 <> 4 GROUP BY adapter""")
def monitor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after the transcripts grew by a line each and the files of one agent went away: copies, cursors, and how many
    cursors lie beyond where they lay before."""
    engine = engine_for(spark, sf_dir)
    state = State(spark, shared_path(spark, "state"))
    monitor = Monitor(engine, state)
    monitor.reconcile()
    before = state.read("cursors").select("path", F.col("offset").alias("was"))
    added = "sk-ant-oat01-" + hashlib.md5(b"added").hexdigest()
    for folder, _, names in os.walk(engine.home):
        for name in names:
            path = os.path.join(folder, name)
            if "/.claude/projects/" in path:
                with open(path, "a") as f:
                    f.write(json.dumps({"role": "user", "content": added}) + "\n")
                os.utime(path, (time.time() - 3600,) * 2)
            elif name.startswith(".aider"):
                os.remove(path)
    monitor.reconcile()
    cursors = state.read("cursors").join(before, "path", "left")
    copies = planted(state.read("findings")).groupBy("adapter").agg(F.count(F.lit(1)).alias("copies"))
    told = cursors.groupBy("adapter").agg(F.count(F.lit(1)).alias("cursors"), F.count_if(F.col("offset") > F.col("was")).alias("grown"))
    return told.join(copies, "adapter").select("adapter", "copies", "cursors", "grown")
