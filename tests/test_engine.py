import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tests import fixtures as fx
from veilsift import model
from veilsift.engine import Engine, installation_key
from veilsift.operators import detect, relational
from veilsift.operators.detect import PREIMAGE, fingerprint
from veilsift.operators.redact import apply_to_database, apply_to_file
from veilsift.operators.state import State, enforced, read_policy_file, write_policy_file
from veilsift.sources import extract, listing
from veilsift.sources.datasource import register
from veilsift.sources.stores import BY_NAME, claiming
from veilsift.streaming.monitor import Monitor

KEY = b"k" * 32


def counts(frame, *columns):
    return {tuple(r[c] for c in columns): r["count"] for r in frame.groupBy(*columns).count().collect()}


def test_claude_tree(spark, tmp_path):
    fx.claude_tree(str(tmp_path))
    report = Engine(spark, KEY, str(tmp_path), {}).scan()
    by = counts(report.findings, "kind", "store")
    assert {s: n for (k, s), n in by.items() if k == "githubToken"} == {"prompt-history": 1, "transcripts": 2, "subagents": 1, "tool-results": 1}
    pems = report.findings.where("kind = 'privateKey'").select("store", "feasibility", "fingerprint").collect()
    assert {(r["store"], r["feasibility"]) for r in pems} == {("transcripts", "semanticRewrite"), ("paste-cache", "byteLengthPreserving")}
    assert len({r["fingerprint"] for r in pems}) == 1
    gaps = {r[0]: r[1] for r in report.gaps.groupBy("reason.tag").count().collect()}
    assert gaps["unknownStore"] == 2 and gaps["skippedSymlink"] == 1 and gaps["excludedByPolicy"] >= 1
    for r in report.findings.collect():
        with open(r["path"], "rb") as f:
            raw = f.read()[r["start"] : r["end"]]
        assert len(raw) == r["end"] - r["start"]
    whole = "\n".join(r["json"] for r in report.json_lines().collect()) + report.text()
    assert not any(s in whole for s in (fx.github(), fx.stripe(), fx.password(17), fx.pem().split("\n")[1]))
    extended = Engine(spark, KEY, str(tmp_path), {}).scan(("conversation", "memory", "extended"))
    assert extended.findings.where("kind = 'slackToken'").count() == 1
    excluded = spark.createDataFrame([(str(tmp_path / ".claude/projects"),)], "folder string")
    assert set(counts(Engine(spark, KEY, str(tmp_path), {}).scan(excluded=excluded).findings, "store")) == {("prompt-history",), ("paste-cache",), ("shell-snapshots",)}


def test_codex_and_editor_trees(spark, tmp_path):
    fx.codex_tree(str(tmp_path))
    fx.editor_tree(str(tmp_path))
    engine = Engine(spark, KEY, str(tmp_path), {})
    report = engine.scan(("conversation", "memory", "extended"))
    by = counts(report.findings, "adapter", "store")
    assert by == {("codex", "prompt-history"): 1, ("codex", "rollouts"): 1, ("codex", "state-db"): 2, ("codex", "other-db"): 1, ("vscode-chat", "vscode-global-db"): 2, ("vscode-chat", "vscode-chat-sessions"): 1}
    assert report.gaps.where("reason.tag = 'unsupportedSchema' and store = 'other-db'").count() == 1
    assert listing.version_of("codex", str(tmp_path / ".codex")) == "0.9.1"
    assert engine.coverage().where("present").count() > 6
    assert {r["version"] for r in engine.coverage().where("adapter = 'codex'").collect()} == {"0.9.1"}


def test_redaction_end_to_end(spark, tmp_path):
    fx.claude_tree(str(tmp_path))
    fx.codex_tree(str(tmp_path))
    engine = Engine(spark, KEY, str(tmp_path), {})
    before = engine.scan()
    wanted = before.findings.select(*model.names(model.FINDING)).persist()
    sizes = {r["path"]: (os.stat(r["path"]).st_size, os.stat(r["path"]).st_ino) for r in wanted.where("feasibility = 'byteLengthPreserving' and kind <> 'privateKey'").collect()}
    planned = engine.plan(wanted).persist()
    assert counts(planned, "deferral") == {(None,): wanted.count()}
    assert not any(fx.github() in str(r) for r in planned.collect())
    assert counts(engine.apply(planned), "outcome") == {("applied",): wanted.count()}
    assert counts(engine.apply(planned), "outcome").keys() <= {("alreadyApplied",), ("artifactChanged",), ("preimageMismatch",)}
    left = engine.verify(before.secrets)
    assert {r["remaining"] for r in left.collect()} == {0}
    for path, (size, inode) in sizes.items():
        if "transcripts" not in path and "555555555555.jsonl" not in path:
            assert (os.stat(path).st_size, os.stat(path).st_ino) == (size, inode)
        if path.endswith(".jsonl"):
            with open(path) as f:
                assert all(json.loads(line) for line in f)
    db = sqlite3.connect(str(tmp_path / ".codex/state_5.sqlite"))
    assert "REDACTED:GITHUB" in db.execute("SELECT title FROM threads").fetchone()[0]


def test_plans_put_off_what_must_wait(spark, tmp_path):
    root = fx.claude_tree(str(tmp_path))
    engine = Engine(spark, KEY, str(tmp_path), {})
    wanted = engine.scan().findings.select(*model.names(model.FINDING)).persist()
    wanted.count()
    os.remove(os.path.join(root, "shell-snapshots/s.sh"))
    fx.write(root, "paste-cache/abc.txt", "nothing here any more, and as long as it was before" * 10)
    planned = engine.plan(wanted)
    why = counts(planned, "store", "deferral")
    assert why[("shell-snapshots", "artifactChanged")] == 1 and why[("paste-cache", "noLongerPresent")] == 1
    fx.write(root, "sessions/%d.json" % os.getpid(), "{}")
    os.utime(os.path.join(root, "history.jsonl"))
    why = counts(engine.plan(wanted), "store", "deferral")
    assert why[("prompt-history", "sessionActive")] == 2
    assert ("prompt-history", None) in counts(engine.plan(wanted, allow_active=True), "store", "deferral")


def test_records_that_are_not_utf8_are_edited_where_the_bytes_are(spark, tmp_path):
    root, token = tmp_path / ".claude", fx.github(70)
    raw = b"\xff\xfe\x80 \" x \" " + token.encode() + b" tail that must stay \xc3"
    path = fx.write(str(root), "paste-cache/odd.txt", raw)
    twice = fx.write(str(root), "paste-cache/twice.txt", b"\xff " + fx.github(71).encode() + b" \x80 " + fx.github(71).encode())
    engine = Engine(spark, KEY, str(tmp_path), {})
    wanted = engine.scan().findings.select(*model.names(model.FINDING)).persist()
    assert counts(engine.plan(wanted), "deferral") == {("notRedactable",): 3}
    planned = engine.plan(wanted, allow_binary=True).persist()
    assert counts(planned, "path", "deferral") == {(path, None): 1, (twice, "notRedactable"): 2}
    assert counts(engine.apply(planned), "outcome") == {("applied",): 1}
    with open(path, "rb") as f:
        after = f.read()
    at = raw.index(token.encode())
    assert len(after) == len(raw) and after[:at] == raw[:at] and after[at + 40 :] == raw[at + 40 :] and token.encode() not in after
    with open(twice, "rb") as f:
        assert f.read().count(fx.github(71).encode()) == 2


def test_other_conditions_hold_for_binary_records_too(spark, tmp_path):
    root = str(tmp_path / ".claude")
    path = fx.write(root, "paste-cache/odd.txt", b"\xff\x80 " + fx.github(72).encode() + b" end")
    engine = Engine(spark, KEY, str(tmp_path), {})
    wanted = engine.scan().findings.select(*model.names(model.FINDING)).persist()
    wanted.count()
    fx.write(root, "sessions/%d.json" % os.getpid(), "{}")
    os.utime(path)  # in use
    assert counts(engine.plan(wanted, allow_binary=True), "deferral") == {("sessionActive",): 1}
    fx.write(root, "paste-cache/odd.txt", b"\xff\x80 " + b"z" * 44)  # changed
    assert counts(engine.plan(wanted, allow_binary=True), "deferral").keys() <= {("notRedactable",), ("artifactChanged",)}
    os.remove(path)
    assert None not in {d for d, in counts(engine.plan(wanted, allow_binary=True), "deferral")}


def test_databases_of_unknown_schema_are_not_written(spark, tmp_path):
    root = os.path.join(str(tmp_path), ".codex")
    os.makedirs(root)
    path = os.path.join(root, "state_9.sqlite")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE novel (id TEXT, words TEXT)")
    db.execute("INSERT INTO novel VALUES ('1', ?)", ("x " + fx.github(73),))
    db.commit()
    db.close()
    os.utime(path, (1e9, 1e9))
    engine = Engine(spark, KEY, str(tmp_path), {})
    wanted = engine.scan(("conversation", "memory", "extended")).findings.select(*model.names(model.FINDING)).persist()
    assert wanted.count() == 1
    for binary in (False, True):
        assert counts(engine.plan(wanted, allow_binary=binary), "deferral") == {("readOnlyStore",): 1}


def test_work_is_dealt_over_several_tasks(spark, tmp_path):
    for i in range(60):
        fx.write(str(tmp_path), f".claude/paste-cache/{i}.txt", fx.github(100 + i))
    engine = Engine(spark, KEY, str(tmp_path), {})
    _, artifacts, _ = engine.listed()
    scanned = detect.scan_artifacts(artifacts, KEY).select("path", F.spark_partition_id().alias("task"))
    assert len({r["task"] for r in scanned.collect()}) > 6


def edit(**more):
    return {"start": 5, "end": 13, "replacement": "********", "preimage": "", "device": 0, "inode": 0, "artifact_kind": "json", "tag": "json", "table": None, "rowid": None, "column": None} | more


def test_edits_that_would_break_a_file_are_refused(tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"a":"secretxx"}')
    info = os.stat(path)
    place = {"device": info.st_dev, "inode": info.st_ino}
    good = fingerprint(KEY, PREIMAGE, b"secretxx")
    assert apply_to_file(str(path), [edit(start=6, end=14, preimage="wrong", **place)], KEY)[0][0] == "preimageMismatch"
    assert apply_to_file(str(path), [edit(start=6, end=14, preimage=good, device=1, inode=2)], KEY)[0][0] == "artifactChanged"
    assert apply_to_file(str(path), [edit(start=6, end=14, replacement='"*******', preimage=good, **place)], KEY)[0][0] == "verificationFailed"
    assert path.read_text() == '{"a":"secretxx"}'
    assert apply_to_file(str(path), [edit(start=6, end=14, preimage=good, **place)], KEY)[0][0] == "applied"
    assert apply_to_file(str(path), [edit(start=6, end=14, preimage=good, **place)], KEY)[0][0] == "alreadyApplied"
    assert apply_to_file(str(tmp_path / "none"), [edit()], KEY)[0][0] == "failed"


def test_busy_databases_are_left_alone(tmp_path):
    path = str(tmp_path / "x.sqlite")
    db = sqlite3.connect(path, isolation_level=None)
    db.execute("CREATE TABLE t (c TEXT)")
    db.execute("INSERT INTO t VALUES ('secretxx')")
    db.execute("BEGIN EXCLUSIVE")
    info = os.stat(path)
    assert apply_to_database(path, [edit(tag="cell", table="t", rowid=1, column="c", start=0, end=8, device=info.st_dev, inode=info.st_ino)], KEY)[0][0] == "failed"
    db.execute("ROLLBACK")
    info = os.stat(path)
    place = {"device": info.st_dev, "inode": info.st_ino, "tag": "cell", "table": "t", "rowid": 1, "column": "c", "start": 0, "end": 8}
    assert apply_to_database(path, [edit(**place | {"rowid": 9})], KEY)[0][0] == "artifactChanged"
    assert apply_to_database(path, [edit(**place | {"inode": 1})], KEY)[0][0] == "artifactChanged"
    good = fingerprint(KEY, PREIMAGE, b"secretxx")
    db.execute("CREATE TRIGGER t1 AFTER UPDATE ON t BEGIN UPDATE t SET c = 'secretxx' WHERE rowid = new.rowid; END")
    assert apply_to_database(path, [edit(**place, preimage=good)], KEY)[0][0] == "verificationFailed"
    db.execute("DROP TRIGGER t1")
    assert apply_to_database(path, [edit(**place, preimage=good)], KEY)[0][0] == "applied"
    assert db.execute("SELECT c FROM t").fetchall() == [("********",)]


def test_reading_a_database_leaves_its_bytes(tmp_path):
    path = str(tmp_path / "w.sqlite")
    db = sqlite3.connect(path)
    db.execute("PRAGMA journal_mode=WAL")
    db.execute("CREATE TABLE threads (title TEXT)")
    db.execute("INSERT INTO threads VALUES ('only in the log')")
    db.commit()
    before = [open(p, "rb").read() for p in (path, path + "-wal")]
    texts = [x.text for x in extract.items(path, "sqlite", "codex", "state-db") if isinstance(x, extract.Region)]
    assert texts == ["only in the log"]
    assert [open(p, "rb").read() for p in (path, path + "-wal")] == before
    db.close()


def test_lines_chunks_and_broken_files(tmp_path):
    path = str(tmp_path / "a.jsonl")
    with open(path, "wb") as f:
        f.write(b'{"a":"first value"}\nnot json token\n\n' + b"x" * 100 + b'\n{"a":"after"}\n{"cut')
    got = list(extract.lines(path, most=50))
    assert [(x.index, x.offset, x.data is None, x.ended) for x in got] == [(0, 0, False, True), (1, 20, False, True), (2, 35, False, True), (3, 36, True, True), (4, 137, False, True), (5, 151, False, False)]
    tags = [x.tag for x in extract.items(path, "jsonl", "claude-code", "s") if isinstance(x, extract.Gap)]
    assert tags == ["corruptRecord", "corruptRecord", "truncatedTail"]
    delta = list(extract.items(path, "jsonl", "claude-code", "s", 137, True))
    assert delta[-1] == 151 and not any(isinstance(x, extract.Region) and x.text.startswith('{"cut') for x in delta)
    text = ("é" * 700 + "日本🙂") * 5
    plain = str(tmp_path / "p.txt")
    with open(plain, "w") as f:
        f.write(text)
    raw, covered = text.encode(), 0
    for offset, data in extract.chunks(plain, 1000, 100):
        assert raw[offset : offset + len(data)] == data and data.decode() and offset <= covered
        covered = offset + len(data)
    assert covered == len(raw)


def test_listing_of_other_agents(spark, tmp_path):
    home = str(tmp_path)
    fx.write(home, ".gemini/tmp/h/chats/a.jsonl", fx.lines({"t": fx.github(20)}))
    fx.write(home, ".gemini/tmp/h/logs.json", json.dumps([fx.github(21)]))
    fx.write(home, ".gemini/tmp/h/odd.bin", b"\0\1")
    fx.write(home, ".gemini/oauth_creds.json", json.dumps([fx.github(22)]))
    fx.write(home, ".cline/tasks/t1/ui_messages.json", json.dumps([fx.github(23)]))
    fx.write(home, ".cline/tasks/t1/api.json", json.dumps([fx.github(24)]))
    fx.write(home, ".cline/data/sessions/s/x.json", json.dumps([fx.github(25)]))
    fx.write(home, ".continue/sessions/s.json", json.dumps([fx.github(26)]))
    fx.write(home, ".continue/config.json", json.dumps([fx.github(27)]))
    fx.write(home, ".pi/agent/--work-app--/s.jsonl", fx.lines({"t": fx.github(28)}))
    fx.write(home, ".pi/agent/notes.txt", fx.github(29))
    fx.write(home, "code/app/.aider.chat.history.md", fx.github(30))
    fx.write(home, "code/app/.aider.other", fx.github(31))
    fx.write(home, "code/node_modules/x/.aider.chat.history.md", fx.github(32))
    report = Engine(spark, KEY, home, {}).scan()
    assert set(counts(report.findings, "adapter", "store")) == {("gemini-cli", "chats"), ("gemini-cli", "logs"), ("cline", "ui-messages"), ("cline", "conversations"), ("cline", "sessions"), ("continue", "sessions"), ("pi", "sessions"), ("aider", "chat-history")}
    unknown = {os.path.basename(r["path"]) for r in report.gaps.where("reason.tag = 'unknownStore'").collect()}
    assert unknown == {"odd.bin", ".aider.other"}
    assert report.artifacts.where("adapter = 'pi'").first()["project"] == "work-app"
    assert claiming(BY_NAME["codex"], "state_7.sqlite-wal").name == "state-db" and claiming(BY_NAME["claude-code"], "settings.json.bak1").name == "settings"


def test_data_source(spark, tmp_path):
    fx.claude_tree(str(tmp_path))
    register(spark)
    regions = spark.read.format("agent_history").option("adapter", "claude-code").option("home", str(tmp_path)).load()
    assert regions.where("store = 'prompt-history'").count() == 2
    assert regions.where("store = 'nothing'").count() == 0
    one = spark.read.format("agent_history").options(adapter="claude-code", home=str(tmp_path), stores="subagents").load()
    assert [r["store"] for r in one.collect()] == ["subagents"]
    assert {r["tag"] for r in regions.select("tag").distinct().collect()} == {"jsonl", "plain"}


def test_policies_and_state(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    assert state.opened_with(KEY)
    secrets = spark.createDataFrame([("a" * 64,), ("b" * 64,)], "fingerprint string")
    state.set_policy(secrets, "alwaysRedact")
    state.set_policy(secrets.where("fingerprint like 'a%'"), "keepForever", label="mine")
    assert [r[0] for r in enforced(state.read("policies"), F.current_timestamp()).collect()] == ["b" * 64]
    write_policy_file(state.read("policies"), str(tmp_path / "p.json"))
    assert os.stat(tmp_path / "p.json").st_mode & 0o777 == 0o600
    with open(tmp_path / "p.json") as f:
        data = json.load(f) | {"not hex": {"policy": "alwaysRedact"}}
    (tmp_path / "q.json").write_text(json.dumps(data))
    assert read_policy_file(spark, str(tmp_path / "q.json")).count() == 2
    state.remove_policy(secrets)
    assert state.read("policies").count() == 0
    assert state.counted(applied=2) == {"applied": 2} and state.counted(applied=1, failed=1) == {"applied": 3, "failed": 1}
    assert not state.opened_with(b"other" * 8) and state.read("findings").count() == 0
    with pytest.raises(ValueError):
        state.set_policy(secrets, "nonsense")
    assert relational.by_prefix(secrets, "AA").count() == 1
    with pytest.raises(ValueError):
        relational.by_prefix(secrets, "c")
    key = installation_key(str(tmp_path / "k/key"))
    assert installation_key(str(tmp_path / "k/key")) == key and len(key) == 32


def test_monitor(spark, tmp_path):
    home, new = str(tmp_path / "home"), []
    path = fx.write(home, ".claude/history.jsonl", fx.lines({"display": "x " + fx.github()}))
    monitor = Monitor(Engine(spark, KEY, home, {}), State(spark, str(tmp_path / "state")), on_new=lambda s: new.extend(r["kind"] for r in s.collect()))
    assert monitor.reconcile() == 1 and monitor.reconcile() == 0
    assert monitor.snapshot().first()["status"] == "yellow"
    with open(path, "a") as f:
        f.write(fx.lines({"display": fx.slack()}) + '{"display":"cut')
    assert monitor.reconcile() == 1
    found = {r["kind"]: r["start"] for r in monitor.state.read("findings").collect()}
    with open(path, "rb") as f:
        assert found["slackToken"] == f.read().index(fx.slack().encode())
    assert [r["reason"]["tag"] for r in monitor.state.read("gaps").collect()] == ["truncatedTail"]
    with open(path, "a") as f:
        f.write('"}\n')
    monitor.reconcile()
    assert monitor.state.read("gaps").count() == 0 and monitor.state.read("findings").count() == 2
    monitor.state.set_policy(monitor.state.read("secrets").where("kind = 'slackToken'"), "alwaysRedact")
    assert counts(monitor.auto_redact(), "outcome") == {("applied",): 1}
    assert [r["kind"] for r in monitor.state.read("findings").collect()] == ["githubToken"]
    with open(path, "w") as f:
        f.write(fx.lines({"display": "shorter"}))
    monitor.reconcile()
    assert monitor.state.read("findings").count() == 0
    os.remove(path)
    monitor.reconcile()
    assert monitor.state.read("cursors").count() == 0 and new == ["githubToken", "slackToken"]
    assert [r["message"] for r in monitor.state.events().collect()] == ["Slack Bot Token"]


def test_policies_are_enforced_after_a_reconcile_and_changes_told_by_hand(spark, tmp_path):
    home = str(tmp_path / "home")
    path, other = fx.write(home, ".claude/history.jsonl", fx.lines({"display": "x " + fx.github()})), os.path.join(home, ".claude/paste-cache/p.txt")
    monitor = Monitor(Engine(spark, KEY, home, {}), State(spark, str(tmp_path / "state")))
    monitor.reconcile()
    fx.write(home, ".claude/paste-cache/p.txt", fx.slack())
    assert monitor.changed([other]) == 1 and monitor.changed([other]) == 0
    assert {r["kind"] for r in monitor.state.read("secrets").collect()} == {"githubToken", "slackToken"}
    monitor.state.set_policy(monitor.state.read("secrets").where("kind = 'githubToken'"), "alwaysRedact")
    monitor.reconcile()
    with open(path) as f:
        assert fx.github() not in f.read()
    assert {r["kind"] for r in monitor.state.read("secrets").collect()} == {"slackToken"}
    os.remove(other)
    monitor.changed([other])
    assert monitor.state.read("findings").count() == 0


def test_monitor_stream(spark, tmp_path):
    home = str(tmp_path / "home")
    fx.write(home, ".claude/history.jsonl", fx.lines({"display": "x " + fx.github()}))
    monitor = Monitor(Engine(spark, KEY, home, {}), State(spark, str(tmp_path / "state")))
    query = monitor.start(str(tmp_path / "checkpoint"), 1)
    try:
        query.processAllAvailable()
        assert monitor.state.read("findings").count() == 1
    finally:
        query.stop()
