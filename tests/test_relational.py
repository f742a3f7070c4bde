from pyspark.sql import functions as F

from veilsift.operators import relational as R


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def findings(spark):
    data = [
        ("f1", "jwt", "high", "claude-code", "transcripts", "/h/.claude/projects/p/a.jsonl", "jsonl:0:/t", 5, "p", 50.0),
        ("f1", "jwt", "medium", "claude-code", "transcripts", "/h/.claude/projects/p/a.jsonl", "jsonl:0:/t", 5, "p", 50.0),
        ("f2", "githubToken", "high", "vscode-chat", "vscode-global-db", "/h/Library/Application Support/Cursor/User/x.vscdb", "cell", 1, None, None),
        ("f2", "githubToken", "high", "codex", "rollouts", "/h/.codex/sessions/r.jsonl", "jsonl:0:/t", 9, None, None),
    ]
    frame = spark.createDataFrame(data, "fingerprint string, kind string, confidence string, adapter string, store string, path string, locator string, start bigint, project string, expires double")
    return frame.withColumn("rule", F.concat("confidence", F.lit("-rule"))).withColumn("end", F.col("start") + 3).withColumn("label", F.upper("kind")).withColumn("masked", F.lit("••••"))


def test_places_identities_and_order(spark):
    once = R.one_for_each_place(findings(spark))
    assert once.count() == 3 and once.where("confidence = 'medium'").count() == 0
    at = F.lit("2026-01-02 00:00:00").cast("timestamp")
    ids = {r["fingerprint"]: r for r in R.identities(once, at).collect()}
    assert ids["f2"]["copies"] == 2 and ids["f1"]["confidence"] == "high" and ids["f1"]["alias"] == "jwt-f1"
    assert [r["fingerprint"] for r in R.ordered(R.identities(once, at)).collect()] == ["f2", "f1"]
    assert R.without_expired(once, F.lit(60.0)).count() == 2 and R.without_expired(once, F.lit(40.0)).count() == 3


def test_overview(spark):
    dismissed = spark.createDataFrame([("f1",)], "fingerprint string")
    seen = {k: rows(v) for k, v in R.overview(R.one_for_each_place(findings(spark))).items()}
    assert seen == {"kind": [("githubToken", 2), ("jwt", 1)], "project": [("User", 1), ("p", 1), ("sessions", 1)], "app": [("Cursor", 1), ("claude-code", 1), ("codex", 1)]}
    assert rows(R.overview(findings(spark), dismissed)["kind"]) == [("githubToken", 2)]
    assert rows(R.by_store(findings(spark)))[0] == ("f1", "claude-code", "transcripts", 2)


def test_outside_matches_whole_folders_only(spark):
    paths = spark.createDataFrame([("/a/b",), ("/a/b/c",), ("/a/bc",), ("/x",), (None,)], "path string")
    folders = spark.createDataFrame([("/a/b/",), ("/nowhere",)], "folder string")
    assert {r[0] for r in rows(R.outside(paths, folders))} == {"/a/bc", "/x", None}


def test_cursors_upserts_and_latest(spark):
    ddl = "path string, device bigint, inode bigint, size bigint, modified double"
    now = spark.createDataFrame([("a", 1, 1, 5, 1.0), ("b", 1, 2, 5, 1.0), ("c", 1, 3, None, 1.0)], ddl)
    before = spark.createDataFrame([("a", 1, 1, 5, 1.0), ("b", 1, 2, 4, 1.0), ("c", 1, 3, None, 1.0), ("d", 1, 4, 1, 1.0)], ddl)
    assert [r[0] for r in rows(R.changed(now, before))] == ["b"]
    assert [r[0] for r in rows(R.vanished(before, now))] == ["d"]
    assert sorted(r[0] + str(r[3]) for r in rows(R.upsert(before, now.where("path = 'b'"), ["path"]))) == ["a5", "b5", "cNone", "d1"]
    both = spark.createDataFrame([("k", 1, "x"), ("k", 3, "y"), ("k", 2, "z")], "key string, at int, v string")
    assert rows(R.latest(both, ["key"], ["at"])) == [("k", 3, "y")]


def test_status_gaps_and_sets(spark):
    s = lambda *a: spark.range(1).select(R.status(*map(F.lit, a))).first()[0]
    assert [s(True, True, 1, 1, True), s(False, False, 0, 0, True), s(False, True, 1, 0, True), s(False, True, 0, 1, True), s(False, True, 0, 0, True), s(False, True, 0, 0, False)] == ["gray", "red", "yellow", "yellow", "green", "gray"]
    gaps = spark.createDataFrame([(("b",), f"p{i}", True) for i in range(7)] + [(("a",), "q", False)], "reason struct<tag:string>, path string, blocks_clean boolean")
    assert rows(R.gap_counts(gaps, 2)) == [("a", 1, ["q"]), ("b", 7, ["p0", "p1"])]
    assert [r[0] for r in rows(R.gap_groups(gaps))] == ["a", "b"]
    assert R.clean(findings(spark).limit(0), gaps.where("not blocks_clean")).first()["is_clean"]
    assert not R.clean(findings(spark), gaps).first()["is_clean"]
    stores = spark.createDataFrame([("a", "memory", True), ("b", "excluded", True), ("c", "memory", False)], "store string, tier string, present boolean")
    assert [r[0] for r in rows(R.in_tiers(stores, ["memory", "excluded"]))] == ["a"]
