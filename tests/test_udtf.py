import json

from tests import fixtures as fx
from veilsift.functions.udtf import register
from veilsift.operators.detect import fingerprint

KEY = b"k" * 32


def test_table_functions_in_sql(spark):
    register(spark, KEY)
    token = fx.github()
    rows = [(1, json.dumps({"a": {"b": "line\n" + token}, "n": 5, "c": "plain value"})), (2, "no json"), (3, None)]
    spark.createDataFrame(rows, "id int, record string").createOrReplaceTempView("records")
    out = spark.sql("SELECT r.id, s.pointer, s.start, s.end, s.offset_map IS NULL AS plain, s.error FROM records r, LATERAL json_strings(r.record) s").collect()
    assert {(r["id"], r["pointer"], r["plain"]) for r in out} == {(1, "/a/b", False), (1, "/c", True), (2, None, True)}
    assert [r["error"] is not None for r in out if r["id"] == 2] == [True]
    found = spark.sql("SELECT r.id, f.* FROM records r, LATERAL json_strings(r.record) s, LATERAL find_secrets(s.text) f").collect()
    assert [(r["id"], r["kind"], r["fingerprint"]) for r in found] == [(1, "githubToken", fingerprint(KEY, "githubToken", token.encode()))]
    assert token not in str(found)
    how = spark.sql("SELECT f.* FROM records r, LATERAL redaction_feasibility(r.record, 0, 6) f WHERE r.id = 1").collect()
    assert {tuple(r) for r in how} == {("/a/b", "semanticRewrite"), ("/c", "byteLengthPreserving")}
