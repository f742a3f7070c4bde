import hashlib
import hmac
import json
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests import fixtures
from veilsift.plans import registry, trees
from veilsift.rules import matcher
from veilsift.rules.formats import MARKER_LABELS
from veilsift.sources.jsonwalk import LEAST_BYTES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


ALL, SQL = registry.QUERIES | trees.QUERIES, registry.ORACLES | trees.ORACLES


@pytest.fixture(scope="module")
def sf_dir():
    """Large enough that documents hold credentials."""
    return "/root/testdata/sf0.01"


def rows_of(columns, rows):
    def plain(v):
        return int(v) if isinstance(v, float) and v == int(v) else v

    return sorted((tuple(plain(r[i]) for i in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want, got = db.sql(SQL[name]), ALL[name](spark, sf_dir)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    right = rows_of(range(len(columns)), want.select(*columns).fetchall())
    assert right and rows_of(range(len(columns)), [tuple(r[c] for c in columns) for r in got.collect()]) == right


def test_every_query_without_sql_has_a_test_here():
    assert set(ALL) - set(SQL) == {"github_checksum", "json_walker_offsets", "catalogue_findings", "catalogue_identities", "redaction_spans"}


def test_checksums_are_those_of_the_values(spark, sf_dir):
    values = {(r["doc_id"], r["n"]) for r in registry.hits(spark, sf_dir).collect()}
    got = registry.github_checksum(spark, sf_dir).collect()
    assert values and {(r["doc_id"], r["n"]) for r in got} == values and all(r["valid"] and not r["spoilt"] for r in got)


def test_walker_gives_each_turns_strings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("j")).collect()
    want = []
    for r in rows:
        raw = r["j"].encode()
        for k, v in json.loads(r["j"]).items():
            body = json.dumps(v, ensure_ascii=False)[1:-1].encode()
            assert body in raw
            if len(v.encode()) >= LEAST_BYTES:  # shorter ones are no credentials
                want.append((r["conv_id"], r["turn"], "/" + k, b"\\" in body))
    got = registry.json_walker_offsets(spark, sf_dir).collect()
    assert want and sorted((r["conv_id"], r["turn"], r["pointer"], r["escaped"]) for r in got) == sorted(want)
    text = {(r["conv_id"], r["turn"]): r["j"].encode() for r in rows}
    for r in got:
        raw = text[r["conv_id"], r["turn"]]
        assert raw[r["start"] - 1 : r["start"]] == b'"' and raw[r["end"] : r["end"] + 1] == b'"'


def test_catalogue_queries_are_what_the_scanner_finds_in_each_text(spark, sf_dir):
    want, copies = [], Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = r["text"] or ""
        for m in matcher.scanner().scan(text):
            fp = hmac.new(registry.KEY, m.kind.encode() + b"\0" + m.canonical.encode(), hashlib.sha256).hexdigest()
            start = len(text[: m.start].encode())
            want.append((r["doc_id"], m.rule, m.masked, fp, start, start + len(text[m.start : m.end].encode())))
            copies[fp] += 1
    got = registry.catalogue_findings(spark, sf_dir).collect()
    assert want and sorted((r["doc_id"], r["rule"], r["masked"], r["fingerprint"], r["start"], r["end"]) for r in got) == sorted(want)
    assert {r["fingerprint"]: r["copies"] for r in registry.catalogue_identities(spark, sf_dir).collect()} == copies


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_plaintext_in_outputs(spark, sf_dir):
    values = {r["value"] for r in registry.hits(spark, sf_dir).collect()}
    assert values
    for name in ("catalogue_findings", "catalogue_identities", "secret_mask", "keyed_secret_docs"):
        whole = str(registry.QUERIES[name](spark, sf_dir).collect())
        assert not any(v in whole for v in values)


def test_redaction_spans_of_texts_beyond_ascii(spark, tmp_path):
    token = fixtures.github()
    texts = {1: f"use {token} now", 2: f"été 日本語 🙂 use {token} now", 3: f"{token} – {fixtures.stripe()} für später ü", 4: "été"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.redaction_spans(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and all(r["same_length"] for r in got.values())
    found = registry.catalogue_findings(spark, str(tmp_path)).collect()
    for i, row in got.items():
        raw = texts[i].encode()
        places = {(r["start"], r["end"]): r for r in found if r["doc_id"] == i}
        assert row["spans"] == len(places)
        for (start, end), r in places.items():
            tag = f"[REDACTED:{MARKER_LABELS[r['kind']]}:{r['fingerprint'][4:8].upper()}]".encode()
            assert raw[start:end].decode() in (token, fixtures.stripe())
            raw = raw[:start] + tag.ljust(end - start, b"*") + raw[end:]
        assert row["redacted_sha256"] == hashlib.sha256(raw).hexdigest()


def test_all_values_of_a_document_are_redacted(spark, tmp_path):
    texts = {1: "password=abcdefgh12 and TOKEN: 'zzzz9999yyyy' end", 2: "secret = " + "x1" * 400, 3: "no key words", 4: None, 5: "api_key=short"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in registry.redacted(spark, str(tmp_path)).collect()}
    assert set(out) == {1, 2} and out[1]["found"] == 2 and len(out[2]["redacted"]) == len(texts[2])
    assert not any(v in r["redacted"] for r in out.values() for v in ("abcdefgh12", "zzzz9999yyyy", "x1x1"))
    assert all(r["is_verified_clean"] for r in registry.verify_clean(spark, str(tmp_path)).collect())
