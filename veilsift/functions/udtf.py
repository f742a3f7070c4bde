"""Table functions for SQL: ``json_strings(record)`` and ``find_secrets(text)``.

    register(spark, key)
    spark.sql("SELECT d.doc_id, s.* FROM documents d, LATERAL find_secrets(d.text) s")

Rows travel in Arrow batches. No plaintext is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from veilsift.operators.detect import byte_range, fingerprint
from veilsift.rules.matcher import scanner
from veilsift.sources.jsonwalk import JSONError, feasibility, string_values

JSON_STRINGS = "pointer string, text string, start int, end int, offset_map array<int>, error string"
FIND_SECRETS = "rule string, kind string, confidence string, label string, masked string, fingerprint string, start int, end int"


class JSONStrings:
    """String values of a JSON document with their byte places; a document that isn't JSON gives one row that says why."""

    def eval(self, record: str) -> Iterator[tuple]:
        if record is None:
            return
        try:
            for v in list(string_values(record.encode())):
                yield v.pointer, v.text, v.start, v.end, v.offset_map, None
        except JSONError as e:
            yield None, None, e.at, None, None, str(e)


class Feasible:
    """How a decoded byte range of each string value could be redacted; nothing for what isn't JSON."""

    def eval(self, record: str, start: int, end: int) -> Iterator[tuple]:
        try:
            for v in list(string_values((record or "null").encode())):
                yield v.pointer, feasibility(True, v.offset_map, start, end)
        except JSONError:
            return


def secrets_function(key: bytes):
    """A table function that finds credentials in a text and fingerprints them with ``key``, which stays in its closure."""

    class FindSecrets:
        def eval(self, text: str) -> Iterator[tuple]:
            for m in scanner().scan(text or ""):
                start, end = byte_range(text, m)
                yield m.rule, m.kind, m.confidence, m.label, m.masked, fingerprint(key, m.kind, m.canonical.encode()), start, end

    return FindSecrets


def register(spark: SparkSession, key: bytes) -> None:
    """Makes the functions known to a session's SQL."""
    spark.udtf.register("json_strings", udtf(JSONStrings, returnType=JSON_STRINGS, useArrow=True))
    spark.udtf.register("redaction_feasibility", udtf(Feasible, returnType="pointer string, feasibility string", useArrow=True))
    spark.udtf.register("find_secrets", udtf(secrets_function(key), returnType=FIND_SECRETS, useArrow=True))
