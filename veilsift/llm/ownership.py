"""Secret scans whose findings are told apart by who owns them across the corpus.

Whole texts are searched for assignments, access keys and long hexadecimal strings, and for further random-looking
strings that alone say little. The digests of all candidates are counted over distinct repositories and owners: a value
that more than ``MOST_OWNERS`` owners or more than ``MOST_REPOSITORIES`` repositories hold, be they one owner's, is a widely
copied example; another whose characters look random is live-looking. The further strings become findings of kind
``owned`` only if live-looking and held by one owner; the base findings stay whatever the counts say.

Values are only kept as digests. Edge cases: a null text is empty; a null repository or owner counts as one of its own;
repeated rows count once for a repository and have a row each in the result; an empty table gives an empty result; other
columns are ignored, whatever their names. Texts of any length are searched whole. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import looked_up, mapped, settled

KINDS = ("assign", "access", "hex", "owned")
MOST_OWNERS, MOST_REPOSITORIES, LEAST_ENTROPY = 2, 3, 3.0
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, shorter ones left out
FURTHER = re.compile(r"[A-Za-z0-9_-]{32,}")


def entropy(value: str) -> float:
    """Bits for each character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind, end, value) of the base findings, in order."""
    low, found = text.lower(), []
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def further_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long strings of mixed characters that no base finding touches."""
    found = []
    for m in FURTHER.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and v.upper() != v and v.lower() != v and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
            found.append((m.start(), 3, m.end(), v))
    return found


SPAN = "struct<start:bigint,kind:int,end:bigint,value:string,random:boolean>"
_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())]))


def candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """doc_id, repository, owner and the candidate spans of each row, values digested; settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(3):
                text = t.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + further_spans(text, base))
                rows.append([{"start": a, "kind": k, "end": b, "value": hashlib.sha256(v.encode()).hexdigest(), "random": entropy(v) >= LEAST_ENTROPY} for a, k, b, v in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, _TYPE)], ["doc_id", "repository", "owner", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(repository.cast("string"), F.lit("\x00")).alias("repository"), F.coalesce(owner.cast("string"), F.lit("\x00")).alias("owner"), "text")
    return settled(rows.transform(mapped, run, f"doc_id bigint, repository string, owner string, spans array<{SPAN}>"), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories, owners and copied of each candidate value. Distinct pairs first, so that no value's rows meet in one task."""
    pairs = found.where(F.size("spans") > 0).select("repository", "owner", F.explode("spans.value").alias("value")).distinct()
    by_owner = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    each = by_owner.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    return each.withColumn("copied", (F.col("owners") > MOST_OWNERS) | (F.col("repositories") > MOST_REPOSITORIES))


def secret_scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row per document: counts of the base findings, digest of their places, all spans, how many are live-looking or
    copied, and the most owners and repositories that one of its values has.

    ``repository`` and ``owner``: columns of ``docs``; a repository is a source's documents of a language and an owner
    a source, unless given.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.to_json(F.array("source", "lang"), {"ignoreNullFields": "false"}) if repository is None else repository
    found = candidates(docs, repository, owner)
    verdicts = settled(ownership(found), "verdicts")
    # Rows with candidates are few; each distinct one is judged once and looked up by its key.
    keyed = found.withColumn("row_key", F.when(F.size("spans") > 0, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(F.col("spans").cast("string")).cast("string"))))
    each = settled(keyed.where("row_key is not null").dropDuplicates(["row_key"]).select("row_key", F.explode("spans").alias("s")).select("row_key", "s.*"), "spans")
    judged = looked_up(each, verdicts, "value").where((F.col("kind") < 3) | (F.col("random") & (F.col("owners") == 1) & ~F.col("copied")))
    live = F.col("random") & ~F.col("copied")
    told = judged.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("kept"), F.sum(live.cast("bigint")).alias("n_live"), F.sum(F.col("copied").cast("bigint")).alias("n_copied"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"))
    rows = keyed.select("doc_id", "row_key")  # those without candidates have no key and stay where they are
    rows = rows.where("row_key is not null").join(told, "row_key", "left").unionByName(rows.where("row_key is null"), allowMissingColumns=True)
    kept = F.coalesce("kept", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter("kept", lambda s: s["kind"] < 3)
    names = F.array(*map(F.lit, KINDS))

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("kept", lambda s: s["kind"] == kind)).cast("bigint")

    rows = rows.withColumn("kept", kept)
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
        line(F.col("kept")).alias("spans"),
        F.coalesce("n_live", F.lit(0).cast("bigint")).alias("n_live"),
        F.coalesce("n_copied", F.lit(0).cast("bigint")).alias("n_copied"),
        F.coalesce("most_owners", F.lit(0).cast("bigint")).alias("most_owners"),
        F.coalesce("most_repositories", F.lit(0).cast("bigint")).alias("most_repositories"),
    )
