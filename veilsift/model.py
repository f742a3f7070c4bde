"""Schemas and enumerations of the engine's tables."""

from __future__ import annotations

LOCATOR = "tag string, line bigint, line_offset bigint, pointer string, table string, rowid bigint, column string"
REGION = f"adapter string, store string, path string, {LOCATOR}, text string, base_offset bigint, offset_map array<bigint>, reliable boolean"
FINDING = (
    "adapter string, store string, path string, session string, project string, "
    f"{LOCATOR}, locator string, rule string, kind string, label string, confidence string, masked string, fingerprint string, "
    "start bigint, end bigint, feasibility string, preimage string, expires double"
)
REASON = "struct<tag:string,detail:string,line:bigint,offset:bigint,bytes:bigint,limit:bigint>"
GAP = f"adapter string, store string, path string, reason {REASON}, blocks_clean boolean"
CURSOR = "path string, adapter string, store string, device bigint, inode bigint, size bigint, modified double, offset bigint"
EVENT = "id bigint, ts timestamp, kind string, adapter string, store string, fp_prefix string, path string, message string"
POLICY = "fingerprint string, policy string, until timestamp, label string, created_at timestamp"
META = "key string, value string"

# States of occurrences, ways and outcomes of redaction, reasons to put one off, gaps, policies.
OCCURRENCE_STATES = ["detected", "waitingForInactiveSession", "readyToRedact", "redacted", "verified", "reappeared", "failed", "dismissed"]
FEASIBILITY = ["byteLengthPreserving", "semanticRewrite", "binaryCell", "offsetsUnreliable"]
DEFERRALS = ["missingStore", "readOnlyStore", "adapterConstraint", "notRedactable", "artifactChanged", "sessionActive", "noLongerPresent"]
OUTCOMES = ["applied", "alreadyApplied", "preimageMismatch", "artifactChanged", "verificationFailed", "failed"]
GAP_REASONS = ["unknownStore", "unsupportedSchema", "unreadable", "oversizeArtifact", "oversizeRecord", "corruptRecord", "truncatedTail", "excludedByPolicy", "skippedSymlink", "binaryArtifact", "offsetsUnreliable"]
HARMLESS_GAPS = ["excludedByPolicy", "binaryArtifact"]
POLICIES = ["alwaysRedact", "redactNow", "redactWhenSessionEnds", "keepUntil", "keepForever", "undecided"]


def names(ddl: str) -> list[str]:
    """Column names of a flat schema."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fieldNames()
