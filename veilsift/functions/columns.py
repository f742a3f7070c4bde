"""Scalar functions as Column expressions; all run in the JVM.

The key of ``hmac_sha256`` becomes a literal of the plan: whoever may see plans may see it. Where that matters, findings
are fingerprinted inside the matching tasks instead (``operators.detect``), where the key is part of a closure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilsift.rules import formats
from veilsift.rules.formats import MARKER_LABELS

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BULLET = "•"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hmac_sha256(key: bytes, namespace: str | Column, value: Column) -> Column:
    """Hex of HMAC-SHA256 over namespace, a zero byte and the value's bytes."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    message = F.concat(F.lit(inner), space.cast("binary"), F.lit(b"\0"), value.cast("binary"))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(message, 256))), 256)


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case; every other character, and so every offset, stays."""
    return F.translate(text, _UPPER, _LOWER)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def base62(value: Column, width: int = 6) -> Column:
    digit = [F.substring(F.lit(BASE62), (F.floor(value / F.lit(62**k)) % 62 + 1).cast("int"), F.lit(1)) for k in range(width - 1, -1, -1)]
    return F.concat(*digit)


def valid_checksum(token: Column) -> Column:
    """A 40-character token ``gh?_`` ends in the base-62 CRC-32 of its 30-character body; anything else isn't judged."""
    judged = (F.length(token) == 40) & token.startswith("gh") & (F.substring(token, 4, 1) == "_")
    return ~judged | (base62(F.crc32(F.encode(F.substring(token, 5, 30), "utf-8"))) == F.substring(token, 35, 6))


def jwt_part(token: Column, part: int) -> Column:
    """Text of the header (1) or payload (2); null if it isn't base64."""
    raw = F.translate(F.split(token, r"\.").getItem(part - 1), "-_", "+/")
    padded = F.rpad(raw, F.length(raw) + F.pmod(-F.length(raw), F.lit(4)), "=")
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def jwt_expiry(token: Column) -> Column:
    """Seconds of the claim ``exp``, or null."""
    return F.get_json_object(jwt_part(token, 2), "$.exp").try_cast("double")


def jwt_expired(token: Column, now: Column) -> Column:
    """True if the token tells an expiry before ``now`` (seconds)."""
    return F.coalesce(jwt_expiry(token) < now, F.lit(False))


def jwt_summary(token: Column) -> Column:
    """Header and payload as JSON text, and when the token was issued and ends."""
    payload = jwt_part(token, 2)
    at = lambda claim: F.timestamp_seconds(F.get_json_object(payload, claim).try_cast("double"))
    return F.struct(jwt_part(token, 1).alias("header"), payload.alias("payload"), at("$.iat").alias("issued"), at("$.exp").alias("expires"))


def mask(secret: Column, prefix: int | Column = 0, suffix: int | Column = 4) -> Column:
    """What may be shown of a value, by the shares in ``formats``; bullets stand for the rest."""
    n = F.length(secret)
    short = n < formats.SHORT
    wish = [F.when(short, F.lit(own)).otherwise(F.lit(w) if isinstance(w, int) else w) for own, w in zip(formats.SHORT_SHOWN, (prefix, suffix), strict=True)]
    left = F.least(F.lit(formats.MOST_SHOWN), F.floor(n / F.when(short, formats.SHORT_SHARE).otherwise(formats.LONG_SHARE)).cast("int"))
    head = F.least(wish[0], left)
    tail = F.least(wish[1], left - head)
    hidden = F.greatest(F.lit(formats.LEAST_BULLETS), F.least(F.lit(formats.MOST_BULLETS), n - head - tail))
    return F.concat(F.left(secret, head), F.repeat(F.lit(BULLET), hidden), F.right(secret, tail))


def mask_url(url: Column) -> Column:
    """A URL without its password and path; what has no user part shows its beginning."""
    told = F.regexp_replace(F.regexp_replace(url, formats.URL_PATH, "$1/…"), formats.URL_USER, f"$1:{formats.BULLETS}@")
    return F.when(url.rlike(formats.URL_USER), told).otherwise(F.concat(F.left(url, F.lit(formats.URL_SHOWN)), F.lit(formats.BULLETS)))


def mask_pem(block: Column) -> Column:
    """The type of a private key, never its content."""
    types = F.create_map(*[F.lit(x) for pair in formats.KEY_TYPES.items() for x in pair])
    word = F.regexp_extract(block, f"BEGIN ({'|'.join(formats.KEY_TYPES)})", 1)
    return F.concat(F.lit(formats.KEY_MASK), F.coalesce(F.try_element_at(types, word), F.lit(formats.OTHER_KEY)))


def marker(kind: Column, fingerprint: Column) -> Column:
    """``[REDACTED:<LABEL>:<four digits>]``; the digits are the last of the fingerprint's first eight."""
    label = F.create_map(*[F.lit(x) for pair in MARKER_LABELS.items() for x in pair])[kind]
    return F.concat(F.lit("[REDACTED:"), label, F.lit(":"), F.upper(F.substring(fingerprint, 5, 4)), F.lit("]"))


def replacement(length: Column, kind: Column, fingerprint: Column) -> Column:
    """``length`` ASCII characters: the marker and asterisks, or asterisks alone if it is too short for the marker."""
    tag = marker(kind, fingerprint)
    return F.when(F.length(tag) <= length, F.rpad(tag, length, "*")).otherwise(F.repeat(F.lit("*"), length))


def pointer_escaped(key: Column) -> Column:
    """A key as a part of a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def mapped(offset_map: Column, base: Column, at: Column) -> Column:
    """Serialized offset of a decoded one; without a map they run alike, beyond its end the last entry holds."""
    return F.when(offset_map.isNull(), base + at).otherwise(F.element_at(offset_map, F.least(at + 1, F.size(offset_map)).cast("int")))


def feasibility(reliable: Column, offset_map: Column, start: Column, end: Column) -> Column:
    """How a range can be redacted: ``offsetsUnreliable``, ``byteLengthPreserving`` or ``semanticRewrite``."""
    steps = F.sequence(start.cast("int"), (end - 1).cast("int"))
    stepped = F.exists(steps, lambda i: F.element_at(offset_map, i + 2) - F.element_at(offset_map, i + 1) != 1)
    plain = offset_map.isNull() | (end <= start) | ~F.coalesce(stepped, F.lit(False))
    return F.when(~reliable, "offsetsUnreliable").when(plain, "byteLengthPreserving").otherwise("semanticRewrite")


def occurrences(text: Column, needle: Column) -> Column:
    """How often a needle occurs, without overlaps; 0 for an empty one."""
    n = F.octet_length(needle)
    return F.when(n == 0, F.lit(0)).otherwise(((F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))) / n).cast("int"))


def excerpt(text: Column, start: Column, end: Column, most: int = 160) -> Column:
    """The text around a secret with bullets in its place, on one line, ``most`` characters at most."""
    lead = F.greatest(start - F.lit(60), F.lit(0))
    before = F.substring(text, lead + 1, start - lead)
    after = F.substring(text, end + 1, F.lit(most))
    line = F.trim(F.regexp_replace(F.concat(before, F.repeat(F.lit(BULLET), 6), after), r"\s+", " "))
    return F.left(F.concat(F.when(lead > 0, "…").otherwise(""), line), F.lit(most))


def reliable_decode(raw: Column) -> Column:
    """Text of bytes with U+FFFD for what isn't UTF-8, and if its length is that of the bytes."""
    text = F.make_valid_utf8(raw.cast("string"))
    return F.struct(text.alias("text"), (F.octet_length(text) == F.octet_length(raw)).alias("reliable"))
