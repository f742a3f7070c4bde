import hashlib
import hmac
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import fixtures as fx
from veilsift.functions import columns as C
from veilsift.rules import matcher
from veilsift.sources.jsonwalk import JSONError, serialized, string_values

VALUES = ["", "a", "short", "elevenchars", "twelve chars", "abcdefghijklmnopqrstuvwxyz0123456789", "été à la plage"]


def test_columns_equal_the_python_forms(spark):
    rows = spark.createDataFrame([(v,) for v in VALUES], "v string")
    key = b"k" * 32
    out = rows.select("v", C.mask(F.col("v"), 4, 4).alias("m"), C.entropy(F.col("v")).alias("e"), C.hmac_sha256(key, "ns", F.col("v")).alias("h"), C.lower_ascii(F.col("v")).alias("l"))
    for r in out.collect():
        assert r["m"] == matcher.mask(r["v"], "githubToken", (4, 4))
        assert abs(r["e"] - matcher.entropy(r["v"])) < 1e-9
        assert r["h"] == hmac.new(key, b"ns\0" + r["v"].encode(), hashlib.sha256).hexdigest()
        assert r["l"] == matcher.lower_ascii(r["v"])
    long_key = b"x" * 100
    assert rows.select(C.hmac_sha256(long_key, "n", F.lit("v"))).first()[0] == hmac.new(long_key, b"n\0v", hashlib.sha256).hexdigest()


def test_tokens_urls_and_keys(spark):
    row = spark.createDataFrame([(fx.github(), fx.DATABASE, fx.pem(), fx.jwt('{"exp":5}'))], "g string, u string, p string, j string").select(
        C.valid_checksum(F.col("g")), C.valid_checksum(F.concat(F.left("g", F.lit(39)), F.lit("!"))), C.mask_url(F.col("u")), C.mask_pem(F.col("p")), C.jwt_expiry(F.col("j")), C.jwt_expired(F.col("j"), F.lit(6.0)), C.jwt_summary(F.col("j"))["payload"], C.jwt_expiry(F.lit("no.jwt")), C.mask_url(F.lit("not a url at all"))
    ).first()
    assert list(row) == [True, False, "mysql://ledger:••••@sql7.warehouse.corp:3307/…", "Private key · RSA", 5.0, True, '{"exp":5}', None, "not a url at••••"]


def test_redaction_columns(spark):
    fp = "0123456789abcdef" * 4
    row = spark.range(1).select(
        C.replacement(F.lit(30), F.lit("githubToken"), F.lit(fp)), C.replacement(F.lit(5), F.lit("jwt"), F.lit(fp)), C.pointer_escaped(F.lit("a/b~c")),
        C.mapped(F.array(*map(F.lit, [3, 5, 6])), F.lit(0), F.lit(9)), C.mapped(F.lit(None).cast("array<int>"), F.lit(4), F.lit(2)),
        C.feasibility(F.lit(True), F.array(*map(F.lit, [3, 5, 6])), F.lit(0), F.lit(1)), C.feasibility(F.lit(True), F.array(*map(F.lit, [3, 5, 6])), F.lit(1), F.lit(2)), C.feasibility(F.lit(False), F.lit(None).cast("array<int>"), F.lit(0), F.lit(1)),
        C.occurrences(F.lit("ababa"), F.lit("ab")), C.occurrences(F.lit("x"), F.lit("")), C.excerpt(F.lit("a SECRET\nb"), F.lit(2), F.lit(8)), C.reliable_decode(F.lit(b"a\xff"))["reliable"], C.reliable_decode(F.lit("é".encode()))["reliable"],
    ).first()
    assert list(row) == ["[REDACTED:GITHUB:4567]" + "*" * 8, "*****", "a~1b~0c", 6, 6, "semanticRewrite", "byteLengthPreserving", "offsetsUnreliable", 2, 0, "a •••••• b", False, True]


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12)


def leaves(value, pointer=""):
    if isinstance(value, str):
        yield pointer, value
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        yield from leaves(v, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}")


@settings(max_examples=300, deadline=None)
@given(JSON, st.booleans())
def test_walker_finds_all_strings_and_their_bytes(value, ascii_only):
    try:
        data = json.dumps(value, ensure_ascii=ascii_only).encode()
    except UnicodeEncodeError:
        return
    try:
        found = list(string_values(data, least=0))
    except JSONError:
        assert b"\\ud" in data.lower()  # a lone surrogate
        return
    assert [(v.pointer, v.text) for v in found] == list(leaves(value))
    for v in found:
        assert json.loads(b'"' + data[v.start : v.end] + b'"') == v.text
        raw = v.text.encode()
        lo, hi = serialized(v.start, v.offset_map, 0, len(raw))
        assert (lo, hi) == (v.start, v.end)
        if v.offset_map is None:
            assert data[v.start : v.end] == raw


def test_walker_refuses_what_is_not_json():
    for bad in (b'{"a":"xxxxxxx"', b'{"a":1}x', b'["\\ud800aaaaaa"]', b'{"a" "b"}', b"[1,]", b'"\x01aaaaaa"', b"", b"[" * 600, b'["\\x"]', b'["\xff\xfeaaaaa"]'):
        try:
            list(string_values(bad))
        except JSONError:
            continue
        raise AssertionError(bad)
