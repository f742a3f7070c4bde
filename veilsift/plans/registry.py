"""Registered queries over the driver's tables and the SQL that states the same.

Every query reads its whole tables. Keyed credentials are found in the JVM (literals first, then one pattern), so plans
stay within code generation; the full rule catalogue runs in ``catalogue_findings``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilsift.functions import columns as C
from veilsift.operators import detect, redact, relational
from veilsift.rules import formats
from veilsift.sources.jsonwalk import feasibility, string_values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = hashlib.sha256(b"registered queries").digest()
KIND = "genericSecret"
PATTERN = r"""(?i)(password|passwd|secret|token|api_?key)["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9+/_=.-]{8,})"""
ANCHOR = "(?i)password|passwd|secret|token|api_?key"
ANCHORS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_PAD = KEY.ljust(64, b"\0")
INNER, OUTER = bytes(b ^ 0x36 for b in _PAD).hex(), bytes(b ^ 0x5C for b in _PAD).hex()


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("$HITS", HITS_SQL).replace("$FP", FP_SQL)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_anchor(text: Column) -> Column:
    return text.rlike(ANCHOR)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n (from 1) and value of each keyed credential in documents. Rows without a literal are left
    out before the pattern is tried."""
    docs = table(spark, sf_dir, "documents").where(has_anchor(F.col("text")))
    values = docs.select("doc_id", "source", "lang", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(2))).alias("p", "value"))
    return values.select("doc_id", "source", "lang", (F.col("p") + 1).cast("bigint").alias("n"), "value")


HITS_SQL = (
    "SELECT doc_id, source, lang, generate_subscripts(v, 1)::BIGINT AS n, unnest(v) AS value FROM "
    "(SELECT doc_id, source, lang, regexp_extract_all(text, '" + PATTERN.replace("'", "''") + "', 2) AS v FROM documents)"
)
FP_SQL = f"sha256(from_hex('{OUTER}') || from_hex(sha256(from_hex('{INNER}') || encode('{KIND}') || from_hex('00') || encode(value))))"


def fingerprinted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fingerprint", C.hmac_sha256(KEY, KIND, F.col("value")))


@query("WITH h AS ($HITS) SELECT source, count(*) AS copies, count(DISTINCT value) AS secrets, count(DISTINCT doc_id) AS docs FROM h GROUP BY source")
def secrets_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("value").alias("secrets"), F.count_distinct("doc_id").alias("docs"))


@query("WITH h AS ($HITS) SELECT lang, count(*) AS copies FROM h GROUP BY lang ORDER BY copies DESC, lang LIMIT 10")
def secrets_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten languages with most copies: a report of the top."""
    return hits(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("copies")).orderBy(F.col("copies").desc(), "lang").limit(10)


@query("""WITH h AS ($HITS), l AS (SELECT *, string_split(value, '') AS c FROM h)
SELECT doc_id, n, round(list_sum(list_transform(list_distinct(c), lambda x: -(len(list_filter(c, lambda y: y = x)) / len(c)) * log2(len(list_filter(c, lambda y: y = x)) / len(c)))), 4) AS bits FROM l""")
def entropy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("doc_id", "n", F.round(C.entropy(F.col("value")), 4).alias("bits"))


@query("""WITH h AS ($HITS), f AS (SELECT *, $FP AS fingerprint FROM h)
SELECT fingerprint, count(*) AS copies, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM f GROUP BY fingerprint""")
def keyed_secret_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities: all copies of a value under its keyed fingerprint."""
    return fingerprinted(hits(spark, sf_dir)).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("WITH h AS ($HITS) SELECT doc_id, n, $FP AS fingerprint FROM h")
def secret_fingerprint_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(hits(spark, sf_dir)).select("doc_id", "n", "fingerprint")


@query("""WITH h AS ($HITS), m AS (SELECT *, length(value) AS k, CASE WHEN length(value) < 12 THEN least(2, length(value) // 4) ELSE least(4, least(12, length(value) // 3)) END AS tail FROM h)
SELECT doc_id, n, repeat('•', greatest(4, least(8, k - tail))::INT) || right(value, tail::INT) AS masked FROM m""")
def secret_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("doc_id", "n", C.mask(F.col("value"), 0, 4).alias("masked"))


@query("""SELECT a.anchor, t.origin, count(*) AS n FROM (SELECT unnest(['password', 'passwd', 'secret', 'token', 'api_key', 'apikey']) AS anchor) a,
(SELECT 'documents' AS origin, lower(text) AS low FROM documents UNION ALL SELECT 'pages', lower(html) FROM pages) t WHERE contains(t.low, a.anchor) GROUP BY ALL""")
def anchor_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents and pages that hold each literal."""
    both = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), C.lower_ascii(F.col("text")).alias("low"))
    both = both.unionByName(table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), C.lower_ascii(F.col("html")).alias("low")))
    found = F.filter(F.array(*map(F.lit, ANCHORS)), lambda a: F.contains(F.col("low"), a))
    return both.select("origin", F.explode(found).alias("anchor")).groupBy("anchor", "origin").agg(F.count(F.lit(1)).alias("n"))


_P = PATTERN.replace("'", "''")
#: The text of each document with its values replaced: what lies between matches, and each match with a marker for its value.
REDACTED_SQL = f"""d AS (SELECT doc_id, string_split_regex(text, '{_P}') AS parts, regexp_extract_all(text, '{_P}', 0) AS m, regexp_extract_all(text, '{_P}', 2) AS v FROM documents WHERE regexp_matches(text, '{_P}')),
e AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS part, m, v FROM d),
f AS (SELECT doc_id, i, part, m[i] AS whole, v[i] AS value FROM e),
g AS (SELECT *, '[REDACTED:SECRET:' || upper(substring($FP, 5, 4)) || ']' AS tag FROM f),
r AS (SELECT doc_id, count(value) AS found, string_agg(part || coalesce(left(whole, length(whole) - length(value)) || CASE WHEN length(tag) <= length(value) THEN rpad(tag, length(value)::INT, '*') ELSE repeat('*', length(value)::INT) END, ''), '' ORDER BY i) AS redacted FROM g GROUP BY doc_id)"""


@query(f"WITH {REDACTED_SQL} SELECT doc_id, found, length(redacted) AS chars, sha256(redacted) AS redacted_sha256 FROM r")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all keyed values replaced at the same length."""
    out = redacted(spark, sf_dir)
    return out.select("doc_id", "found", F.length("redacted").cast("bigint").alias("chars"), F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, found and redacted: the text put together again from what lies between matches and the matches, of which each
    ends in its value."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(ANCHOR)).where(F.col("text").rlike(PATTERN))
    both = docs.select("doc_id", F.split("text", PATTERN, -1).alias("parts"), F.arrays_zip(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("whole"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(2)).alias("value")).alias("matches"))

    def told(part: Column, match: Column) -> Column:
        size = F.length(match["value"])
        new = C.replacement(size, F.lit(KIND), C.hmac_sha256(KEY, KIND, match["value"]))
        return F.concat(part, F.coalesce(F.concat(F.left(match["whole"], F.length(match["whole"]) - size), new), F.lit("")))

    return both.select("doc_id", F.size("matches").cast("bigint").alias("found"), F.array_join(F.zip_with("parts", "matches", told), "").alias("redacted"))


@query(f"WITH {REDACTED_SQL} SELECT doc_id, found, len(regexp_extract_all(redacted, '{_P}', 2)) AS remaining, len(regexp_extract_all(redacted, '{_P}', 2)) = 0 AS is_verified_clean FROM r")
def verify_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted documents, searched afresh with the same pattern."""
    left = redacted(spark, sf_dir).select("doc_id", "found", F.size(F.regexp_extract_all("redacted", F.lit(PATTERN), F.lit(2))).cast("bigint").alias("remaining"))
    return left.withColumn("is_verified_clean", F.col("remaining") == 0)


@query("""WITH h AS ($HITS), b AS (SELECT doc_id, n, value, 'medium' AS confidence, 1 AS r FROM h UNION ALL SELECT doc_id, n, value, 'high', 2 FROM h WHERE length(value) >= 32)
SELECT doc_id, n, confidence FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY r DESC) = 1""")
def dedupe_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules find the same places; the surer one keeps each."""
    h = hits(spark, sf_dir)
    both = h.withColumn("confidence", F.lit("medium")).withColumn("rule", F.lit("a")).unionByName(h.where("length(value) >= 32").withColumn("confidence", F.lit("high")).withColumn("rule", F.lit("b")))
    places = both.select(F.col("doc_id").alias("path"), F.col("n").alias("locator"), F.lit(0).alias("start"), F.lit(0).alias("end"), "rule", "confidence")
    return relational.one_for_each_place(places).select(F.col("path").alias("doc_id"), F.col("locator").alias("n"), "confidence")


@query("WITH h AS ($HITS), d AS (SELECT DISTINCT doc_id FROM h) SELECT d.doc_id, l.quality, l.toxic FROM d LEFT JOIN labels l USING (doc_id)")
def secret_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("doc_id").distinct().join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


def cursors_of(orders: DataFrame) -> DataFrame:
    """Orders as a listing of artifacts: path, device, inode, size, modified."""
    return orders.select(F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(1).alias("device"), F.col("o_orderkey").alias("inode"), F.floor("o_totalprice").cast("bigint").alias("size"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("modified"))


@query("""SELECT '/o/' || o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE 'new' END AS why FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""")
def unchanged_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a listing, the artifacts whose cursor differs (every seventh grew) or is missing (every eleventh)."""
    now = cursors_of(table(spark, sf_dir, "orders"))
    before = now.where("inode % 11 <> 0 or inode % 7 = 0").withColumn("size", F.when(F.col("inode") % 7 == 0, F.col("size") - 1).otherwise(F.col("size")))
    return relational.changed(now, before).select("path", F.when(F.col("inode") % 7 == 0, "changed").otherwise("new").alias("why"))


@query("SELECT '/o/' || o_orderkey AS path FROM orders WHERE o_orderstatus = 'F'")
def vanished_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors of artifacts that are no longer listed."""
    orders = table(spark, sf_dir, "orders")
    return relational.vanished(cursors_of(orders), cursors_of(orders.where("o_orderstatus <> 'F'"))).select("path")


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def cursor_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key wins."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return relational.latest(rows, ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query("SELECT page_id FROM pages WHERE NOT (url LIKE 'https://m.%' OR url LIKE 'http://m.%' OR url LIKE 'https://blog.%')")
def url_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(~(F.col("url").startswith("https://m.") | F.col("url").startswith("http://m.") | F.col("url").startswith("https://blog."))).select("page_id")


@query("""WITH p AS (SELECT page_id, '/' || regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages),
f AS (SELECT DISTINCT regexp_extract(path, '^/[^/]+/[^/]+', 0) AS folder FROM p WHERE page_id % 50 = 0)
SELECT page_id, path FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE p.path = f.folder OR (f.folder <> '' AND starts_with(p.path, f.folder || '/')))""")
def exclusion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under none of some excluded folders; every folder above a path is looked up by equality."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", "^https?://([^?#]*)", 1)).alias("path"))
    folders = pages.where("page_id % 50 = 0").select(F.regexp_extract("path", "^/[^/]+/[^/]+", 0).alias("folder")).distinct()
    return relational.outside(pages, folders)


@query("""WITH h AS ($HITS) SELECT doc_id, n, NOT (regexp_matches(value, '(?i)example') OR regexp_matches(value, '(?i)placeholder') OR regexp_matches(value, '(?i)changeme') OR regexp_matches(value, '(?i)redacted')
OR regexp_matches(value, '(?i)your[_-]?(?:api|secret|token|key|password)') OR regexp_matches(value, '(?i)^(?:xxx+|\\*+|\\.\\.\\.+|true|false|null|none|undefined)$')) AS real FROM h""".replace("\\\\", "\\"))
def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, and if they are more than placeholders."""
    bad = F.lit(False)
    for p in formats.PLACEHOLDERS[4:10]:
        bad = bad | F.col("value").rlike(p)
    return hits(spark, sf_dir).select("doc_id", "n", (~bad).alias("real"))


@query("""SELECT conv_id, turn, 'jsonl:' || (sum(strlen(coalesce(text, '')) + 1) OVER w - strlen(coalesce(text, '')) - 1)::BIGINT || ':/text' AS locator, strlen(coalesce(text, ''))::BIGINT AS bytes
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)""")
def conversation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a region with the place that it would have in a file of its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    at = F.sum(size + 1).over(w) - size - 1
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("jsonl:"), at.cast("bigint").cast("string"), F.lit(":/text")).alias("locator"), size.cast("bigint").alias("bytes"))


@query("""WITH g AS (SELECT doc_id, source, CASE WHEN text IS NULL OR text = '' THEN 'unreadable' WHEN strlen(text) > 20000 THEN 'oversizeArtifact' WHEN contains(text, chr(0)) THEN 'binaryArtifact' END AS reason FROM documents)
SELECT reason, count(*) AS gaps, count(*) FILTER (reason <> 'binaryArtifact') AS blocking FROM g WHERE reason IS NOT NULL GROUP BY reason""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_rows(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("gaps"), F.count_if(F.col("reason") != "binaryArtifact").alias("blocking"))


def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    reason = F.when(text.isNull() | (text == ""), "unreadable").when(F.octet_length(text) > 20000, "oversizeArtifact").when(text.contains("\0"), "binaryArtifact")
    return table(spark, sf_dir, "documents").select("doc_id", "source", reason.alias("reason")).where("reason is not null")


@query("""WITH g AS (SELECT DISTINCT source, CASE WHEN strlen(text) > 20000 THEN 'long' WHEN strlen(text) > 5000 THEN 'middle' ELSE 'short' END AS reason, 'documents/' || doc_id AS path FROM documents),
r AS (SELECT reason, path, count(*) OVER (PARTITION BY reason) AS gaps, row_number() OVER (PARTITION BY reason ORDER BY path) AS k FROM g)
SELECT reason, any_value(gaps) AS gaps, string_agg(path, ',' ORDER BY path) AS paths FROM r WHERE k <= 5 GROUP BY reason""")
def gap_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps by reason with their first five paths: a report of the top."""
    size = F.octet_length("text")
    reason = F.when(size > 20000, "long").when(size > 5000, "middle").otherwise("short")
    rows = table(spark, sf_dir, "documents").select(F.struct(reason.alias("tag")).alias("reason"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"))
    return relational.gap_counts(rows, 5).select("reason", "gaps", F.array_join("paths", ",").alias("paths"))


@query("""WITH h AS ($HITS), f AS (SELECT DISTINCT $FP AS fingerprint, doc_id FROM h), p AS (SELECT DISTINCT fingerprint FROM f WHERE doc_id % 3 = 0)
SELECT f.fingerprint, count(*) AS docs, any_value(p.fingerprint) IS NOT NULL AS has_policy FROM f LEFT JOIN p USING (fingerprint) GROUP BY f.fingerprint""")
def policy_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprinted(hits(spark, sf_dir)).select("fingerprint", "doc_id").distinct()
    policies = f.where("doc_id % 3 = 0").select("fingerprint").distinct().withColumn("policy", F.lit("keepForever")).withColumn("until", F.lit(None).cast("timestamp"))
    secrets = f.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("docs"))
    return relational.with_policy(secrets, policies).select("fingerprint", "docs", F.col("policy").isNotNull().alias("has_policy"))


@query("""WITH h AS ($HITS), f AS (SELECT $FP AS fingerprint, doc_id FROM h)
SELECT fingerprint, 'new' AS side FROM f GROUP BY 1 HAVING min(doc_id % 2) = 1 UNION ALL SELECT fingerprint, 'both' FROM f GROUP BY 1 HAVING min(doc_id % 2) = 0 AND max(doc_id % 2) = 1""")
def new_secret_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of odd documents: those that even ones lack, and those in both."""
    f = fingerprinted(hits(spark, sf_dir))
    odd, even = f.where("doc_id % 2 = 1").select("fingerprint").distinct(), f.where("doc_id % 2 = 0").select("fingerprint").distinct()
    return relational.new_secrets(odd, even).withColumn("side", F.lit("new")).unionByName(odd.intersect(even).withColumn("side", F.lit("both")))


@query("""WITH h AS ($HITS), f AS (SELECT $FP AS fingerprint, source FROM h) SELECT fingerprint, bool_or(source = 'src0') AS is_live, count(*) AS copies FROM f GROUP BY fingerprint""")
def live_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets with a copy in an artifact that is in use."""
    f = fingerprinted(hits(spark, sf_dir)).withColumnRenamed("source", "path")
    active = spark.createDataFrame([("src0",)], "path string")
    return relational.live(f.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies")), f, active).select("fingerprint", "is_live", "copies")


@query("""WITH h AS ($HITS), a AS (SELECT count(*) AS findings FROM h), b AS (SELECT count(*) FILTER (text IS NULL OR text = '' OR strlen(text) > 20000) AS blocking FROM documents)
SELECT findings, blocking, CASE WHEN findings > 0 OR blocking > 0 THEN 'yellow' ELSE 'green' END AS status FROM a, b""")
def status_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = hits(spark, sf_dir).agg(F.count(F.lit(1)).alias("findings"))
    b = gap_rows(spark, sf_dir).agg(F.count_if(F.col("reason") != "binaryArtifact").alias("blocking"))
    row = a.crossJoin(b)  # one row each
    return row.withColumn("status", relational.status(F.lit(False), F.lit(True), F.col("findings"), F.col("blocking"), F.lit(True)))


@query("""WITH c AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(coalesce(text, '')) - 1, 0), 3072))::BIGINT AS start FROM documents)
SELECT doc_id, start, length(substring(coalesce(text, ''), (start + 1)::INT, 4096))::BIGINT AS chars FROM c""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in pieces of 4096 characters that overlap by 1024."""
    text = F.coalesce("text", F.lit(""))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(3072))).alias("start")
    cut = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), starts)
    return cut.select("doc_id", F.col("start").cast("bigint").alias("start"), F.length(F.substr("text", F.col("start") + 1, F.lit(4096))).cast("bigint").alias("chars"))


@query("SELECT page_id, replace(replace(url, '~', '~0'), '/', '~1') AS pointer, strlen(url)::BIGINT AS bytes FROM pages")
def pointer_escaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.pointer_escaped(F.col("url")).alias("pointer"), F.octet_length("url").cast("bigint").alias("bytes"))


@query("""WITH h AS ($HITS), o AS (SELECT source, lang, doc_id, $FP AS fingerprint FROM h)
SELECT fingerprint, source AS adapter, lang AS store, count(*) AS copies FROM o GROUP BY ALL""")
def copies_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.by_store(fingerprinted(hits(spark, sf_dir)).withColumnsRenamed({"source": "adapter", "lang": "store"}))


def base64url(text: Column) -> Column:
    return F.translate(F.base64(F.encode(text, "utf-8")), "+/=\n", "-_")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN sec::DOUBLE WHEN 1 THEN sec + 0.5::DOUBLE END AS expires, CASE event_id % 4 WHEN 0 THEN sec < m WHEN 1 THEN sec + 0.5 < m ELSE false END AS expired
FROM (SELECT event_id, epoch_us(ts) // 1000000 AS sec FROM events), (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2000000 AS m FROM events)""")
def jwt_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token for each event whose claims tell its time as an expiry, in four forms; expired before the middle of all times."""
    events = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    middle = events.agg(F.expr("(min(micros) + max(micros)) div 2000000").alias("m"))
    at, form = F.expr("micros div 1000000").cast("string"), F.col("event_id") % 4
    claims = F.when(form == 0, F.concat(F.lit('{"exp":'), at, F.lit("}"))).when(form == 1, F.concat(F.lit('{"sub":"ü","exp":'), at, F.lit(".5}"))).when(form == 2, F.lit('{"exp":"soon"}')).otherwise(F.lit("no json"))
    token = F.concat_ws(".", base64url(F.lit('{"alg":"none"}')), base64url(claims), F.lit("c2ln"))
    rows = events.select("event_id", token.alias("token")).join(F.broadcast(middle))  # a single row
    return rows.select("event_id", C.jwt_expiry(F.col("token")).alias("expires"), C.jwt_expired(F.col("token"), F.col("m")).alias("expired"))


@query()
def github_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checksum made for each credential's value, and if it and a spoilt one are valid."""
    body = F.rpad(F.regexp_replace("value", "[^A-Za-z0-9]", ""), F.lit(30), "0")
    token = F.concat(F.lit("ghp_"), body, C.base62(F.crc32(F.encode(body, "utf-8"))))
    rows = hits(spark, sf_dir).select("doc_id", "n", token.alias("token"))
    return rows.select("doc_id", "n", C.valid_checksum(F.col("token")).alias("valid"), C.valid_checksum(F.concat(F.left("token", F.lit(39)), F.lit("!"))).alias("spoilt"))


@query()
def json_walker_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String values of each conversation turn as a JSON record, with their byte places."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(c, t, v.pointer, v.start, v.end, v.offset_map is not None, feasibility(True, v.offset_map, 0, len(v.text.encode()))) for c, t, j in zip(*(x.to_pylist() for x in batch.columns), strict=True) for v in string_values(j.encode())]
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "turn", "pointer", "start", "end", "escaped", "feasibility"])

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("record"))
    return rows.mapInArrow(run, "conv_id bigint, turn bigint, pointer string, start bigint, end bigint, escaped boolean, feasibility string")


@query()
def catalogue_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the whole rule catalogue in documents: literals by one automaton, then patterns in windows around them."""
    found = detect.scan_table(table(spark, sf_dir, "documents"), "doc_id", "text", KEY, source="documents")
    return found.select("doc_id", "rule", "kind", "confidence", "masked", "fingerprint", "start", "end", "feasibility")


@query()
def catalogue_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of all credentials in documents."""
    found = relational.one_for_each_place(detect.scan_table(table(spark, sf_dir, "documents"), "doc_id", "text", KEY, source="documents"))
    return relational.identities(found, F.lit("2026-01-01 00:00:00").cast("timestamp"))


@query()
def redaction_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all findings of the catalogue replaced, in one pass over their spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = relational.one_for_each_place(detect.scan_table(docs, "doc_id", "text", KEY, source="documents"))
    new = C.replacement((F.col("end") - F.col("start")).cast("int"), F.col("kind"), F.col("fingerprint")).cast("binary")
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", new.alias("replacement")))).alias("spans"))
    # Offsets are bytes, so texts are cut as bytes.
    joined = docs.join(spans, "doc_id").withColumn("text", F.col("text").cast("binary"))
    out = redact.redacted_text(F.col("text"), F.col("spans"))
    return joined.select("doc_id", F.size("spans").alias("spans"), F.sha2(out, 256).alias("redacted_sha256"), (F.length(out) == F.length("text")).alias("same_length"))
