"""The relational work on findings: one row for a place, identities, statuses, counts and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank(confidence: Column | str) -> Column:
    """low, medium and high as numbers."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)


def rank_name(level: Column) -> Column:
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level + 1)


def one_for_each_place(findings: DataFrame) -> DataFrame:
    """The surest finding of each (path, locator, start); the rule's name settles ties."""
    w = Window.partitionBy("path", "locator", "start").orderBy(rank("confidence").desc(), "rule", "end")
    return findings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def identities(findings: DataFrame, seen_at: Column | None = None) -> DataFrame:
    """One row for each fingerprint: first kind, label and mask by place, greatest confidence, first and last seen, copies.

    All aggregates combine within tasks, so a secret with very many copies isn't gathered in one.
    """
    at = F.current_timestamp() if seen_at is None else seen_at
    first = lambda c: F.min_by(c, F.struct("path", "locator", "start"))
    return findings.groupBy("fingerprint").agg(
        first("kind").alias("kind"),
        first("label").alias("label"),
        first("masked").alias("masked"),
        rank_name(F.max(rank("confidence"))).alias("confidence"),
        F.min(at).alias("first_seen"),
        F.max(at).alias("last_seen"),
        F.count(F.lit(1)).alias("copies"),
    ).withColumn("alias", F.concat_ws("-", F.lower("kind"), F.left("fingerprint", F.lit(8))))


def ordered(secrets: DataFrame) -> DataFrame:
    """Surest first, then by alias."""
    return secrets.orderBy(rank("confidence").desc(), "alias")


def without_expired(findings: DataFrame, now: Column) -> DataFrame:
    """Without tokens whose expiry is before ``now`` (seconds)."""
    return findings.where(~((F.col("kind") == "jwt") & F.coalesce(F.col("expires") < now, F.lit(False))))


def in_tiers(stores: DataFrame, tiers: list[str]) -> DataFrame:
    """Present stores of the tiers asked for; excluded ones never."""
    return stores.where(F.col("present") & F.col("tier").isin([t for t in tiers if t != "excluded"]))


def outside(rows: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is neither one of ``folders`` (column folder) nor under one.

    Every prefix of a path is looked up by equality, so there is no pairing of all paths with all folders.
    """
    whole = F.length("__path")
    ends = F.filter(F.sequence(F.lit(1), whole), lambda i: (F.substr(F.col("__path"), i + 1, F.lit(1)) == "/") | (i == whole))
    tops = rows.select(F.col(path).alias("__path")).where(whole > 0).distinct()
    tops = tops.select("__path", F.explode(F.transform(ends, lambda i: F.substr(F.col("__path"), F.lit(1), i))).alias("__top"))
    clean = folders.select(F.regexp_replace("folder", "/+$", "").alias("__top")).distinct()
    hit = tops.join(clean, "__top", "left_semi").select("__path").distinct()
    return rows.join(hit, rows[path] == hit["__path"], "left_anti")


def changed(artifacts: DataFrame, cursors: DataFrame) -> DataFrame:
    """Artifacts without a cursor, or whose device, inode, size or time differs from it."""
    c = cursors.select("path", *[F.col(x).alias(f"__{x}") for x in ("device", "inode", "size", "modified")], F.lit(True).alias("__known"))
    same = F.col("__known")
    for x in ("device", "inode", "size", "modified"):
        same = same & F.col(x).eqNullSafe(F.col(f"__{x}"))
    return artifacts.join(c, "path", "left").where(~F.coalesce(same, F.lit(False))).select(*artifacts.columns)


def vanished(cursors: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Cursors whose path isn't listed any more."""
    return cursors.join(artifacts.select("path").distinct(), "path", "left_anti")


def upsert(table: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``news`` in the place of those with equal keys. Keys of ``news`` are distinct."""
    return table.join(news.select(*keys).distinct(), keys, "left_anti").unionByName(news)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; combines within tasks."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return best.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest]).select(*rows.columns)


def clean(findings: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: findings, blocking_gaps, is_clean."""
    a = findings.agg(F.count(F.lit(1)).alias("findings"))
    b = gaps.agg(F.count_if(F.col("blocks_clean")).alias("blocking_gaps"))
    return a.crossJoin(b).withColumn("is_clean", (F.col("findings") == 0) & (F.col("blocking_gaps") == 0))  # one row each


def status(paused: Column, accessible: Column, findings: Column, blocking: Column, verified: Column) -> Column:
    """gray, red, yellow or green."""
    return F.when(paused, "gray").when(~accessible, "red").when((findings > 0) | (blocking > 0), "yellow").when(verified, "green").otherwise("gray")


def headline(state: Column, findings: Column, blocking: Column) -> Column:
    return F.when(state == "red", "Some history can't be read").when(findings > 0, F.concat(findings.cast("string"), F.lit(" copies of secrets found"))).when(blocking > 0, F.concat(blocking.cast("string"), F.lit(" places couldn't be checked"))).when(state == "green", "No secrets found in any known place").otherwise("Not checked yet")


def by_store(findings: DataFrame) -> DataFrame:
    """Copies of each secret by store, most first."""
    return findings.groupBy("fingerprint", "adapter", "store").agg(F.count(F.lit(1)).alias("copies")).orderBy("fingerprint", F.col("copies").desc(), "adapter", "store")


def gap_counts(gaps: DataFrame, most: int = 5) -> DataFrame:
    """Gaps by reason with their number and the first ``most`` paths."""
    each = gaps.groupBy(F.col("reason.tag").alias("reason"), "path").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("reason").orderBy("path")
    counted = each.groupBy("reason").agg(F.sum("n").alias("gaps"))
    first = each.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).groupBy("reason").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return counted.join(first, "reason").orderBy("gaps", "reason")


def count_by(findings: DataFrame, column: Column | str, dismissed: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Copies by a column, most first, without dismissed fingerprints."""
    rows = findings if dismissed is None else findings.join(dismissed.select("fingerprint").distinct(), "fingerprint", "left_anti")
    c = (F.col(column) if isinstance(column, str) else column).alias("name")
    out = rows.groupBy(c).agg(F.count(F.lit(1)).alias("copies")).orderBy(F.col("copies").desc(), "name")
    return out if most is None else out.limit(most)


def project_of(project: Column, path: Column) -> Column:
    """A finding's project, or the folder that its file lies in."""
    return F.coalesce(project, F.element_at(F.split(path, "/"), -2))


def app_of(adapter: Column, path: Column) -> Column:
    """The program that a finding belongs to; of editors the path tells which."""
    editor = F.regexp_extract(path, r"Application Support/([^/]+)/", 1)
    return F.when((adapter == "vscode-chat") & (editor != ""), editor).otherwise(adapter)


def live(secrets: DataFrame, occurrences: DataFrame, active: DataFrame) -> DataFrame:
    """Secrets with a column ``is_live``: some copy lies in an artifact that is in use."""
    hot = occurrences.join(active.select("path").distinct(), "path", "left_semi").select("fingerprint").distinct().withColumn("is_live", F.lit(True))
    return secrets.join(hot, "fingerprint", "left").withColumn("is_live", F.coalesce("is_live", F.lit(False)))


def with_policy(secrets: DataFrame, policies: DataFrame) -> DataFrame:
    return secrets.join(policies.select("fingerprint", "policy", "until"), "fingerprint", "left")


def by_prefix(secrets: DataFrame, prefix: str) -> DataFrame:
    """The one secret whose fingerprint begins with ``prefix``; an error if there is none, or more."""
    found = secrets.where(F.col("fingerprint").startswith(prefix.lower()))
    n = found.select("fingerprint").distinct().limit(2).count()
    if n != 1:
        raise ValueError(f"{'no secret' if not n else 'more than one secret'} begins with {prefix}")
    return found


def new_secrets(now: DataFrame, before: DataFrame) -> DataFrame:
    """Fingerprints that weren't there before."""
    return now.join(before.select("fingerprint").distinct(), "fingerprint", "left_anti")


def overview(findings: DataFrame, dismissed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Copies by kind, by project (the ten with most) and by program, without dismissed fingerprints."""
    return {
        "kind": count_by(findings, "kind", dismissed),
        "project": count_by(findings, project_of(F.col("project"), F.col("path")), dismissed, 10),
        "app": count_by(findings, app_of(F.col("adapter"), F.col("path")), dismissed),
    }


def gap_groups(gaps: DataFrame, most: int = 50) -> DataFrame:
    """Gaps by label in its order, with at most ``most`` paths each."""
    return gap_counts(gaps, most).orderBy("reason")
