import hashlib
import re

from pyspark.sql import functions as F

from tests.llm import cases
from veilsift.llm import exact_dedup as module
from veilsift.llm.exact_dedup import MergeIndex, deduplicated, exact_duplicates


def brute(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, n, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_against_brute_force_with_awkward_rows(spark):
    got = sorted((tuple(r) for r in exact_duplicates(cases.frame(spark)).collect()), key=str)
    assert got == brute([r[:2] for r in cases.rows()])


def test_empty_table(spark):
    assert exact_duplicates(cases.frame(spark, [])).count() == 0
    assert deduplicated(cases.frame(spark, [])).count() == 0


def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(spark):
    docs = cases.plain(spark, [(i, f"text {i % 5}") for i in range(40)])
    weak = exact_duplicates(docs, digest=lambda t: F.lit("same"))
    groups = {tuple(r) for r in weak.groupBy("keep_id", "group_size").count().collect()}
    assert groups == {(k, 8, 8) for k in range(5)}


def test_one_row_of_each_group_stays(spark):
    kept = deduplicated(cases.frame(spark)).select("doc_id").collect()
    assert sorted((r[0] is None, r[0] or 0) for r in kept) == [(False, -13), (False, 2), (False, 5), (False, 6), (False, 8), (False, 9), (False, 12), (True, 0)]


def test_runs_are_merged_level_by_level_without_a_shuffle(spark):
    index = MergeIndex(spark)

    def entries(ids):
        order = F.struct(F.lit(-1).alias("less"), F.lit(False).alias("none"), F.col("id").alias("doc_id"), F.col("id").alias("row"))
        return spark.createDataFrame([(i, f"d{i % 3}") for i in ids], "id bigint, digest string").select("digest", order.alias("order"), F.lit(1).cast("bigint").alias("members"))

    def held():
        return {r["digest"]: (r["order"]["doc_id"], r["members"]) for r in index.entries().collect()}

    index.flush(entries(range(5, 9)))
    assert [len(x) for x in index.levels] == [1]
    index.flush(entries(range(2, 5)))
    assert [len(x) for x in index.levels] == [0, 1] and held() == {"d0": (3, 2), "d1": (4, 2), "d2": (2, 3)}
    index.flush(entries([1, 30]))
    assert [len(x) for x in index.levels] == [1, 1] and held() == {"d0": (3, 3), "d1": (1, 3), "d2": (2, 3)}
    assert "Exchange" not in index.entries()._jdf.queryExecution().executedPlan().toString()
    index.flush(entries([0]))
    assert [len(x) for x in index.levels] == [0, 0, 1] and held() == {"d0": (0, 4), "d1": (1, 3), "d2": (2, 3)}
    found = index.lookup("d0", "none")
    assert [(r["digest"], r["order"]["doc_id"], r["members"]) for r in found.collect()] == [("d0", 0, 4)]
    assert "PushedFilters: [In(digest" in found._jdf.queryExecution().toString()
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lsm_")]


def test_number_of_runs_and_shuffled_hits_change_nothing(spark, monkeypatch):
    docs = cases.plain(spark, [(i, f"text {i % 37} " * (1 + i % 3)) for i in range(300)]).repartition(6)
    one = sorted(map(tuple, module.decided(docs, runs=1).drop("text_key").collect()))
    assert sorted(one, key=str) == brute([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()])
    monkeypatch.setattr(module, "SENT_HITS", 3)
    monkeypatch.setattr(module, "MOST_BITS", 15)
    assert sorted(map(tuple, module.decided(docs, runs=6).drop("text_key").collect())) == one


def test_filter_tells_all_keys(spark):
    keys = spark.range(-3000, 3000, 7).select(F.xxhash64("id").alias("key"))
    told = module.Filter(keys, 857).told(spark.range(-3000, 3000).select(F.col("id"), F.xxhash64("id").alias("k")), F.col("k"))
    assert {r["id"] for r in told.where("__may").collect()} >= set(range(-3000, 3000, 7))
    assert told.where("__may").count() < 1400 and told.count() == 6000


def test_lookups_consult_the_filter(spark):
    plan = exact_duplicates(cases.frame(spark))._jdf.queryExecution().toString()
    assert "__may" in plan and "__map" in plan


def test_columns_with_clashing_names_stay(spark):
    docs = cases.plain(spark, [(1, "a"), (2, "a "), (2, "a "), (3, "b")]).withColumnsRenamed({"lang": "__own0", "source": "gone_id"}).withColumn("text_key", F.lit(1))
    kept = deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_main_path_has_no_python(spark):
    plan = exact_duplicates(cases.frame(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
