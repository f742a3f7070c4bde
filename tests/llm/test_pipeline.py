import os
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from veilsift.llm import decontamination as D
from veilsift.llm import queries
from veilsift.llm import toxicity as T
from veilsift.llm.sentencepiece import Pieces


def compared(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = db.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    left = sorted((tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, sf_dir).collect()), key=str)
    return left, sorted(want.select(*columns).fetchall(), key=str)


def test_queries_equal_their_sql(spark, sf_dir):
    for name in queries.ORACLES:
        left, right = compared(spark, sf_dir, name)
        assert left == right, name


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages_keep_columns_and_only_take_rows_away(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        now = [r[0] for r in out.select("doc_id").collect()]
        assert set(now) <= before and len(now) == len(set(now)) and len(now) > 0.7 * len(before), name
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == ["doc_id", "n_ids", "ids"]
    ids = whole.select("doc_id", "n_ids").collect()
    assert 0 < len(ids) < len(before) and all(r["n_ids"] > 0 for r in ids)


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    for data in (None, []):
        docs = cases.frame(spark, data).withColumnsRenamed({"member": "__own0", "value": "gone_id", "tile": "text_key", "digest": "node"})
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= docs.count(), name
            assert out.columns == (docs.columns if name != corpus_pipeline.STAGES[-1][0] else ["doc_id", "n_ids", "ids"])


def untoxic(docs, spark, sf_dir):
    """Scores gram by gram from the trained model's weights."""
    frame = cases.plain(spark, docs)
    model = T.learn(frame, spark.read.parquet(f"{sf_dir}/labels.parquet"), T.every_fourth(F.col("doc_id")))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    for i, t in docs:
        known = [weight[b] for b in {int(b) for g in T.hashed_grams(t or "") for b in g} if b in weight]
        if 1 / (1 + np.exp(-(sum(known) / np.sqrt(max(1, len(known))) + model.intercept))) < T.THRESHOLD:
            yield i, t


def exact(docs):
    best = {}
    for i, t in docs:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[norm] = min(best.get(norm, (0, i + 1)), (-len(t or ""), i))
    return [(i, t) for i, t in docs if (-len(t or ""), i) in best.values()]


def dissimilar(docs):
    """All pairs of sets of five-word shingles."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, t) for i, t in docs if i in least.values()]


def unleaked(docs, items):
    """All documents against all items that share a seed with them."""
    cut = [D.tokens_of(x) for x in items]
    for i, t in docs:
        words = D.tokens_of(t)
        seeds = {tuple(words[k : k + 4]) for k in range(len(words) - 3)}

        def leaked(own, words=words, seeds=seeds):
            if not any(tuple(own[k : k + 4]) in seeds for k in range(len(own) - 3)):
                return False
            numbers = {w: k for k, w in enumerate(dict.fromkeys(own + words))}
            return sum(k for *_, k in D.greedy_tiles([numbers[w] for w in own], [numbers[w] for w in words])) >= D.COVERAGE * len(own)

        if not any(map(leaked, cut)):
            yield i, t


def test_the_pipeline_is_its_stages_by_hand(spark, sf_dir, tmp_path):
    """Documents of the smallest table, with planted copies, near copies and leaks, through plain versions of all stages."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    long = [(i, t) for i, t in docs if t and 60 < len(t.split()) < 400]
    docs += [(10_000 + i, "  " + t.replace(" ", "\n", 3)) for i, t in long[:8]]
    docs += [(11_000 + i, t + " and one more") for i, t in long[8:16]] + [(12_000 + i, f"{t} {items[i % len(items)]} {t[:40]}") for i, t in long[16:22]] + [(13_000, None), (13_001, "")]
    for name in ("labels", "benchmark"):
        os.symlink(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    cases.plain(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = [len(docs)]
    kept = list(untoxic(docs, spark, sf_dir))
    for step in (exact, dissimilar, lambda d: list(unleaked(d, items))):
        sizes.append(len(kept))
        kept = step(kept)
    sizes.append(len(kept))
    assert all(a > b for a, b in zip(sizes, sizes[1:])), sizes
    pieces = Pieces.read(queries.piece_model())
    want = {i: np.frombuffer(raw, "<i4").tolist() for (i, _), raw in zip(kept, pieces.encode([t for _, t in kept]), strict=True)}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
