import random
import zlib

import numpy as np

from tests.llm import cases
from veilsift.llm import toxicity as T


def corpus(n=1600, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        bad = i % 6 == 0
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["Zugrotten", "vylest", "quorbig"]))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    out = T.toxicity(cases.plain(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_grams_of_slices_are_those_of_the_whole(monkeypatch):
    text = "".join(random.Random(1).choices("abcdefghij étü日本🙂", k=5000))
    whole = np.sort(np.concatenate(list(T.hashed_grams(text))))
    monkeypatch.setattr(T, "SLICE", 97)
    assert np.array_equal(np.sort(np.concatenate(list(T.hashed_grams(text)))), whole)
    assert len(whole) == sum(5000 - n + 1 for n in T.ORDERS)


def test_awkward_rows_labels_and_empty_tables(spark):
    docs, labels = corpus(400)
    odd = [(1, None, None), (2, 1, 7), (None, 1, 1), (0, 1, 1), (0, 1, 1), (10**6, 1, 1)]
    table = spark.createDataFrame(labels + odd, "doc_id bigint, quality int, toxic int")
    model = T.learn(cases.plain(spark, docs), table)
    assert T.scored(cases.frame(spark), model).count() == len(cases.rows())
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["predicted"] for r in T.toxicity(cases.frame(spark), none).collect()} == {1}  # nothing is known: one half
    assert T.toxicity(cases.frame(spark, []), none).count() == 0
    one_class = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id bigint, quality int, toxic int")
    assert {r["predicted"] for r in T.toxicity(cases.frame(spark), one_class).collect()} == {0}


def test_rejected_documents_go_and_clean_ones_stay(spark):
    docs, labels = corpus()
    kept = {r["doc_id"] for r in T.untoxic(cases.plain(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    clean = {i for i, _, t in labels if not t}
    assert len(kept & clean) > 0.98 * len(clean) and len(kept - clean) < 0.05 * len(docs)


def plain_grams(text):
    """Buckets of a text's n-grams, character by character."""
    text, found = text.lower(), set()
    for n in T.ORDERS:
        for i in range(len(text) - n + 1):
            h = ord(text[i]) + 1
            for c in text[i + 1 : i + n]:
                h = (h * 2654435761 + ord(c)) % (1 << 32)
            found.add(((h ^ n * 0x9E3779B1 % (1 << 32)) * 0x85EBCA6B % (1 << 32)) >> (32 - T.BITS))
    return found


def test_scores_are_those_of_a_plain_model(spark):
    docs, labels = corpus(600)
    docs += [(10_001, "ÉTÉ Vylest 日本 zugrotten"), (10_002, None), (10_003, ""), (10_004, "Zugrotten " * 200_000)]
    table = cases.plain(spark, docs)
    model = T.learn(table, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    assert len(weight) > 100
    for r in T.scored(table, model).collect():
        text = dict(docs)[r["doc_id"]] or ""
        known = [weight[b] for b in plain_grams(text[:5000]) if b in weight]
        want = 1 / (1 + np.exp(-(sum(known) / np.sqrt(max(1, len(known))) + model.intercept)))
        assert abs(r["score"] - want) < 1e-4, r["doc_id"]
