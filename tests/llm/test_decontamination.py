import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from veilsift.llm import decontamination as D


def brute_tiles(item, text, least):
    """Greedy string tiling by trying everything: the longest unmarked match first."""
    done_i, done_t, out = [x < 0 for x in item], [x < 0 for x in text], []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and not done_i[p + k] and not done_t[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < least:
            return out
        out.append((p, t, k))
        done_i[p : p + k] = done_t[t : t + k] = [True] * k


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(-1, 3), max_size=30))
def test_tiles_cover_what_greedy_tiling_by_hand_covers(item, text):
    got, want = D.greedy_tiles(item, text, 3), brute_tiles(item, text, 3)
    for p, t, k in got:
        assert item[p : p + k] == text[t : t + k] and k >= 3
    assert len({p + i for p, _, k in got for i in range(k)}) == sum(k for *_, k in got)
    assert len({t + i for _, t, k in got for i in range(k)}) == sum(k for *_, k in got)
    assert not want or max(k for *_, k in got) == max(k for *_, k in want)
    assert bool(got) == bool(want)


def bench(n=30, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfghjk" for b in ("an", "el", "ir", "os", "ut", "ay")]
    return words, [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 60))) + ".") for i in range(n)]


def test_planted_passages_are_found_in_whatever_order(spark):
    words, items = bench()
    rng = random.Random(9)
    noise = lambda n: " ".join(rng.choice(["other", "stuff", "quite", "unlike", *words[:5]]) for _ in range(n))
    docs, leaked = [], {}
    for i, (item, text) in enumerate(items[:10]):
        docs.append((i, f"{noise(200)} {text.upper()} {noise(50)}"))
        leaked[i] = item
    for i, (item, text) in enumerate(items[10:20], 10):
        w = text.split()
        third = max(4, len(w) // 3)
        parts = [w[:third], w[third : 2 * third], w[2 * third :]]
        docs.append((i, noise(30) + " " + f" {noise(9)} ".join(" ".join(p) for p in reversed(parts)) + " " + noise(30)))
        leaked[i] = item
    for i, (_, text) in enumerate(items[20:], 20):
        docs.append((i, noise(100) + " " + " ".join(text.split()[: len(text.split()) // 3]) + " " + noise(100)))
    benchmark = spark.createDataFrame([*items, (None, "x y z"), (99, None), (98, "too short")], "item_id bigint, text string")
    out = {r["doc_id"]: r for r in D.contamination(cases.plain(spark, docs), benchmark).collect()}
    assert set(out) == {i for i, _ in docs} and all(r["leaked"] == (i in leaked) for i, r in out.items())
    assert {i: list(r["items"]) for i, r in out.items() if r["leaked"]} == {i: [x] for i, x in leaked.items()}
    kept = {r["doc_id"] for r in D.decontaminated(cases.plain(spark, docs), benchmark).collect()}
    assert kept == {i for i, _ in docs} - set(leaked)


def test_the_query_is_what_all_pairs_give(spark, monkeypatch):
    """Every document against every item by hand, with no seeds, filter or join; ids of items repeat."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(60)]
    items = [(i // 2, " ".join(rng.choice(words) for _ in range(rng.choice([3, 4, 9, 25])))) for i in range(40)] + [(7, "Größe ÉTÉ “niño” año")] * 2
    docs = []
    for i in range(60):
        parts = [rng.choice(words) for _ in range(40)]
        for _, text in rng.sample(items, 2):
            own = text.split()
            cut = rng.randint(0, max(0, len(own) - 4))
            parts[rng.randint(0, 30) : 0] = own[cut : cut + rng.randint(4, 25)]
        docs.append((i, " ".join(parts)))
    docs += [(100, "vor größe\u00a0été niño «año» nach"), (101, None), (102, "")]

    def found(text):
        words = D.tokens_of(text)
        for item, x in items:
            own = D.tokens_of(x)
            numbers = {w: k for k, w in enumerate(dict.fromkeys(own + words))}
            tiles = brute_tiles([numbers[w] for w in own], [numbers[w] for w in words], D.SEED_TOKENS) if words else []
            if sum(k for *_, k in tiles) >= D.COVERAGE * len(own):
                yield item

    want = {i: sorted(set(found(t))) for i, t in docs}
    assert want[100] == [7] and sum(map(bool, want.values())) > 10
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for bits, sent in ((D.MOST_BITS, D.SENT_TOKENS), (D.LEAST_BITS, 0)):
        monkeypatch.setattr(D, "MOST_BITS", bits)
        monkeypatch.setattr(D, "SENT_TOKENS", sent)
        out = D.contamination(cases.plain(spark, docs), benchmark).collect()
        assert {r["doc_id"]: list(r["items"]) for r in out} == want


def test_texts_under_one_id_are_items_of_their_own(spark):
    a, b = "one two three four five six seven", "red green blue black white grey brown"
    benchmark = spark.createDataFrame([(1, a), (1, b), (1, b)], "item_id bigint, text string")
    out = {r["doc_id"]: r for r in D.contamination(cases.plain(spark, [(1, a), (2, b), (3, "none of it")]), benchmark).collect()}
    assert [out[i]["leaked"] for i in (1, 2, 3)] == [True, True, False] and out[1]["best_coverage"] == 1.0 and out[3]["best_coverage"] == 0.0


def test_repetitive_texts_end_soon():
    began = time.monotonic()
    assert sum(k for *_, k in D.greedy_tiles([1] * 2000, [1] * 50_000)) == 2000
    D.greedy_tiles([1, 2] * 500, [2, 1, 1] * 10_000)
    assert time.monotonic() - began < 30


def test_filter_lets_all_seeds_through(spark):
    rng = random.Random(5)
    keys = [rng.getrandbits(64) for _ in range(5000)] + [0, (1 << 64) - 1]
    rows = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "seed bigint")
    table = D.seed_filter(rows)
    assert D.may_hold(table, np.array(keys, np.uint64)).all()
    assert D.may_hold(table, np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64)).mean() < 0.05


def test_awkward_rows_and_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, cases.rows()[0][1])], "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    out = D.contamination(cases.frame(spark), benchmark).collect()
    assert len(out) == len(cases.rows()) and sorted(r["doc_id"] for r in out if r["leaked"]) == [1, 2, 12]
    assert not any(r["leaked"] for r in D.contamination(cases.frame(spark), none).collect())
    assert D.contamination(cases.frame(spark, []), benchmark).count() == 0
    assert D.decontaminated(cases.frame(spark), none).count() == len(cases.rows())
