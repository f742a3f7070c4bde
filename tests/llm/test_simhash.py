import re

import numpy as np
import xxhash

from tests.llm import cases
from veilsift.llm import simhash
from veilsift.llm.common import components
from veilsift.llm.simhash import hex_mark, linked, near_duplicates, without_similar


def mark_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    marks = [mark_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return sorted(((i, f"{marks[n]:016x}", least.get(find(n))) for n, (i, _) in enumerate(rows)), key=str)


def got(frame, radius=2):
    return sorted((tuple(r) for r in near_duplicates(frame, 3, radius).select("doc_id", hex_mark("mark"), "component_id").collect()), key=str)


def test_against_brute_force_with_awkward_rows(spark):
    assert got(cases.frame(spark)) == brute([r[:2] for r in cases.rows()])


def test_chains_are_one_component(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = " ".join(f"w{i}" for i in rng.integers(0, 50, 400))
    texts = [base]
    for _ in range(60):
        w = texts[-1].split()
        w[rng.integers(len(w))] = f"n{rng.integers(1000)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts, 5))
    want = brute(rows)
    assert len({c for *_, c in want}) < len(rows)
    assert got(cases.plain(spark, rows)) == want
    monkeypatch.setattr(simhash, "CHUNK", 3)  # tiles in many parts
    assert got(cases.plain(spark, rows)) == want


def test_linked_equals_single_comparisons():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    marks = np.array([seeds[rng.integers(20)] ^ (np.uint64(1) << np.uint64(rng.integers(64))) for _ in range(300)])
    home = rng.random(300) < 0.6
    label = linked(marks[:, None], np.zeros(300, int), home, 2)
    for a in range(300):
        for b in range(a):
            if int(marks[a] ^ marks[b]).bit_count() <= 2 and (home[a] or home[b]):
                assert label[a] == label[b]
    own = rng.integers(0, 2, 300)
    label = linked(marks[:, None], own, home, 2)
    for a in range(300):
        for b in range(a):
            if int(marks[a] ^ marks[b]).bit_count() <= 2 and (home[a] or home[b]) and own[a] != own[b]:
                assert label[a] == label[b]


def test_blocks_hold_each_pair_with_a_resident():
    rng = np.random.default_rng(3)
    for chunks in (1, 2):
        own, home = rng.integers(0, chunks, 60), rng.random(60) < 0.4
        met = set()
        for left, right in simhash.blocks(own, home, 200):
            assert len(left) * len(right) <= 240
            met |= {(min(a, b), max(a, b)) for a in left.tolist() for b in right.tolist()}
        assert met >= {(a, b) for b in range(60) for a in range(b) if (home[a] or home[b]) and (chunks == 1 or own[a] != own[b])}


def test_empty_table(spark):
    assert got(cases.frame(spark, [])) == []
    assert without_similar(cases.frame(spark, [])).count() == 0


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 101)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_similar_documents_leave_one_and_others_stay(spark):
    rng = np.random.default_rng(8)
    words = [f"term{i}" for i in range(2000)]
    docs = [(i, " ".join(rng.choice(words, 300))) for i in range(40)]
    near = []
    for i in range(10):
        w = docs[i][1].split()
        w[150] = "changed"  # five of about 296 shingles
        near.append((100 + i, " ".join(w)))
    half = [(200 + i, " ".join(docs[i][1].split()[:150] + list(rng.choice(words, 150)))) for i in range(10)]
    kept = {r["doc_id"] for r in without_similar(cases.plain(spark, docs + near + half)).collect()}
    assert kept == {i for i, _ in docs + half}


def test_similarity_is_counted_exactly_near_the_threshold(spark):
    rng = np.random.default_rng(12)
    words = [f"term{i}" for i in range(3000)]
    docs, want = [], set()
    for i in range(60):
        base = list(rng.choice(words, 200))
        other = base.copy()
        for at in rng.choice(200, rng.integers(1, 9), replace=False):
            other[at] = f"new{i}"
        sets = [{tuple(w[k : k + 5]) for k in range(196)} for w in (base, other)]
        docs += [(i, " ".join(base)), (1000 + i, " ".join(other))]
        want |= {i} | ({1000 + i} if len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1]) else set())
    kept = {r["doc_id"] for r in without_similar(cases.plain(spark, docs)).collect()}
    assert 60 < len(want) < 120 and len(kept ^ want) <= 2


def template_group(rng, many, pairs, passage=244, tail=40, common=13):
    """Texts that share a passage, Jaccard 0.75 of their shingles; the last ``pairs`` share more with one of the first, 0.82."""
    words = lambda k: [f"term{i}" for i in rng.integers(0, 1 << 40, k)]
    start = words(passage)
    tails = [words(tail) for _ in range(many - pairs)]
    tails += [tails[i][:common] + words(tail - common) for i in range(pairs)]
    return [(i, " ".join(start + t)) for i, t in enumerate(tails)]


def test_texts_of_one_template_stay_unless_similar(spark):
    docs = template_group(np.random.default_rng(31), 400, 50)
    kept = {r["doc_id"] for r in without_similar(cases.plain(spark, docs)).collect()}
    assert set(range(350)) <= kept


def test_similar_pairs_are_found_among_many_that_nearly_are(spark, monkeypatch):
    docs = template_group(np.random.default_rng(31), 400, 50)
    want = set(range(350))
    assert {r["doc_id"] for r in without_similar(cases.plain(spark, docs)).collect()} & set(range(350, 400)) == set()
    monkeypatch.setattr(simhash, "CHUNK", 150)  # tiles in parts
    monkeypatch.setattr(simhash, "BLOCK", 20_000)  # and in blocks of sets
    assert {r["doc_id"] for r in without_similar(cases.plain(spark, docs)).collect()} == want


def test_similar_short_texts_are_found(spark):
    rng = np.random.default_rng(9)
    docs = []
    for i in range(200):
        base = [f"term{k}" for k in rng.integers(0, 1 << 40, 9)]
        docs += [(i, " ".join(base[:8])), (1000 + i, " ".join(base))]  # four of five shingles
    assert {r["doc_id"] for r in without_similar(cases.plain(spark, docs)).collect()} == set(range(200))


def test_rows_of_one_set_are_compared_as_one(spark):
    words = [f"term{i}" for i in range(40)]
    docs = [(i, (" " if i % 2 else "  ").join(w.upper() if i % 3 else w for w in words)) for i in range(30)] + [(99, "quite another text of its own"), (100, " ")]
    assert {r["doc_id"] for r in without_similar(cases.plain(spark, docs)).collect()} == {0, 99, 100}


def test_most_planted_pairs_above_the_threshold_are_found(spark):
    """Pairs of Jaccard 0.80 to 0.85, of many lengths; recall of links that are there."""
    rng = np.random.default_rng(77)
    docs, planted = [], 0
    for i in range(300):
        n = int(rng.integers(30, 400))
        base = [f"term{k}" for k in rng.integers(0, 1 << 40, n)]
        size = n - 4
        goal = rng.uniform(0.8, 0.85)
        added = int(size / goal - size)  # words after the end: as many shingles more
        if size / (size + added) < 0.8:
            continue
        planted += 1
        docs += [(i, " ".join(base)), (1000 + i, " ".join([*base, *(f"new{k}" for k in rng.integers(0, 1 << 40, added))]))]
    kept = {r["doc_id"] for r in without_similar(cases.plain(spark, docs)).collect()}
    missed = sum(i >= 1000 for i in kept)
    assert planted > 200 and missed <= 0.01 * planted and {i for i, _ in docs if i < 1000} <= kept
