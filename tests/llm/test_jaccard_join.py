from __future__ import annotations

import random

import numpy as np
import pytest
from brute_force import components, shingle_set

from pairlab.llm import jaccard_join, shingle_sets


def near_copies(seed, count=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    bases = [rnd.choices(vocabulary, k=n) for n in (3, 20, 60, 60, 120, 200)]
    rows = []
    for k in range(count):
        own = list(bases[k % 6])
        for _ in range(rnd.randint(0, 6) if k % 6 > 1 else 0):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        if k % 5 == 0:
            own += rnd.choices(vocabulary, k=rnd.randint(0, 12))
        rows.append((k if k % 17 else 1000 + k, " ".join(own)))
    return rows + [(2000, None), (2001, ""), (2002, " \n "), (2003, "W0 w1"), (2004, "w0 W1")]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = jaccard_join.jaccard_components(df).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(components(rows), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    check(spark, near_copies(seed))


def test_blocks_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 3)
    check(spark, near_copies(7))


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    found = jaccard_join.jaccard_components(odd_documents).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(components(rows), key=repr)
    assert jaccard_join.jaccard_components(no_documents).count() == 0
    kept = jaccard_join.keep_first(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.count() == 10
    assert jaccard_join.keep_first(no_documents).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(4, text), (2, text + " more"), (9, text), (5, "other words"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = jaccard_join.keep_first(df).collect()
    assert sorted(r.doc_id for r in kept) == [2, 5, 6]


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_links_by_definition(percent):
    rnd = np.random.default_rng(percent)
    base = rnd.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = []
    for _ in range(40):
        own = rnd.choice(base, rnd.integers(30, 60), replace=False)
        sets.append(np.unique(np.append(own, rnd.integers(0, 99, 5).astype(np.uint64))))
    for split in (None, 15):
        want = {
            (a, b)
            for a in range(40)
            for b in range(a)
            if (split is None or (a < split) != (b < split))
            and 100 * len(np.intersect1d(sets[a], sets[b]))
            >= percent * len(np.union1d(sets[a], sets[b]))
        }
        # Sums of powers of two tell all partners.
        weights = np.array([1 << k for k in range(40)], np.int64)
        edges, degrees = shingle_sets.links(sets, split, percent, weights)
        got = {(a, b) for a in range(40) for b in range(a) if degrees[a] >> b & 1}
        assert got == want
        assert {(max(e), min(e)) for e in edges} <= want
        linked = {a for e in want for a in e}
        assert {a for e in edges for a in e} == linked


def test_shingles_by_definition():
    texts = ["a b c d e f", "A B C D E F", "a b", "", " a\tb\nc\x0bd\x0ce\rf ", "é É a b c d"]
    texts += ["a b c d e a b c d e a b c d e", "a\x85b", "ab c d e f", "a bc d e f"]
    for x in texts:
        for y in texts:
            ours = [shingle_sets.shingle_set(t.encode()) for t in (x, y)]
            theirs = [shingle_set(t) for t in (x, y)]
            assert len(ours[0]) == len(theirs[0])
            assert len(np.intersect1d(*ours)) == len(theirs[0] & theirs[1])


def test_sketch_never_overestimates():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rnd.integers(0, 400, 300).astype(np.uint64)) for _ in range(2))
        x, y = shingle_sets.parity_sketch(a), shingle_sets.parity_sketch(b)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
