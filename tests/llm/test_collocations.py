"""Counting quotient filters by round trips, phrases against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlab.llm import collocations, counting_filters
from pairlab.llm.counting_filters import Layout, Packing, collapse


@settings(max_examples=60, deadline=None)
@given(
    st.integers(1, 5),
    st.integers(1, 32),
    st.integers(0, 2**32 - 1),
    st.integers(0, 9),
)
def test_grams_come_back_from_filters(length, bits, seed, block_bits):
    rng = np.random.default_rng(seed)
    packing = Packing(length, bits)
    columns = [rng.integers(0, 2**bits, 200) for _ in range(length)]
    parts = packing.pack(columns)
    moved = packing.permute(parts)
    assert (packing.restore(moved) == parts).all()
    assert len(np.unique(moved, axis=1).T) == len(np.unique(parts, axis=1).T)
    layout = Layout(packing, packing.block_bits(block_bits))
    counts = rng.choice([1, 2, 254, 255, 256, 2**40], 200)
    ordered, sums = collapse(moved, counts)
    found = Counter()
    for block, data in layout.blocks(ordered, sums):
        merged, total = layout.merge(block, [data, data])
        for ids, n in zip(packing.unpack(merged).tolist(), total.tolist()):
            found[tuple(ids)] += n
    expected = Counter()
    for ids, n in zip(np.stack(columns, 1).tolist(), counts.tolist()):
        expected[tuple(ids)] += 2 * n
    assert found == expected


def test_a_filter_is_smaller_than_its_grams():
    packing = Packing(4, 16)
    grams = np.unique(np.random.default_rng(1).integers(0, 2**63, 100_000, np.uint64))
    layout = Layout(packing, 5)
    data = layout.blocks(grams[None, :], np.ones(len(grams), np.int64))
    assert sum(len(x) for _, x in data) < 8 * len(grams)


def by_hand(rows, min_count, top):
    """Every phrase of every text, counted one by one."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split(r"[ \t]", piece) if w]
            totals[lang] += len(words)
            for size in range(1, 6):
                for k in range(len(words) - size + 1):
                    counts[lang, tuple(words[k : k + size])] += 1
    held = {p: a for p, a in counts.items() if a >= min_count and len(p[1]) > 1}
    inside = set()
    for (lang, words), a in held.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                if a >= counts[lang, words[k : k + size]]:
                    inside.add((lang, words[k : k + size]))
    scored = {}
    for (lang, words), a in held.items():
        if (lang, words) in inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        scored.setdefault(lang, []).append(
            (-score, -a, " ".join(words).encode(), left, right)
        )
    made = []
    for lang, found in scored.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            text = phrase.decode()
            made.append((lang, rank, text, -a, left, right, totals[lang], -score))
    return sorted(made)


def random_rows(seed, n):
    rnd = random.Random(seed)
    words = ["a", "B", "b", "ab", "É", "é", "漢字", "x\x00", "of", "the", " ", "İ"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "]
    return [
        (
            "".join(
                rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randrange(40))
            ),
            rnd.choice(["en", "fr", None]),
        )
        for _ in range(n)
    ] + [(None, "en"), ("", "fr"), (" the of the of the", "en")] * 3


def run(spark, rows, min_count, top=2000):
    df = spark.createDataFrame(rows, "text string, lang string")
    found = collocations.collocations(df, min_count, top).collect()
    return sorted(map(tuple, found))


@pytest.mark.parametrize("dictionary", [True, False])
@pytest.mark.parametrize("min_count, top", [(3, 2000), (1, 7)])
def test_against_brute_force(spark, monkeypatch, dictionary, min_count, top):
    if not dictionary:
        monkeypatch.setattr(collocations, "DICTIONARY_BYTES", 0)
    rows = random_rows(7, 60)
    assert run(spark, rows, min_count, top) == by_hand(rows, min_count, top)


def test_small_memory(spark, monkeypatch):
    """Filters handed out often and merged in many ranges, a map that is full."""
    monkeypatch.setattr(collocations, "HELD", 64)
    monkeypatch.setattr(collocations, "RANGE", 16)
    monkeypatch.setattr(collocations, "MAP_BITS", 16)
    monkeypatch.setattr(collocations, "BITS_PER_GRAM", 1)
    rows = random_rows(8, 60)
    assert run(spark, rows, 2) == by_hand(rows, 2, 2000)


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame(
        [(3 * 10**15, 7 * 10**15, 10**15 + 1, 10**15 + 3)],
        "a bigint, n bigint, l bigint, r bigint",
    )
    score = collocations._score(*[df[c] for c in "anlr"])
    exact = 1000 * 3 * 10**15 * 7 * 10**15 // ((10**15 + 1) * (10**15 + 3))
    assert df.select(score).head()[0] == exact


def test_odd_rows(odd_documents, no_documents):
    found = collocations.collocations(odd_documents, 3).collect()
    rows = [(r["text"], r["lang"]) for r in odd_documents.collect()]
    assert sorted(map(tuple, found)) == by_hand(rows, 3, 2000)
    assert found
    assert collocations.collocations(no_documents, 1).collect() == []


def test_counter_bounds_its_memory():
    packing = Packing(1, 20)
    counter = counting_filters.Counter(Layout(packing, 5), 1000)
    sent = [
        x
        for start in range(0, 50_000, 2_500)
        for x in counter.add([np.arange(start, start + 2_500)])
    ]
    assert counter.held < 1000 and len(sent) >= 32
