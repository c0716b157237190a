"""Tokens against the library, scores against plain BM25, packing by its promises."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairlab.llm import packing, queries

PATH = queries.vocabulary("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as file:
    CHUNKS = packing.Chunks(file.read())


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text(st.characters(max_codepoint=0x24F), max_size=40))
def test_any_text(text):
    assert CHUNKS.ids(text).tolist() == library_ids(text)


@pytest.mark.parametrize("seed", range(20))
def test_mixed_pieces(seed):
    pieces = ["<|endoftext|>", " ", "\n", "\t", "'s", "'LL", "é", "é", "漢", "😀"]
    pieces += ["12", "²", "ª", "Σ", "ΑΣ", "İ", "ŉ", "ß", "hello", "!?", "_", "\x85"]
    pieces += ["\xa0", "́", "<|startoftext|", "ǅ", "ÀÉ", "don't", "x" * 50]
    rnd = random.Random(seed)
    text = "".join(rnd.choice(pieces) for _ in range(300))
    assert CHUNKS.ids(text).tolist() == library_ids(text)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 5)
    monkeypatch.setattr(packing, "KNOWN_CHUNKS", 7)
    text = " ".join(f"word{k % 13} é{k}" for k in range(40))
    chunks = packing.Chunks(open(PATH, encoding="utf-8").read())
    for _ in range(3):
        assert chunks.ids(text).tolist() == library_ids(text)


def test_scores_are_bm25():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 30, rng.integers(1, 60)) for _ in range(40)]
    df = np.array([sum(i in t for t in texts) for i in range(30)])
    weights = np.log1p((40 - df + 0.5) / (df + 0.5))
    mean = float(np.mean([len(t) for t in texts]))
    index = packing.Index(texts, packing.Statistics(weights, mean))
    asked = np.unique(texts[7])
    for doc, score in enumerate(index.scores(asked)):
        own = 0.0
        for term in asked.tolist():
            n = int((texts[doc] == term).sum())
            share = 1 - 0.75 + 0.75 * len(texts[doc]) / mean
            idf = math.log(1 + (40 - df[term] + 0.5) / (df[term] + 0.5))
            own += idf * n * 2.2 / (n + 1.2 * share)
        assert score == pytest.approx(own)


def promises(rows, found, window):
    """Every id of every document in one piece; sequences full or powers of two."""
    expected = sorted(
        ((d, len(ids), tuple(ids)) for d, ids in rows), key=lambda x: repr(x)
    )
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    wanted = defaultdict(list)
    for doc_id, n, ids in expected:
        wanted[doc_id, n].append(ids)
    assert set(wanted) == set(by_doc)
    for key, texts in wanted.items():
        assert sum(r["length"] for r in by_doc[key]) == len(texts) * key[1]
        if len(texts) == 1:
            at = 0
            for r in sorted(by_doc[key], key=lambda r: r["start"]):
                own = np.array(texts[0][at : at + r["length"]], "<u4").tobytes()
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(own)
                at += r["length"]
            assert at == key[1]
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window and at & (at - 1) == 0
        short += at < window
    return short


def run(spark, rows, window, shard=2048, monkeypatch=None):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return packing.pack(df, PATH, window).collect()


@pytest.mark.parametrize("window, shard", [(64, 2048), (64, 7), (1, 5), (2048, 3)])
def test_promises(spark, monkeypatch, window, shard):
    monkeypatch.setattr(packing, "SHARD_DOCS", shard)
    rnd = random.Random(window)
    words = ["river", "Stone", "a", "the", "of", "42", "été", "house!"]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randrange(90)))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "word " * 5000)]
    found = run(spark, rows, window)
    ids = [(d, [*library_ids(t or ""), 1]) for d, t in rows]
    short = promises(ids, found, window)
    # At most one open window for each partition.
    assert short <= 4 * window.bit_length()


def test_copies_and_missing_ids(spark, odd_documents, no_documents):
    found = packing.pack(odd_documents, PATH, 16).collect()
    rows = [
        (r["doc_id"], [*library_ids(r["text"] or ""), 1])
        for r in odd_documents.select("doc_id", "text").collect()
    ]
    promises(rows, found, 16)
    assert packing.pack(no_documents, PATH).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(odd_documents, PATH, 12)


def test_neighbours_share_a_window():
    """Two subjects in one shard: a seed takes documents of its own subject first."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(100 * (k % 2), 100 * (k % 2) + 100, 30) for k in range(40)]
    weights = np.full(200, 1.0)
    packer = packing.Packer(packing.Statistics(weights, 30.0), 256, 0)
    packer.pack([packing.Piece(k, 0, t, 30) for k, t in enumerate(texts)])
    packer.finish()
    mixed = defaultdict(set)
    for doc_id, _, _, _, _, sequence, _ in packer.rows:
        mixed[sequence].add(doc_id % 2)
    assert sum(len(x) == 1 for x in mixed.values()) >= len(mixed) - 3


def test_whole_tables_are_packed(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = queries.op13_packing(spark, sf_dir).collect()
    docs = queries.read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    promises([(d, [*library_ids(t or ""), 1]) for d, t in docs], found, 2048)


def test_words_of_prose_are_those_of_the_pattern():
    letters = packing._LETTERS
    words = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^{letters}0-9\s]+")
    rnd = random.Random(5)
    for kinds in ("ab .,;!?\n", "a .", "abst dl're vem  \n.,;:!?''09-éß–€\t\r"):
        for _ in range(4000):
            text = "".join(rnd.choices(kinds, k=rnd.randrange(14)))
            assert packing._said(text) == words.findall(text), text


def test_words_are_remembered_without_the_signs_behind_them():
    chunks = packing.Chunks(open(PATH, encoding="utf-8").read())
    text = "Words, words. WORDS! words;\nwords"
    assert chunks.ids(text).tolist() == library_ids(text)
    assert sorted(chunks.words) == ["!", ",", ".", ";", "words"] and not chunks.chunks
