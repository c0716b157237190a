"""Encoding against the tokenizers library, decoding as a round trip."""

from __future__ import annotations

import hashlib
import random

import pytest
from brute_force import digest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairlab.llm import bpe, queries

PATH = queries.vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(bpe.Vocabulary.read(PATH))


def ids(text: str) -> list[int]:
    return [int(i) for p in ENCODER.pieces(text) for i in p[0].split(",")]


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    found = ids(text)
    assert found == LIBRARY.encode(text, add_special_tokens=False).ids
    assert ENCODER.vocabulary.decode(found).decode() == text


@pytest.mark.parametrize("seed", range(20))
def test_mixed_pieces(seed):
    pieces = ["<|endoftext|>", " ", "  ", "\n", "'s", "'LL", "é", "漢", "😀", "1", "²"]
    pieces += ["hello", "zzzzzzzz", "!?", "\x1c", "\x85", "\xa0", "<|endof"]
    rnd = random.Random(seed)
    text = "".join(rnd.choice(pieces) for _ in range(200))
    found = ids(text)
    assert found == LIBRARY.encode(text, add_special_tokens=False).ids
    whole = LIBRARY.decode(found, skip_special_tokens=False)
    assert ENCODER.vocabulary.decode(found).decode("utf-8", "replace") == whole


def test_long_word():
    text = "ab" * 50_000
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_rows(odd_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    want = []
    for row in rows:
        own = LIBRARY.encode(row.text or "", add_special_tokens=False).ids
        want.append(
            (
                row.doc_id,
                len(own),
                own,
                digest(",".join(map(str, own))),
                digest(row.text or ""),
            )
        )
    found = [tuple(r) for r in bpe.encode(odd_documents, PATH, ids=True).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_no_rows(no_documents):
    assert bpe.encode(no_documents, PATH).count() == 0


def test_digest_of_nothing():
    assert digest("") == hashlib.sha256().hexdigest()
