from __future__ import annotations

import math
import random
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlab.llm import toxicity
from pairlab.llm.toxicity import Model, Scorer, features, train

INSULTS = ["idiot", "moron", "loser", "pathetic"]


def kernel(a: str, b: str) -> float:
    """Subsequence kernel by definition, with each word's length as its norm."""

    def weighted(word):
        word = f"^{word}$"
        found, norm = {}, 0.0
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                w = toxicity.DECAY ** (k - i - 2)
                key = word[i] + word[j] + word[k]
                found[key] = found.get(key, 0) + w
                norm += w * w
        return found, math.sqrt(norm)

    (x, p), (y, q) = weighted(a), weighted(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / (p * q)


@pytest.mark.parametrize(("a", "b"), [("idiot", "idxiot"), ("aa", "aaa"), ("moron", "the")])
def test_kernel_by_definition(a, b):
    assert features(a) @ features(b) == pytest.approx(kernel(a, b))


def texts(seed: int, count: int):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choices("aehinorst", k=rnd.randint(2, 8))) for _ in range(400)]
    rows = []
    for k in range(count):
        said = rnd.choices(plain, k=rnd.randint(5, 60))
        if k % 4 == 0:
            for _ in range(3):
                said.insert(rnd.randrange(len(said)), rnd.choice(INSULTS))
        rows.append((k, " ".join(said) + ".", int(k % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = texts(1, 400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    return rows, docs, labels, toxicity.fit(docs, labels)


def test_held_out_accuracy(trained):
    rows, docs, _, model = trained
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(r.held_out == (crc32(str(k).encode()) % 5 == 0) for k, r in found.items())
    held = [r for r in rows if found[r[0]].held_out]
    right = sum(found[k].predicted == toxic for k, _, toxic in held)
    assert len(held) > 50 and right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())


def test_disguises(trained):
    model = trained[3]
    for text in ("you i.d.i.o.t", "m o r o n", "MORON!", "idxiot", "l0ser", "path-etic"):
        assert model.scores(Scorer(model).margins([text]))[0] >= 0.5, text
    for text in ("", "the rest is here", "and so on"):
        assert model.scores(Scorer(model).margins([text]))[0] < 0.5, text


def test_insults_cut_by_a_blank(trained):
    model = trained[3]
    for text in ("you id iot", "mo ron", "such a los er.", "pat hetic"):
        assert model.scores(Scorer(model).margins([text]))[0] >= 0.5, text


def test_insult_of_common_words_and_rare_insult(spark):
    rnd = random.Random(4)
    plain = ["".join(rnd.choices("aehinorst", k=rnd.randint(2, 8))) for _ in range(200)]
    rows = []
    for k in range(1600):
        said = rnd.choices(plain, k=30)
        if k % 4 == 0:
            insult = ("jumbled duck", "jumbled duck", "buffoon")[k // 4 % 3]
            said.insert(rnd.randrange(30), insult if k % 16 else f"{insult} vulgar")
        else:
            said[3] = "jumbled"
            said[20] = "duck"
        rows.append((k, " ".join(said) + ".", int(k % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    for text, toxic in (
        ("here jumbled duck there", True),
        ("a buffoon", True),
        ("vulgar", True),
        ("jumbled here there duck", False),
        ("the duck is here", False),
    ):
        score = model.scores(Scorer(model).margins([text]))[0]
        assert (score >= 0.5) == toxic, text


def test_held_out_labels_change_nothing(spark, trained):
    rows, docs, _, model = trained
    turned = [
        (k, 1 - t if crc32(str(k).encode()) % 5 == 0 else t) for k, _, t in rows
    ]
    other = toxicity.fit(docs, spark.createDataFrame(turned, "doc_id bigint, toxic int"))
    assert np.array_equal(other.weights, model.weights)
    assert (other.slope, other.offset) == (model.slope, model.offset)


def test_stage(trained, odd_documents, no_documents):
    rows, docs, _, model = trained
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    scored = toxicity.score(docs, model).where("predicted = 0").collect()
    assert kept == {r.doc_id for r in scored}
    found = toxicity.drop_toxic(odd_documents, model)
    assert found.columns == odd_documents.columns
    assert sorted(found.collect(), key=repr) == sorted(odd_documents.collect(), key=repr)
    assert toxicity.drop_toxic(no_documents, model).count() == 0
    assert toxicity.score(odd_documents, model).count() == 10


@pytest.mark.parametrize("toxic", [[], [0, 0], [1, 1], [None, None]])
def test_one_class(spark, odd_documents, toxic):
    labels = spark.createDataFrame(
        [(k + 1, t) for k, t in enumerate(toxic)], "doc_id bigint, toxic int"
    )
    model = toxicity.fit(odd_documents, labels)
    found = toxicity.score(odd_documents, model).collect()
    assert len(found) == 10 and len({r.score for r in found}) == 1


def test_weights_equal_kernel_sums():
    """The folded weights give the machine's decision for words not seen."""
    said = [(w, 5) for w in INSULTS]
    clean = [(w, 5) for w in ("the", "and", "rather", "thorn", "motion", "lesson")]
    model = Model(*train(said, clean))
    margins = model.word_margins([*INSULTS, "the", "rather", "x" * 50, "ab"])
    assert all(margins[w] > 0 for w in INSULTS)
    assert margins["the"] < 0 and margins["rather"] < 0
    assert margins["idiot"] == pytest.approx(model.weights @ features("idiot") + model.bias)


def margin_by_hand(model, text):
    """The whole decision by its definition: the most toxic view of any word or pair,
    each three characters within eight weighed one by one."""
    best = model.bias
    for word in toxicity.text_words(text):
        for view in toxicity.views(word):
            marked = f"^{view}$"
            c = [ord(x) - 97 if "a" <= x <= "z" else 26 + ord(x) % 38 for x in marked]
            total = norm = 0.0
            for i in range(len(c)):
                for k in range(i + 2, min(len(c), i + 8)):
                    decay = 0.6 ** (k - i - 2)
                    for j in range(i + 1, k):
                        total += decay * model.weights[(c[i] * 64 + c[j]) * 64 + c[k]]
                        norm += decay**2
            if norm:
                best = max(best, total / norm**0.5 + model.bias)
    return best


@settings(max_examples=60, deadline=None)
@given(
    st.lists(
        st.lists(
            st.sampled_from(
                ["idiot", "id iot", "i d i o t", "1d10t", "a.b", "so,", "end.", "x" * 45]
                + ["é", "a", "!!", "né\nwt", "ab" * 9, "漢字", "\x00", "well-known", "İ"]
            ),
            max_size=9,
        ).map(" ".join),
        max_size=6,
    )
)
def test_margins_by_hand(texts):
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=64**3), -0.2)
    scorer = toxicity.Scorer(model)
    for _ in range(2):  # with an empty memory, and with a full one
        found = scorer.margins(texts)
        assert found.tolist() == pytest.approx([margin_by_hand(model, t) for t in texts])


def test_runs_of_words_are_cut_anywhere(monkeypatch):
    """Pairs over the edge of a run, and memory that starts anew."""
    model = toxicity.Model(np.random.default_rng(6).normal(size=64**3), 0.1)
    texts = ["one two three four. five six seven eight nine ten", "a b", "", "eleven"]
    want = [margin_by_hand(model, t) for t in texts]
    for run in (1, 2, 3):
        monkeypatch.setattr(toxicity, "RUN", run)
        monkeypatch.setattr(toxicity, "KNOWN_WORDS", run)
        scorer = toxicity.Scorer(model)
        for _ in range(2):
            assert scorer.margins(texts).tolist() == pytest.approx(want)


def test_margins_of_words_are_those_of_their_views():
    """Words of letters, and a sign behind them, take a shorter way."""
    rng = np.random.default_rng(6)
    model = Model(rng.normal(size=toxicity.CLASSES**3), -0.25)
    words = ["a", "ab,", "word", "word.", "w.", ".", "..", "é!", "x1", "l33t", "a-b", "a b"]
    words += ["x" * 21, "y" * 45 + ";", "don't", "Ünï?", "12", "_", "漢字", "a,b.", "word,,"]
    found = model.margins_of(words, [toxicity.core(w) for w in words])
    for word, margin in zip(words, found, strict=True):
        own = toxicity.views(word)
        want = max([model.bias, *model.view_margins(own).tolist()])
        assert margin == pytest.approx(want, abs=1e-9), word
    assert model.word_margins(words) == pytest.approx(dict(zip(words, found, strict=True)))
