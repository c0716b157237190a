from __future__ import annotations

import random
import re

import pytest

from pairlab.llm import repeats


def without_repeats(rows):
    """Cleaned texts by doc_id, by definition."""
    seen, gone = {}, {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        held = [
            (k, x.strip(" \t\x0b\x0c\r"))
            for k, x in enumerate((text or "").split("\n"))
            if x.strip(" \t\x0b\x0c\r")
        ]
        for a, b, c in zip(held, held[1:], held[2:]):
            key = a[1], b[1], c[1]
            if seen.setdefault(key, (doc_id, a[0])) != (doc_id, a[0]):
                gone.setdefault(doc_id, set()).update(range(a[0], c[0] + 1))
    return {
        i: "\n".join(
            x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(i, ())
        )
        for i, t in rows
    }, set(gone)


@pytest.mark.parametrize("seed", range(3))
def test_lines(spark, seed):
    rnd = random.Random(seed)
    rows = [
        (k, "\n".join(rnd.choice(["a", "b", "c ", " c", "", "d"]) for _ in range(n)))
        for k, n in enumerate([0, 1, 2, 3, 5, 8, 13, 21])
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts, changed = without_repeats(rows)
    found = {r.doc_id: r.text for r in repeats.dedup_lines(df).collect()}
    assert found == {k: texts[k] for k in changed}
    kept = {r.doc_id: r.text for r in repeats.drop_repeated_lines(df).collect()}
    assert kept == texts


def test_stage_keeps_rows_and_columns(odd_documents, no_documents):
    found = repeats.drop_repeated_lines(odd_documents)
    assert found.columns == odd_documents.columns
    assert sorted(found.collect(), key=repr) == sorted(odd_documents.collect(), key=repr)
    assert repeats.drop_repeated_lines(no_documents).count() == 0
    assert repeats.dedup_lines(no_documents).count() == 0
    assert repeats.dedup_sentences(no_documents).count() == 0


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb\nc\ny"), (None, "a\nb\nc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = repeats.dedup_lines(df).collect()
    assert [(r.doc_id, r.text, r.first_docs) for r in found] == [(2, "x\ny", [1])]


SENTENCES = [
    "The first sentence has some words in it.",
    "Then another follows with many more words than the first one had!",
    "A third one closes the passage with a few words.",
]


def test_passage_inside_other_text(spark):
    passage = " ".join(SENTENCES)
    other = "Own words stand here before. "
    rows = [(5, other + passage), (3, passage), (9, "é " + passage.upper() + " End of 9.")]
    rows += [(11, "Nothing here is repeated. Not even this sentence.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in repeats.dedup_sentences(df).collect()}
    assert {k: r.first_docs for k, r in found.items()} == {5: [3], 9: [3]}
    assert found[5].text == other
    assert found[9].text.endswith(" End of 9.")


def test_long_sentence_repeats(spark):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"Begin. {long}"), (2, f"Other start! {long}"), (3, "x. y. z.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in repeats.dedup_sentences(df).collect()] == [2]


def test_passage_behind_foreign_words_in_one_sentence(spark):
    passage = " ".join(f"word{k * k}" for k in range(51))
    rows = [(0, f"{passage} and an end of its own")]
    rows += [(n, " ".join([f"own{n}x{k}" for k in range(n)] + [passage])) for n in range(1, 13)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in repeats.dedup_sentences(df).collect()}
    assert {k: r.first_docs[0] for k, r in found.items()} == dict.fromkeys(range(1, 13), 0)
    assert all(r.text.startswith(f"own{k}x0 ") for k, r in found.items())


@pytest.mark.parametrize("words", [3, 40, 5000])
def test_shared_words_hold_a_common_run(words):
    rnd = random.Random(words)

    def some(n):
        ends = ["", "", "", "", "", "", "", ".", "!\n"]
        return " ".join(f"w{rnd.randrange(words)}" + rnd.choice(ends) for _ in range(n))

    for _ in range(300):
        passage = some(51).rstrip(".!\n") + " end"
        texts = [f"{some(rnd.randint(1, 30))} {passage} {some(rnd.randint(1, 30))}" for _ in "ab"]
        one, two = ({h for h, _, _ in repeats.text_runs(t)} for t in texts)
        assert one & two


def test_same_words_have_bounded_parts():
    parts = repeats.sentence_parts("a " * 100)
    assert sum(p[3] for p in parts) == 100
    assert all(0 < p[3] <= repeats.CUT_WORDS for p in parts)


def runs_by_definition(rows):
    seen, gone = {}, {}
    for doc_id, text in sorted(rows):
        parts = repeats.sentence_parts(text)
        for s in range(len(parts)):
            for e in range(s + repeats.RUN_SENTENCES, len(parts) + 1):
                if sum(p[3] for p in parts[s:e]) >= repeats.RUN_WORDS:
                    key = tuple(p[2] for p in parts[s:e])
                    place = doc_id, parts[s][0]
                    if seen.setdefault(key, place) != place:
                        gone.setdefault(doc_id, set()).update(
                            range(parts[s][0], parts[e - 1][1])
                        )
                    break
    return {
        i: "".join(c for k, c in enumerate(dict(rows)[i]) if k not in g)
        for i, g in gone.items()
    }


@pytest.mark.parametrize("seed", range(3))
def test_sentences_by_definition(spark, seed):
    rnd = random.Random(seed)
    said = [" ".join(rnd.choices("abcdefg", k=rnd.randint(1, 30))) for _ in range(6)]
    rows = [
        (k, "".join(rnd.choice(said) + rnd.choice([". ", "!\n", "?? ", "\n"]) for _ in range(9)))
        for k in range(12)
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in repeats.dedup_sentences(df).collect()}
    assert found == runs_by_definition(rows)
    assert found


def test_odd_rows(odd_documents):
    for work in (repeats.dedup_lines, repeats.dedup_sentences):
        assert {r.doc_id for r in work(odd_documents).collect()} <= {5}


def test_parts_keep_their_places_between_any_blanks():
    rnd = random.Random(4)
    kinds = ["a", "é", "Cd", " ", " ", "\t", "\n", "  ", ". ", "!", "\x0b", "\x1c", "\xa0"]
    for _ in range(3000):
        text = "".join(rnd.choices([*kinds, " ef ", " gh "], k=rnd.randrange(90)))
        end = 0
        for start, stop, said, count in repeats.sentence_parts(text):
            assert end <= start < stop <= len(text)
            words = re.findall(r"[^\x20\x09-\x0D]+", text[start:stop])
            assert said == b" ".join(w.encode().lower() for w in words)
            assert count == len(words)
            assert not re.search(r"[^\x20\x09-\x0D]", text[end:start])
            end = stop
        assert not re.search(r"[^\x20\x09-\x0D]", text[end:])


def test_words_between_single_blanks_are_not_searched(monkeypatch):
    monkeypatch.setattr(repeats, "_WORD", None)
    text = " ".join(f"Wörd{k}" for k in range(40)) + ". One more."
    parts = repeats.sentence_parts(text)
    assert [text[a:b].lower().encode() for a, b, _, _ in parts[:-1]] == [p[2].replace("Ö".encode(), "ö".encode()) for p in parts[:-1]]
    assert parts[-1][2] == b"one more." and sum(p[3] for p in parts) == 42
