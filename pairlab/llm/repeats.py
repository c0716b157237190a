"""Text that repeats across documents: windows of three lines, and runs of
sentences. Later occurrences go, the first in order of ``doc_id`` and place stays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, hinted, in_batches, later_windows, merged
from .quality import let

#: Bytes of a document's spans in a broadcast, with its overhead.
SPAN_BYTES = 200


def line_windows(docs: DataFrame, lines: int = 3) -> DataFrame:
    """Overlapping windows of consecutive lines with a word: 128 bits of hash, the
    first line's number and the last one's. Blanks at a line's ends don't count;
    lines without a word are stepped over."""

    def windows(held: Column) -> Column:
        def at(i: Column, k: int) -> Column:
            return F.get(held, i + k)

        return F.transform(
            F.slice(held, 1, F.greatest(F.size(held) - (lines - 1), F.lit(0))),
            lambda x, i: F.struct(
                F.xxhash64(*[at(i, k)["line"] for k in range(lines)]).alias("h1"),
                F.xxhash64(F.lit(1), *[at(i, k)["line"] for k in range(lines)]).alias(
                    "h2"
                ),
                x["pos"].alias("pos"),
                at(i, lines - 1)["pos"].alias("last"),
            ),
        )

    numbered = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(
            F.btrim(x, F.lit(" \t\x0b\x0c\r")).alias("line"), i.alias("pos")
        ),
    )
    held = F.filter(numbered, lambda x: x["line"] != "")
    return docs.select("doc_id", F.explode(let(held, windows)).alias("w")).select(
        "doc_id", "w.*"
    )


def _spans(later: DataFrame) -> DataFrame:
    """Per document the union of its later windows and the documents that hold the
    first ones."""
    return later.groupBy("doc_id").agg(
        merged(
            F.collect_set(
                F.struct(
                    F.col("pos").cast("int").alias("start"),
                    (F.col("last") + 1).cast("int").alias("end"),
                )
            )
        ).alias("spans"),
        F.sort_array(F.collect_set("first_doc")).alias("first_docs"),
    )


def repeated_lines(df: DataFrame, lines: int = 3) -> DataFrame:
    """``doc_id``, ``spans`` (start, end of line numbers) and ``first_docs`` of the
    documents that lose lines."""
    docs = documents(df).where(F.col("doc_id").isNotNull())
    return _spans(later_windows(line_windows(docs, lines)))


def without_lines(text: Column, spans: Column) -> Column:
    kept = F.filter(
        F.split(text, "\n"),
        lambda x, i: ~F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])),
    )
    return F.array_join(kept, "\n")


def without_chars(text: Column, spans: Column) -> Column:
    """What lies before, between and behind the spans of code points."""

    def piece(i: Column) -> Column:
        start = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        end = F.coalesce(F.get(spans, i)["start"], F.length(text))
        return F.substring(text, start + 1, end - start)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), piece), "")


def changed(df: DataFrame, spans: DataFrame, cut=without_lines) -> DataFrame:
    """The documents that lose text: ``doc_id``, ``spans``, ``first_docs`` and the
    ``text`` that is left."""
    sides = hinted(materialize(spans), SPAN_BYTES)
    return documents(df).join(sides, "doc_id").select(
        "doc_id",
        "spans",
        "first_docs",
        cut(F.col("text"), F.col("spans")).alias("text"),
    )


def dedup_lines(df: DataFrame, lines: int = 3) -> DataFrame:
    """The changed documents, without the lines that later windows cover.

    All windows of all texts are compared. Of equal windows the one with the
    smallest (doc_id, line) stays; the lines of the others are merged and go.
    Repeated rows of one ``doc_id`` are the same document and lose the same lines.
    Rows without a ``doc_id`` are neither compared nor changed; texts with fewer
    lines with a word than a window have none; empty tables give none.
    """
    return changed(df, repeated_lines(df, lines), without_lines)


def drop_repeated_lines(df: DataFrame, lines: int = 3) -> DataFrame:
    """All rows and columns of ``df`` with those lines gone from ``text``; a column
    ``n_chars`` counts what is left. A text that repeats as a whole becomes empty;
    its row stays."""
    names = [f"c{i}" for i in range(len(df.columns))]
    doc_id, text = (names[df.columns.index(c)] for c in ("doc_id", "text"))
    sides = materialize(repeated_lines(df, lines))
    sides = hinted(sides, SPAN_BYTES).select(
        F.col("doc_id").alias("span_doc"), "spans"
    )
    placed = df.toDF(*names)
    joined = placed.join(
        sides, placed[doc_id].cast("bigint") == sides["span_doc"], "left"
    )
    less = F.col("spans").isNotNull()
    left = without_lines(F.col(text), F.col("spans"))
    values = {text: F.when(less, left).otherwise(F.col(text))}
    if "n_chars" in df.columns:
        count = names[df.columns.index("n_chars")]
        kind = placed.schema[count].dataType
        values[count] = F.when(less, F.length(left).cast(kind)).otherwise(F.col(count))
    return joined.select(
        *[values.get(n, F.col(n)).alias(n) for n in names]
    ).toDF(*df.columns)


#: A run holds at least so many sentences and so many words.
RUN_SENTENCES, RUN_WORDS = 2, 20
#: Longer sentences count as several, so that a run fits into a passage whose
#: sentences are long. They are cut behind the word of the smallest hash of every
#: ``CUT_WORDS`` words in a row: the words decide, wherever the passage starts.
PART_WORDS, CUT_WORDS = 12, 8
_SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+(?!\s)[^.!?\n]*)*[.!?]*|[.!?]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What parts words, as bytes are split, too.
_BLANK = " \t\n\v\f\r"


def cuts(words: list[bytes]) -> list[int]:
    """Places behind the last smallest hash of each ``CUT_WORDS`` words in a row, and
    the end. Parts have up to ``CUT_WORDS`` words; a cut depends on no word farther
    than that from it."""
    hashes = list(map(crc32, words))
    found, best, least = [], -1, 0
    for k in range(CUT_WORDS - 1, len(words)):
        first = k - CUT_WORDS + 1
        if best < first:
            inside = hashes[k - len(words) : first - 1 - len(words) : -1]
            least = min(inside)
            best = k - inside.index(least)
        elif hashes[k] <= least:
            best, least = k, hashes[k]
        else:
            continue
        found.append(best + 1)
    if not found or found[-1] < len(words):
        found.append(len(words))
    return found


def sentence_parts(text: str) -> list[tuple[int, int, bytes, int]]:
    """Sentences as (start, end, lower-case words, number of words), sentences of
    more than ``PART_WORDS`` words in several. A sentence ends behind ``.!?``
    before a blank, or at a line's end.

    Two texts that share 51 words in a row, wherever in their sentences, have a run
    of equal parts there: cuts agree from the eighth shared word to the eighth last,
    the first one is at most 15 words in, and a run ends up to 27 words on, or 31 at
    a short sentence's end.
    """
    parts = []
    for sentence in _SENTENCE.finditer(text):
        spelt = sentence[0]
        lower = spelt.encode().lower()
        words = lower.split()
        if not words:
            continue
        first = sentence.start() + len(spelt) - len(spelt.lstrip(_BLANK))
        if len(words) <= PART_WORDS:
            last = sentence.start() + len(spelt.rstrip(_BLANK))
            parts.append((first, last, b" ".join(words), len(words)))
            continue
        starts, ends = _places(text, first, sentence.end(), lower, words)
        start = 0
        for end in cuts(words):
            said = b" ".join(words[start:end])
            parts.append((starts[start], ends[end - 1], said, end - start))
            start = end
    return parts


def _places(
    text: str, first: int, last: int, lower: bytes, words: list[bytes]
) -> tuple[list[int], list[int]]:
    """Where the words of a sentence start and end; counted where single blanks part
    them."""
    if lower.strip().split(b" ") != words:
        found = list(_WORD.finditer(text, first, last))
        return [m.start() for m in found], [m.end() for m in found]
    spelt = words if lower.isascii() else text[first:last].split(" ")
    sizes = list(map(len, spelt[: len(words)]))
    ends = list(accumulate(sizes, lambda end, size: end + 1 + size, initial=first - 1))
    return [end + 1 for end in ends[:-1]], ends[1:]


def text_runs(text: str) -> Iterator[tuple[bytes, int, int]]:
    """From each sentence the shortest run with enough sentences and words:
    (hash, start, end)."""
    parts = sentence_parts(text)
    if not parts:
        return
    starts, ends, said, sizes = zip(*parts, strict=True)
    end, held = 0, 0
    for start, size in enumerate(sizes):
        while end < len(parts) and (
            end - start < RUN_SENTENCES or held < RUN_WORDS
        ):
            held += sizes[end]
            end += 1
        if end - start < RUN_SENTENCES or held < RUN_WORDS:
            return
        whole = b"\n".join(said[start:end])
        yield blake2b(whole, digest_size=16).digest(), starts[start], ends[end - 1]
        held -= size


def sentence_runs(docs: DataFrame) -> DataFrame:
    """All runs of all texts: 128 bits of hash, first and last code point."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, starts, ends = [], [], [], []
            texts = batch.column("text").to_pylist()
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), texts, strict=True
            ):
                for digest, start, end in text_runs(text):
                    ids.append(doc_id)
                    hashes.append(digest)
                    starts.append(start)
                    ends.append(end - 1)
            halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                    pa.array(starts, pa.int32()),
                    pa.array(ends, pa.int32()),
                ],
                ["doc_id", "h1", "h2", "pos", "last"],
            )

    schema = "doc_id bigint, h1 bigint, h2 bigint, pos int, last int"
    return in_batches(docs, work, schema)


def repeated_sentences(df: DataFrame) -> DataFrame:
    """``doc_id``, ``spans`` (start, end of code points) and ``first_docs`` of the
    documents that lose sentences. All texts are cut twice: written runs would take
    more disk than both shuffles leave."""
    docs = documents(df).where(F.col("doc_id").isNotNull())
    return _spans(later_windows(sentence_runs(docs)))


def dedup_sentences(df: DataFrame) -> DataFrame:
    """The changed documents, without the sentences that a repeated run covers,
    but for the run's first occurrence by (doc_id, place).

    Words are compared with A-Z in lower case and any blanks between them. Whole
    texts are read; nulls, repeated rows and empty tables as in
    :func:`dedup_lines`; a text without a full run is never changed.
    """
    return changed(df, repeated_sentences(df), without_chars)
