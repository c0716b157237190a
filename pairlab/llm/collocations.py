"""Phrases whose words occur together more often than their parts explain, by
language, from lossless counts of all n-grams that can be frequent.

Frequent words get ids; texts become runs of ids. Then one pass for each length
counts the n-grams of which both parts, one word shorter, are frequent, in counting
quotient filters (:mod:`.counting_filters`): each task fills compact filters, which
are merged by ranges of quotients. A frequent phrase has only frequent parts, so
nothing that is asked for is left out, and counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import table_bytes
from ..operators.ordering import global_index
from ..session import materialize
from .common import in_batches, pick
from .counting_filters import Counter, Layout, Packing

LONGEST = 5
#: A table of words up to this size is sent to every task; a larger one is joined.
DICTIONARY_BYTES = 8 * 1024**2
#: Grams a task counts before it hands out filters, and grams before merging in a
#: range of quotients.
HELD, RANGE = 1 << 20, 1 << 20
#: Bits of the map of frequent grams: at most so many, and so many for each gram.
MAP_BITS, BITS_PER_GRAM = 26, 16
#: Parts of a language, each of which names its best phrases first.
PARTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What ends a piece, what separates words.
_ENDS, _GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_FOLDED = bytes.maketrans(
    UPPER.encode() + _ENDS + _GAPS, LOWER.encode() + b"\n" * len(_ENDS) + b"  "
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _texts(df: DataFrame) -> DataFrame:
    return pick(df, text="text", lang="lang").select(
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``word`` (A to Z lower-cased) and ``f`` of all word occurrences.

    Words are counted as they stand before they are lower-cased, so that this is
    done once for each distinct word of a task's share."""
    said = F.explode(F.split("text", r"[.,;:!?\x0A-\x0D\x20\x09]+")).alias("raw")
    raw = texts.select("lang", said).where("raw <> ''").groupBy("lang", "raw")
    folded = F.translate("raw", UPPER, LOWER).alias("word")
    return (
        raw.agg(F.count("*").alias("f"))
        .select("lang", folded, "f")
        .groupBy("lang", "word")
        .agg(F.sum("f").alias("f"))
    )


def _ids_from_dictionary(texts: DataFrame, words: DataFrame) -> DataFrame:
    ids: dict[str, dict[bytes, int]] = {}
    for lang, word, i in words.select("lang", "word", "id").collect():
        ids.setdefault(lang, {})[word.encode()] = i
    shared = texts.sparkSession.sparkContext.broadcast(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, lang in zip(
                batch.column("text").to_pylist(),
                batch.column("lang").to_pylist(),
                strict=True,
            ):
                known, found = shared.value.get(lang, {}), []
                for piece in text.encode().translate(_FOLDED).split(b"\n"):
                    said = piece.split(b" ")
                    found += [known.get(w, 0) for w in said if w]
                    found.append(0)
                made.append(np.array(found, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["ids"])

    return in_batches(texts, work, "ids binary")


def _ids_from_join(texts: DataFrame, words: DataFrame) -> DataFrame:
    """The same where the words don't fit in a task: every word occurrence is joined
    to its id and goes back to its text."""
    cut = F.split(F.regexp_replace("text", r"[.,;:!?\x0A-\x0D]", " \n "), "[ \t]+")
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    said = rows.select("row", "lang", F.posexplode(cut)).where("col <> ''")
    said = said.withColumn("word", F.translate("col", UPPER, LOWER))
    found = said.join(words.select("lang", "word", "id"), ["lang", "word"], "left")
    place = F.struct("pos", F.coalesce("id", F.lit(0)).alias("id"))
    rows = found.groupBy("row").agg(F.array_sort(F.collect_list(place)).alias("said"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.array([*x, 0], "<u4").tobytes() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["ids"])

    return in_batches(rows.select(F.col("said.id").alias("ids")), work, "ids binary")


def encoded(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``ids`` (four bytes each) of every text's words, 0 for words without an id
    and where a piece ends; a written table."""
    small = table_bytes(words) <= DICTIONARY_BYTES
    return materialize((_ids_from_dictionary if small else _ids_from_join)(texts, words))


def _places(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """A place in a map of ``2 ** bits`` bits for each gram."""
    x = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        x = (x + column.astype(np.uint64) + np.uint64(1)) * _ODD
        x ^= x >> np.uint64(29)
    return ((x * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


class FrequentMap:
    """A bit for each place of a frequent gram. Its size has a fixed bound; where it
    fills up, more grams are counted in vain, and none is missed."""

    def __init__(self, grams: DataFrame, length: int) -> None:
        wanted = max(16, (BITS_PER_GRAM * max(1, grams.count()) - 1).bit_length())
        bits = self.bits = min(MAP_BITS, wanted)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("ids").flatten().to_numpy().reshape(-1, length)
                at = np.unique(_places(list(ids.T), bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at >> 16), pa.array(at & 0xFFFF)], ["share", "at"]
                )

        def join(table: pa.Table) -> pa.Table:
            held = np.zeros(1 << 16, np.uint8)
            held[table["at"].to_numpy()] = 1
            data = np.packbits(held).tobytes()
            return pa.table(
                {"share": table["share"][:1], "data": pa.array([data], pa.binary())}
            )

        shares = (
            grams.mapInArrow(places, "share bigint, at bigint")
            .groupBy("share", "at")
            .agg(F.count("*"))
            .select("share", "at")
            .groupBy("share")
            .applyInArrow(join, "share bigint, data binary")
        )
        self.data = np.zeros(1 << (bits - 3), np.uint8)
        for share, data in shares.collect():
            start = share << 13
            self.data[start : start + 8192] = np.frombuffer(data, np.uint8)

    def hits(self, columns: list[np.ndarray]) -> np.ndarray:
        at = _places(columns, self.bits)
        return (self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def frequent_grams(
    rows: DataFrame,
    length: int,
    bits: int,
    total: int,
    min_count: int,
    shorter: FrequentMap | None,
) -> DataFrame:
    """``ids`` and ``f`` of the grams of ``length`` ids that occur ``min_count``
    times, as a written table. ``shorter`` marks the frequent ones one id shorter,
    ``total`` bounds the number of occurrences."""
    packing = Packing(length, bits)
    layout = Layout(packing, packing.block_bits(max(5, (total // RANGE).bit_length())))
    known = rows.sparkSession.sparkContext.broadcast(shorter)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(layout, HELD)

        def sent(filters) -> Iterator[pa.RecordBatch]:
            found = list(filters)
            for start in range(0, len(found), 64):
                blocks, data = zip(*found[start : start + 64], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int64()), pa.array(data, pa.binary())],
                    ["block", "data"],
                )

        for batch in batches:
            # The end of each row is an end of a piece, too.
            whole = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u4")
            for start in range(0, len(whole), HELD):
                flat = whole[start : start + HELD + length - 1]
                n = len(flat) - length + 1
                if n <= 0:
                    continue
                columns = [flat[k : k + n] for k in range(length)]
                held = columns[0] > 0
                for column in columns[1:]:
                    held &= column > 0
                at = np.flatnonzero(held)
                columns = [c[at] for c in columns]
                if known.value is not None:
                    own = known.value.hits(columns[:-1])
                    own &= known.value.hits(columns[1:])
                    columns = [c[own] for c in columns]
                if len(columns[0]):
                    yield from sent(counter.add(columns))
        yield from sent(counter.flush())

    def merge(table: pa.Table) -> pa.Table:
        data = [x.as_py() for x in table["data"]]
        parts, counts = layout.merge(table["block"][0].as_py(), data)
        own = counts >= min_count
        ids = packing.unpack(parts[:, own])
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(ids) + 1, dtype=np.int32) * length),
            pa.array(ids.reshape(-1)),
        )
        return pa.table({"ids": lists, "f": pa.array(counts[own], pa.int64())})

    filters = in_batches(rows, count, "block bigint, data binary")
    return materialize(
        filters.groupBy("block").applyInArrow(merge, "ids array<bigint>, f bigint")
    )


def frequent_phrases(df: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of one to five words with ``min_count`` occurrences in a language
    (ids, f); their words (id, lang, word, f); and words by language (lang, n)."""
    texts = _texts(df)
    counts = materialize(word_counts(texts))
    totals = materialize(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = counts.where(F.col("f") >= min_count).withColumn("order", -F.col("f"))
    numbered = global_index(frequent, ["order", "lang", "word"], "place")
    words = materialize(
        numbered.select((F.col("place") + 1).alias("id"), "lang", "word", "f")
    )
    size, total = words.agg(F.max("id"), F.sum("f")).head()
    found = words.select(F.array("id").alias("ids"), "f")
    if not size:
        return found, words, totals
    rows, shorter = encoded(texts, words), None
    for length in range(2, LONGEST + 1):
        grams = frequent_grams(
            rows, length, size.bit_length(), total, min_count, shorter
        )
        found = found.union(grams)
        if length < LONGEST:
            shorter = FrequentMap(grams, length)
    return found, words, totals


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in decimals: products may pass 64 bits."""
    a, n, left, right = (x.cast("decimal(19,0)") for x in (a, n, left, right))
    product, below = F.lit(1000).cast("decimal(4,0)") * a * n, left * right
    # Decimal division rounds; what is cut off is exact.
    return ((product - product % below) / below).cast("bigint")


def collocations(df: DataFrame, min_count: int = 100, top: int = 2000) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: of each
    language (null: ``und``) the ``top`` phrases of two to five words with
    ``min_count`` occurrences, whose words don't all lie inside a longer phrase that
    is as frequent.

    A phrase's score is that of its weakest cut. Equal scores are ordered by
    occurrences, then by the phrase's bytes. Null and empty texts hold no words; a
    repeated row counts each time; an empty table gives no rows; ``doc_id`` and other
    columns are not read.
    """
    grams, words, totals = frequent_phrases(df, min_count)
    phrases = grams.where(F.size("ids") > 1).withColumnRenamed("f", "a")
    inside = phrases.where(F.size("ids") > 2).select(
        F.explode(
            F.array(
                F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids))")
            )
        ).alias("ids"),
        "a",
    )
    # A longer phrase has no more occurrences, so "as frequent" means equal.
    kept = materialize(phrases.join(inside, ["ids", "a"], "left_anti"))
    cuts = kept.select(
        "ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k")
    ).select(
        "*",
        F.expr("slice(ids, 1, k)").alias("left"),
        F.expr("slice(ids, k + 1, size(ids))").alias("right"),
    )
    first = words.select(F.col("id").alias("first"), "lang").join(totals, "lang")
    cuts = (
        cuts.join(grams.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left")
        .join(grams.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
        .withColumn("first", F.col("ids")[0])
        .join(first, "first")
    )
    score = _score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    weakest = cuts.groupBy("ids", "a", "lang", "n").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    spelt = (
        kept.select("ids", F.posexplode("ids").alias("pos", "id"))
        .join(words.select("id", "word"), "id")
        .groupBy("ids")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("said"))
        .select("ids", F.array_join("said.word", " ").alias("phrase"))
    )
    scored = weakest.join(spelt, "ids").select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    own = Window.partitionBy("lang", "part").orderBy(*best)
    scored = scored.withColumn("part", part).withColumn("rank", F.row_number().over(own))
    whole = Window.partitionBy("lang").orderBy(*best)
    ranked = scored.where(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(whole).cast("bigint")
    )
    return ranked.where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
