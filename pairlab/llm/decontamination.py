"""Benchmark passages in documents: SimHash of windows as long as an item, a
multi-index over Hamming blocks, and exact weighted similarity of the candidates.
DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import hinted, pick
from .quality import let, words

#: Words of a shingle; per cent of weighted similarity from which a window is a
#: copy of an item.
SHINGLE, PERCENT = 5, 80
#: A fingerprint's 64 bits in blocks, and how many bits of one block may differ in
#: the index. Fingerprints that differ in up to ``RADIUS`` bits agree up to
#: ``BLOCK_RADIUS`` bits in one block at least, by the pigeonhole principle.
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: 64-bit words of the bitmap that tells positions without any item's shingle.
FILTER_WORDS = 1 << 14


def shingles(text: Column) -> Column:
    """Hashes of all runs of five lower-case words in order; a text with fewer words
    has one, of them all; null for texts without a word."""

    def hashed(w: Column) -> Column:
        runs = F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]),
        )
        whole = F.array(F.xxhash64(F.lit("short"), F.array_join(w, " ")))
        return F.when(F.size(w) < SHINGLE, whole).otherwise(runs)

    return let(words(F.lower(text)), hashed)


def _shift(value: Column, bits: Column | int) -> Column:
    bits = F.lit(bits) if isinstance(bits, int) else bits.cast("int")
    return F.call_function("shiftrightunsigned", value, bits)


def simhash(window: Column, longest: int) -> Column:
    """64 bits, each set where more than half of the hashes (with their number of
    times) have it set. The bits' counts are added side by side in lanes of a long
    that are wide enough for ``longest`` hashes."""
    width = next(w for w in (8, 16, 32) if longest < 1 << w)
    lanes = 64 // width
    mask = sum(1 << (width * k) for k in range(lanes))

    def lane_sums(j: int) -> Column:
        return F.aggregate(
            window,
            F.lit(0).cast("bigint"),
            lambda a, h: a + _shift(h, j).bitwiseAND(F.lit(mask)),
        )

    sums = F.array(*[lane_sums(j) for j in range(width)])

    def bits(s: Column) -> Column:
        def bit(b: Column) -> Column:
            held = _shift(F.get(s, b % width), (b / width).cast("int") * width)
            count = held.bitwiseAND(F.lit((1 << width) - 1))
            set_bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
            return F.when(2 * count > F.size(window), set_bit).otherwise(
                F.lit(0).cast("bigint")
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)),
            F.lit(0).cast("bigint"),
            lambda a, b: a.bitwiseOR(bit(b)),
        )

    return let(sums, bits)


def _block(value: Column, k: Column | int) -> Column:
    if isinstance(k, Column):
        k = k * BLOCK_BITS
    else:
        k *= BLOCK_BITS
    return _shift(value, k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def block_index(items: DataFrame) -> DataFrame:
    """For every item its block values and all that differ from them in up to
    ``BLOCK_RADIUS`` bits: (m, block, value, item_id, item_fp)."""
    near = [v for v in range(1 << BLOCK_BITS) if v.bit_count() <= BLOCK_RADIUS]
    return (
        items.select(
            "item_id",
            "m",
            "item_fp",
            F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"),
        )
        .withColumn("other", F.explode(F.array(*[F.lit(v) for v in near])))
        .select(
            "m",
            "block",
            _block(F.col("item_fp"), F.col("block"))
            .bitwiseXOR(F.col("other").cast("bigint"))
            .alias("value"),
            "item_id",
            "item_fp",
        )
    )


def _again(ordered: Column) -> Column:
    """Of a sorted array what equals its forerunner: every value once less."""
    return F.filter(
        ordered, lambda x, i: (i > 0) & x.eqNullSafe(F.get(ordered, i - F.lit(1)))
    )


def common_weight(window: Column, item: Column) -> Column:
    """Sum over the distinct hashes of both of the smaller number of times.

    What both hold counts once by a hashed intersection. Of the repetitions, those
    beyond a value's first, few different ones are counted one by one, and many
    different ones by rounds, each of which takes one more time of every value: in
    both cases the work stays far below the product of the lengths.
    """

    def times(array: Column, h: Column) -> Column:
        return F.size(F.filter(array, lambda x: x == h))

    def few(w: Column, i: Column) -> Column:
        return F.aggregate(
            F.array_intersect(w, i),
            F.lit(0),
            lambda a, h: a + F.least(times(w, h), times(i, h)),
        )

    def rounds(w: Column, i: Column) -> Column:
        # One more time than that no value of the shorter array occurs.
        most = F.least(F.size(w), F.size(i))
        start = F.struct(w.alias("w"), i.alias("i"), F.lit(0).alias("n"))
        done = F.aggregate(
            F.sequence(F.lit(1), F.ceil(F.sqrt(most)).cast("int") + 1),
            start,
            lambda a, _: F.struct(
                _again(a["w"]).alias("w"),
                _again(a["i"]).alias("i"),
                (a["n"] + F.size(F.array_intersect(a["w"], a["i"]))).alias("n"),
            ),
        )
        # What is left has few different values: each occurs more often than that.
        return let(done, lambda d: d["n"] + few(d["w"], d["i"]))

    def more(both: Column) -> Column:
        w, i = both["w"], both["i"]
        return F.when((F.size(w) == 0) | (F.size(i) == 0), 0).otherwise(rounds(w, i))

    repeated = F.struct(
        let(F.sort_array(window), _again).alias("w"),
        let(F.sort_array(item), _again).alias("i"),
    )
    return F.size(F.array_intersect(window, item)) + let(repeated, more)


def _bitmap(grams: DataFrame) -> str:
    """The shingles of all items as a bitmap of fixed size, written as JSON."""
    bit = F.col("h").bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
    one = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int")
    )
    rows = (
        grams.groupBy((bit / 64).cast("int").alias("word"))
        .agg(F.bit_or(one).alias("bits"))
        .collect()
    )
    held = [0] * FILTER_WORDS
    for row in rows:
        held[row["word"]] = row["bits"]
    return json.dumps(held, separators=(",", ":"))


def text_hash(text: Column) -> list[Column]:
    """128 bits of a text, in two halves."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``t1``, ``t2`` (the text's hash), ``item_id``, ``similarity`` and
    ``position`` of every window that is a copy of an item: see
    :func:`contaminated`."""
    items = pick(benchmark, item_id="item_id", text="text").select(
        F.col("item_id").cast("bigint").alias("item_id"),
        shingles(F.col("text")).alias("item_sh"),
    )
    items = materialize(
        items.where(F.col("item_sh").isNotNull())
        .distinct()
        .withColumn("m", F.size("item_sh"))
    )
    longest = items.agg(F.max("m")).head()[0] or 1
    row_bytes = 8 * longest + 64
    items = hinted(
        materialize(items.withColumn("item_fp", simhash(F.col("item_sh"), longest))),
        row_bytes,
    )
    grams = materialize(
        items.select(F.explode("item_sh").alias("h"), "m").distinct()
    )
    held = F.from_json(F.lit(_bitmap(grams)), "array<bigint>")

    def likely(h: Column) -> Column:
        bit = h.bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
        word = F.get(held, _shift(bit, 6).cast("int"))
        return _shift(word, bit.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1

    def starts(sh: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.size(sh) - 1), lambda i: likely(F.get(sh, i))
        )
        return F.transform(
            places,
            lambda i: F.struct(
                i.alias("position"),
                F.get(sh, i).alias("h"),
                F.slice(sh, i + 1, F.lit(longest)).alias("window"),
            ),
        )

    texts = pick(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *text_hash(F.col("text")),
        "text",
    )
    row = ["doc_id", "t1", "t2"]
    windows = (
        texts.select(*row, F.explode(let(shingles(F.col("text")), starts)).alias("w"))
        .select(*row, "w.*")
        .join(hinted(grams, 40), "h")
        .select(*row, "position", "m", F.expr("slice(window, 1, m)").alias("window"))
        .withColumn("fp", simhash(F.col("window"), longest))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
        .withColumn("value", _block(F.col("fp"), F.col("block")))
    )
    index = materialize(block_index(items))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.lit(True)
    for k in range(BLOCKS - 1):
        # Found in an earlier block already.
        first = first & (
            (F.col("block") <= k) | (F.bit_count(_block(differ, k)) > BLOCK_RADIUS)
        )
    near = (
        windows.join(hinted(index, 64), ["m", "block", "value"])
        .where((F.bit_count(differ) <= RADIUS) & first)
        .select(*row, "position", "window", "item_id", "item_fp")
    )
    texts_of = items.select(F.col("item_id").alias("own"), "item_fp", "item_sh")
    return (
        near.join(texts_of.withColumnRenamed("item_fp", "own_fp"), [
            F.col("item_id").eqNullSafe(F.col("own")),
            F.col("item_fp") == F.col("own_fp"),
        ])
        .withColumn("common", common_weight(F.col("window"), F.col("item_sh")))
        .withColumn("all", F.size("window") + F.size("item_sh") - F.col("common"))
        .where(100 * F.col("common") >= PERCENT * F.col("all"))
        .withColumn("similarity", F.col("common") / F.col("all"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity`` and ``position`` (of the best
    window's first word) for every document that holds a copy of an item.

    Windows of as many shingles as an item has are taken at every word where a
    shingle of an item of that size stands: another window shares nothing with the
    item, or less than the one that starts at its first shared shingle. Their
    fingerprints meet the items' in the block index, which finds all within
    ``RADIUS`` bits; candidates are kept if the weighted Jaccard similarity of
    their shingles (each with its number of times) is at least 0.8. At a text's end
    windows are shorter.

    Null and empty texts hold nothing and match nothing, nor do items without a
    word; an item of fewer than five words equals only a text that is these words.
    Repeated rows of a document count once, rows without a ``doc_id`` under null;
    of equal windows the first is named. Empty tables give none. Only ``doc_id``,
    ``item_id`` and ``text`` are read.
    """
    return candidates(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"),
        F.max_by("position", F.struct("similarity", -F.col("position"))).alias(
            "position"
        ),
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``df``, with all columns, whose text holds no copy of an item.
    Each row is judged by its own text, also without a ``doc_id`` or with one that
    other rows have; a null text holds no copy and stays."""
    found = candidates(df, benchmark).select("doc_id", "t1", "t2").distinct()
    found = materialize(found)
    found = hinted(found, 32).withColumnRenamed("doc_id", "found_doc")
    names = [f"c{i}" for i in range(len(df.columns))]
    doc_id, text = (names[df.columns.index(c)] for c in ("doc_id", "text"))
    placed = df.toDF(*names)
    h1, h2 = text_hash(placed[text])
    same = (
        placed[doc_id].cast("bigint").eqNullSafe(found["found_doc"])
        & (h1 == found["t1"])
        & (h2 == found["t2"])
    )
    return placed.join(found, same, "left_anti").toDF(*df.columns)
