"""Exact Jaccard self-join of documents on word shingles, and its components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, documents, hinted, in_batches, rows_by
from .shingle_sets import (
    Order,
    candidate_forest,
    links,
    low_bits,
    marked,
    parity_sketch,
    prefix_size,
    set_id,
    shingle_set,
)

PERCENT = 80
#: Bits of the bitmaps of tokens seen twice: eight for each such token, within
#: these bounds (128 KB to 128 MB); classes of frequent tokens.
LEAST_BITS, MOST_BITS, CLASSES = 1 << 20, 1 << 30, 1 << 20
#: Tokens that fewer sets have are of the lowest class.
FREQUENT = 16
#: Index lists up to this length are compared pair by pair; the members of longer
#: ones are candidates of one another untested.
LONG_LIST = 2_048
#: Sets and tokens that a task compares with one another. More candidates are cut
#: into blocks, and every pair of blocks is a task.
BLOCK_SETS, BLOCK_TOKENS = 2_048, 2_000_000
#: Sets that a partition remembers having written.
KNOWN_SETS = 500_000


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """Texts as bytes, without decoding them."""
    return (x.as_py() for x in batch.column("text").cast(pa.binary()))


def _new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """For each batch the sets that this partition has not shown yet."""
    known: set[bytes] = set()
    for batch in batches:
        made = []
        for text in _texts(batch):
            tokens = shingle_set(text)
            digest = set_id(tokens)
            if len(tokens) and digest not in known:
                if len(known) < KNOWN_SETS:
                    known.add(digest)
                made.append(tokens)
        yield made


def _low_tokens(df: DataFrame, chosen) -> DataFrame:
    """Low bits of the tokens that ``chosen`` takes of every set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _new_sets(batches):
            held = [low_bits(chosen(tokens)) for tokens in made]
            flat = np.concatenate(held) if held else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int32())], ["low"])

    return in_batches(df, work, "low int")


def _twice(tokens: DataFrame) -> DataFrame:
    """The tokens that stand there more than once, with their number, as a written
    table."""
    counted = tokens.groupBy("low").agg(F.count("*").alias("n"))
    return materialize(counted.where("n > 1"))


def _bitmap(twice: DataFrame) -> np.ndarray:
    """A bitmap of these tokens, eight bits for each within the bounds. Where two
    share a bit, a token is taken for one seen twice, which costs time only."""
    wanted = 8 * twice.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, wanted - 1).bit_length()))
    bit = F.col("low").bitwiseAND(F.lit(size - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit % 64)
    words = (
        twice.groupBy(F.shiftright(bit, 6).alias("word"))
        .agg(F.bit_or(one).alias("bits"))
        .toArrow()
    )
    held = np.zeros(size // 64, np.int64)
    if words.num_rows:
        held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return held


def _classes(twice: DataFrame) -> np.ndarray:
    """A class for each remainder of the tokens' low bits: the doublings of its most
    frequent token over ``FREQUENT``."""
    most = (
        twice.where(F.col("n") >= FREQUENT)
        .groupBy(F.col("low").bitwiseAND(F.lit(CLASSES - 1)).alias("at"))
        .agg(F.max("n").alias("n"))
        .toArrow()
    )
    held = np.zeros(CLASSES, np.uint8)
    if most.num_rows:
        over = most.column("n").to_numpy() / FREQUENT
        held[most.column("at").to_numpy()] = 1 + np.log2(over).astype(np.uint8)
    return held


def _token_order(df: DataFrame, percent: int) -> Order:
    """The order of tokens, from those that stand low in the sets by hash: twice as
    many as a prefix takes, so that a set with shared passages finds enough others
    for its prefix."""

    def lowest(tokens: np.ndarray) -> np.ndarray:
        return tokens[: 2 * prefix_size(len(tokens), percent)]

    twice = _twice(_low_tokens(df, lowest))
    return Order(_bitmap(twice), _classes(twice))


def _sets_and_postings(df: DataFrame, order, seen, percent: int) -> DataFrame:
    """In one written table a row (doc_id, said, set_id, size) for every document,
    and the rows (token, set_id, size, place, sketch) of the index lists: the prefix
    tokens that may stand in another prefix too, once for each set and partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            ids, sizes = [], []
            tokens_out, places, owners, sketches = [], [], [], []
            for k, text in enumerate(_texts(batch)):
                tokens = shingle_set(text)
                digest = set_id(tokens)
                ids.append(digest)
                sizes.append(len(tokens))
                if not len(tokens) or digest in known:
                    continue
                if len(known) < KNOWN_SETS:
                    known.add(digest)
                first = order.value.first(tokens, percent)
                at = np.flatnonzero(marked(seen.value, low_bits(first)))
                if len(at):
                    tokens_out.append(first[at].view(np.int64))
                    places.append(at)
                    owners.append(np.full(len(at), k))
                    sketches += [parity_sketch(tokens).tobytes()] * len(at)
            rows = len(ids)
            of = pa.array(np.arange(rows))
            owner = pa.array(np.concatenate([np.arange(0), *owners]), pa.int64())
            set_ids, set_sizes = pa.array(ids, pa.binary()), pa.array(sizes, pa.int64())
            none = np.zeros(0, np.int64)
            for which, columns in (
                (
                    of,
                    [
                        batch.column("doc_id"),
                        batch.column("said"),
                        pa.nulls(rows, pa.int64()),
                        pa.nulls(rows, pa.int64()),
                        pa.nulls(rows, pa.binary()),
                    ],
                ),
                (
                    owner,
                    [
                        pa.nulls(len(owner), pa.int64()),
                        pa.nulls(len(owner), pa.int64()),
                        pa.array(np.concatenate([none, *tokens_out])),
                        pa.array(np.concatenate([none, *places])),
                        pa.array(sketches, pa.binary()),
                    ],
                ),
            ):
                yield pa.RecordBatch.from_arrays(
                    [*columns, set_ids.take(which), set_sizes.take(which)],
                    ["doc_id", "said", "token", "place", "sketch", "set_id", "size"],
                )

    schema = (
        "doc_id bigint, said bigint, token bigint, place bigint, sketch binary, "
        "set_id binary, size bigint"
    )
    return materialize(in_batches(df, work, schema))


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between set ids that connect all sets that may be similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        first: bytes | None = None  # of a list too long to be held
        current = None
        a: list[bytes] = []
        b: list[bytes] = []

        def close(table: pa.Table) -> None:
            """All complete lists of a table sorted by token."""
            token = table.column("token").to_numpy()
            cuts = np.flatnonzero(np.diff(token)) + 1
            starts = np.concatenate([[0], cuts])
            ends = np.append(cuts, len(token))
            ids = table.column("set_id").to_pylist()
            sizes = table.column("size").to_numpy()
            places = table.column("place").to_numpy()
            sketches = np.frombuffer(
                b"".join(table.column("sketch").to_pylist()), np.uint8
            ).reshape(len(ids), -1)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < 2:
                    continue
                # Copies from several partitions follow one another.
                own = [s, *[k for k in range(s + 1, e) if ids[k] != ids[k - 1]]]
                if len(own) < 2:
                    continue
                if len(own) > LONG_LIST:
                    a.extend([ids[s]] * (len(own) - 1))
                    b.extend(ids[k] for k in own[1:])
                    continue
                at = np.array(own)
                for x, y in candidate_forest(
                    sizes[at], places[at], sketches[at], percent
                ):
                    a.append(ids[own[x]])
                    b.append(ids[own[y]])

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"]
            )
            a.clear()
            b.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            token = batch.column("token").to_numpy()
            if first is not None:
                # The list went on: its members are tied to its first one.
                n = int(np.searchsorted(token != current, True))
                rest = table.slice(0, n).column("set_id").to_pylist()
                a.extend([first] * len(rest))
                b.extend(rest)
                table, token = table.slice(n), token[n:]
                if not table.num_rows:
                    yield flush()
                    continue
                first = None
            if tail is not None:
                table = pa.concat_tables([tail, table])
                token = table.column("token").to_numpy()
            last = int(np.searchsorted(token[::-1] != token[-1], True))
            cut = len(token) - last
            if cut:
                close(table.slice(0, cut))
            tail = table.slice(cut)
            if tail.num_rows > 4 * LONG_LIST:
                held = tail.column("set_id").to_pylist()
                first, current = held[0], token[-1]
                a.extend([first] * (len(held) - 1))
                b.extend(held[1:])
                tail = None
            if a:
                yield flush()
        if tail is not None and tail.num_rows:
            close(tail)
        yield flush()

    dealt = postings.repartition("token").sortWithinPartitions("token", "set_id")
    return dealt.mapInArrow(work, "a binary, b binary").where("a != b").distinct()


def _members(
    df: DataFrame, sets: DataFrame, labels: DataFrame, percent: int
) -> DataFrame:
    """The sets that have candidates, once each, as (key, side, set_id, tokens):
    for small components one key, for larger ones a key for each pair of blocks."""
    reps = sets.groupBy("set_id").agg(
        F.min(F.struct("doc_id", "said")).alias("one"), F.max("size").alias("size")
    )
    known = materialize(labels.join(reps, F.col("node") == F.col("set_id")))
    loads = F.greatest(F.count("*") / BLOCK_SETS, F.sum("size") / BLOCK_TOKENS)
    blocks = known.groupBy("root").agg(F.ceil(loads).cast("int").alias("blocks"))
    placed = known.join(blocks, "root").select(
        "root", "blocks", "set_id", "one.doc_id", "one.said"
    )
    wanted = hinted(materialize(placed), 120)
    texts = df.join(
        wanted.withColumnRenamed("doc_id", "one_doc"),
        "said",
    ).where(F.col("doc_id").eqNullSafe(F.col("one_doc")))
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")
        ),
    )
    spread = (
        texts.withColumn("block", own)
        .withColumn("pair", F.explode(pair))
        .select("root", "pair.i", "pair.j", "block", "set_id", "text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted_ids = batch.column("set_id").to_pylist()
            kept, tokens_out = [], []
            for k, text in enumerate(_texts(batch)):
                tokens = shingle_set(text)
                if set_id(tokens) == wanted_ids[k]:
                    kept.append(k)
                    tokens_out.append(tokens.tobytes())
            rows = batch.select(["root", "i", "j", "block", "set_id"]).take(
                pa.array(kept, pa.int64())
            )
            yield rows.append_column("tokens", pa.array(tokens_out, pa.binary()))

    schema = "root binary, i int, j int, block int, set_id binary, tokens binary"
    return in_batches(spread, work, schema)


def _verified(members: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """Exact links among members: (a, b) for a forest of them, and for each set
    (a, null, n) the number of documents whose sets it links to in this task."""
    weighted = members.join(hinted(copies, 60), "set_id", "left").withColumn(
        "copies", F.coalesce("copies", F.lit(1).cast("bigint"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), table in rows_by(batches, ["root", "i", "j"]):
            rows = dict(
                zip(
                    table.column("set_id").to_pylist(),
                    zip(
                        table.column("tokens").to_pylist(),
                        table.column("block").to_pylist(),
                        table.column("copies").to_pylist(),
                        strict=True,
                    ),
                    strict=True,
                )
            )
            ids = sorted(rows, key=lambda k: rows[k][1])
            sets = [np.frombuffer(rows[k][0], np.uint64) for k in ids]
            split = None if i == j else sum(rows[k][1] == i for k in ids)
            if len(ids) < 2:
                continue
            weight = np.array([rows[k][2] for k in ids], np.int64)
            edges, degrees = links(sets, split, percent, weight)
            linked = np.flatnonzero(degrees).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[a] for a, _ in edges], pa.binary()),
                    pa.array([ids[b] for _, b in edges], pa.binary()),
                    pa.nulls(len(edges), pa.int64()),
                ],
                ["a", "b", "n"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k in linked], pa.binary()),
                    pa.nulls(len(linked), pa.binary()),
                    pa.array(degrees[linked], pa.int64()),
                ],
                ["a", "b", "n"],
            )

    dealt = weighted.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(work, "a binary, b binary, n bigint")


def jaccard_components(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest ``doc_id``
    reachable by links, its own included) and ``n_links`` (other documents linked
    to) of every row.

    A document's set holds the hashes of its distinct runs of five words, A-Z taken
    as a-z; a text with fewer words is one run, a text without words has an empty
    set and is linked with nothing. Two rows link if the intersection is at least
    ``percent`` per cent of the union, exactly, whatever the number of copies:

    1. Equal sets are one set, told by 128 bits.
    2. Similar sets share a token among their first ones in any common order. Here
       tokens that other sets have come late in it, so most prefixes hold nothing
       shared, and only tokens that two prefixes have become index lists.
    3. An index list connects the sets on it that may be similar by size, place and
       a sketch that can't overestimate their difference. No pairs leave the task,
       only a spanning forest.
    4. Each connected group of candidates is compared exactly in one task, or in
       one for every two blocks of it if it is large, and a forest of the links
       gives the components.

    Repeated rows are equal sets. Rows without a ``doc_id`` take part and name no
    component; a component without any id has null. An empty table gives none.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    texts = documents(df).withColumn("said", F.xxhash64("text"))
    plain = texts.select("text")
    order = context.broadcast(_token_order(plain, percent))
    prefixes = _low_tokens(plain, lambda tokens: order.value.first(tokens, percent))
    seen = context.broadcast(_bitmap(_twice(prefixes)))
    rows = _sets_and_postings(texts, order, seen, percent)
    sets = rows.where("token is null").select("doc_id", "said", "set_id", "size")
    postings = rows.where("token is not null").select(
        "token", "set_id", "size", "place", "sketch"
    )
    near = components(spark, materialize(_candidates(postings, percent)))
    per_set = sets.groupBy("set_id", "size").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies")
    )
    per_set = materialize(per_set)
    copied = per_set.where("copies > 1").select("set_id", "copies")
    members = _members(texts, sets, near, percent)
    found = materialize(_verified(members, copied, percent))
    labels = components(spark, found.where("b is not null").select("a", "b"))
    degrees = (
        found.where("n is not null")
        .groupBy(F.col("a").alias("set_id"))
        .agg(F.sum("n").alias("others"))
    )
    rooted = per_set.join(
        labels.withColumnRenamed("node", "set_id"), "set_id"
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    linked = (
        rooted.join(least, "root")
        .join(degrees, "set_id", "left")
        .select("set_id", "component", "others")
    )
    groups = (
        per_set.join(linked, "set_id", "left")
        .where("size > 0 and (copies > 1 or component is not null)")
        .select(
            "set_id",
            F.coalesce("component", "first").alias("component"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    return sets.join(hinted(materialize(groups), 60), "set_id", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_first(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, with all columns, of one document for each component: the
    one with the smallest ``doc_id``. Rows without words or without a ``doc_id``
    stay."""
    later = (
        jaccard_components(df, percent)
        .where("n_shingles > 0 and component_id < doc_id")
        .select(F.col("doc_id").alias("later_doc"))
        .distinct()
    )
    names = [f"c{i}" for i in range(len(df.columns))]
    doc_id = names[df.columns.index("doc_id")]
    placed = df.toDF(*names)
    gone = hinted(materialize(later), 16)
    same = placed[doc_id].cast("bigint") == gone["later_doc"]
    return placed.join(gone, same, "left_anti").toDF(*df.columns)
