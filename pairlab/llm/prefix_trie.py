"""A trie of conversations over their turns, with the aggregates of every node.

A conversation becomes a path of fixed-size turn keys. Paths are sorted and dealt out
in ranges, so that a shard holds neighbours whatever they share; it packs them into a
double array over dense turn ids and reads its nodes from there. Only nodes on a
shard's first and last path can lie in other shards, too: those are merged globally.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_unique
from ..session import materialize
from .common import BROADCAST_BYTES, pick
from .double_array import build, common_prefixes

#: Bytes of a turn in a path: 16 of its digest, 4 of its text's length.
TURN = 20
#: Bytes of paths in one shard, ids in one row of a shared node's ends.
SHARD_BYTES, IDS_PER_ROW = 32 * 1024**2, 4096
#: Conversations of one block share a start of up to so many turns less one.
BLOCK, STARTS = 5, 9
NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
_NODE += "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_ROWS = f"kind int, key binary, parent_key binary, n_bytes bigint, ids binary, {_NODE}"


def paths(df: DataFrame) -> DataFrame:
    """``conv_id`` and its turns as one binary ``path``, in order of ``turn`` (null
    first; equal ones by their keys). A turn's key holds the digest of role and
    text, null ones empty. Rows without a ``conv_id`` belong to no conversation."""
    turns = pick(df, conv_id="conv_id", turn="turn", role="role", text="text").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    named = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    size = F.lpad(F.hex(F.octet_length("text")), 8, "0")
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    said = F.struct("turn", F.concat(F.md5(named), size).alias("key"))
    # One shuffle: what a block's conversations share needs no further one.
    return (
        turns.where(F.col("conv_id").isNotNull())
        .select("conv_id", block.alias("block"), said.alias("said"))
        .repartition("block")
        .groupBy("block", "conv_id")
        .agg(F.sort_array(F.collect_list("said")).alias("said"))
        .select("block", "conv_id", F.col("said.key").alias("keys"))
    )


def rebuilt(df: DataFrame) -> DataFrame:
    """Conversations that branch: each begins like the first one of its block, up to
    a turn that a checksum of its id says, and goes on with its own turns."""
    own = paths(df)
    turns = F.crc32(F.col("conv_id").cast("string").cast("binary")) % STARTS
    start = F.when(F.col("conv_id") == F.col("block"), F.slice("keys", 1, STARTS - 1))
    shared = F.max(start).over(Window.partitionBy("block"))
    named = own.withColumn("turns", turns.cast("int")).withColumn("start", shared)
    first = F.coalesce(F.slice("start", F.lit(1), F.col("turns")), F.expr("array()"))
    rest = F.slice("keys", F.col("turns") + 1, F.size("keys"))
    path = F.unhex(F.array_join(F.concat(first, rest), ""))
    return named.select("conv_id", path.alias("path"))


def _digests(turns: np.ndarray) -> list[bytes]:
    """A key for each node on a path, from the root on."""
    keys = [hashlib.md5(b"").digest()]
    for turn in turns:
        keys.append(hashlib.md5(keys[-1] + turn[:16].tobytes()).digest())
    return keys


def _dense(turns: np.ndarray) -> np.ndarray:
    """Ids of turns in order of their first occurrence."""
    halves = np.ascontiguousarray(turns[:, :16]).view(np.int64)
    first, second = (pd.factorize(halves[:, k])[0] for k in (0, 1))
    both = first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second
    return pd.factorize(both)[0].astype(np.int64)


def _rows(kind: int, count: int, **columns) -> pa.Table:
    """Rows of a shard's result; columns that aren't given are null."""
    made = {}
    for name, dtype in (x.split() for x in _ROWS.split(", ")):
        arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}.get(
            dtype, pa.binary()
        )
        value = kind if name == "kind" else columns.get(name)
        if value is None or name == "kind":
            made[name] = pa.array([value] * count, arrow)
        else:
            made[name] = pa.array(value, arrow)
    return pa.table(made)


class Shard:
    """The nodes of a run of sorted paths.

    ``convs`` are the conversations by path, then by id; ``data`` and ``bounds`` the
    paths' turns."""

    def __init__(self, convs: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> None:
        self.convs, self.turns = convs, data
        codes = _dense(data)
        sizes = np.diff(bounds)
        shared = common_prefixes(codes, bounds)
        copy = (shared == sizes) & np.append(False, sizes[1:] == sizes[:-1])
        self.rows = np.flatnonzero(~copy)
        self.copies = np.diff(np.append(self.rows, len(convs)))
        sizes = sizes[self.rows]
        firsts = bounds[:-1][self.rows]
        offsets = np.append(0, np.cumsum(sizes))
        place = np.arange(offsets[-1]) + np.repeat(firsts - offsets[:-1], sizes)
        self.trie = build(codes[place], offsets)
        count = len(self.trie.check)
        self.depth, self.n_bytes = np.full(count, -1), np.zeros(count, np.int64)
        self.n_convs = np.zeros(count, np.int64)
        self.conv_id = np.full(count, np.iinfo(np.int64).max)
        self.ends = np.zeros(len(self.rows), np.int64)
        # Equal paths are sorted by id.
        least = convs[self.rows]
        at, state, depth = np.arange(len(self.rows)), np.zeros(len(self.rows), int), 0
        self.depth[0] = 0
        lengths = np.ascontiguousarray(data[:, 16:]).view(">i4").ravel()
        while len(at):
            np.add.at(self.n_convs, state, self.copies[at])
            np.minimum.at(self.conv_id, state, least[at])
            self.ends[at] = state
            on = sizes[at] > depth
            at, state = at[on], state[on]
            here = firsts[at] + depth
            state = self.trie.step(state, codes[here])
            depth += 1
            self.depth[state] = depth
            self.n_bytes[state] = lengths[here]
        self._mark_shared(firsts, sizes)
        self._sum_up()

    def _mark_shared(self, firsts: np.ndarray, sizes: np.ndarray) -> None:
        """Keys of the nodes on the first and the last path."""
        self.keys: dict[int, bytes] = {}
        self.parents: dict[int, bytes | None] = {}
        for row in (0, len(self.rows) - 1):
            turns = self.turns[firsts[row] : firsts[row] + sizes[row]]
            state, way = int(self.ends[row]), []
            while state >= 0:
                way.append(state)
                state = int(self.trie.check[state])
            keys = _digests(turns)
            self.keys.update(zip(reversed(way), keys, strict=True))
            self.parents.update(zip(reversed(way), [None, *keys], strict=False))
        self.shared = np.zeros(len(self.trie.check), bool)
        self.shared[list(self.keys)] = True

    def _sum_up(self) -> None:
        """Children, and what is summed over subtrees; what shared nodes add to it
        themselves and as children is known globally only."""
        parent = self.trie.check
        own = np.flatnonzero((self.depth > 0) & ~self.shared)
        count = len(parent)
        self.n_children = np.bincount(parent[own], minlength=count)
        single = (self.n_children == 0) & (self.depth >= 0) & ~self.shared
        self.n_leaves = single.astype(np.int64)
        self.saved = np.where(self.shared, 0, (self.n_convs - 1) * self.n_bytes)
        held = np.flatnonzero(self.depth > 0)
        held = held[np.argsort(-self.depth[held], kind="stable")]
        levels = np.flatnonzero(np.diff(self.depth[held])) + 1
        for some in np.split(held, levels):
            np.add.at(self.n_leaves, parent[some], self.n_leaves[some])
            np.add.at(self.saved, parent[some], self.saved[some])

    def tables(self) -> Iterator[pa.Table]:
        parent, digest = self.trie.check, {}
        shared_ends = []
        single = self.copies == 1
        for row, state in enumerate(self.ends.tolist()):
            ids = self.convs[self.rows[row] : self.rows[row] + self.copies[row]]
            if self.shared[state]:
                shared_ends.append((state, ids))
                continue
            said = str(ids[0]) if single[row] else ",".join(map(str, ids.tolist()))
            digest[state] = hashlib.sha256(said.encode()).hexdigest()
        for mine in (False, True):
            nodes = np.flatnonzero((self.depth >= 0) & (self.shared == mine))
            if not len(nodes):
                continue
            above = parent[nodes]
            common = {
                "conv_id": self.conv_id[nodes],
                "depth": self.depth[nodes],
                "n_convs": self.n_convs[nodes],
                "n_children": self.n_children[nodes],
                "n_leaves": self.n_leaves[nodes],
                "saved_tokens": self.saved[nodes],
            }
            states = nodes.tolist()
            if mine:
                yield _rows(
                    1,
                    len(nodes),
                    **common,
                    key=[self.keys[s] for s in states],
                    parent_key=[self.parents[s] for s in states],
                    n_bytes=self.n_bytes[nodes],
                )
                continue
            yield _rows(
                0,
                len(nodes),
                **common,
                parent_key=[self.keys.get(p) for p in above.tolist()],
                parent_conv_id=pa.array(self.conv_id[above], mask=self.shared[above]),
                ends_sha256=[digest.get(s, NOTHING) for s in states],
            )
        for state, ids in shared_ends:
            for start in range(0, len(ids), IDS_PER_ROW):
                some = ids[start : start + IDS_PER_ROW]
                said = ",".join(map(str, some.tolist())).encode()
                key = [self.keys[state]]
                yield _rows(2, 1, key=key, conv_id=some[:1], ids=[said])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    sizes = pc.binary_length(table["path"]).to_numpy().astype(np.int64)
    data = b"".join([x.as_py() for x in table["path"]])
    turns = np.frombuffer(data, np.uint8).reshape(-1, TURN)
    bounds = np.append(0, np.cumsum(sizes // TURN))
    shard = Shard(table["conv_id"].to_numpy(), turns, bounds)
    for made in shard.tables():
        yield from made.to_batches(max_chunksize=16_384)


def _hashed_ends(rows: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256`` of the ids of shared nodes, read in their order a
    batch at a time; only the hash is held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.binary()), pa.array([state.hexdigest()])],
                ["key", "ends_sha256"],
            )

        for batch in batches:
            for own, ids in zip(batch["key"], batch["ids"], strict=True):
                if own.as_py() != key:
                    if key is not None:
                        yield row()
                    key, state = own.as_py(), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py())
        if key is not None:
            yield row()

    ordered = rows.repartition("key").sortWithinPartitions("key", "conv_id")
    return ordered.select("key", "ids").mapInArrow(work, "key binary, ends_sha256 string")


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """``key``, ``leaves`` and ``saved`` summed over each node's subtree in the table
    of (key, parent_key, leaves, saved). Pointers to ancestors double each round, so
    a tree of depth d takes log2(d) rounds of joins."""
    sums = nodes.select("key", F.col("parent_key").alias("up"), "leaves", "saved")
    while sums.where(F.col("up").isNotNull()).limit(1).count():
        below = sums.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("key"))
        below = below.agg(F.sum("leaves").alias("more"), F.sum("saved").alias("also"))
        far = sums.select(F.col("key").alias("up"), F.col("up").alias("far"))
        sums = materialize(
            sums.join(below, "key", "left")
            .join(far, "up", "left")
            .select(
                "key",
                F.col("far").alias("up"),
                (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("also", F.lit(0))).alias("saved"),
            )
        )
    return sums.select("key", "leaves", "saved")


def _merged(rows: DataFrame) -> DataFrame:
    """The shared nodes of all shards, whole, as a written table."""
    nodes = materialize(
        rows.where("kind = 1")
        .groupBy("key")
        .agg(
            F.max("parent_key").alias("parent_key"),
            F.max("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.max("n_bytes").alias("n_bytes"),
            F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"),
        )
    )
    children = nodes.groupBy(F.col("parent_key").alias("key")).agg(
        F.count("*").alias("children")
    )
    nodes = materialize(
        nodes.join(children, "key", "left").withColumn(
            "n_children", F.col("n_children") + F.coalesce("children", F.lit(0))
        )
    )
    own = nodes.select(
        "key",
        "parent_key",
        (F.col("n_children") == 0).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    ends = _hashed_ends(rows.where("kind = 2"))
    return materialize(
        nodes.join(_subtree_sums(own), "key")
        .join(ends, "key", "left")
        .select(
            "key",
            "parent_key",
            "conv_id",
            "depth",
            "n_convs",
            "n_children",
            (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
            (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
    )


def trie_nodes(conversations: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, path): ``conv_id`` (least
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    Paths and ids are dealt out by ranges, so a frequent start, and a path that many
    conversations have, lie in several shards. An empty table has no nodes.
    """
    stored = materialize(conversations)
    size = stored.agg(F.sum(F.octet_length("path") + F.lit(16))).head()[0] or 0
    spark = stored.sparkSession
    shards = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes)
    )
    ordered = stored.repartitionByRange(shards, "path", "conv_id")
    ordered = ordered.sortWithinPartitions("path", "conv_id")
    rows = materialize(ordered.mapInArrow(_shard, _ROWS))
    shared = _merged(rows)
    names = [x.split()[0] for x in _NODE.split(", ")]
    own = rows.where("kind = 0")
    above = shared.select(
        F.col("key").alias("parent_key"), F.col("conv_id").alias("above")
    )
    inner = own.where("parent_key IS NULL").select(*names)
    outer = own.where("parent_key IS NOT NULL").drop("parent_conv_id")
    outer = outer.select("parent_key", *[n for n in names if n != "parent_conv_id"])
    top = shared.select("parent_key", *[n for n in names if n != "parent_conv_id"])
    joined = join_unique(
        outer.union(top), above, ["parent_key"], limit=BROADCAST_BYTES
    ).withColumnRenamed("above", "parent_conv_id")
    return inner.union(joined.select(*names))


def conversation_trie(df: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations of ``df`` (conv_id, turn,
    role, text), see :func:`trie_nodes`, :func:`rebuilt` and :func:`paths`.

    Null roles and texts are empty; repeated rows are turns of their own; other
    columns are not read.
    """
    return trie_nodes(rebuilt(df), shard_bytes)
