"""Double arrays against dictionaries, nodes of conversations against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlab.llm import double_array, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@settings(max_examples=100, deadline=None)
@given(st.sets(st.lists(st.integers(0, 6) | st.integers(0, 900), max_size=6).map(tuple)))
def test_double_array_holds_every_prefix_and_nothing_else(sequences):
    rows = sorted(sequences)
    codes = np.array([c for r in rows for c in r], np.int64)
    offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
    trie = double_array.build(codes, offsets)
    states = {}
    for row in rows:
        state = 0
        for depth, label in enumerate(row):
            state = int(trie.step(np.array([state]), np.array([label]))[0])
            assert state > 0 and states.setdefault(row[: depth + 1], state) == state
    assert len(set(states.values())) == len(states) == (trie.check >= 0).sum()
    for prefix, state in states.items():
        for label in (0, 3, 901):
            if (*prefix, label) not in states:
                assert trie.step(np.array([state]), np.array([label]))[0] == -1


def by_hand(rows):
    """Nodes as a dictionary of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            order = (turn is not None, turn or 0, key, len(text.encode()))
            own[conv].append((order, (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        block = c - int(np.fmod(c, 5))
        paths[c] = tuple(own.get(block, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    made = []
    for node, convs in members.items():
        inside = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == node)
        made.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                len(children[node]),
                sum(not children[n] for n in inside),
                sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in inside if n),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(made, key=repr)


def run(spark, rows, shard_bytes=prefix_trie.SHARD_BYTES):
    df = spark.createDataFrame(rows, SCHEMA)
    found = prefix_trie.conversation_trie(df, shard_bytes).collect()
    return sorted(map(tuple, found), key=repr)


def random_rows(seed, convs, texts):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(rnd.randrange(0, 7)):
            rows.append((c, turn, rnd.choice(["u", "a", None]), rnd.choice(texts)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_bytes", [prefix_trie.SHARD_BYTES, 1500])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, shard_bytes):
    rows = random_rows(seed, 120, ["", "é", "hello", "hello there", None, "x,y"])
    assert run(spark, rows, shard_bytes) == by_hand(rows)


def test_many_copies_over_several_shards(spark, monkeypatch):
    """One path that most conversations have is dealt out by id and merged whole."""
    monkeypatch.setattr(prefix_trie, "IDS_PER_ROW", 3)
    rows = [(c, t, "u", f"turn {t}") for c in range(300) for t in range(9)]
    rows += [(c, 0, "u", "other") for c in range(300, 320)]
    rows += [(400, t, "u", f"turn {t}") for t in range(3)]
    assert run(spark, rows, 4000) == by_hand(rows)


def test_a_long_conversation(spark):
    rows = [(5, t, "u", str(t % 7)) for t in range(700)]
    rows += [(6, t, "u", str(t % 7)) for t in range(640)] + [(6, 640, "a", "end")]
    assert run(spark, rows, 9000) == by_hand(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, "u", "first"),
        (0, None, "u", "first"),
        (0, 1, None, None),
        (0, 1, "", "b"),
        (1, 7, "u", "x" * 300_000),
        (3, -2, "u", "\x00"),
        (-3, 0, "u", "a"),
        (None, 0, "u", "nobody's"),
        (2**62, 0, "u", "far"),
    ]
    assert run(spark, rows) == by_hand(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS KEYS", "2 AS path", "3 AS block", "4 AS kind"
    )
    assert prefix_trie.conversation_trie(df).count() == len(by_hand(rows))


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "u", "x")]) == []


def test_turnless(spark):
    """All own turns lie before the branch, and there is no first conversation."""
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "u", "gone")]
    empty = hashlib.sha256(str(c).encode()).hexdigest()
    assert run(spark, rows) == [(c, 0, None, 1, 0, 1, 0, empty)] == by_hand(rows)
