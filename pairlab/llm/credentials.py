"""Secrets in texts, and multipart credentials: weak candidates count only where
complementary parts stand in the same scope, a block of lines."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, in_batches

# The base patterns, with the group that is measured and its least
# number of characters.
BASE = (
    (
        "assign",
        r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: Weak parts: who a secret may belong to, an opaque string as secrets look like, of
#: any length, and where it may be used.
WEAK = (
    (
        "identity",
        r"((?ai:user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|access_?key_?id))"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]+)",
    ),
    ("secret", r"[A-Za-z0-9+/_-]{20,}={0,2}"),
    ("endpoint", r"[a-z][a-z0-9+.-]*://[^\s\"'<>]+"),
)
KINDS = tuple(x[0] for x in (*BASE, *WEAK))
#: What each kind is in a credential. A weak part is reported where the scope holds
#: one of each set of roles that complement its own.
ROLES = {
    "access": "identifier",
    "identity": "identifier",
    "assign": "secret",
    "hex": "secret",
    "secret": "secret",
    "endpoint": "endpoint",
}
COMPLEMENTS = {
    "identifier": {"secret"},
    "secret": {"identifier", "endpoint"},
    "endpoint": {"secret"},
}

Part = tuple[int, int, int]  # start, place of the kind in KINDS, end

_BASE = [(k, re.compile(p), group, least) for k, (_, p, group, least) in enumerate(BASE)]
_WEAK = [(len(BASE) + k, re.compile(p)) for k, (_, p) in enumerate(WEAK)]
_BLANK_LINE = re.compile(r"\n[\x20\t\r]*(?=\n)")
_LONG_HEX = re.compile(r"[0-9a-f]{32}")
_SIGN = re.compile(r"[:=]")


def base_parts(text: str) -> list[Part]:
    """Leftmost, non-overlapping matches of each base kind; those whose measured
    group is too short are dropped after matching."""
    parts = []
    for kind, pattern, group, least in _BASE:
        if kind == 0 and not _SIGN.search(text):
            continue
        if kind == 1 and "AKIA" not in text:
            continue
        if kind == 2 and not _LONG_HEX.search(text):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                parts.append((m.start(), kind, m.end()))
    return sorted(parts)


def _mixed(value: str) -> bool:
    """Whether a string looks drawn rather than written: digits, capitals and
    small letters together."""
    return (
        any(c.isdigit() for c in value)
        and any(c.isupper() for c in value)
        and any(c.islower() for c in value)
    )


def weak_parts(text: str, base: list[Part]) -> list[Part]:
    """Weak candidates that overlap no base part; opaque strings inside an endpoint
    are a piece of it."""
    found: dict[str, list[Part]] = {}
    for kind, pattern in _WEAK:
        own = [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
        if KINDS[kind] == "secret":
            own = [p for p in own if _mixed(text[p[0] : p[2]])]
        found[KINDS[kind]] = [p for p, met in _overlaps(own, base) if not met]
    known = found["endpoint"]
    found["secret"] = [p for p, met in _overlaps(found["secret"], known) if not met]
    known = sorted(found["secret"] + known)
    found["identity"] = [p for p, met in _overlaps(found["identity"], known) if not met]
    return sorted(p for own in found.values() for p in own)


def _overlaps(
    parts: list[Part], others: list[Part]
) -> Iterator[tuple[Part, list[Part]]]:
    """Interval join by a sweep: for each part the others that overlap it. Both lists
    are sorted by start."""
    active: list[Part] = []
    following = 0
    for part in parts:
        while following < len(others) and others[following][0] < part[2]:
            active.append(others[following])
            following += 1
        active = [x for x in active if x[2] > part[0]]
        yield part, [x for x in active if x[0] < part[2]]


def scopes(text: str) -> list[Part]:
    """Blocks of lines without a blank line between them, as intervals."""
    ends = [m.start() for m in _BLANK_LINE.finditer(text)]
    return [(s, -1, e) for s, e in zip([0, *ends], [*ends, len(text) + 1], strict=True)]


def linked(text: str, base: list[Part]) -> list[Part]:
    """Weak parts that complement others anywhere in their scope: an opaque string
    beside an identifier or an endpoint, these beside a secret."""
    opaque = any(_mixed(m[0]) for m in _WEAK[1][1].finditer(text))
    if not opaque and not any(ROLES[KINDS[k]] == "secret" for _, k, _ in base):
        return []  # neither identifiers nor endpoints mean anything alone
    weak = weak_parts(text, base)
    if not weak:
        return []
    reported = []
    # A part lies in the scope where it begins: no kind crosses a blank line.
    for _, inside in _overlaps(scopes(text), sorted(base + weak)):
        roles = {ROLES[KINDS[k]] for _, k, _ in inside}
        for part in inside:
            needs = COMPLEMENTS[ROLES[KINDS[part[1]]]]
            if part[1] >= len(BASE) and needs & roles:
                reported.append(part)
    return reported


def written(parts: list[Part]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(parts))


def scan(df: DataFrame) -> DataFrame:
    """Per row ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``
    (of the base spans as kind:start:end) and ``spans`` (base and linked spans), in
    code points, ends exclusive, by start, then kind.

    Every whole text is read; nothing leaves its row, so repeated and null
    ``doc_id`` are passed on and an empty table gives an empty result. Null and
    empty texts have no spans.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                base = base_parts(text)
                for kind, column in enumerate(counts):
                    column.append(sum(p[1] == kind for p in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + linked(text, base)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                ],
                ["doc_id", *[f"n_{b[0]}" for b in BASE], "base_sha256", "spans"],
            )

    schema = (
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
        "base_sha256 string, spans string"
    )
    return in_batches(documents(df), work, schema)
