"""Training sequences of related documents: for each seed, a sharded BM25 index
returns unused neighbours, which greedily fill the seed's window.

Whole windows of a long document are sequences of their own. What is left of each
document, less than a window, is dealt out by a sketch of its tokens, so that similar
documents meet; a shard is indexed in memory, with document frequencies and lengths of
the whole corpus, and packed until nothing of it is left.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from types import ModuleType
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import byte_letters
from .common import documents, in_batches

WINDOW, END = 2048, 1
#: Documents of one shard of the index, and of a partition that is packed.
SHARD_DOCS, PARTITION_DOCS = 2048, 8192
#: A seed asks with so many of its rarest tokens, and looks at so many answers.
QUERY_TOKENS, ANSWERS = 48, 256
#: The usual constants of BM25.
SATURATION, LENGTH_SHARE = 1.2, 0.75
#: Words, and chunks of texts that aren't plain, kept with their ids in a Python
#: worker, some 180 MB; beyond, the memory starts anew.
KNOWN_WORDS, KNOWN_CHUNKS = 750_000, 100_000
#: Text of these characters only is cut and lower-cased here: their letters and case
#: are the same in every Unicode version, none is composed. ``<|`` begins the
#: vocabulary's special tokens.
_PLAIN = re.compile("[\\t\\n\\r -~¡-±´-¸º»¿À-įı-ſ‐-‧€]*")
_SPECIAL = "<|"
_LETTERS = "a-zªµºß-öø-įı-ſ"
# How the vocabulary cuts lower-case text into words.
_WORDS = re.compile(
    rf"[{_LETTERS}]+|[^{_LETTERS}0-9\s'][^{_LETTERS}0-9\s]*"
    rf"|'(?:s|t|re|ve|m|ll|d)|[0-9]|'[^{_LETTERS}0-9\s]*"
)
#: Lower-case prose: letters, and these signs.
_SIGNS = ".,;:!?"
_PROSE = re.compile(rf"[{_LETTERS}{_SIGNS} \n]*")


def _said(text: str) -> list[str]:
    """The words of a plain lower-case text. In prose whose signs all stand before a
    blank, blanks part the words once one is put before each sign."""
    if _PROSE.fullmatch(text):
        ends = f"{text}\n"
        held = [(x, n) for x in _SIGNS if (n := text.count(x))]
        if all([n == ends.count(f"{x} ") + ends.count(f"{x}\n") for x, n in held]):
            for sign, _ in held:
                text = text.replace(sign, f" {sign}")
            return text.split()
    return _WORDS.findall(text)


def _is_plain(text: str) -> bool:
    return _SPECIAL not in text and _PLAIN.fullmatch(text) is not None


class _Memory(dict):
    """Makes what it doesn't hold."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        found = self[text] = self.make(text)
        return found


class Chunks:
    """Ids of texts by a ``tokenizer.json`` of lower-case words, as the library gives
    them. Words never cross a blank: plain texts are cut into words here, and each word
    is encoded once and remembered. Of other texts the chunks between blanks are
    remembered: plain ones by their words, others by the library as they are."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind, self.code = ("<u2", "H") if size <= 1 << 16 else ("<u4", "I")
        self.letters = byte_letters()
        self.words, self.chunks = _Memory(self._word), _Memory(self._chunk)

    def _word(self, word: str) -> bytes:
        spelt = (
            word
            if word.isascii()
            else "".join([self.letters[b] for b in word.encode()])
        )
        found = [t.id for t in self.library.model.tokenize(spelt)]
        return array(self.code, found).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if _is_plain(chunk):
            return self._plain(chunk)
        found = self.library.encode(chunk, add_special_tokens=False).ids
        return array(self.code, found).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _said(text.lower())))

    def ids(self, text: str) -> np.ndarray:
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        if len(self.chunks) > KNOWN_CHUNKS:
            self.chunks.clear()
        if _is_plain(text):
            found = self._plain(text)
        else:
            chunks = text.replace("\n", " ").split(" ")
            found = b"".join(map(self.chunks.__getitem__, chunks))
        return np.frombuffer(found, self.kind)


def _reused(spec: str) -> Chunks:
    """What this Python worker has learned in earlier tasks, where it had any."""
    name = "_pairlab_known_chunks"
    known = sys.modules.setdefault(name, ModuleType(name)).__dict__
    key = hash(spec)
    if key not in known:
        known[key] = Chunks(spec)
    return known[key]


def _sketches(distinct: list[np.ndarray]) -> list[int]:
    """Of each document two minima of hashes of its tokens: similar documents often
    share the first."""
    starts = np.cumsum([0, *[len(x) for x in distinct[:-1]]])
    x = np.concatenate(distinct).astype(np.uint64) + np.uint64(1)
    x *= np.uint64(0x9E3779B97F4A7C15)
    first = np.minimum.reduceat(x >> np.uint64(33), starts)
    x *= np.uint64(0xD6E8FEB86659FD93)
    second = np.minimum.reduceat(x >> np.uint64(32), starts)
    return (first << np.uint64(32) | second).tolist()


def _crc(ids: np.ndarray) -> int:
    return crc32(ids.astype("<u4").tobytes())


def tokenized(df: DataFrame, path: str, window: int, end: int) -> DataFrame:
    """A row per document: ``doc_id``, ``doc_tokens`` (with ``end``), ``crcs`` of its
    whole windows, the ``rest`` of its ids and their ``sketch``. And rows without a
    text's columns, with ``df``: how many documents of a task hold each id."""
    with open(path, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id bigint, doc_tokens bigint, crcs binary, rest binary, "
    schema += "sketch bigint, df binary"
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, held = _reused(spec.value), np.zeros(0, np.int64)
        kind = np.dtype(chunks.kind)
        for batch in batches:
            rows, own = [], []
            texts = batch.column("text").to_pylist()
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts, strict=True):
                ids = np.append(chunks.ids(text), np.array([end], kind))
                own.append(np.unique(ids))
                whole = len(ids) // window
                crcs = [_crc(ids[k * window :][:window]) for k in range(whole)]
                rest = ids[whole * window :]
                rows.append(
                    (
                        doc_id,
                        len(ids),
                        np.array(crcs, "<u4").tobytes(),
                        rest.tobytes(),
                    )
                )
            if rows:
                sketches = _sketches(own)
                rows = [(*r, s, None) for r, s in zip(rows, sketches, strict=True)]
                counts = np.bincount(np.concatenate(own))
                if len(counts) > len(held):
                    held = np.append(held, np.zeros(len(counts) - len(held), np.int64))
                held[: len(counts)] += counts
                yield _batch(rows, names, types)
        if len(held):
            made = (None, None, None, None, None, held.astype("<u4").tobytes())
            yield _batch([made], names, types)

    return in_batches(documents(df), work, schema)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


@dataclass
class Statistics:
    """Of the whole corpus: weight of each id by how many documents hold it, and the
    mean length of what is packed."""

    weights: np.ndarray
    mean: float


def statistics(rows: DataFrame, size: int, window: int) -> Statistics:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column("df"):
                counts = np.frombuffer(data.as_py(), "<u4")
                total[: len(counts)] += counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = rows.where("df IS NOT NULL").select("df").mapInArrow(work, "id bigint, n bigint")
    counts = np.zeros(size, np.int64)
    # At most one row for each id of the vocabulary.
    for i, n in found.groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    docs, mean = (
        rows.where("df IS NULL")
        .agg(F.count("*"), F.avg(F.col("doc_tokens") % window))
        .head()
    )
    weights = np.log1p((docs - counts + 0.5) / (counts + 0.5))
    return Statistics(weights, max(1.0, mean or 0.0))


class Index:
    """BM25 over a shard's documents: for each id the documents that hold it, with
    their share of the score."""

    def __init__(self, texts: list[np.ndarray], known: Statistics) -> None:
        self.size = len(texts)
        ids, docs, times = [], [], []
        for k, text in enumerate(texts):
            own, n = np.unique(text, return_counts=True)
            ids.append(own)
            docs.append(np.full(len(own), k))
            times.append(n)
        self.texts, self.weights = ids, known.weights
        lengths = np.array([len(t) for t in texts])
        flat, doc = np.concatenate(ids).astype(np.int64), np.concatenate(docs)
        n = np.concatenate(times).astype(float)
        share = 1 - LENGTH_SHARE + LENGTH_SHARE * lengths[doc] / known.mean
        value = known.weights[flat] * n * (SATURATION + 1) / (n + SATURATION * share)
        order = np.argsort(flat, kind="stable")
        self.docs, self.values = doc[order], value[order]
        self.starts = np.searchsorted(flat[order], np.arange(len(known.weights) + 1))

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Of all documents, for the rarest of these distinct ids."""
        ids = ids.astype(np.int64)
        if len(ids) > QUERY_TOKENS:
            rare = np.argpartition(-self.weights[ids], QUERY_TOKENS)[:QUERY_TOKENS]
            ids = ids[rare]
        starts, ends = self.starts[ids], self.starts[ids + 1]
        sizes = ends - starts
        at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.docs[at], self.values[at], minlength=self.size)


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, length: int) -> tuple[Piece, Piece]:
        rest = self.start + length
        return (
            Piece(self.doc_id, self.start, self.ids[:length], self.doc_tokens),
            Piece(self.doc_id, rest, self.ids[length:], self.doc_tokens),
        )


@dataclass
class Packer:
    """Fills windows from one shard after another; ``rows`` are the pieces placed."""

    known: Statistics
    window: int
    next_id: int
    pieces: list[Piece] = field(default_factory=list)
    room: int = 0
    rows: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.room = self.window

    def whole(self, doc_id: int | None, doc_tokens: int, crcs: np.ndarray) -> None:
        """The whole windows of a long document, each a sequence."""
        for k, crc in enumerate(crcs.tolist()):
            start = k * self.window
            row = (doc_id, start, self.window, crc, doc_tokens, self.next_id, 0)
            self.rows.append(row)
            self.next_id += 1

    def _close(self) -> None:
        offset = 0
        for piece in self.pieces:
            n = len(piece.ids)
            place = (piece.doc_tokens, self.next_id, offset)
            self.rows.append((piece.doc_id, piece.start, n, _crc(piece.ids), *place))
            offset += n
        self.next_id += bool(self.pieces)
        self.pieces, self.room = [], self.window

    def _add(self, piece: Piece) -> Piece | None:
        """Place a piece; what doesn't fit is returned."""
        rest = None
        if len(piece.ids) > self.room:
            piece, rest = piece.cut(self.room)
        self.pieces.append(piece)
        self.room -= len(piece.ids)
        if not self.room:
            self._close()
        return rest

    def pack(self, shard: list[Piece]) -> None:
        """Place all pieces of a shard. A window that is begun stays open for the
        next one."""
        if not shard:
            return
        index = Index([p.ids for p in shard], self.known)
        sizes = np.array([len(p.ids) for p in shard])
        unused, seed, left = np.ones(len(shard), bool), 0, None
        while left is not None or unused.any():
            if left is not None:
                asked = np.unique(left.ids)
                left = self._add(left)
            else:
                while not unused[seed]:
                    seed += 1
                unused[seed] = False
                asked = index.texts[seed]
                left = self._add(shard[seed])
            if left is not None or self.room == self.window:
                continue
            scores = np.where(unused, index.scores(asked), -1.0)
            best = np.arange(len(scores))
            if len(best) > ANSWERS:
                best = np.argpartition(-scores, ANSWERS)[:ANSWERS]
            best = best[np.lexsort((best, -scores[best]))]
            best = best[scores[best] >= 0]
            for k in best.tolist():
                if sizes[k] <= self.room:
                    unused[k] = False
                    self._add(shard[k])
                    if self.room == self.window:
                        break
            else:
                # Nothing fits any more: the best one left is cut.
                rest = best[unused[best]]
                if len(rest):
                    unused[rest[0]] = False
                    left = self._add(shard[rest[0]])

    def finish(self) -> None:
        """Cut an open window into sequences of powers of two, which need no padding."""
        pieces, filled = self.pieces, self.window - self.room
        for power in reversed(range(self.window.bit_length())):
            if not filled >> power & 1:
                continue
            self.pieces, room = [], 1 << power
            while room:
                piece = pieces.pop(0)
                if len(piece.ids) > room:
                    piece, rest = piece.cut(room)
                    pieces.insert(0, rest)
                self.pieces.append(piece)
                room -= len(piece.ids)
            self._close()


def pack(df: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pack the documents of ``df`` into sequences of ``window`` tokens, a power of
    two: one row per piece with ``doc_id``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id`` and ``offset``.

    Every id of every row lies in one piece. Only the last window of each packed
    partition isn't full; it is cut into sequences of powers of two, so nothing needs
    padding. Null and empty texts are the id ``end`` alone. Repeated rows and rows
    without a ``doc_id`` are packed each. Where no unused document of a shard shares a
    rare token with the seed, the next ones follow. Other columns are not read.
    """
    if window & (window - 1):
        raise ValueError(f"Not a power of two: {window}")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    size = library.get_vocab_size(with_added_tokens=True)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    rows = materialize(tokenized(df, path, window, end))
    known = rows.sparkSession.sparkContext.broadcast(statistics(rows, size, window))
    docs = rows.where("df IS NULL").drop("df")
    spark = rows.sparkSession
    partitions = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-docs.count() // PARTITION_DOCS),
    )
    order = ["sketch", "doc_id", "rest", "crcs"]
    dealt = docs.repartitionByRange(partitions, "sketch", F.xxhash64("rest", "doc_id"))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, "
    schema += "doc_tokens bigint, sequence_id bigint, offset bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        packer, shard = Packer(known.value, window, first), []

        def placed() -> Iterator[pa.RecordBatch]:
            rows, packer.rows = packer.rows, []
            if rows:
                yield _batch(rows, names, [pa.int64()] * len(names))

        for batch in batches:
            for doc_id, tokens, crcs, rest in zip(
                *[batch[c].to_pylist() for c in ("doc_id", "doc_tokens", "crcs", "rest")],
                strict=True,
            ):
                packer.whole(doc_id, tokens, np.frombuffer(crcs, "<u4"))
                ids = np.frombuffer(rest, kind)
                if len(ids):
                    shard.append(Piece(doc_id, tokens - len(ids), ids, tokens))
                if len(shard) >= SHARD_DOCS:
                    packer.pack(shard)
                    shard = []
            yield from placed()
        packer.pack(shard)
        packer.finish()
        yield from placed()

    return in_batches(dealt.sortWithinPartitions(*order), work, schema)
