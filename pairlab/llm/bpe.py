"""Byte-level BPE: encoding by a priority queue of merge ranks over a linked list
of symbols, decoding by concatenating vocabulary strings.

Gives the ids of the ``tokenizers`` library for a ``tokenizer.json`` of that kind
(byte-level words, merges in order of rank, special tokens matched in the raw
text first, none added).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, in_batches

# How byte-level vocabularies cut text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids in a Python worker; beyond, the memory starts anew.
KNOWN_WORDS = 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else
    the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in printable else spare))
        spare += byte not in printable
    return letters


@dataclass
class Vocabulary:
    """Ids of symbols, merges by pair of ids, and each id's bytes."""

    bytes_to_id: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]
    strings: dict[int, bytes]
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {
            i: bytes(byte_of[c] for c in s) for s, i in ids.items() if s not in special
        }
        strings |= {i: s.encode() for s, i in special.items()}
        merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault(
                (ids[left], ids[right]), (rank, ids[left + right])
            )
        return cls([ids[letter] for letter in letters], merges, strings, special)

    def encode_word(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost among equals, until none is
        left. Symbols form a doubly linked list over their first positions; queue
        entries whose symbols have changed since are skipped."""
        merges = self.merges
        symbols = [self.bytes_to_id[b] for b in word]
        size = len(symbols)
        before = list(range(-1, size - 1))
        after = list(range(1, size + 1))
        queue = []
        for i in range(size - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, whole, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= size or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = whole, -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                found = merges.get((whole, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1], whole, symbols[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], whole))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1], symbols[h], whole))
        return [s for s in symbols if s >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.strings[i] for i in ids])


class Encoder:
    """A vocabulary with the words it has met, each as (ids as text, number of
    ids, decoded bytes)."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.words = regex.compile(WORDS)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.cut = (
            regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
            if special
            else None
        )
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def pieces(self, text: str) -> list[tuple[str, int, bytes]]:
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        found = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                i = self.vocabulary.special[part]
                found.append((str(i), 1, self.vocabulary.strings[i]))
            elif part:
                found += self._plain(part)
        return found

    def _plain(self, text: str) -> list[tuple[str, int, bytes]]:
        known, vocabulary = self.known, self.vocabulary
        words = self.words.findall(text)
        if len(known) > KNOWN_WORDS:
            known.clear()
        for word in set(words).difference(known):
            ids = vocabulary.encode_word(word.encode())
            known[word] = ",".join(map(str, ids)), len(ids), vocabulary.decode(ids)
        return [known[w] for w in words]


def encode(
    df: DataFrame, path: str, ids: bool = False, digests: bool = True
) -> DataFrame:
    """``doc_id``, ``n_tokens`` (long), then on request ``ids`` (array of int) and
    ``ids_sha256``, ``decoded_sha256`` of every whole text.

    ``path`` is the vocabulary's file, read on the driver; the tables made of it
    are broadcast (their size is the vocabulary's, whatever the data). Null and
    empty texts have no tokens. Rows keep their number: repeated and null
    ``doc_id`` are passed on. Other columns are not read.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    schema = "doc_id bigint, n_tokens bigint"
    schema += ", ids array<int>" * ids
    schema += ", ids_sha256 string, decoded_sha256 string" * digests

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            counts, texts, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                found = encoder.pieces(text)
                joined = ",".join([x[0] for x in found])
                counts.append(sum([x[1] for x in found]))
                texts.append(joined)
                if digests:
                    whole = b"".join([x[2] for x in found])
                    text = whole.decode("utf-8", errors="replace")
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64())]
            names = ["doc_id", "n_tokens"]
            if ids:
                lists = [[int(x) for x in t.split(",")] if t else [] for t in texts]
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            if digests:
                made = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                columns += [pa.array(made, pa.string()), pa.array(decoded, pa.string())]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_batches(documents(df), work, schema)
