"""Toxic documents by a subsequence string kernel: a support vector machine over
Nyström landmarks, trained on sentences of labelled documents.

The kernel counts common subsequences of three characters, each weighted by a decay
for every character skipped, so that ``idxiot``, ``i.d.i.o.t`` or ``id iot`` still
resemble ``idiot``. A sentence is judged by its most suspicious piece, a document by
its most suspicious sentence; pieces are the words and all pairs of neighbours, the
blank between them a character to skip. The decision is a sum over landmarks of kernel values, hence
linear in the weighted subsequences; it is folded into one weight for each of
``CLASSES`` ** 3 subsequences, which gives the same numbers at a bounded cost for
each word.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, in_batches, pick

#: Labelled documents of each class that a model is fitted on, chosen by a hash of
#: their id. Everything is scored, whatever their number.
DOCS_PER_CLASS = 3_000
#: Landmarks; clean words that a round adds, the most frequent and the most toxic by
#: the machine of the round before; and rounds. Suspicious words are all kept: the
#: bounded number of documents bounds them, too.
LANDMARKS, CLEAN_WORDS, ROUNDS = 256, 2_500, 2
#: Folds of doc ids by crc32; fold 0 is never learned from.
FOLDS = 5
#: Decay for a skipped character, and the widest subsequence.
DECAY, SPAN = 0.6, 8
#: Letters a to z are classes of their own, other characters share the rest.
CLASSES = 64
#: Longer words are cut into overlapping pieces of this length.
PIECE = 20
#: Words kept with their margins in a Python worker.
KNOWN_WORDS = 300_000
#: Words of a run of text whose pairs are weighed together.
RUN = 4096
#: Log odds, less so many standard errors, from which a word or pair makes a
#: sentence toxic. Many are tried, so few may get there by chance.
SUSPICIOUS, ERRORS = 0.5, 3

_SPACED = re.compile(r"(?<!\S)\w(?: \w){3,}(?!\S)")
_JUNK = re.compile(r"[\W_]+")
_SIGNS = frozenset(",.;:!?")
# Digits and signs written for letters.
_WRITTEN = str.maketrans("013457@$", "oieastas")


def held_out(doc_id: Column) -> Column:
    """Fold 0 of crc32 of the id as text; rows without an id belong to it."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(True))


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the subsequences of a word of this length, and their decay."""
    i, j, k = (
        x.ravel() for x in np.meshgrid(*[np.arange(length)] * 3, indexing="ij")
    )
    held = (i < j) & (j < k) & (k - i < SPAN)
    places = np.stack([i[held], j[held], k[held]])
    decay = DECAY ** (places[2] - places[0] - 2.0)
    return places, decay / np.sqrt((decay**2).sum())


@cache
def _class_of() -> np.ndarray:
    """By code point."""
    points = np.arange(sys.maxunicode + 1)
    letters = (points >= 97) & (points <= 122)
    return np.where(letters, points - 97, 26 + points % (CLASSES - 26)).astype(np.uint8)


def _classes(words: list[str], length: int) -> np.ndarray:
    points = np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(-1, length)
    return _class_of()[points].astype(np.int64)


def by_length(words: Iterable[str]) -> dict[int, list[str]]:
    """Words between marks of their start and end, so that stems and endings count
    as such; by length."""
    groups: dict[int, list[str]] = {}
    for word in words:
        marked = f"^{word}$"
        groups.setdefault(len(marked), []).append(marked)
    return groups


def subsequences(words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all subsequences of marked words of one length, and their decay."""
    places, decay = _triples(length)
    c = _classes(words, length)
    codes = (c[:, places[0]] * CLASSES + c[:, places[1]]) * CLASSES + c[:, places[2]]
    return codes, decay


def features(word: str) -> np.ndarray:
    """A word as a point of the kernel's feature space, of length about one."""
    point = np.zeros(CLASSES**3)
    codes, decay = subsequences([f"^{word}$"], len(word) + 2)
    np.add.at(point, codes[0], decay)
    return point


def core(word: str) -> str:
    """The letters of a word that is made of letters, and perhaps a sign behind them;
    of others nothing."""
    if word.isalpha():
        return word
    return word[:-1] if word[-1:] in _SIGNS and word[:-1].isalpha() else ""


def views(word: str) -> list[str]:
    """What is scored of a word between blanks: its letters and digits joined, and
    their runs where there are several; the same with digits read as letters;
    long ones in overlapping pieces. Of a pair, its words'
    letters and digits with a blank between them and without."""
    if letters := core(word):
        found = [letters]
    elif " " in word:
        runs = [_JUNK.sub("", x) for x in word.split(" ")]
        found = [" ".join(runs), "".join(runs)] if all(runs) else []
    else:
        runs = [x for x in _JUNK.split(word) if x]
        found = ["".join(runs), *(runs if len(runs) > 1 else [])]
        read = _JUNK.sub("", word.translate(_WRITTEN))
        if read != found[0] and sum(map(str.isalpha, word)) >= 3:
            found.append(read)
    cut = []
    for x in found:
        if len(x) <= PIECE:
            cut.append(x)
        else:
            steps = range(0, len(x) - PIECE // 2, PIECE // 2)
            cut += [x[s : s + PIECE] for s in steps]
    return cut


def text_words(text: str) -> set[str]:
    """Distinct lower-case words, pairs of neighbours within a sentence, and words
    spelt with blanks between letters."""
    text = text.lower()
    said = text.split()
    found = set(said)
    found.update([f"{a} {b}" for a, b in pairwise(said) if a[-1] not in ".!?"])
    found.update(m[0].replace(" ", "") for m in _SPACED.finditer(text))
    return found


@dataclass
class Model:
    """Weight of each subsequence, bias, and the line from margins to log odds.
    Without weights every text has the score ``prior``."""

    weights: np.ndarray | None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    prior: float = 0.0

    def view_margins(self, spelt: list[str]) -> np.ndarray:
        """Margins of views of words, each between marks of its own."""
        found = []
        for start in range(0, len(spelt), RUN):
            some = spelt[start : start + RUN]
            sizes = np.array([len(v) for v in some])
            windows = Windows(self, "".join(some))
            found.append(windows.margins(np.cumsum(sizes) - sizes, sizes))
        return np.concatenate(found or [np.zeros(0)])

    def margins_of(self, words: list[str], cores: list[str]) -> np.ndarray:
        """The highest margin of each word's views; the bias where it has none. A short
        core is its word's only view."""
        more = {
            k: views(words[k])
            for k, c in enumerate(cores)
            if not c or len(c) > PIECE
        }
        spelt = [c if k not in more else "" for k, c in enumerate(cores)]
        places = dict.fromkeys(chain(spelt, *more.values()))
        places.pop("", None)
        known = self.view_margins(list(places))
        places.update(zip(places, range(len(places)), strict=True))
        # A word without weights inside still has the bias.
        known = np.maximum(np.append(known, self.bias), self.bias)
        places[""] = len(known) - 1
        look = places.__getitem__
        found = known[np.fromiter(map(look, spelt), np.int64, len(spelt))]
        for k, own in more.items():
            if own:
                found[k] = known[list(map(look, own))].max()
        return found

    def word_margins(self, words: Iterable[str]) -> dict[str, float]:
        """By distinct word."""
        words = list(dict.fromkeys(words))
        found = self.margins_of(words, [core(w) for w in words])
        return dict(zip(words, found.tolist(), strict=True))

    def scores(self, margins: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(margins), self.prior)
        odds = np.clip(self.slope * margins + self.offset, -30, 30)
        return 1 / (1 + np.exp(-odds))


def _norms(longest: int) -> np.ndarray:
    """By number of characters, marks included: the length of the decays of all
    subsequences; :func:`_triples` divides by it."""
    counts = np.zeros(longest + 1)
    for n in range(3, longest + 1):
        held = range(2, min(SPAN, n))
        counts[n] = sum((n - k) * (k - 1) * DECAY ** (2 * (k - 2)) for k in held)
    return np.sqrt(np.maximum(counts, 1e-300))


class Windows:
    """Margins of many overlapping pieces of one run of characters.

    The subsequences that start at a character and end ``k`` after it are weighed
    once; running sums over the characters, one for each ``k``, then give those inside
    any window. Only the marks at a window's two ends are weighed for each window.
    """

    def __init__(self, model: Model, letters: str) -> None:
        self.model, n = model, len(letters)
        codes = np.full(n + 2 * SPAN, _classes(["^"], 1)[0, 0])
        if n:
            codes[SPAN : SPAN + n] = _classes([letters], n)[0]
        self.codes = codes
        first, middle = codes * CLASSES**2, codes * CLASSES
        self.sums = []
        (ends, at), (found, part) = np.empty((2, n), np.int64), np.empty((2, n))
        for k in range(2, SPAN):
            np.add(first[SPAN : SPAN + n], codes[SPAN + k : SPAN + n + k], out=ends)
            for j in range(1, k):
                np.add(ends, middle[SPAN + j : SPAN + n + j], out=at)
                model.weights.take(at, out=part if j > 1 else found, mode="clip")
                if j > 1:
                    found += part
            found *= DECAY ** (k - 2)
            sums = np.zeros(n + 1)
            np.cumsum(found, out=sums[1:])
            self.sums.append(sums)
        mark, end = (_classes([c], 1)[0, 0] for c in "^$")
        cube = model.weights.reshape(CLASSES, CLASSES, CLASSES)
        self.opening = np.ascontiguousarray(cube[mark]).ravel()
        self.closing = np.ascontiguousarray(cube[:, :, end]).ravel()
        self.both = np.ascontiguousarray(cube[mark, :, end])

    def margins(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of the windows of ``sizes`` characters, one at least, from ``starts``."""
        ends, shortest = starts + sizes, int(sizes.min(initial=SPAN))
        total = np.zeros(len(starts))
        for k, sums in enumerate(self.sums, 2):
            last = np.maximum(ends - k, starts)
            total += sums.take(last) - sums.take(starts)
        begin, close = SPAN - 1 + starts, SPAN + ends
        ahead = [self.codes.take(begin + j) for j in range(SPAN)]
        back = [self.codes.take(close - j) for j in range(SPAN)]
        upper = [x * CLASSES for x in ahead], [x * CLASSES for x in back]
        at, part = np.empty(len(starts), np.int64), np.empty(len(starts))
        for k in range(2, SPAN):
            # k characters from the mark to the subsequence's other end.
            own = np.zeros(len(starts))
            for j in range(1, k):
                np.add(upper[0][j], ahead[k], out=at)
                own += self.opening.take(at, out=part, mode="clip")
                np.add(upper[1][k], back[k - j], out=at)
                own += self.closing.take(at, out=part, mode="clip")
            own *= DECAY ** (k - 2)
            if shortest < k:
                own[sizes < k] = 0.0
            total += own
            short = np.flatnonzero(sizes == k - 1) if shortest < k else ()
            for j in range(1, k) if len(short) else ():
                total[short] += self.both[ahead[j][short]] * DECAY ** (k - 2)
        longest = int(sizes.max(initial=0)) + 2
        return total / _norms(longest)[sizes + 2] + self.model.bias


def _pieces(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows, long ones cut as in :func:`views`, and which each came from."""
    steps = np.where(sizes <= PIECE, 1, -(-(sizes - PIECE // 2) // (PIECE // 2)))
    whole = np.repeat(np.arange(len(sizes)), steps)
    step = np.arange(len(whole)) - np.repeat(np.cumsum(steps) - steps, steps)
    at = step * (PIECE // 2)
    return starts[whole] + at, np.minimum(sizes[whole] - at, PIECE), whole


def _raise_to(best: np.ndarray, sorted_places: np.ndarray, values: np.ndarray) -> None:
    """Raise ``best`` at each place to the largest of its values."""
    if len(values):
        new = sorted_places[1:] != sorted_places[:-1]
        begins = np.flatnonzero(np.append(True, new))
        at = sorted_places[begins]
        best[at] = np.maximum(best[at], np.maximum.reduceat(values, begins))


class Scorer:
    """Margins of texts, with the words met before. Pairs of neighbours hardly repeat
    and are read from the running text."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.letters = np.zeros(0, object)
        self.known = np.zeros(0)
        self.sizes, self.goes_on = np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, new: set[str]) -> None:
        """Of each word its margin, its letters and digits, and whether the sentence
        goes on behind it."""
        words = list(new)
        cores = [core(w) for w in words]
        clean = [c or _JUNK.sub("", w) for c, w in zip(cores, words, strict=True)]
        self.letters = np.append(self.letters, np.array(clean, object))
        count = len(self.places)
        self.places.update(zip(words, range(count, count + len(clean)), strict=True))
        goes_on = [w[-1] not in ".!?" for w in words]
        self.known = np.append(self.known, self.model.margins_of(words, cores))
        self.sizes = np.append(self.sizes, np.array([len(c) for c in clean], np.int64))
        self.goes_on = np.append(self.goes_on, np.array(goes_on, bool))

    def _pair_margins(
        self, clean: list[str], sizes: np.ndarray, first: np.ndarray
    ) -> np.ndarray:
        """The margin of each word ``first`` with the next one, with a blank and
        without, of words by their letters and digits."""
        best = np.full(len(first), self.model.bias)
        for blank in (1, 0):
            windows = Windows(self.model, (" " * blank).join(clean))
            starts = np.cumsum(sizes + blank) - sizes - blank
            own = sizes[first] + sizes[first + 1] + blank
            at, size, pair = _pieces(starts[first], own)
            begins = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            found = np.maximum.reduceat(windows.margins(at, size), begins)
            best = np.maximum(best, found)
        return best

    def margins(self, texts: list[str]) -> np.ndarray:
        best = np.full(len(texts), self.model.bias)
        if self.model.weights is None:
            return np.zeros(len(texts))
        if len(self.places) > KNOWN_WORDS:
            self._forget()
        lowered = [t.lower() for t in texts]
        said = [t.split() for t in lowered]
        spelt = [
            {m[0].replace(" ", "") for m in _SPACED.finditer(t)} for t in lowered
        ]
        words = list(chain.from_iterable(said))
        text = np.repeat(np.arange(len(said)), [len(w) for w in said])
        if new := set(words).union(*spelt).difference(self.places):
            self._learn(new)
        at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        _raise_to(best, text, self.known[at])
        for k, own in enumerate(spelt):
            for word in own:
                best[k] = max(best[k], self.known[self.places[word]])
        sizes = self.sizes[at]
        pair = self.goes_on[at] & (sizes > 0)
        pair[:-1] &= (sizes[1:] > 0) & (text[1:] == text[:-1])
        pair[-1:] = False
        for start in range(0, len(words), RUN):
            some = np.flatnonzero(pair[start : start + RUN])
            if len(some):
                end = start + RUN + 1
                clean = self.letters[at[start:end]].tolist()
                margins = self._pair_margins(clean, sizes[start:end], some)
                _raise_to(best, text[start + some], margins)
        return best


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic line, by Newton steps with a small penalty."""
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-2 * w
        curve = design.T @ (design * (weight * p * (1 - p))[:, None])
        step = np.linalg.solve(curve + 1e-2 * np.eye(2), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope of the logistic line through the margins, and the margin of score one
    half: where F1 of the toxic class is largest, in the middle of the widest gap
    among equally good places."""
    order = np.argsort(-x, kind="stable")
    x, y, weight = x[order], y[order], weight[order]
    hits = np.cumsum(weight * y)
    f1 = 2 * hits / (np.cumsum(weight) + hits[-1])
    gaps = np.append(x[:-1] - x[1:], 0.0)
    f1 = np.where(gaps > 0, f1, -1.0)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(gaps[best])]
    slope, _ = _logistic(x, y, weight)
    return max(slope, 2.0), float(x[k] - gaps[k] / 2)


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0):
    """Linear support vector machine with squared hinge loss, by Newton steps over
    the rows inside the margin; the last coefficient is the bias."""
    design = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(design.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(100):
        own = design[active]
        scaled = own * (cost * weight[active])[:, None]
        w = np.linalg.solve(ridge + scaled.T @ own, scaled.T @ y[active])
        now = y * (design @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _landmarks(
    words: list[str], first: int, end: int, count: int, alike: float = 0.7
) -> tuple[list[int], np.ndarray]:
    """The first ``count`` of words ``first`` to ``end`` that aren't like an earlier
    one chosen, and the kernel's values between all words and these."""
    places: dict[str, list[int]] = {}
    for k, word in enumerate(words):
        places.setdefault(f"^{word}$", []).append(k)
    groups = []
    for length, some in by_length(dict.fromkeys(words)).items():
        codes, decay = subsequences(some, length)
        groups.append((codes, decay, [places[w] for w in some]))
    chosen, columns = [], []
    best = np.full(len(words), -np.inf)
    for k in range(first, end):
        if best[k] > alike:
            continue
        point, column = features(words[k]), np.zeros(len(words))
        for codes, decay, at in groups:
            for value, own in zip((point[codes] @ decay).tolist(), at, strict=True):
                column[own] = value
        chosen.append(k)
        columns.append(column)
        best = np.maximum(best, column)
        if len(chosen) == count:
            break
    return chosen, np.array(columns).reshape(len(chosen), len(words)).T


def disguised(words: list[tuple[str, int]], count: int) -> list[tuple[str, int]]:
    """The most frequent words with a character inserted at each inner place, also
    a blank."""
    made = []
    for word, n in words[:count]:
        inner = range(1, len(word)) if 4 <= len(word) <= PIECE else ()
        for place in inner:
            # A blank that cuts off one letter alone is left to the other signs.
            cut = " " if " " not in word and 2 <= place <= len(word) - 2 else ""
            for other in filter(None, ("xzvj"[place % 4], cut)):
                made.append((word[:place] + other + word[place:], max(1, n // 20)))
    return made


def train(
    positive: list[tuple[str, int]], negative: list[tuple[str, int]]
) -> tuple[np.ndarray, float]:
    """Weights of subsequences and bias, from witnesses of toxic and of clean
    sentences with the number of sentences that each stands for."""
    words = [w for w, _ in positive] + [w for w, _ in negative]
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    counts = np.sqrt(np.array([n for _, n in positive + negative], float))
    weight = np.where(
        y > 0, counts / counts[y > 0].sum(), counts / counts[y < 0].sum()
    ) * len(y) / 2
    n = len(positive)
    toxic, toxic_values = _landmarks(words, 0, n, 2 * LANDMARKS // 3)
    clean, clean_values = _landmarks(words, n, len(words), LANDMARKS // 3)
    landmarks, kernel = toxic + clean, np.hstack([toxic_values, clean_values])
    values, vectors = np.linalg.eigh(kernel[landmarks])
    held = values > 1e-6 * values.max()
    root = vectors[:, held] / np.sqrt(values[held])
    beta, bias = _machine(kernel @ root, y, weight)
    dense = np.zeros(CLASSES**3)
    for share, k in zip((root @ beta).tolist(), landmarks, strict=True):
        dense += share * features(words[k])
    return dense, bias


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """Up to ``DOCS_PER_CLASS`` labelled documents of each class outside fold 0, as
    a written table (doc_id, text, toxic), and the number of labels by class. A
    document labelled twice is toxic if one label says so."""
    known = pick(labels, doc_id="doc_id", toxic="toxic").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("toxic").cast("int").alias("toxic"),
    )
    known = (
        known.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for toxic in (0, 1):
        own = known.where(F.col("toxic") == toxic)
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(DOCS_PER_CLASS)
        chosen = own if chosen is None else chosen.union(own)
    # At most two times DOCS_PER_CLASS ids.
    return materialize(documents(docs).join(F.broadcast(chosen), "doc_id")), sizes


def training_sentences(sample: DataFrame) -> DataFrame:
    """Distinct sentences of the sample with their documents' label, as a written
    table (said, toxic). Copies count once, and a sentence that a clean document
    holds too is clean."""
    cut = F.split(F.lower("text"), r"[.!?]+\s|\n")
    return materialize(
        sample.select(F.explode(cut).alias("said"), "toxic")
        .where(F.trim("said") != "")
        .groupBy("said")
        .agg(F.min("toxic").alias("toxic"))
    )


def _sentence_words(sentence: str) -> set[str]:
    found = set()
    for word in text_words(sentence):
        # A pair is learned with its blank only; joined, most hold another insult.
        own = views(word)[:1] if " " in word else views(word)
        found.update(v for v in own if len(v) >= 3)
    return found


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
    return zip(
        batch.column("said").to_pylist(), batch.column("toxic").to_pylist(), strict=True
    )


def _word_odds(sentences: DataFrame) -> DataFrame:
    """``word``, ``clean`` (sentences) and ``z``: log odds of the sentences that
    hold it to be toxic, less ``ERRORS`` standard errors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, toxic = [], []
            for sentence, label in _pairs(batch):
                own = _sentence_words(sentence)
                words += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(toxic, pa.int32())],
                ["word", "toxic"],
            )

    sizes = dict.fromkeys((0, 1), 0)
    sizes |= {
        r["toxic"]: r["count"] for r in sentences.groupBy("toxic").count().collect()
    }
    t, c = F.col("t") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (sizes[1] + 1 - F.col("t"))) - F.log(
        c / (sizes[0] + 1 - F.col("clean"))
    )
    return (
        in_batches(sentences, work, "word string, toxic int")
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("clean"))
        .select("word", "clean", (odds - ERRORS * F.sqrt(1 / t + 1 / c)).alias("z"))
    )


def _witnesses(
    sentences: DataFrame, odds: dict[str, float], least: float
) -> DataFrame:
    """For each clean sentence its most suspicious word, for each toxic one all
    words with odds of ``least``: (word, toxic, z)."""
    known = sentences.sparkSession.sparkContext.broadcast(odds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = known.value
        for batch in batches:
            rows: list[tuple[str, int, float]] = []
            for sentence, label in _pairs(batch):
                own = _sentence_words(sentence)
                if label:
                    rows += [(v, 1, z[v]) for v in own if z.get(v, 0.0) >= least]
                elif own:
                    best = max(own, key=lambda v: (z.get(v, 0.0), v))
                    rows.append((best, 0, z.get(best, 0.0)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.string()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.float64()),
                ],
                ["word", "toxic", "z"],
            )

    return in_batches(sentences, work, "word string, toxic int, z double")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents outside fold 0.

    Sentences inherit their document's label; of toxic documents only those with a
    word that is significantly more frequent in toxic sentences are learned from.
    The most frequent of these also count with a character inserted.
    Each machine then names the clean words it holds most toxic; they join the
    clean witnesses of the next one. Scores are calibrated on the
    documents' margins, weighted to the classes' shares in the labels. Fewer than two classes
    give a constant score. Nulls in ids, texts or labels are never learned from.
    """
    sample, sizes = training_rows(docs, labels)
    shown = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not shown.get(0) or not shown.get(1):
        return Model(None, prior=float(not sizes.get(0) and bool(sizes.get(1))))
    sentences = training_sentences(sample)
    words = materialize(_word_odds(sentences))
    odds = {r["word"]: r["z"] for r in words.where("z > 0").collect()}
    least = SUSPICIOUS
    # A pair with a suspicious word says no more than the word.
    odds = {
        w: z
        for w, z in odds.items()
        if " " not in w or all(odds.get(x, 0.0) < least for x in w.split(" "))
    }
    seen = _witnesses(sentences, odds, least).groupBy("word", "toxic").agg(
        F.count("*").alias("n"), F.max("z").alias("z")
    )
    seen = materialize(seen)
    most = (F.desc("n"), "word")
    positive = seen.where("toxic = 1").orderBy(*most).collect()
    negative = seen.where((F.col("toxic") == 0) & (F.col("z") < least))
    negative = negative.orderBy(*most).limit(CLEAN_WORDS // 2).collect()
    if not positive or not negative:
        return Model(None, prior=sizes.get(1, 0) / max(1, sum(sizes.values())))
    said = [(r["word"], r["n"]) for r in positive]
    clean = [(r["word"], r["n"]) for r in negative]
    said += disguised(said, LANDMARKS // 2)
    own, seen_clean = {w for w, _ in said}, {w for w, _ in clean}
    candidates = words.where((F.col("clean") > 0) & (F.col("z") < least))
    model = Model(*train(said, clean))
    for _ in range(ROUNDS):
        hard = scored_words(candidates, model).orderBy(F.desc("margin"), "word")
        # Clean pairs are also to stay clean when read without the blank.
        read = dict.fromkeys(
            v
            for r in hard.limit(CLEAN_WORDS).collect()
            for v in views(r["word"])
            if len(v) >= 3 and v not in own and v not in seen_clean
        )
        clean += [(v, 1) for v in read]
        seen_clean.update(read)
        model = Model(*train(said, clean))
    rows = scored(sample, model, ["toxic"], raw=True).select("toxic", "score").collect()
    x = np.array([r["score"] for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    share = {k: sizes[k] / sum(sizes.values()) / shown[k] for k in (0, 1)}
    weight = np.where(y > 0, share[1], share[0]) * len(y)
    model.slope, cut = _line(x, y, weight)
    model.offset = -model.slope * cut
    return model


def scored_words(words: DataFrame, model: Model) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = shared.value.word_margins(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(margins), pa.string()),
                    pa.array(list(margins.values()), pa.float64()),
                ],
                ["word", "margin"],
            )

    return words.select("word").mapInArrow(work, "word string, margin double")


def scored(
    df: DataFrame, model: Model, keep: list[str], raw: bool = False
) -> DataFrame:
    """Columns ``keep`` and the ``score`` (the margin if ``raw``) of ``text``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            margins = scorer.margins(batch.column("text").to_pylist())
            found = margins if raw else shared.value.scores(margins)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], pa.array(found, pa.float64())],
                [*keep, "score"],
            )

    types = dict(df.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keep], "score double"])
    return in_batches(df.select(*keep, "text"), work, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row. Empty and
    null texts have the score of a text without a suspicious word; repeated rows
    are scored each; an empty table gives an empty result."""
    rows = scored(documents(docs), model, ["doc_id"])
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(df: DataFrame, model: Model) -> DataFrame:
    """The rows of ``df``, with all columns, whose score is below one half."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(df.columns))]
    text = names[df.columns.index("text")]
    placed = df.toDF(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "").to_pylist()
            found = shared.value.scores(scorer.margins(texts))
            yield batch.filter(pa.array(found < 0.5))

    return in_batches(placed, work, placed.schema).toDF(*df.columns)
