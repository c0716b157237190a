"""Brute-force twins of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text: str | None) -> frozenset:
    w = words(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def components(rows: list[tuple], percent: int = 80) -> list[tuple]:
    """(doc_id, size, component, links) of (doc_id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    degree = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 100 * common >= percent * union:
                up[root(a)] = root(b)
                degree[a] += 1
                degree[b] += 1
    least: dict[int, int] = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = root(k)
            least[r] = min(doc_id, least.get(r, doc_id))
    return [
        (rows[k][0], len(sets[k]), least.get(root(k)), degree[k])
        for k in range(len(rows))
    ]


def item_copies(docs: list[tuple], items: list[tuple], percent: int = 80) -> dict:
    """(doc_id, item_id): (similarity, position), over all item-sized windows that
    start at a shingle of the item."""
    found: dict = {}
    for doc_id, text in docs:
        w = words((text or "").lower())
        sh = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        for item_id, item in items:
            v = words((item or "").lower())
            own = [tuple(v[k : k + 5]) for k in range(max(1, len(v) - 4))] if v else []
            if not own:
                continue
            held, have = Counter(own), set(own)
            for p, first in enumerate(sh):
                if first not in have:
                    continue
                window = Counter(sh[p : p + len(own)])
                common = sum((window & held).values())
                union = sum((window | held).values())
                if 100 * common >= percent * union:
                    best = found.get((doc_id, item_id), (0.0, 0))
                    if common / union > best[0]:
                        found[doc_id, item_id] = (common / union, p)
    return found
