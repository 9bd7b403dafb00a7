"""Comparing documents: page alignment and word differences.

Both are order-dependent programs over one pair of documents, so they run on groups that Spark forms; a group is the two documents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd

#: Cells of an alignment table, edits of a page that are worked out; beyond them pages pair by place and a page is one replacement.
CELLS, EDITS = 250_000, 2000
BONUS = 1e-6


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def align(a: Sequence[frozenset], b: Sequence[frozenset]) -> list[tuple[int | None, int | None]]:
    """Pairs in order that maximise the summed similarity; equal pages at both ends pair at once. On ties a pair goes before a page of
    the first document alone, and that before one of the second."""
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    left, right = range(head, n - tail), range(head, m - tail)
    middle: list[tuple[int | None, int | None]] = []
    if left and right and len(left) * len(right) <= CELLS:
        gain = np.array([[jaccard(a[i], b[j]) + BONUS for j in right] for i in left])
        best = np.zeros((len(left) + 1, len(right) + 1))
        for i in range(len(left)):
            for j in range(len(right)):
                best[i + 1, j + 1] = max(best[i, j] + gain[i, j], best[i, j + 1], best[i + 1, j])
        i, j = len(left), len(right)
        while i or j:
            if i and j and best[i, j] == best[i - 1, j - 1] + gain[i - 1, j - 1]:
                i, j = i - 1, j - 1
                middle.append((left[i], right[j]))
            elif i and (not j or best[i, j] == best[i - 1, j]):
                i -= 1
                middle.append((left[i], None))
            else:
                j -= 1
                middle.append((None, right[j]))
        middle.reverse()
    else:
        for k in range(max(len(left), len(right))):
            middle.append((left[k] if k < len(left) else None, right[k] if k < len(right) else None))
    return [*((k, k) for k in range(head)), *middle, *((n - tail + k, m - tail + k) for k in range(tail))]


def common(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as index pairs, from the places of each word: the last place that each length can end at."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    ends: list[int] = []
    chains: list[tuple | None] = []
    for i, w in enumerate(a):
        for j in reversed(places.get(w, ())):
            k = bisect_left(ends, j)
            link = (i, j, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    out, link = [], chains[-1] if chains else None
    while link:
        out.append((link[0], link[1]))
        link = link[2]
    return out[::-1]


def word_diff(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    """(kind, a from, a to, b from, b to) hunks that tile both sequences; kinds equal, insert, delete, replace."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    # words that only one side has are edits whatever the order, so most pages over the limit are known before the work
    shared = (Counter(x) & Counter(y)).total()
    pairs = common(x, y) if len(x) + len(y) - 2 * shared <= EDITS else []
    if len(x) + len(y) - 2 * len(pairs) > EDITS:
        pairs = []
    same = [*((k, k) for k in range(head)), *((i + head, j + head) for i, j in pairs), *((len(a) - tail + k, len(b) - tail + k) for k in range(tail))]
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for p, q in [*same, (len(a), len(b))]:
        if p > i or q > j:
            out.append(("replace" if p > i and q > j else "delete" if p > i else "insert", i, p, j, q))
        if p < len(a) or q < len(b):
            if out and out[-1][0] == "equal" and out[-1][2] == p and out[-1][4] == q:
                out[-1] = ("equal", out[-1][1], p + 1, out[-1][3], q + 1)
            else:
                out.append(("equal", p, p + 1, q, q + 1))
        i, j = p + 1, q + 1
    return out


ALIGNED = "pair bigint, row int, page_a int, page_b int, similarity double"
OPS = "pair bigint, row int, page_a int, page_b int, op int, kind string, words_a int, words_b int, text_a string, text_b string"


def _sides(pages: pd.DataFrame) -> tuple[list[list[str]], list[list[str]]]:
    ordered = pages.sort_values(["side", "page"])
    return tuple([list(w) for w in ordered.loc[ordered["side"] == s, "words"]] for s in (0, 1))


def align_pair(pages: pd.DataFrame) -> pd.DataFrame:
    """pages: pair, side (0 or 1), page, words (array). Alignment rows of the pair."""
    a, b = _sides(pages)
    keys = [[frozenset(w) for w in side] for side in (a, b)]
    rows = [(pages["pair"].iloc[0], k, i, j, jaccard(keys[0][i], keys[1][j]) if i is not None and j is not None else None) for k, (i, j) in enumerate(align(*keys))]
    return pd.DataFrame(rows, columns=["pair", "row", "page_a", "page_b", "similarity"]).astype({"page_a": "Int32", "page_b": "Int32"})


def diff_pair(pages: pd.DataFrame) -> pd.DataFrame:
    """Aligned pages' differences, hunk by hunk; a page without counterpart is one insertion or deletion."""
    a, b = _sides(pages)
    rows = []
    for k, (i, j) in enumerate(align(*[[frozenset(w) for w in side] for side in (a, b)])):
        x, y = a[i] if i is not None else [], b[j] if j is not None else []
        for n, (kind, p, q, r, s) in enumerate(word_diff(x, y)):
            rows.append((pages["pair"].iloc[0], k, i, j, n, kind, q - p, s - r, " ".join(x[p:q]), " ".join(y[r:s])))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OPS.split(", ")]).astype({"page_a": "Int32", "page_b": "Int32"})
