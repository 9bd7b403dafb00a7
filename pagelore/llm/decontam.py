"""Benchmark decontamination by pigeonhole edit matching.

An item contaminates a document if some passage of the document is within the item's error budget of it by edit distance, after
lower-casing and making each run of white space one space. With a budget of k edits an item is cut into k + 1 pieces, of which one at least
is untouched; an automaton finds all pieces of a block of items in one pass over the text. A hit is verified up a binary tree of the
pieces: a node of s pieces may have s - 1 edits, and one child at least of a matching node matches too, so a chance hit ends at
its first small node. Each check is Myers' bit-parallel distance.

Items go to the workers in blocks of about BLOCK_CHARS characters, each against all documents; nothing of the documents moves.

Defined cases: a null or blank text or item matches nothing; items under SHORT characters must be there unchanged; repeated rows and items
give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits per character of an item, least length that allows edits, characters of items that a worker holds.
RATE, SHORT, BLOCK_CHARS = 0.1, 20, 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate) if length >= SHORT else 0


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], length: int, text: str, most: int) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of text, that part's end); more than ``most`` counts as most + 1."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best, end = full, 0, length, most + 1, -1
    get = peq.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        plus = (mh << 1 & full) | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


@dataclass
class Node:
    item: int
    at: int  # where the node's text begins in the item
    peq: dict[str, int]
    length: int
    budget: int
    up: int  # -1: the whole item


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.nodes: list[Node] = []
        self.ids: list[int] = []
        pieces: dict[str, list[int]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            n = budget(len(text), rate) + 1
            cuts = [len(text) * k // n for k in range(n + 1)]
            todo = [(0, n, -1)]
            while todo:
                a, b, up = todo.pop()
                own = text[cuts[a] : cuts[b]]
                k = len(self.nodes)
                self.nodes.append(Node(len(self.ids), cuts[a], masks(own) if b - a > 1 or up < 0 else {}, len(own), b - a - 1, up))
                if b - a > 1:
                    todo += [(a, (a + b) // 2, k), ((a + b) // 2, b, k)]
                else:
                    pieces.setdefault(own, []).append(k)
            self.ids.append(item_id)
        self.pieces = pieces
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """(node of a piece, its end in text)"""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for piece, nodes in self.pieces.items():
                self.automaton.add_word(piece, nodes)
            self.automaton.make_automaton()
        for end, nodes in self.automaton.iter(text):
            for k in nodes:
                yield k, end + 1

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, budget, end of the passage in the normal text): of each item the nearest passage, then the first."""
        text = normal(text)
        if not text or not self.ids:
            return
        best: dict[int, tuple[int, int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for k, end in self.hits(text):
            node = self.nodes[k]
            start = end - node.length - node.at  # where the item would begin without edits
            while node.up >= 0:
                k = node.up
                node = self.nodes[k]
                if (k, start) in seen:
                    break
                seen.add((k, start))
                low = max(0, start + node.at - node.budget)
                distance, stop = myers(node.peq, node.length, text[low : start + node.at + node.length + 2 * node.budget], node.budget)
                if distance > node.budget:
                    break
                if node.up < 0:
                    found = (distance, low + stop, node.budget)
                    best[node.item] = min(found, best.get(node.item, found))
            else:
                if node.budget == 0:  # an item of one piece
                    best[node.item] = min((0, end, 0), best.get(node.item, (0, end, 0)))
        for item, (distance, stop, most) in best.items():
            yield self.ids[item], distance, most, stop


def blocks(benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> Iterator[Matcher]:
    """Matchers of bounded blocks that hold all items together."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars * 2 // block_chars) if chars > block_chars else 1)
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Matcher([(r[0], r[1]) for r in part.collect()], rate)


def _find(docs: DataFrame, matcher: Matcher) -> Column:
    """struct of parallel arrays (item_id, distance, budget, passage_end) for each text."""
    shared = docs.sparkSession.sparkContext.broadcast(matcher)

    @F.pandas_udf("item_id array<bigint>, distance array<int>, budget array<int>, passage_end array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [[[m[k] for m in found] for k in range(4)] for found in (list(shared.value.matches(t)) for t in texts)]
            yield pd.DataFrame(rows, columns=["item_id", "distance", "budget", "passage_end"], dtype=object)

    return run("text")


def _holds(docs: DataFrame, matcher: Matcher) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(matcher)

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([next(shared.value.matches(t), None) is not None for t in texts], dtype=bool)

    return run("text")


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget, passage_end: a row for each document's row and each item that it holds."""
    out = None
    for matcher in blocks(benchmark, rate, block_chars):
        found = docs.select("doc_id", "text").withColumn("m", _find(docs, matcher))
        found = found.select("doc_id", F.explode(F.arrays_zip(*[F.col(f"m.{c}").alias(c) for c in ("item_id", "distance", "budget", "passage_end")])).alias("m")).select("doc_id", "m.*")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    for matcher in blocks(benchmark, rate, block_chars):
        docs = docs.filter(~_holds(docs, matcher))
    return docs
