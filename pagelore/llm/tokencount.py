"""Token counts by dynamic programming over prefixes.

In byte-pair encoding the tokens of a prefix are the tokens of a shorter prefix and one last token: the only one that ends there and can
stand after the last token of the rest. So one pass over a piece gives the exact count at every prefix, and a text's counts are
running sums over its pieces, with what a cut changes there (runs of white space, contractions, special strings) put right. A text's table
has the exact count at each of its prefixes, so truncation and budget questions are lookups in it.

The vocabulary is a byte-level tokenizer file of the tokenizers library; special strings inside texts are single tokens, as they are by
default there.

Defined cases: null text is empty: no bytes, no tokens; repeated rows are counted alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import small_batches

#: Pieces and code points of pieces whose counts a worker keeps.
REMEMBERED, REMEMBERED_CHARS = 600_000, 6_000_000
#: Rows that go to a worker at once.
ROWS = 1000
#: Fixed value: the public split pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = regex.compile(r"\s").match
SPACES = regex.compile(r"\s{2,}")
#: Pieces of PATTERN whose first two characters alone are two pieces.
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_of() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        of = byte_of()
        as_bytes = lambda s: bytes(of[c] for c in s)
        special = {x["content"] for x in found["added_tokens"]}
        self.tokens = [as_bytes(t) for t in found["model"]["vocab"] if t not in special]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in found["model"]["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        self.halves = {a + b: ((a, b), k) for (a, b), k in self.ranks.items()}
        if len(self.halves) != len(self.ranks):
            raise ValueError("two merges make the same token")
        self.edges: tuple[dict, dict] = ({}, {})
        self.ending = ahocorasick.Automaton()
        for k, t in enumerate(self.tokens):
            self.ending.add_word(t.decode("latin-1"), (k, len(t)))
        self.ending.make_automaton()
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PATTERN)
        self.forget()
        self.follows: dict[int, bool] = {}

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The tokens that stand at one edge of ``token`` while it is built, each with the rank of the merge that ends it."""
        found = self.edges[right].get(token)
        if found is None:
            found, t, until = [], token, 1 << 60
            while True:
                found.append((t, until))
                if t not in self.halves:
                    break
                left_right, until = self.halves[t]
                t = left_right[right]
            self.edges[right][token] = found
        return found

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether a and b stay two tokens: no merge across their border comes before the merges that take its two sides away. Of equal
        merges the left one is first."""
        left = self.edge(b, False)
        for x, x_until in self.edge(a, True):
            for y, y_until in left:
                rank = self.ranks.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def prefix_counts(self, data: bytes) -> list[int]:
        """Tokens of data[:p] for each p, for data that is one piece. The automaton names all tokens that end at each byte."""
        follows, first = self.follows, len(self.tokens) << 17
        last, count = [0] * (len(data) + 1), [0] * (len(data) + 1)
        for end, (k, length) in self.ending.iter(data.decode("latin-1")):
            p = end + 1
            if not count[p]:
                at = p - length
                pair = last[at] << 17 | k if at else first | k
                ok = follows.get(pair)
                if ok is None:
                    if len(follows) > REMEMBERED:
                        follows.clear()
                    ok = follows[pair] = not at or self.may_follow(self.tokens[last[at]], self.tokens[k])
                if ok:
                    last[p], count[p] = k, count[at] + 1
        return count

    def prefixes(self, piece: str) -> list[int]:
        """Tokens of piece[:k] for each k from 1, for text that is one piece."""
        count = self.prefix_counts(piece.encode("utf-8", "replace"))
        if len(count) == len(piece) + 1:
            return count[1:]
        return [count[p] for p in accumulate(len(c.encode("utf-8", "replace")) for c in piece)]

    def cut(self, text: str) -> tuple[list[str], list[bool]]:
        """(pieces, whether each is a special string)."""
        if self.special is None or not self.special.search(text):
            found = self.pieces.findall(text)
            return found, [False] * len(found)
        out, marks, at = [], [], 0
        for m in self.special.finditer(text):
            part = self.pieces.findall(text[at : m.start()])
            out += [*part, m[0]]
            marks += [*([False] * len(part)), True]
            at = m.end()
        part = self.pieces.findall(text[at:])
        return out + part, marks + [False] * len(part)

    def place(self, piece: str) -> int:
        """Number of the piece, whose prefix counts are kept in ``flat`` from ``start`` on."""
        k = self.memo.get(piece)
        if k is None:
            k = self.memo[piece] = len(self.memo)
            self.flat.extend(self.prefixes(piece))
            self.start.append(len(self.flat))
        return k

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.start = array("i"), array("q", [0])

    def counts(self, text: str) -> np.ndarray:
        """Tokens of text[:p] for each p from 1 to the text's length: the prefix table."""
        found, marks = self.cut(text)
        if len(self.memo) > REMEMBERED or len(self.flat) > REMEMBERED_CHARS:
            self.forget()
        known = self.memo
        for w in {w for w in found if w not in known}:
            self.place(w)
        if not found:
            return np.zeros(0, np.int64)
        k = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat, np.int32)
        size = start[k + 1] - start[k]
        ends = np.cumsum(size)
        out = flat[np.repeat(start[k] - (ends - size), size) + np.arange(ends[-1])].astype(np.int64)
        del start, flat  # the arrays can grow again
        whole = out[ends - 1]
        whole[np.array(marks, bool)] = 1
        before = np.cumsum(whole) - whole
        out += np.repeat(before, size)
        out[ends - 1] = before + whole
        # pieces that a cut inside them makes two of
        for c in CONTRACTIONS:
            if c in known and c in text:
                both = self.prefixes(c[0])[-1] + self.prefixes(c[1])[-1]
                at = np.flatnonzero((k == known[c]) & ~np.array(marks, bool))
                out[ends[at] - 2] = before[at] + both
        if any(marks):
            self._inside_specials(text, marks, ends, out)
        # white space at the end is one piece
        for m in SPACES.finditer(text):
            first = m.start()
            out[first : m.end()] = (out[first - 1] if first else 0) + np.array(self.prefixes(m[0]))
        return out

    def _inside_specials(self, text: str, marks: list[bool], ends: np.ndarray, out: np.ndarray) -> None:
        """Part of a special string is plain text, cut together with the plain text before it."""
        edge = 0
        for n in np.flatnonzero(marks).tolist():
            start, end = (int(ends[n - 1]) if n else 0), int(ends[n])
            # only what follows the last white space before it can be cut in another way
            back = start
            while back > edge and not BLANK(text, back - 1):
                back -= 1
            while back > edge and BLANK(text, back - 1):
                back -= 1
            plain = int(out[back - 1]) if back else 0
            for p in range(start + 1, end):
                out[p - 1] = plain + sum(self.prefixes(x)[-1] for x in self.pieces.findall(text[back:p]))
            edge = end

    def longest_within(self, counts: np.ndarray, limit: int) -> int:
        """Code points of the longest prefix with at most ``limit`` tokens, from the prefix table."""
        fits = np.flatnonzero(counts <= limit)
        return int(fits[-1]) + 1 if len(fits) else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One for each worker process and file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_tables(docs: DataFrame, path: str, limit: int, text: str = "text", tables: bool = True) -> Column:
    """struct(n_bytes, n_tokens, fits_chars, counts) of each text. counts is the prefix table, little-endian unsigned 32-bit numbers, one for
    each code point (null if ``tables`` is false); fits_chars is the longest prefix within ``limit`` tokens, answered from the table."""
    small_batches(docs.sparkSession, ROWS)

    @F.pandas_udf("n_bytes bigint, n_tokens bigint, fits_chars bigint, counts binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                counts = own.counts(t)
                rows.append((len(t.encode("utf-8", "replace")), int(counts[-1]) if len(counts) else 0, own.longest_within(counts, limit), counts.astype("<u4").tobytes() if tables else None))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "fits_chars", "counts"])

    return run(F.col(text))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, tables: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fits_chars, and with ``tables`` counts for each row."""
    found = docs.select("doc_id", prefix_tables(docs, path, limit, tables=tables).alias("p"))
    return found.select("doc_id", "p.n_bytes", "p.n_tokens", (F.col("p.n_tokens") > limit).alias("over_limit"), "p.fits_chars", *(["p.counts"] if tables else []))
