"""Token ids in compressed binary files: an adaptive context-mixing range coder.

A block holds BLOCK ids, starts from an empty model and ends in its own checksums, so blocks are read and repaired alone. It begins with its
distinct ids as plain numbers in order of first appearance; what is coded is each id's place in that list. For each id:

* order 2 and order 1 each give all of their chance to the id that last followed the same two ids, or the same one;
* order 0 spreads its chance over the ids of the block so far by their frequencies, renewed at the places RENEW, over "the next new id", and over
  those that are new since the renewal; what the last two had between the last two renewals is their share;
* the chances are weighed. The weights adapt: they depend on how often orders 2 and 1 were right of late and on whether they agree, and are
  renewed with order 0 from the outcomes of the block so far;
* in the whole, order 2's guess comes first, then order 1's, then order 0. An id that stands in several places is coded where it is widest.

Lists are of the block alone, so models are small and take ids of any vocabulary up to 32 bits.

The range coder has 32-bit digits and carries. numpy runs it over many blocks of a partition side by side, one id of each block a step; a
block's bytes don't depend on its neighbours.

Files: Spark writes rows (part, block, payload), so a lost executor's files are written again. A payload is MAGIC, numbers of ids, of
document pieces and of bytes of digits, crc32 of the ids, crc32 of the rest, the pieces (doc number in the part, doc_id, null mark, ids), the digits.

Defined cases: null text is empty and has the end id alone; a null doc_id sorts first; rows that share a doc_id are ordered by a hash
of the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagelore.llm.common import shared_dir, stored

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MAGIC, BLOCK, LANES = b"PLR4", 4096, 2048
#: Slots of the order-2 table, bits of weights, bits of order 0.
SLOTS, WEIGHT, ORDER0 = 2048, 11, 13
WHOLE0, BITS = 1 << ORDER0, WEIGHT + ORDER0
PROBES, TOGETHER, AT_ONCE = 200, 32_000_000, 500_000
HEAD = struct.Struct("<4sIIIII")
DICTIONARY = struct.Struct("<?H")
PIECE = np.dtype([("doc", "<i8"), ("doc_id", "<i8"), ("null", "u1"), ("n", "<u4")])
U = np.uint64
FULL, DIGIT, HALF, CUT = U((1 << 64) - 1), U(1 << 32), U(32), U(BITS)
#: Numbers of numpy's types, so that arrays keep theirs.
ONE, TWO, THREE, FOUR, SEVEN, MIX, LAST_SLOT = (np.int16(x) for x in (1, 2, 3, 4, 7, 293, SLOTS - 1))
ALL, LEFT, SPAN, SIXTEEN, LOW, BITS0 = (np.int32(x) for x in (1 << WEIGHT, 14, (1 << 14) - 1, 16, (1 << 16) - 1, ORDER0))
RENEW = [48, 192, 640, 1408, 2560]


class Orders:
    """Orders 1 and 2 and the weights of all three, for many blocks side by side; row 0 of an array of two rows is order 2, row 1 order 1. A
    slot holds an id's number and, in its low two bits, whether it was right the last two times; if it wasn't and isn't now, it is taken over. A
    block's weights depend on these bits of both slots and on whether the two agree (CONTEXTS); they are renewed with order 0, from all
    outcomes of the block so far."""

    CONTEXTS, PRIOR = 32, 8

    def __init__(self, n: int, longest: int, kinds: int) -> None:
        lanes = np.arange(n)
        self.own = np.stack([lanes * (SLOTS + 37), n * (SLOTS + 37) + lanes * (kinds + 5)])
        self.slots, self.by = np.empty(n * (SLOTS + 37 + kinds + 5), np.int16), lanes * self.CONTEXTS
        self.slots.fill(0)
        self.last, self.hashed = np.zeros(n, np.int16), np.zeros(n, np.int16)
        third = ((1 << WEIGHT) - 3) // 3 + 1
        self.weights = np.full(n * self.CONTEXTS, 2 * third << 16 | third, np.int32)
        self.outcomes, self.counts, self.upto = np.zeros((longest, 3, n), np.int8), np.zeros((n, self.CONTEXTS, 4)), 0

    def renew(self, t: int, n: int) -> None:
        """The weights of the first n blocks from their outcomes before t."""
        own = self.outcomes[self.upto : t, :, :n]
        some = (own[:, 2] << np.int8(2) | own[:, 1] << np.int8(1) | own[:, 0]) + np.arange(n, dtype=np.int32) * (self.CONTEXTS * 4)
        self.counts[:n] += np.bincount(some.ravel(), minlength=n * self.CONTEXTS * 4).reshape(n, self.CONTEXTS, 4)
        self.upto = t
        own = self.counts[:n]
        right = np.stack([own[..., 1] + own[..., 3], own[..., 2]], -1)
        total = own.sum(-1, keepdims=True)
        usual = (right.sum(1, keepdims=True) + 1) / (total.sum(1, keepdims=True) + 3)
        chance = ((right + self.PRIOR * usual) / (total + self.PRIOR) * ((1 << WEIGHT) - 3)).astype(np.int32) + 1
        self.weights[: n * self.CONTEXTS] = (chance[..., 0] + chance[..., 1] << 16 | chance[..., 0]).ravel()

    def predict(self, n: int) -> None:
        """Guesses of the first n blocks; the width ``two`` of order 2's in the whole of 2 ** BITS, ``both`` with order 1's, and w0, the weight of
        order 0."""
        last = self.last[:n]
        near = np.empty((2, n), np.int16)
        np.bitwise_and(self.hashed[:n] + last * MIX, LAST_SLOT, out=near[0])
        near[1] = last
        self.at = near.astype(np.intp)
        self.at += self.own[:, :n]
        slot = self.slots[self.at]
        self.guess, self.trust = slot >> TWO, slot & THREE
        context = self.trust[0] << TWO
        context += self.trust[1]
        context += (self.guess[0] == self.guess[1]).view(np.int8) << FOUR
        self.context = context
        at = context.astype(np.intp)
        at += self.by[:n]
        weights = self.weights[at]
        both = weights >> SIXTEEN
        self.w0 = ALL - both
        self.two, self.both = (weights & LOW) << BITS0, both << BITS0

    def learn(self, t: int, now: np.ndarray) -> None:
        """``right`` is which guesses were."""
        n = len(now)
        right = self.right.view(np.int8)
        self.outcomes[t, :2, :n], self.outcomes[t, 2, :n] = right, self.context
        trust = self.trust << ONE
        trust |= right
        trust &= THREE
        slot = self.guess << TWO
        slot |= trust
        trust |= self.trust
        taken = np.negative((trust == 0).view(np.int8), dtype=np.int16)
        taken &= slot ^ (now << TWO)
        slot ^= taken
        self.slots[self.at] = slot
        np.multiply(self.last[:n], SEVEN, out=self.hashed[:n])
        self.last[:n] = now


class Order0:
    """Frequencies of the numbers before t, for many blocks; each block's add up to WHOLE0 with those for the others: column 0 is for the
    next new number of the block, column k + 1 for number k, also if it is new since t. What new numbers and those new since the table ``before``
    had of the ids since then is what they get in the next one; the latter share it alike. ``kinds``: how many numbers each block has in all."""

    def __init__(self, columns: np.ndarray, t: int, n: int, before: Order0 | None, kinds: np.ndarray, slots: bool) -> None:
        since, old = (before.at, before.seen[:n]) if before is not None else (0, np.ones(n, np.int16))
        self.at, wide = t, int(kinds.max()) + 1
        self.base = np.arange(n, dtype=np.int32) * np.int32(wide)
        some, kinds = columns[since:t, :n], kinds[:n].astype(np.int16)
        new, again = (some == 0).sum(0), (some > old).sum(0)
        self.seen = old + new.astype(np.int16)
        count = np.bincount((some + self.base).ravel(), minlength=n * wide).astype(np.float32).reshape(n, wide)
        count[:, 0] = 0
        place = np.arange(-1, wide - 1, dtype=np.int16)
        unseen = place >= self.seen[:, None]
        count += (place >= old[:, None]) > unseen  # a new number is one of its block once
        if before is not None:
            count += before.count[:n]
        self.count = count
        left = kinds - self.seen.astype(np.int64)
        whole, ids = WHOLE0 - 1 - kinds.astype(np.int64), t - since + 2
        fresh = np.where(left > 0, (whole - 1) * (new + 1) // ids, 0)
        alike = np.where(left > 0, np.minimum((whole - 1) * (again + 1) // ids, whole // 8 if t == 0 else whole) // np.maximum(left, 1), 0)
        # a little less than the rest, so that rounding never makes more of it
        rate = ((whole - fresh - alike * left) / max(t, 1) * (1 - 1e-6)).astype(np.float32)
        freq = (count * rate[:, None]).astype(np.int32)
        own = place < kinds[:, None]
        freq += own
        own &= unseen
        freq += own * alike.astype(np.int32)[:, None]
        freq[:, 0] = fresh + 1
        begin = np.cumsum(freq, axis=1, dtype=np.int32)
        if before is not None:
            before.slot = None
        if slots:  # what rounding leaves is in no use
            upto = freq.copy()
            upto[:, -1] += WHOLE0 - begin[:, -1]
            self.slot = np.repeat(np.tile(np.arange(wide, dtype=np.int16), n), upto.ravel())
        begin -= freq
        begin <<= LEFT
        begin |= freq
        self.spans = begin.ravel()


class Coder:
    """Low ends and widths of many blocks' intervals. Widths are over 32 bits after ``shift``, so that they can be cut in 2 ** BITS parts. A low
    end that passes 64 bits carries one on to the digits before. A reader has ``digits`` and needs ``off`` alone, how far its code is above the
    low end."""

    def __init__(self, n: int, digits: np.ndarray | None) -> None:
        self.low, self.width, self.used = np.zeros(n, U), np.full(n, FULL), np.zeros(n, np.int64)
        self.lanes: list[np.ndarray] = []
        self.written: list[np.ndarray] = []
        self.carries: list[tuple[np.ndarray, np.ndarray]] = []
        if digits is not None:
            self.off = digits[:, 0].astype(U) << U(32) | digits[:, 1].astype(U)
            self.flat, self.used = digits.ravel(), np.arange(n) * digits.shape[1] + 2

    def value(self, n: int) -> np.ndarray:
        """Where the codes of the first n blocks are, out of 2 ** BITS."""
        self.part = self.width[:n] >> CUT
        return (self.off[:n] // self.part).astype(np.int32)

    def write(self, begin: np.ndarray, size: np.ndarray) -> None:
        n = len(begin)
        low, width = self.low[:n], self.width[:n]
        part = width >> CUT
        step = begin.astype(U)
        step *= part
        low += step
        passed = low < step
        if passed.any():
            at = passed.nonzero()[0]
            self.carries.append((at, self.used[at]))
        np.multiply(part, size.astype(U), out=width)
        at = (width < DIGIT).nonzero()[0]
        own = low[at]
        self.lanes.append(at)
        self.written.append(own >> HALF)
        low[at] = own << HALF
        width[at] <<= HALF
        self.used[at] += 1

    def read(self, begin: np.ndarray, size: np.ndarray) -> None:
        n = len(begin)
        off, width = self.off[:n], self.width[:n]
        step = begin.astype(U)
        step *= self.part
        off -= step
        np.multiply(self.part, size.astype(U), out=width)
        at = (width < DIGIT).nonzero()[0]
        used = self.used[at]
        own = off[at] << HALF
        own |= self.flat[used]
        off[at] = own
        used += 1
        self.used[at] = used
        width[at] <<= HALF

    def close(self) -> list[bytes]:
        """Each block's digits."""
        n = len(self.low)
        every = np.arange(n)
        lanes = np.concatenate([*self.lanes, every, every]).astype(np.uint16 if n <= 1 << 16 else np.int64)
        digits = np.concatenate([*self.written, self.low >> HALF, self.low & (DIGIT - U(1))]).astype("<u4")
        digits = digits[np.argsort(lanes, kind="stable")]
        upto = np.cumsum(self.used + 2)
        first = upto - self.used - 2
        for at, used in self.carries:
            place = first[at] + used
            while len(place):
                place = place - 1
                digits[place] += np.uint32(1)
                place = place[digits[place] == 0]
        return [digits[a:b].tobytes() for a, b in zip(first.tolist(), upto.tolist(), strict=True)]


def numbered(ids: np.ndarray, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers from 1 on in order of first appearance, and the ids in that order; a number has a minus where it is new, except the first.
    ``scratch``: 2 ** 16 places."""
    at = np.arange(len(ids))
    if int(ids.max()) >= len(scratch):
        own = np.unique(ids, return_index=True, return_inverse=True)
        first = own[1][own[2]]
    else:
        key = ids.astype(np.intp)
        scratch[key[::-1]] = at[::-1]  # of repeated places the last value stays, which is the first one's
        first = scratch[key]
    begins = first == at
    rank = np.cumsum(begins, dtype=np.int16)
    kinds = ids[begins]
    begins[0] = False
    rank = rank[first]
    np.negative(rank, out=rank, where=begins)
    return rank, kinds


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's ids in order of appearance (DICTIONARY says how wide and how many), and the digits of their numbers. Blocks of 1 to BLOCK ids
    under 2 ** 32."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    lengths = np.array([len(blocks[k]) for k in order])
    rows, heads, scratch = np.ones((len(order), lengths[0]), np.int16), [], np.zeros(1 << 16, np.int64)
    kinds = np.zeros(len(order), np.int64)
    for lane, k in enumerate(order):
        rows[lane, : len(blocks[k])], own = numbered(blocks[k], scratch)
        kinds[lane] = len(own)
        wide = bool(own.max() >= 1 << 16)
        heads.append(DICTIONARY.pack(wide, len(own)) + own.astype("<u4" if wide else "<u2").tobytes())
    numbers = np.ascontiguousarray(rows.T)
    del rows
    columns = np.maximum(numbers, 0)  # new numbers have none
    np.abs(numbers, out=numbers)
    numbers -= ONE
    orders, coder, table = Orders(len(order), lengths[0], int(kinds.max())), Coder(len(order), None), None
    for t, n in enumerate(np.searchsorted(-lengths, -np.arange(lengths[0])).tolist()):  # n blocks are longer than t
        if t == 0 or t in RENEW:
            table = Order0(columns, t, n, table, kinds, False)
            orders.renew(t, n)
            begins = table.spans[columns[t : min([k for k in RENEW if k > t], default=BLOCK), :n] + table.base]
            sizes = begins & SPAN
            begins >>= LEFT
        now, k = numbers[t, :n], t - table.at
        orders.predict(n)
        begin, size = orders.w0 * begins[k, :n], orders.w0 * sizes[k, :n]
        begin += orders.both
        orders.right = orders.guess == now
        # where a guess is right, its own interval is taken if it is wider
        at = (orders.right[0] | orders.right[1]).nonzero()[0]
        two, wide = orders.two[at], size[at]
        for right, first, own in ((orders.right[1, at], two, orders.both[at] - two), (orders.right[0, at], 0, two)):
            right &= own > wide
            begin[at] = np.where(right, first, begin[at])
            wide = np.where(right, own, wide)
        size[at] = wide
        coder.write(begin, size)
        orders.learn(t, now)
    digits = coder.close()
    out: list[bytes] = [b""] * len(order)
    for lane, k in enumerate(order):
        out[k] = heads[lane] + digits[lane]
    return out


def decode(coded: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """From (number of ids, bytes) of each block its ids."""
    order = sorted(range(len(coded)), key=lambda k: -coded[k][0])
    lengths = np.array([coded[k][0] for k in order])
    heads, own = [], []
    for k in order:
        wide, n = DICTIONARY.unpack_from(coded[k][1])
        heads.append(np.frombuffer(coded[k][1], "<u4" if wide else "<u2", n, DICTIONARY.size))
        own.append(np.frombuffer(coded[k][1], "<u4", offset=DICTIONARY.size + heads[-1].nbytes))
    digits = np.zeros((len(order), max(map(len, own)) + 1), np.uint32)
    for lane, some in enumerate(own):
        digits[lane, : len(some)] = some
    kinds = np.array([len(x) for x in heads])
    numbers, columns = np.zeros((lengths[0], len(order)), np.int16), np.zeros((lengths[0], len(order)), np.int16)
    orders, coder, table = Orders(len(order), lengths[0], int(kinds.max())), Coder(len(order), digits), None
    known, places = np.ones(len(order), np.int16), np.arange(len(order)) << ORDER0
    for t, n in enumerate(np.searchsorted(-lengths, -np.arange(lengths[0])).tolist()):
        if t == 0 or t in RENEW:
            table = Order0(columns, t, n, table, kinds, True)
            orders.renew(t, n)
        orders.predict(n)
        v = coder.value(n)
        at = v - orders.both
        guessed = (at < 0).nonzero()[0]
        at = (at / orders.w0).astype(np.intp)
        np.maximum(at, 0, out=at)
        at += places[:n]
        now = table.slot[at]
        at = now.astype(np.intp)
        at += table.base[:n]
        span = table.spans[at]
        begin, size = span >> LEFT, span & SPAN
        begin *= orders.w0
        begin += orders.both
        size *= orders.w0
        now -= ONE
        two = orders.two[guessed]
        by2 = v[guessed] < two
        begin[guessed] = np.where(by2, 0, two)
        size[guessed] = np.where(by2, two, orders.both[guessed] - two)
        now[guessed] = np.where(by2, orders.guess[0, guessed], orders.guess[1, guessed])
        coder.read(begin, size)
        new = (now < 0).nonzero()[0]
        if len(new):
            number = known[new]
            now[new] = number
            known[new] = number + ONE
        numbers[t, :n] = now
        own = columns[t, :n]
        np.add(now, ONE, out=own)
        own[new] = 0
        orders.right = orders.guess == now
        orders.learn(t, now)
    out: list[np.ndarray] = [heads[0][:0]] * len(order)
    rows = np.ascontiguousarray(numbers.T)
    for lane, k in enumerate(order):
        out[k] = heads[lane].take(rows[lane, : lengths[lane]])
    return out


def pack(ids: np.ndarray, pieces: np.ndarray, digits: bytes) -> bytes:
    rest = pieces.tobytes() + digits
    return HEAD.pack(MAGIC, len(ids), len(pieces), len(digits), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest)) + rest


def unpack(payload: bytes) -> tuple[int, np.ndarray, bytes, int]:
    """(number of ids, pieces, digits, crc32 of the ids)"""
    magic, n, pieces, digits, crc, rest_crc = HEAD.unpack_from(payload)
    rest = payload[HEAD.size :]
    if magic != MAGIC or len(rest) != pieces * PIECE.itemsize + digits or zlib.crc32(rest) != rest_crc:
        raise ValueError("damaged block")
    return n, np.frombuffer(rest, PIECE, pieces), rest[pieces * PIECE.itemsize :], crc


class Runs:
    """A run of ids for each number."""

    def __init__(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.flat, self.count = flat, count
        self.start = np.cumsum(count, dtype=np.int64) - count

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all numbers, how many of them up to each number's end)"""
        count = self.count[numbers]
        upto = np.cumsum(count, dtype=np.int64)
        at = np.repeat(self.start[numbers] - (upto - count), count)
        at += np.arange(len(at))
        return self.flat[at], upto


class WordIds:
    """Ids of texts from the tokenizers library. Where its normalizer and splitter never join across white space, each distinct word of the
    given texts is encoded once; nothing is kept from one call to the next. That is tried on PROBES pairs of words from the vocabulary, and if it fails texts are encoded whole. Where they also cut a word's
    last punctuation off and take A-Z as a-z, which is tried in the same way, words that differ in these share their letters' ids: of a word of
    Latin letters alone (without marks, which may join a letter) the letters in lower case and the punctuation after them are encoded."""

    TAIL = string.punctuation.replace("'", "")
    #: Latin letters without marks, also in lower case (that of U+0130 has a mark).
    LATIN = string.ascii_letters + "\u00aa\u00b5\u00ba" + "".join(map(chr, sorted(set(range(0xC0, 0x250)) - {0xD7, 0xF7, 0x130})))

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        ids = self.tokenizer.get_vocab()
        vocabulary = sorted(ids)
        probes = [vocabulary[k * len(vocabulary) // PROBES].replace("</w>", "") for k in range(PROBES)] + ["a", "9", "!", "'s", "\u00e9", "\u65e5"]
        words = [x for x in ("".join(p.split()) for p in probes) if x]
        pairs = [(a, b, " \n\t\r\x0b\x0c"[k % 6] * (1 + k % 2)) for k, (a, b) in enumerate(zip(words, reversed(words), strict=True))]
        self.by_word = self._batch([a + s + b for a, b, s in pairs]) == [x + y for x, y in zip(self._batch([a for a, _, _ in pairs]), self._batch([b for _, b, _ in pairs]), strict=True)]
        letters = [x for x in (*words, *(v.replace("</w>", "") for v in vocabulary[:: max(1, len(vocabulary) // (20 * PROBES))])) if self._letters(x.encode("utf-8", "replace"))]
        marks, n = self.TAIL, len(self.TAIL)
        tails = [marks[k % n] * (1 + k % 4 // 3) + marks[k // n % n] * (k % 2) for k in range(len(letters))]
        cut = [x + y for x, y in zip(self._batch([x.encode().lower().decode() for x in letters]), self._batch(tails), strict=True)]
        self.by_part = self.by_word and bool(letters) and all(self._batch([f(x) + y for x, y in zip(letters, tails, strict=True)]) == cut for f in (str, self._capital, self._capitals))
        # of small Latin letters alone, words need no normalizer, and of a-z they are cut by spaces; a text of such words gives all their ids at
        # once, and each word's last one has the suffix of a word's end
        model = self.tokenizer.model
        self.plain, self.latin, suffix = Tokenizer(model), Tokenizer(model), getattr(model, "end_of_word_suffix", None)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if self.tokenizer.pre_tokenizer is not None:
            self.latin.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for token, i in ids.items() if suffix and token.endswith(suffix)]] = True
        added = any(self._letters(x.content.encode()) for x in self.tokenizer.get_added_tokens_decoder().values())
        small = sorted({x.lower() for x in letters} | {x.lower()[:2] + c for x, c in zip(letters, itertools.cycle(self.LATIN.lower()))})
        plain = [x for x in small if x.isascii()]
        if added or not self.by_part or not plain or self._lists(*self._plain(plain)) != self._batch(plain) or self._lists(*self._latin(small)) != self._batch(small):
            self.plain = None

    @staticmethod
    def _lists(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
        upto = np.cumsum(counts)
        return [ids[b - n : b].tolist() for b, n in zip(upto, counts, strict=True)]

    @classmethod
    def _letters(cls, word: bytes) -> bool:
        text = word.decode("utf-8", "replace")
        return bool(text) and not text.strip(cls.LATIN)

    @staticmethod
    def _capital(x: str) -> str:
        return x[0].encode().upper().decode() + x[1:]

    @staticmethod
    def _capitals(x: str) -> str:
        return x.encode().upper().decode()

    def _batch(self, texts: list[str]) -> list[list[int]]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in run(texts, add_special_tokens=False)]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many of each word)"""
        ids = self._batch(words)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of a-z."""
        return self._joined(self.plain, words)

    def _latin(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of small Latin letters."""
        return self._joined(self.latin, words)

    def _joined(self, tokenizer: Tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        run = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        texts = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in run(texts, add_special_tokens=False)), np.uint32)
        upto = np.flatnonzero(self.ends[ids]) + 1
        if len(upto) != len(words) or upto[-1] != len(ids):
            return self._ids(words)
        return ids, np.diff(upto, prepend=0)

    def _runs(self, parts: pa.Array) -> tuple[Runs, np.ndarray]:
        """The ids of distinct parts of words, and each part's number among them."""
        plain = latin = np.zeros(len(parts), bool)
        if self.plain is not None:
            plain = pc.ascii_is_alpha(parts).to_numpy(zero_copy_only=False)
            latin = pc.and_(pc.match_substring_regex(parts, f"^[{self.LATIN}]+$"), pc.equal(pc.utf8_lower(parts), parts)).to_numpy(zero_copy_only=False) & ~plain
        flat, counts, places = [], [], []
        for some, encode in ((plain, self._plain), (latin, self._latin), (~(plain | latin), self._ids)):
            places.append(np.flatnonzero(some))
            words = parts.filter(pa.array(some)).to_numpy(zero_copy_only=False).tolist()
            for at in range(0, len(words), 20_000):
                ids, own = encode(words[at : at + 20_000])
                flat.append(ids)
                counts.append(own)
        place = np.empty(len(parts), np.int64)
        place[np.concatenate(places)] = np.arange(len(parts))
        return Runs(np.concatenate(flat), np.concatenate(counts)), place

    def _words(self, words: pa.Array) -> Runs:
        """The ids of distinct words from those of their parts, and one more run, the end id."""
        parts, tails = words, pa.repeat(pa.scalar("", words.type), len(words))
        if self.by_part:
            body = pc.ascii_rtrim(words, self.TAIL)
            letters = pc.ascii_is_alpha(body)
            parts = pc.if_else(letters, pc.ascii_lower(body), words)
            tails = pc.if_else(letters, pc.ascii_ltrim(words, string.ascii_letters), tails)
            other = pc.and_(pc.invert(pc.string_is_ascii(body)), pc.match_substring_regex(body, f"^[{self.LATIN}]+$"))
            parts = pc.if_else(other, pc.ascii_lower(body), parts)
            tails = pc.replace_with_mask(tails, other, pc.utf8_ltrim(words.filter(other), self.LATIN))
        parts, tails = parts.dictionary_encode(), tails.dictionary_encode()
        runs, place = self._runs(pa.concat_arrays([parts.dictionary, tails.dictionary]))
        of = np.empty(2 * len(words), np.int64)
        of[0::2], of[1::2] = place[parts.indices.to_numpy()], place[tails.indices.to_numpy() + len(parts.dictionary)]
        ids, upto = runs.of(of)
        return Runs(np.append(ids, np.uint32(self.end_id)), np.append(np.diff(upto[1::2], prepend=0), 1))

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of each text), with the end id after each text. Texts are a list or an Arrow array of large strings."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_word:
            found = [[*own, self.end_id] for own in self._batch([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)])]
            return np.array([x for own in found for x in own], np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        if not isinstance(texts, pa.Array):
            texts = pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.large_binary()).cast(pa.large_string())
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        upto = np.cumsum(pc.list_value_length(words).to_numpy())
        words = words.flatten().dictionary_encode()
        of = np.empty(len(words) + len(texts), np.int64)
        ends = upto + np.arange(len(texts))
        is_word = np.ones(len(of), bool)
        is_word[ends] = False
        of[is_word], of[ends] = words.indices.to_numpy(), len(words.dictionary)
        runs = self._words(words.dictionary)
        del words
        ids = np.concatenate([runs.of(of[at : at + AT_ONCE])[0] for at in range(0, len(of), AT_ONCE)])
        return ids, np.diff(np.cumsum(runs.count[of])[ends], prepend=0)


_encoders: dict[tuple[str, int], WordIds] = {}


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, partitions: int | None = None) -> None:
    """The ids of all texts, in ascending doc_id order, as blocks under ``path``."""
    spark = docs.sparkSession
    # half of the usual number: a task that codes more blocks side by side takes less time for each
    partitions = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (tokenizer, end_id) not in _encoders:
            _encoders[tokenizer, end_id] = WordIds(tokenizer, end_id)
        own = _encoders[tokenizer, end_id]
        part, block, doc = TaskContext.get().partitionId(), 0, 0
        held_ids, held_pieces = np.zeros(0, np.uint32), np.zeros(0, PIECE)

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            """Whole blocks of what is held; all of it at the end."""
            nonlocal held_ids, held_pieces, block
            while len(held_ids) >= BLOCK * LANES * 3 // 2 or (last and len(held_ids)):
                take = len(held_ids) if len(held_ids) < BLOCK * LANES * 3 // 2 else BLOCK * LANES
                edges = np.append(np.arange(0, take, BLOCK), take)
                upto = np.cumsum(held_pieces["n"].astype(np.int64))
                first = upto - held_pieces["n"]
                cut = [held_ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                rows = []
                for (a, b), ids, digits in zip(zip(edges[:-1], edges[1:], strict=True), cut, encode(cut), strict=True):
                    i, j = np.searchsorted(upto, a, "right"), np.searchsorted(first, b, "left")
                    pieces = held_pieces[i:j].copy()
                    pieces["n"] = np.minimum(upto[i:j], b) - np.maximum(first[i:j], a)
                    rows.append((part, block, pack(ids, pieces, digits)))
                    block += 1
                keep = np.searchsorted(upto, take, "right")
                rest = held_pieces[keep:].copy()
                if len(rest):
                    rest["n"][0] = upto[keep] - max(first[keep], take)
                held_ids, held_pieces = held_ids[take:], rest
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "block", "payload"])

        def hold(some: list[pa.RecordBatch]) -> None:
            nonlocal held_ids, held_pieces, doc
            rows = pa.Table.from_batches(some).combine_chunks()
            texts, given = (rows[k].combine_chunks() if isinstance(rows[k], pa.ChunkedArray) else rows[k] for k in ("text", "id"))
            ids, counts = own.encode(texts.cast(pa.large_string()))
            pieces = np.zeros(len(rows), PIECE)
            pieces["doc"], pieces["n"] = doc + np.arange(len(rows)), counts
            pieces["null"], pieces["doc_id"] = given.is_null().to_numpy(zero_copy_only=False), given.fill_null(0).to_numpy()
            doc += len(rows)
            held_ids, held_pieces = np.concatenate([held_ids, ids]), np.concatenate([held_pieces, pieces])

        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += batch.nbytes
            del batch
            if size >= TOGETHER:  # the more texts together, the fewer words are encoded again
                hold(some)
                some, size = [], 0
                pa.default_memory_pool().release_unused()
                yield from blocks(False)
        if some:
            hold(some)
            some = []
            pa.default_memory_pool().release_unused()
        yield from blocks(True)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange(partitions, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    rows = rows.select(F.col("doc_id").alias("id"), "text")
    rows.mapInArrow(run, "part int, block bigint, payload binary").write.parquet(path)


def times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, lowest power in the highest bit."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit, b = bit >> 1, b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@functools.cache
def powers() -> list[int]:
    """x to the power 32 * n modulo that polynomial, for the n of a block."""
    out = [1 << 31]
    word = 1 << 31 - 8
    for _ in range(2):
        word = times(word, word)
    while len(out) <= BLOCK:
        out.append(times(out[-1], word))
    return out


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """crc32 of a whole from (bytes, crc32) of its parts in order."""
    out = 0
    for n, crc in parts:
        if n % 4 == 0 and n <= 4 * BLOCK:
            power = powers()[n // 4]
        else:
            power, square, k = 1 << 31, 1 << 23, n  # x^0 and x^8
            while k:
                if k & 1:
                    power = times(power, square)
                square, k = times(square, square), k >> 1
        out = (times(out, power) if out else 0) ^ crc
    return out


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document's piece in a block: part, doc, block, doc_id, start (in its part), n, crc32; with its ids if asked."""
    schema = "part int, doc bigint, block bigint, id string, start bigint, n bigint, crc bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = -(-len(batch) // -(-len(batch) * 2 // (3 * LANES))) if len(batch) else 1
            for at in range(0, len(batch), step):
                some = batch.iloc[at : at + step]
                found = [unpack(bytes(p)) for p in some["payload"]]
                rows = []
                for (n, pieces, _, crc), ids, part, block in zip(found, decode([(x[0], x[2]) for x in found]), some["part"], some["block"], strict=True):
                    raw = ids.astype("<u4").tobytes()
                    if len(ids) != n or zlib.crc32(raw) != crc:
                        raise ValueError("damaged block")
                    start = 0
                    for piece in pieces.tolist():
                        own = raw[4 * start : 4 * (start + piece[3])]
                        rows.append((part, piece[0], block, None if piece[2] else str(piece[1]), block * BLOCK + start, piece[3], zlib.crc32(own)) + ((ids[start : start + piece[3]].tolist(),) if with_ids else ()))
                        start += piece[3]
                yield pd.DataFrame(rows, columns=["part", "doc", "block", "id", "start", "n", "crc", *["ids"] * with_ids])

    rows = spark.read.schema("part int, block bigint, payload binary").parquet(path)
    out = rows.mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("id").cast("bigint")).drop("id")


@F.pandas_udf(LongType())
def joined(parts: pd.Series) -> pd.Series:
    return pd.Series([crc_joined([(4 * int(p["n"]), int(p["crc"])) for p in own]) if len(own) > 1 else 0 for own in parts], dtype="int64")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files."""
    pieces = read_ids(spark, path)
    docs = pieces.groupBy("part", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("_in_part"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("_p"))
    docs = docs.select("part", "doc_id", "_in_part", "n_tokens", F.when(F.size("_p") == 1, F.col("_p")[0]["crc"]).otherwise(joined("_p")).alias("ids_crc32"))
    return docs


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids and reads them back: doc_id, start, n_tokens, ids_crc32 for each row."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id)
    found = stored(documents(spark, path), "ids")
    # one row for each part, in order
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    base = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return found.join(base, "part").select("doc_id", (F.col("_base") + F.col("_in_part")).alias("start"), "n_tokens", "ids_crc32")
