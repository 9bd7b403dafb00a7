"""Hard-negative mining by blocked dense products.

A row's score is the integer inner product of its vector with the anchor's, each component x taken as floor(SCALE * x). Anchors are broadcast
in blocks of at most about BLOCK_BYTES; every task multiplies its rows with the block, tile by tile, in float64, which is exact while sums
stay under 2**53 (checked row by row; larger vectors are multiplied as Python integers). The first pass keeps for each anchor the best
rows of its own label, the second the best rows of other labels inside each positive's window of scores. What a task keeps is a table of
fixed size for each anchor of the block, and such tables merge: a task sends one at its end, and a window by anchor takes the best of them.

So the rows never move, no pair of rows leaves a task unless it is among the task's best, and a block costs two scans. More anchors mean
more blocks; their distinct rows are stored once, dealt to blocks by hash.

Defined cases: a row with a null id, label or vector, or with a null or non-finite component takes no part; vectors of different lengths
are never compared; all empty vectors score 0; scores beyond 64 bits count as the largest of their sign; rows with the anchor's own id
are no partners of it; an id in several rows is a partner with each of them, and an anchor with each distinct one; repeated anchor rows
count once; ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import stored

#: A component x counts as floor(SCALE * x). Bytes of a block of anchors; anchors and rows of a tile.
SCALE, BLOCK_BYTES, TILE, WIDTH = 256, 32_000_000, 1024, 2048

#: Partners kept of each anchor, and of each anchor and positive.
POSITIVES, NEGATIVES = 5, 10

#: A negative's score is at least and at most so many hundredths of the positive's.
LOW, HIGH = 30, 90

#: Sums of products stay exact in float64 below this.
EXACT = 2.0**53

NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    picked = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>"))
    return picked.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)


@dataclass
class Vectors:
    """Rows of one length: values are floor(SCALE * x) in float64; ``wide`` marks those whose products may be inexact."""

    ids: np.ndarray
    labels: np.ndarray
    raw: np.ndarray
    values: np.ndarray = field(init=False)
    wide: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        with np.errstate(over="ignore"):
            self.values = np.floor(self.raw * SCALE)
        limit = np.sqrt(EXACT / max(1, self.raw.shape[1]))
        self.wide = ~(np.abs(self.values) < limit).all(axis=1)
        self.raw = np.where(self.wide[:, None], self.raw, 0) if self.wide.any() else self.raw[:0]

    def __len__(self) -> int:
        return len(self.ids)

    def whole(self, at: np.ndarray) -> list[list[int]]:
        """The same components as Python integers."""
        raw = self.raw if len(self.raw) else np.zeros_like(self.values)
        out = []
        for k in at:
            source = raw[k] if self.wide[k] else self.values[k] / SCALE
            out.append([int(np.floor(x * SCALE)) if abs(x) < 2.0**900 else int(x) * SCALE for x in source.tolist()])
        return out


def by_length(batch: pa.RecordBatch | pa.Table) -> dict[int, Vectors]:
    """The rows of a batch by length of vector."""
    if isinstance(batch, pa.RecordBatch):
        batch = pa.Table.from_batches([batch])
    batch = batch.combine_chunks()
    if not batch.num_rows:
        return {}
    ids, labels = (batch[c].to_numpy().astype(np.int64) for c in ("vec_id", "label"))
    lists = batch["embedding"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = Vectors(ids[at], labels[at], flat[(offsets[at][:, None] + np.arange(n)).ravel()].reshape(len(at), n))
    return out


class Best:
    """The best k (score, id) of each place, as tables that merge."""

    def __init__(self, places: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.full((places, k), NONE), np.full((places, k), MOST)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(place):
            return
        met = np.unique(place)
        place = np.concatenate([place, np.repeat(met, self.k)])
        score = np.concatenate([score, self.scores[met].ravel()])
        ids = np.concatenate([ids, self.ids[met].ravel()])
        order = np.lexsort((ids, ~score, place))
        place, score, ids = place[order], score[order], ids[order]
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        kept = nth < self.k
        self.scores[place[kept], nth[kept]] = score[kept]
        self.ids[place[kept], nth[kept]] = ids[kept]

    def offer(self, first: int, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """A tile of exact float64 scores of the places from ``first`` on: only what can be among the best is sorted."""
        least = self.scores[first : first + len(scores), -1].astype(np.float64)
        if scores.shape[1] > self.k:
            at = scores.shape[1] - self.k
            least = np.maximum(least, np.partition(np.where(fits, scores, -np.inf), at, axis=1)[:, at])
        row, col = np.nonzero(fits & (scores >= least[:, None]))
        self.add(row + first, scores[row, col].astype(np.int64), ids[col])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, nth = np.nonzero(self.scores > NONE)
        return place, self.scores[place, nth], self.ids[place, nth]


def products(anchors: Vectors, rows: Vectors) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first anchor, places of rows, exact scores in float64) of tiles, for the pairs of vectors that are not wide."""
    plain = np.flatnonzero(~rows.wide)
    left = np.where(anchors.wide[:, None], 0, anchors.values) if anchors.wide.any() else anchors.values
    for b in range(0, len(plain), WIDTH):
        at = plain[b : b + WIDTH]
        right = rows.values[at].T
        for a in range(0, len(anchors), TILE):
            yield a, at, left[a : a + TILE] @ right


def wide_products(anchors: Vectors, rows: Vectors) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, places of rows, scores in int64) of the pairs with a wide vector."""
    far = np.flatnonzero(rows.wide)
    everything = np.arange(len(rows)) if anchors.wide.any() else far
    whole = dict(zip(everything.tolist(), rows.whole(everything), strict=True))
    for a in range(len(anchors)) if len(everything) else ():
        at = everything if anchors.wide[a] else far
        own = anchors.whole([a])[0]
        found = [max(-MOST, min(MOST, sum(x * y for x, y in zip(own, whole[k], strict=True)))) for k in at.tolist()]
        if len(at):
            yield a, at, np.array(found, dtype=np.int64)


def _positives(block: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(len(v), k) for n, v in block.value.items()}
        for batch in batches:
            for n, rows in by_length(batch).items():
                if n not in best:
                    continue
                anchors = block.value[n]
                for a, at, scores in products(anchors, rows):
                    part = slice(a, a + len(scores))
                    fits = (anchors.labels[part, None] == rows.labels[at]) & (anchors.ids[part, None] != rows.ids[at]) & ~anchors.wide[part, None]
                    best[n].offer(a, scores, fits, rows.ids[at])
                for a, at, scores in wide_products(anchors, rows):
                    fits = (anchors.labels[a] == rows.labels[at]) & (anchors.ids[a] != rows.ids[at])
                    best[n].add(np.full(fits.sum(), a), scores[fits], rows.ids[at][fits])
        for n, table in best.items():
            place, score, ids = table.found()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), n)), pa.array(place), pa.array(score), pa.array(ids)], names=["length", "anchor", "score", "vec_id"])

    return run


def bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers x with low * score <= 100 * x <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(block: Broadcast, windows: Broadcast, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least, most = {}, {}, {}
        for n, (_, scores) in windows.value.items():
            best[n] = [Best(len(scores), k) for _ in range(scores.shape[1])]
            limits = [[bounds(int(s), low, high) if s > NONE else (MOST, NONE) for s in row] for row in scores]
            least[n], most[n] = (np.array([[max(-MOST, x[c]) for x in row] for row in limits], dtype=np.int64).reshape(scores.shape) for c in (0, 1))
        for batch in batches:
            for n, rows in by_length(batch).items():
                if n not in best:
                    continue
                anchors = block.value[n]
                for a, at, scores in products(anchors, rows):
                    part = slice(a, a + len(scores))
                    other = (anchors.labels[part, None] != rows.labels[at]) & (anchors.ids[part, None] != rows.ids[at]) & ~anchors.wide[part, None]
                    for j, table in enumerate(best[n]):
                        fits = other & (scores >= least[n][part, j, None].astype(np.float64)) & (scores <= most[n][part, j, None].astype(np.float64))
                        table.offer(a, scores, fits, rows.ids[at])
                for a, at, scores in wide_products(anchors, rows):
                    other = (anchors.labels[a] != rows.labels[at]) & (anchors.ids[a] != rows.ids[at])
                    for j, table in enumerate(best[n]):
                        fits = other & (scores >= least[n][a, j]) & (scores <= most[n][a, j])
                        table.add(np.full(fits.sum(), a), scores[fits], rows.ids[at][fits])
        for n, tables in best.items():
            anchor_ids, (ids, scores) = block.value[n].ids, windows.value[n]
            for j, table in enumerate(tables):
                place, score, vec = table.found()
                columns = [np.full(len(place), n), place, np.full(len(place), j), anchor_ids[place], ids[place, j], scores[place, j], vec, score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["length", "anchor", "slot", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def blocks(anchors: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[dict[int, Vectors]]:
    """All distinct anchors, in blocks of bounded size."""
    kept = stored(anchors.distinct(), "anchors")
    size = kept.agg(F.sum(8 * (F.size("embedding") + 2))).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        found = by_length(kept.filter(F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(n)) == k).toArrow())
        if found:
            yield found


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``is_anchor`` is over vec_id, label, embedding."""
    rows = usable(rows)
    context = rows.sparkSession.sparkContext
    out = rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    for found in blocks(rows.filter(is_anchor), block_bytes):
        block = context.broadcast(found)
        best = rows.mapInArrow(_positives(block, positives), "length bigint, anchor bigint, score bigint, vec_id bigint")
        order = Window.partitionBy("length", "anchor").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives).toArrow()  # at most ``positives`` rows for each anchor of the block
        tables = {n: (np.full((len(v), positives), MOST), np.full((len(v), positives), NONE)) for n, v in found.items()}
        lengths, at, nth, ids, scores = (best[c].to_numpy() for c in ("length", "anchor", "nth", "vec_id", "score"))
        for n, (to_ids, to_scores) in tables.items():
            own = lengths == n
            to_ids[at[own], nth[own] - 1], to_scores[at[own], nth[own] - 1] = ids[own], scores[own]
        schema = "length bigint, anchor bigint, slot bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
        mined = rows.mapInArrow(_negatives(block, context.broadcast(tables), negatives, low, high), schema)
        order = Window.partitionBy("length", "anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
        mined = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        out = out.unionByName(mined.select(*out.columns))
    return out
