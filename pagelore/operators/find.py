"""Matches of a pattern in whole texts, with offsets and contexts: one pass over each text, in Arrow batches.

In column functions an offset is a running sum over all gaps before it, worked out for each text in interpreted steps; here the matcher knows
it. Keys go through as they are and are repeated for the rows of a text by their index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pagelore.functions import spans
from pagelore.functions import text as T
from pagelore.functions.text import CONTEXT

#: Rows of a batch that is given out.
ROWS = 50_000

LINE_ENDS = str.maketrans("\r\n", "  ")


def folded(text: str) -> str:
    """Lower case, code point for code point."""
    return text.replace("İ", "i").replace("Σ", "σ").lower()


def python_pattern(pattern: str) -> str:
    """The same pattern in this matcher's words."""
    return pattern.replace(r"\p{IsAlphabetic}", r"\p{Alphabetic}")


def _matches(pattern: str, match_case: bool, around: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(python_pattern(pattern)).finditer
        for batch in batches:
            keys = batch.select([c for c in batch.schema.names if c != "text"])
            row, start, length, context, at = [], [], [], [], []

            def out() -> pa.RecordBatch:
                columns = [c.take(pa.array(row, pa.int32())) for c in keys.columns] + [pa.array(start, pa.int32()), pa.array(length, pa.int32())]
                names = [*keys.schema.names, "char_start", "char_length"]
                if around is not None:
                    columns, names = [*columns, pa.array(context, pa.string()), pa.array(at, pa.int32())], [*names, "context", "context_at"]
                for x in (row, start, length, context, at):
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names=names)

            for k, text in enumerate(batch["text"].to_pylist()):
                if not text:
                    continue
                for m in find(text if match_case else folded(text)):
                    a, b = m.span()
                    row.append(k)
                    start.append(a)
                    length.append(b - a)
                    if around is not None:
                        low = a - around if a > around else 0
                        context.append(text[low : b + around])
                        at.append(a - low)
                if len(row) >= ROWS:
                    context[:] = [c.translate(LINE_ENDS) if "\n" in c or "\r" in c else c for c in context]
                    yield out()
            context[:] = [c.translate(LINE_ENDS) if "\n" in c or "\r" in c else c for c in context]
            if row:
                yield out()

    return run


def places(docs: DataFrame, keys: list[str], pattern: str, match_case: bool = False, around: int | None = None) -> DataFrame:
    """A row for each match in ``text``: keys, char_start, char_length; with ``around`` also what stands so far around it, line ends as blanks, and
    where the match begins in that."""
    rows = docs.select(*keys, F.col("text"))
    more = [StructField("context", StringType()), StructField("context_at", IntegerType())] if around is not None else []
    schema = StructType([f for f in rows.schema if f.name != "text"] + [StructField("char_start", IntegerType()), StructField("char_length", IntegerType()), *more])
    return rows.mapInArrow(_matches(pattern, match_case, around), schema)


def hits(docs: DataFrame, keys: list[str], pattern: str, match_case: bool = False, around: int = CONTEXT) -> DataFrame:
    """A row for each match: keys, char_start, char_length, context, context_at."""
    return places(docs, keys, pattern, match_case, around)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in spans.slices(batch):
            many, start, length, found = spans.runs(part["text"])
            row = pa.array(np.repeat(np.arange(part.num_rows, dtype=np.int32), many))
            names = [c for c in part.schema.names if c != "text"]
            numbers = [pa.array(x, pa.int32()) for x in (spans.numbers_in(many).astype(np.int32), start, length)]
            yield pa.RecordBatch.from_arrays([*(part[c].take(row) for c in names), *numbers, found], names=[*names, "k", "start", "length", "key"])


def words(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each maximal run without white space in ``text``: keys, k (its number from 0), start, length, key (the run, folded)."""
    # folding keeps each code point's place
    rows = docs.select(*keys, T.fold(F.col("text")).alias("text"))
    more = [StructField(c, IntegerType()) for c in ("k", "start", "length")] + [StructField("key", StringType())]
    return rows.mapInArrow(_words, StructType([f for f in rows.schema if f.name != "text"] + more))
