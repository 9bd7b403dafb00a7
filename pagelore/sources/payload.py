"""Pages as binary payloads: a header with counts, sections of words and lines, the text. Built in Arrow batches; the header and the text are read
by column functions, sections in Arrow batches.

Little-endian. Header: four letters, version and the page's bits above the lowest 32 (16 bits each; 0 for most pages), page, characters, words,
lines (32 bits each). A word has its first
character and its length, a line the same (32 bits each). Then the number of bytes of the text, and the text in UTF-8. A buffer that is
shorter than what its header says, or begins with other letters, reads as null."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from pagelore.functions import spans

MAGIC, VERSION, HEADER, WORD, LINE = "PGLR", 1, 24, 8, 8


def number_at(buffer: Column, offset: Column | int, size: int = 4) -> Column:
    """The number of ``size`` bytes at an offset; null beyond the end."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    digits = F.concat(*[F.hex(F.substring(buffer, (offset + 1 + k).cast("int"), F.lit(1))) for k in reversed(range(size))])
    return F.when(offset + size <= F.length(buffer), F.conv(digits, 16, 10).cast("bigint"))


def _encoded(page: pa.Array, text: pa.Array) -> pa.Array:
    words, lines = spans.runs(text), spans.runs(text, spans.line_ends)
    sections = [np.stack(x[1:3], axis=1).astype("<u4").tobytes() for x in (words, lines)]
    out, at = [], [0, 0]
    for p, t, *many in zip(page.to_pylist(), text.to_pylist(), words[0].tolist(), lines[0].tolist(), strict=True):
        own = [x[8 * a : 8 * (a + n)] for x, a, n in zip(sections, at, many, strict=True)]
        at = [a + n for a, n in zip(at, many, strict=True)]
        if p is None or t is None:
            out.append(None)
            continue
        body = t.encode()
        out.append(b"".join((struct.pack("<4sHhIIII", MAGIC.encode(), VERSION, p >> 32, p & 0xFFFFFFFF, len(t), *many), *own, struct.pack("<I", len(body)), body)))
    return pa.array(out, pa.binary())


def encoded(page: Column, text: Column) -> Column:
    """The buffer of a page; null for a null page or text."""
    return F.arrow_udf(_encoded, BinaryType())(page, text)


def header(buffer: Column) -> Column:
    """struct(version, page, chars, words, lines), or null."""
    names = (("chars", 12, 4), ("words", 16, 4), ("lines", 20, 4))
    high = number_at(buffer, 6, 2)
    page = F.shiftleft(high - F.when(high < 1 << 15, 0).otherwise(1 << 16), 32).bitwiseOR(number_at(buffer, 8))
    fields = F.struct(number_at(buffer, 4, 2).alias("version"), page.alias("page"), *[number_at(buffer, at, size).alias(name) for name, at, size in names])
    return F.when((F.length(buffer) >= HEADER) & (F.substring(buffer, 1, 4) == F.encode(F.lit(MAGIC), "UTF-8")), fields)


def text_offset(head: Column) -> Column:
    """Where the text's length stands."""
    return HEADER + head["words"] * WORD + head["lines"] * LINE


def text_of(buffer: Column) -> Column:
    """The text, or null for a short or foreign buffer."""
    at = text_offset(header(buffer))
    size = number_at(buffer, at)
    return F.when(at + 4 + size <= F.length(buffer), F.decode(F.substring(buffer, (at + 5).cast("int"), size.cast("int")), "UTF-8"))


def _spans(buffers: pa.Array, kind: int) -> pa.Array:
    ends, parts = [0], []
    for b in buffers:
        data = b.as_buffer()
        size, known = (data.size, data.size >= HEADER and data[:4].to_pybytes() == MAGIC.encode()) if data is not None else (0, False)
        many = struct.unpack_from("<II", data, 16) if known else (0, 0)
        first = HEADER + sum(many[:kind]) * WORD
        known = known and first + many[kind] * WORD <= size
        parts.append(np.frombuffer(data, "<u4", 2 * many[kind], first) if known else None)
        ends.append(ends[-1] + (many[kind] if known else 0))
    flat = np.concatenate([np.zeros(0, "<u4"), *(p for p in parts if p is not None)]).astype(np.int64).reshape(-1, 2)
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], names=["start", "length"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([p is None for p in parts], pa.bool_()))


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType())]))


def spans_of(buffer: Column, kind: str) -> Column:
    """The words or lines: array of (start, length); null for a short or foreign buffer."""

    def read(buffers: pa.Array) -> pa.Array:
        return _spans(buffers, ("words", "lines").index(kind))

    return F.arrow_udf(read, SPANS)(buffer)
