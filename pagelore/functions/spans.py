"""Runs of characters in whole texts, with offsets in code points: array steps over the bytes of an Arrow batch, one pass over all its texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of ``text.SPACE``: single bytes, and the UTF-8 of what is beyond ASCII.
NARROW = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

#: Bytes of text that are worked on at once; a longer text is worked on whole.
AT_ONCE = 1 << 20


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    found = NARROW[data]
    for lead in sorted({c[0] for c in WIDE}):
        at = np.flatnonzero(data == lead)
        for c in (c for c in WIDE if c[0] == lead and len(at)):
            here = at[at + len(c) <= len(data)]
            here = here[np.logical_and.reduce([data[here + k] == c[k] for k in range(1, len(c))])]
            for k in range(len(c)):
                found[here + k] = True
    return found


def line_ends(data: np.ndarray) -> np.ndarray:
    return data == ord("\n")


def runs(texts: pa.Array, gaps: Callable[[np.ndarray], np.ndarray] = spaces) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The maximal runs of what ``gaps`` doesn't mark, text by text: how many each text has, their starts, lengths and texts. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~gaps(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    many = np.diff(np.searchsorted(starts, offsets))
    # code points before each byte
    place = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data & 0xC0 != 0x80, out=place[1:])
    sizes = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=sizes[1:])
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(data[inside])))
    return many, place[starts] - np.repeat(place[offsets[:-1]], many), place[ends] - place[starts], found


def slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts with about AT_ONCE bytes in column ``name``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[name]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        until = max(first + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        yield batch.slice(first, until - first)
        first = until


def numbers_in(many: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each group of ``many`` rows."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
