"""Order-dependent text operators: sentences, paragraphs, line simplification. Each works on one page or stroke at a time."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import regex

#: A line shorter than this part of the longest ends its sentence.
SHORT_LINE = 0.6
ENDS, CLOSERS, TIGHT = ".?!…。？！．", ".?!…。？！．\"'”’)]}」』》〉", "。？！"
MARKER = re.compile(r"\d{1,3}|[A-Za-z]|[ivxlcIVXLC]{1,5}")


#: A mark with all closing marks behind it.
STOP = re.compile(f"[{re.escape(ENDS)}][{re.escape(CLOSERS)}]*")


def line_ends(text: str) -> set[int]:
    """Where a line ends that ends its sentence: a short one, or one before a blank one; not the last."""
    lines = pd.Series(text.split("\n"))
    width, end = lines.str.strip().str.len(), lines.str.len().add(1).cumsum() - 1
    short, before_blank = width < SHORT_LINE * max(1, width.max()), (width.shift(-1) == 0) & (end.index + 2 < len(lines))
    return set(end[(width > 0) & (end.index + 1 < len(lines)) & (short | before_blank)])


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence. Candidates are marks before white space or at the end of the text and the ends of lines; a mark behind
    nothing but a list marker is none."""
    marks = {m.end(): m.start() for m in STOP.finditer(text) if m[0][0] in TIGHT or not text[m.end() : m.end() + 1].strip()}
    ends, spans, begin = line_ends(text) | {len(text)}, [], 0
    for end in sorted(marks.keys() | ends):
        stop = marks.get(end)
        if end not in ends and MARKER.fullmatch(text[begin:stop].strip()):
            continue
        own = text[begin:end]
        if own.strip():
            spans.append((begin + len(own) - len(own.lstrip()), begin + len(own.rstrip())))
        begin = end
    return spans


def speakable(text: str) -> str:
    """White space folded, words joined that a line end had cut."""
    text = regex.sub(r"(\p{L})-\r?\n(\p{Ll})", r"\1\2", text)
    text = regex.sub(r"(\p{L})[\u0002­]\s*(\p{L})", r"\1\2", text)
    return " ".join(re.sub("[\u0002­]", "", text).split())


SENTENCES = "doc_id bigint, k int, start int, stop int, spoken string"


def split_sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(d, k, a, b, speakable(t[a:b])) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for k, (a, b) in enumerate(sentences(t))]
        yield pd.DataFrame(rows, columns=["doc_id", "k", "start", "stop", "spoken"])


def joined(first: str, then: str) -> str:
    """A hyphen between letters before a small letter is a cut word."""
    if len(first) > 1 and first[-1] == "-" and first[-2].isalpha() and then[:1].islower():
        return first[:-1] + then
    return f"{first} {then}"


PARAGRAPHS = "page int, k int, lines int, size double, text string"


def paragraphs(lines: pd.DataFrame) -> pd.DataFrame:
    """lines: page, k, text, size, baseline (upwards), left. A line joins the paragraph above it if its size is within 15 per cent of that
    one's median, it is at most 1.8 sizes below, and its left edge is within 3 sizes."""
    out: list[dict] = []
    for x in lines.sort_values("k").itertuples():
        p = out[-1] if out else None
        if p:
            size = max(1.0, sorted(p["sizes"])[len(p["sizes"]) // 2])
            below = p["baseline"] - x.baseline
            if abs(x.size - size) <= 0.15 * size and 0 < below <= 1.8 * size and abs(x.left - p["left"]) <= 3 * size:
                p["text"] = joined(p["text"], x.text)
                p["sizes"].append(x.size)
                p["baseline"] = x.baseline
                continue
        out.append({"text": x.text, "sizes": [x.size], "baseline": x.baseline, "left": x.left})
    rows = [(lines["page"].iloc[0], k, len(p["sizes"]), sorted(p["sizes"])[len(p["sizes"]) // 2], p["text"]) for k, p in enumerate(out)]
    return pd.DataFrame(rows, columns=["page", "k", "lines", "size", "text"])


STROKE = "stroke int, k int, x double, y double"


def simplify(points: pd.DataFrame, most: float = 1.0) -> pd.DataFrame:
    """points: stroke, k, x, y. The points that keep the line within ``most`` of all others: between two kept ones the farthest is kept
    too while it is farther away than that."""
    p = points.sort_values("k").reset_index(drop=True)
    xy = list(zip(p["x"], p["y"], strict=True))
    keep, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = xy[a], xy[b]
        length = (bx - ax) ** 2 + (by - ay) ** 2

        def far(k: int, ax=ax, ay=ay, bx=bx, by=by, length=length) -> float:
            t = 0.0 if length == 0 else min(1.0, max(0.0, ((xy[k][0] - ax) * (bx - ax) + (xy[k][1] - ay) * (by - ay)) / length))
            return math.hypot(xy[k][0] - ax - t * (bx - ax), xy[k][1] - ay - t * (by - ay))

        k = max(range(a + 1, b), key=far, default=None)
        if k is not None and far(k) > most:
            keep.add(k)
            todo += [(a, k), (k, b)]
    return p.loc[sorted(keep), ["stroke", "k", "x", "y"]]


MERGED = "page int, k int, text string, l double, r double"


def word_boxes(chars: pd.DataFrame) -> pd.DataFrame:
    """chars: page, k, ch, l, r, baseline, size. Words: broken at white space, at a baseline that moves by over half the size, at a gap
    of over a quarter of it, or a step back of over half, all against the word so far."""
    out: list[dict] = []
    open_ = False
    for c in chars.sort_values("k").itertuples():
        if c.ch.isspace():
            open_ = False
            continue
        w = out[-1] if out else None
        if open_ and abs(c.baseline - w["baseline"]) <= 0.5 * c.size and -0.5 * c.size <= c.l - w["r"] <= 0.25 * c.size:
            w["text"] += c.ch
            w["l"], w["r"] = min(w["l"], c.l), max(w["r"], c.r)
        else:
            out.append({"text": c.ch, "l": c.l, "r": c.r, "baseline": c.baseline})
        open_ = True
    rows = [(chars["page"].iloc[0], k, w["text"], w["l"], w["r"], w["baseline"]) for k, w in enumerate(out)]
    return pd.DataFrame(rows, columns=["page", "k", "text", "l", "r", "baseline"])
