"""Personal data in text: patterns, merged spans, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelore.functions.text import matches

#: The accepted shapes. Resident number, phone, mailbox, grouped and plain account numbers.
RRN = r"(?<!\d)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\s?[-‐–]?\s?[1-4]\d{6}(?!\d)"
PHONE = r"(?<![\d+])(?:\+82[-.\s]?\(?0?|\(?0)(?:1[016789]|2|[3-6][1-5]|70|50[2-8])\)?[-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)"
EMAIL = r"(?:[A-Za-z0-9._%+-]+|[가-힣]+)@(?:(?:[A-Za-z0-9-]+|[가-힣]+)\.)+(?:[A-Za-z]{2,}|한국)(?![A-Za-z0-9])"
ACCOUNT_GROUPED = r"(?<![\d-])\d{2,6}(?:-\d{2,8}){2,3}(?![\d-])"
ACCOUNT_PLAIN = r"(?<!\d)\d{11,14}(?!\d)"

SPAN = "array<struct<start:int,end:int,kind:string>>"
KINDS = ("rrn", "phone", "email", "account")


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["length"]).alias("end"), F.lit(kind).alias("kind")))


def accounts(text: Column) -> Column:
    """Account numbers of both shapes, without those that are phone numbers."""
    digits = lambda m: F.length(F.regexp_replace(m["text"], r"\D", ""))
    not_phone = lambda m: ~m["text"].rlike(f"^(?:{PHONE})$")
    grouped = F.filter(matches(text, ACCOUNT_GROUPED), lambda m: (digits(m) >= 10) & (digits(m) <= 16) & not_phone(m))
    return F.concat(grouped, F.filter(matches(text, ACCOUNT_PLAIN), not_phone))


def find(text: Column, kinds: tuple[str, ...] = KINDS, keyword: str | None = None) -> Column:
    """Spans of all kinds, not yet merged."""
    simple = {"rrn": RRN, "phone": PHONE, "email": EMAIL}
    parts = [_spans(accounts(text) if k == "account" else matches(text, simple[k]), k) for k in kinds]
    if keyword:
        parts.insert(0, _spans(matches(text, keyword), "keyword"))
    return F.concat(*parts)


def merge(spans: Column) -> Column:
    """Overlapping spans become one with the first one's kind; spans that only touch stay apart."""
    # by start, then the longer one first
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        own = F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kind"].alias("kind"))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], -s["back"]).alias("end"), last["kind"].alias("kind"))
        overlaps = (F.size(done) > 0) & (s["start"] < last["end"])
        return F.when(overlaps, F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), joined)).otherwise(F.array_append(done, own))

    return F.aggregate(ordered, F.array().cast(SPAN), step)


def kept_runs(text: Column, merged: Column) -> Column:
    """What merged spans leave: start and text of each run between them; blank ones are dropped."""
    edges = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
    stops = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(text)))
    runs = F.zip_with(edges, stops, lambda a, b: F.struct(a.alias("start"), F.substring(text, a + 1, b - a).alias("text")))
    return F.filter(runs, lambda r: F.trim(r["text"]) != "")


def redact(text: Column, merged: Column, mask: str = "█") -> Column:
    """The text with every code point of the spans masked: its length stays."""
    edges = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
    stops = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.zip_with(edges, stops, lambda a, b: F.substring(text, a + 1, b - a))
    hidden = F.concat(F.transform(merged, lambda s: F.repeat(F.lit(mask), s["end"] - s["start"])), F.array(F.lit("")))
    return F.array_join(F.zip_with(kept, hidden, lambda a, b: F.concat(a, b)), "")
