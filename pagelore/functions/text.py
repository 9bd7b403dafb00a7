"""Text expressions: folding, matches with offsets, context, tokens. Offsets count code points from 0."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space in the widest sense that both white-space classes of the corpus share.
SPACE = r"[\s\u0085   -     　]"
NOT_SPACE = r"[^\s\u0085   -     　]"
WORD_CHARACTER = r"[\p{IsAlphabetic}\p{N}_]"
CONTEXT = 40


def fold(text: Column) -> Column:
    """Lower case, code point for code point: the two letters whose lower case depends on place or has two code points are set first."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def literal(needle: str, whole_word: bool = False) -> str:
    """The pattern of a needle."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", needle)
    return f"(?<!{WORD_CHARACTER}){quoted}(?!{WORD_CHARACTER})" if whole_word else quoted


def keyword(words: str) -> str:
    """The pattern of a keyword: trimmed, white space inside matches any run of it."""
    return rf"{SPACE}+".join(literal(w) for w in words.split())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def each(rows: DataFrame, keys: list[str], array: Column, name: str) -> DataFrame:
    """A row for each element of a computed array. An outer explosion with a filter on what comes out: a plain one lets the planner guess that
    the array isn't empty, and that guess works the array out once more below."""
    return rows.select(*keys, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, n: a + n)


def running(numbers: Column) -> Column:
    """The sum of all numbers before each one: of whole blocks, then inside the block. Blocks are as long as there are blocks, so a number costs
    the square root of their count."""
    blocks = lambda n, b: F.transform(F.sequence(F.lit(0), (F.size(n) / b).cast("int")), lambda k: _sum(F.slice(n, k * b + 1, b)))
    before = lambda s: F.transform(s, lambda _, k: _sum(F.slice(s, 1, k)))
    inside = lambda n, b, z: F.transform(n, lambda _, k: F.get(z, (k / b).cast("int")) + _sum(F.slice(n, (k / b).cast("int") * b + 1, k % b)))
    length = lambda n: (F.sqrt(F.size(n)) + 1).cast("int")
    return let(numbers, lambda n: let(length(n), lambda b: let(blocks(n, b), lambda s: let(before(s), lambda z: inside(n, b, z)))))


def matches(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern, left to right, none overlapping: start, length and text of each.

    What stands between matches comes from a split, the matches themselves from an extraction; starts are running sums."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def place(hits: Column, lengths: Column) -> Column:
        steps = F.zip_with(lengths, F.transform(hits, lambda h: F.length(h)), lambda g, h: g + F.coalesce(h, F.lit(0)))
        starts = F.zip_with(running(steps), lengths, lambda s, g: s + g)
        return F.zip_with(hits, F.slice(starts, 1, F.size(hits)), lambda h, s: F.struct(s.alias("start"), F.length(h).alias("length"), h.alias("text")))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: let(gaps, lambda lengths: place(hits, lengths)))


def tokens(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.regexp_extract_all(text, F.lit(f"({NOT_SPACE}+)"), F.lit(1))


def visible(text: Column) -> Column:
    """Code points that are neither white space nor controls."""
    return F.length(text) - F.regexp_count(text, F.lit(rf"[\s\u0085   -     　\p{{Cc}}]"))


def words_plain(text: Column) -> Column:
    """Number of non-empty parts between single spaces."""
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def words_trimmed(text: Column) -> Column:
    """Number of parts between runs of white space."""
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def escape_characters(text: Column, characters: str) -> Column:
    """A backslash before each of the characters."""
    inside = "".join(f"\\{c}" for c in characters)
    return F.regexp_replace(text, f"([{inside}])", r"\\$1")


def csv_plain(value: Column) -> Column:
    """A CSV cell, quoted if it has to be."""
    return F.when(value.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_guarded(value: Column, free_text: bool = True) -> Column:
    """A CSV cell that no spreadsheet takes for a formula; white space at its edges is kept by quotes."""
    v = F.replace(value, F.lit("\r\n"), F.lit("\n"))
    if free_text:
        v = F.when(v.rlike("^[=+\\-@]"), F.concat(F.lit("'"), v)).otherwise(v)
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(v.rlike(f'[,"\n\r]|^{SPACE}|{SPACE}\\z'), quoted).otherwise(v)


def markdown_summary(text: Column) -> Column:
    return escape_characters(text, "\\`*_[]<>#|")


def markdown_flow(text: Column) -> Column:
    """Inline marks anywhere, block marks only as the first character."""
    return F.regexp_replace(text, r"(^[#>\-+=|]|[\\*_\[\]<>`])", r"\\$1")


def xml_text(text: Column) -> Column:
    """Five entities; control characters that XML forbids go."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def link_path(text: Column) -> Column:
    for c, code in ((" ", "%20"), ("(", "%28"), (")", "%29")):
        text = F.replace(text, F.lit(c), F.lit(code))
    return text


def file_title(text: Column, fallback: str = "untitled", most: int = 80) -> Column:
    """A file name from a title: reserved and control characters become `_`, edges are trimmed, dots at the end go."""
    t = F.regexp_replace(text, r'[\\/:*?"<>|\p{Cc}]', "_")
    t = F.substring(F.regexp_replace(F.trim(t), r"[.\s]+$", ""), 1, most)
    return F.when(t == "", F.lit(fallback)).otherwise(t)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def path_key(path: Column) -> Column:
    return F.replace(F.lower(path), F.lit("\\"), F.lit("/"))


def expand(template: Column, values: dict[str, Column | None], absent: str | None = None) -> Column:
    """One pass over `{{name}}` tokens: known names are replaced, the values are not expanded again, unknown tokens stay. A known name
    without value becomes ``absent``, or stays if that is None."""
    names = "|".join(values)
    parts = F.split(template, r"(?=\{\{)|(?<=\}\})", -1)

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, rf"^\{{\{{({names})\}}\}}$", 1)
        out = part
        for k, v in values.items():
            out = F.when(name == k, v if v is not None else (part if absent is None else F.lit(absent))).otherwise(out)
        return out

    return F.array_join(F.transform(parts, one), "")


def pdf_date(raw: Column) -> Column:
    """`D:YYYYMMDDHHmmSS` with an optional zone, or RFC 3339, as `YYYY-MM-DD HH:MM:SS` in UTC; anything else comes back unchanged."""
    iso = F.try_to_timestamp(F.when(F.trim(raw).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.trim(raw)))
    body = F.regexp_replace(F.trim(raw), "^D:", "")
    digits = F.regexp_extract(body, r"^(\d*)", 1)
    part = lambda at, n, default: F.when(F.length(digits) >= at + n - 1, F.substring(digits, at, n)).otherwise(default)
    second = F.lpad(F.least(part(13, 2, "00").cast("int"), F.lit(59)).cast("string"), 2, "0")
    plain = F.try_to_timestamp(F.when(F.length(digits) >= 4, F.concat(part(1, 4, ""), F.lit("-"), part(5, 2, "01"), F.lit("-"), part(7, 2, "01"), F.lit(" "), part(9, 2, "00"), F.lit(":"), part(11, 2, "00"), F.lit(":"), second)))
    zone = F.substring(body, F.length(digits) + 1, F.lit(40))
    number = lambda k: F.coalesce(F.try_element_at(F.regexp_extract_all(zone, F.lit(r"\d+"), F.lit(0)), F.lit(k)).cast("int"), F.lit(0))
    seconds = F.when(F.substring(zone, 1, 1).isin("+", "-"), (number(1) * 3600 + number(2) * 60) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)).otherwise(0)
    moved = F.timestamp_seconds(F.unix_timestamp(plain) - seconds)
    return F.coalesce(F.date_format(F.coalesce(iso, moved), "yyyy-MM-dd HH:mm:ss"), raw)


def byte_size(n: Column) -> Column:
    """Bytes with a unit and one decimal at most."""
    unit = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = F.floor(n / F.pow(F.lit(1024.0), unit) * 10 + 0.5) / 10
    text = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1))


def uri_7bit(text: Column) -> Column:
    """Bytes outside ! to ~ percent-encoded; what is encoded already stays."""
    one = lambda c: F.when((c >= "!") & (c <= "~"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def relative_day(day: Column, today: Column) -> Column:
    """today, yesterday, n days ago within a week, else the date; nothing for no date."""
    n = F.datediff(today, day)
    return F.when(day.isNull(), "").when(n <= 0, "today").when(n == 1, "yesterday").when(n < 7, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
