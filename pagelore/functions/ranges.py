"""Page ranges as text, page labels, numerals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGES = "array<int>"


def _number(token: Column, count: Column) -> Column:
    """A page number of the document, else null."""
    n = F.when(F.trim(token).rlike(r"^\+?\d{1,9}$"), F.trim(token).cast("int"))
    return F.when((n >= 1) & (n <= count), n)


def _result(parts: Column, bad: Column) -> Column:
    """Sorted distinct 0-based pages of parts (lo, hi); null if ``bad`` or nothing is chosen."""
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(p["lo"] - 1, p["hi"] - 1)))))
    return F.when(~bad & (F.size(parts) > 0), pages)


def parse_strict(spec: Column, count: Column) -> Column:
    """`1-3,5,9-`; empty or `all` is every page; backward, open to the left or outside is an error: null."""
    tokens = F.filter(F.transform(F.split(spec, ","), lambda t: F.trim(t)), lambda t: t != "")

    def one(t: Column) -> Column:
        lo = _number(F.substring_index(t, "-", 1), count)
        after = F.trim(F.substring(t, F.instr(t, "-") + 1, F.lit(1000)))
        hi = F.when(~t.contains("-"), lo).when(after == "", count).otherwise(_number(after, count))
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    parts = F.transform(tokens, one)
    bad = F.exists(parts, lambda p: p["lo"].isNull() | p["hi"].isNull() | (p["lo"] > p["hi"]))
    whole = F.trim(F.lower(spec)).isin("", "all")
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast(PAGES))
    good = F.filter(parts, lambda p: p["lo"] <= p["hi"])
    return F.when(whole, every).otherwise(_result(good, bad))


def parse_lenient(spec: Column, count: Column) -> Column:
    """`,` or `;` between parts, `-4` and `8-` are open, backward parts are swapped; empty is null."""
    tokens = F.filter(F.transform(F.split(spec, "[,;]"), lambda t: F.trim(t)), lambda t: t != "")
    shape = r"^(\d*)\s*([-–—]?)\s*(\d*)$"

    def one(t: Column) -> Column:
        a, dash, b = (F.regexp_extract(t, shape, k) for k in (1, 2, 3))
        lo = F.when((a == "") & (dash != ""), F.lit(1)).otherwise(_number(a, count))
        hi = F.when(dash == "", F.when(b == "", lo)).when(b == "", count).otherwise(_number(b, count))
        # least() skips nulls, so a bad end must stay null
        ok = t.rlike(shape) & lo.isNotNull() & hi.isNotNull()
        return F.struct(F.when(ok, F.least(lo, hi)).alias("lo"), F.when(ok, F.greatest(lo, hi)).alias("hi"))

    parts = F.transform(tokens, one)
    return _result(F.filter(parts, lambda p: p["lo"].isNotNull()), F.exists(parts, lambda p: p["lo"].isNull()) | (count <= 0))


def parse_scan(spec: Column, count: Column) -> Column:
    """The third dialect: `,` or `，`, dashes and `~`, no open ends, backward parts are swapped."""
    tokens = F.filter(F.transform(F.split(spec, "[,，]"), lambda t: F.trim(t)), lambda t: t != "")
    shape = r"^(\d+)(?:\s*[-–~]\s*(\d+))?$"

    def one(t: Column) -> Column:
        a, b = F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2)
        lo = _number(a, count)
        hi = F.when(b == "", lo).otherwise(_number(b, count))
        ok = t.rlike(shape) & lo.isNotNull() & hi.isNotNull()
        return F.struct(F.when(ok, F.least(lo, hi)).alias("lo"), F.when(ok, F.greatest(lo, hi)).alias("hi"))

    parts = F.transform(tokens, one)
    return _result(F.filter(parts, lambda p: p["lo"].isNotNull()), F.exists(parts, lambda p: p["lo"].isNull()) | (count <= 0))


def roman(n: Column) -> Column:
    """Lower-case numerals; thousands are repeated, numbers count modulo a million."""
    m = n % 1_000_000
    digit = lambda value, one, five, ten: F.element_at(F.array(*map(F.lit, ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten))), (value + 1).cast("int"))
    return F.concat(F.repeat(F.lit("m"), (m / 1000).cast("int")), digit((m / 100).cast("int") % 10, "c", "d", "m"), digit((m / 10).cast("int") % 10, "x", "l", "c"), digit(m % 10, "i", "v", "x"))


def letters(n: Column) -> Column:
    """a to z, then aa to zz, and so on: one letter, repeated."""
    return F.repeat(F.char(F.lit(97) + (n - 1) % 26), (((n - 1) / 26).cast("int") + 1) % 1000)


def label(style: Column, prefix: Column, n: Column) -> Column:
    """A page label from its range's style."""
    number = (
        F.when(style == "decimal", n.cast("string"))
        .when(style == "roman", roman(n))
        .when(style == "romanUpper", F.upper(roman(n)))
        .when(style == "alpha", letters(n))
        .when(style == "alphaUpper", F.upper(letters(n)))
        .otherwise("")
    )
    return F.concat(F.coalesce(prefix, F.lit("")), number)


def bates(prefix: str, digits: int, start: int, n: Column, suffix: str = "") -> Column:
    """A running number of at least ``digits`` digits; longer ones are not cut."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{digits}d", (n + start).cast("bigint")), F.lit(suffix))


def booklet(count: int) -> list[int | None]:
    """0-based pages in booklet order, None for a blank: sheets of four, outermost first."""
    whole = -(-count // 4) * 4
    order = [p for s in range(whole // 4) for p in (whole - 1 - 2 * s, 2 * s, 2 * s + 1, whole - 2 - 2 * s)]
    return [p if p < count else None for p in order]
