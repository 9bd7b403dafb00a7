"""Stamps on pages: watermarks, headers and footers with templates, page selections, places and running numbers; sizes and layouts of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.functions import text as T

#: Sheets in points, longest side of a page, least side.
A4, LETTER, MOST_SIDE, LEAST_SIDE = (595.28, 841.89), (612.0, 792.0), 14_400.0, 1.0

#: Documents of a block whose numbers are summed before the blocks are.
BLOCK = 1000

ANCHORS = ("topLeft", "top", "topRight", "left", "center", "right", "bottomLeft", "bottom", "bottomRight")


def selected(page: Column, ranges: Column) -> Column:
    """Whether a page (from 0) is in one of the ranges (first, last); null means every page."""
    return ranges.isNull() | F.exists(ranges, lambda r: (page >= r["first"]) & (page <= r["last"]))


def place(anchor: Column, margin: Column, width: Column, height: Column, w: Column, h: Column, turn: Column) -> tuple[Column, Column]:
    """Bottom left of a stamp of w by h, turned by ``turn`` degrees about its middle, on a page of width by height: its turned box is what the
    anchor and the margin place."""
    c, s = F.abs(F.cos(F.radians(turn))), F.abs(F.sin(F.radians(turn)))
    bw, bh = w * c + h * s, w * s + h * c
    x = F.when(anchor.isin("topLeft", "left", "bottomLeft"), margin).when(anchor.isin("topRight", "right", "bottomRight"), width - margin - bw).otherwise((width - bw) / 2)
    y = F.when(anchor.isin("bottomLeft", "bottom", "bottomRight"), margin).when(anchor.isin("topLeft", "top", "topRight"), height - margin - bh).otherwise((height - bh) / 2)
    return x + (bw - w) / 2, y + (bh - h) / 2


def numbered(rows: DataFrame, doc: str, page: str) -> DataFrame:
    """``rows`` with ``nth``, from 0 over all documents in order and their pages in order: numbers go on from file to file. Counts of documents
    are summed in blocks and blocks over all, so the one task that sees all blocks sees a thousandth of the documents."""
    block = F.floor(F.col(doc) / BLOCK)
    sizes = rows.groupBy(doc).agg(F.count("*").alias("_n")).withColumn("_block", block)
    totals = sizes.groupBy("_block").agg(F.sum("_n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_block").orderBy(doc).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_inside", inside).join(totals.select("_block", before.alias("_before")), "_block").select(doc, (F.col("_inside") + F.col("_before")).alias("_start"))
    own = F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1
    return rows.withColumn("_own", own).join(starts, doc).withColumn("nth", F.col("_own") + F.col("_start")).drop("_own", "_start")


def label(prefix: Column, start: Column, nth: Column, digits: Column, suffix: Column) -> Column:
    """A running number between a prefix and a suffix; a number wider than its digits is written in full."""
    number = (start + nth).cast("string")
    return F.concat(prefix, F.repeat(F.lit("0"), F.greatest(digits - F.length(number), F.lit(0))), number, suffix)


def add(pages: DataFrame, specs: DataFrame, date: str) -> DataFrame:
    """doc_id, page, spec, role, text, x, y for pages (doc_id, page, total, filename, width, height, group) and specs (spec, group, role,
    template, ranges, anchor, margin, turn, size, start, digits, prefix, suffix). Each group has some specs; a running number counts the
    pages that a spec stamps, on through all documents."""
    rows = pages.join(specs, "group").filter(selected(F.col("page"), F.col("ranges")))
    parts = []
    for (spec,) in specs.select("spec").distinct().orderBy("spec").collect():  # specs are a user's few
        parts.append(numbered(rows.filter(F.col("spec") == spec), "doc_id", "page"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    values = {"page": (F.col("page") + 1).cast("string"), "total": F.col("total").cast("string"), "date": F.lit(date), "filename": F.col("filename"), "bates": label(F.col("prefix"), F.col("start"), F.col("nth"), F.col("digits"), F.col("suffix"))}
    rows = rows.withColumn("text", T.expand(F.col("template"), values))
    # half a size for a character, 1.2 sizes for a line
    x, y = place(F.col("anchor"), F.col("margin"), F.col("width"), F.col("height"), F.length("text") * F.col("size") * 0.5, F.col("size") * 1.2, F.col("turn"))
    return rows.select("doc_id", "page", "spec", "role", "text", (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


def remove(stamps: DataFrame, role: str | None = None, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """What stays: stamps of other roles or on other pages. Stamps without a role go only when all roles do."""
    goes = F.lit(True) if role is None else F.coalesce(F.col("role") == role, F.lit(False))
    if ranges is not None:
        goes = goes & selected(F.col("page"), F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ranges]))
    return stamps.filter(~goes)


def layout(w: Column, h: Column, sheet: Column, contain: Column, margin: Column) -> Column:
    """struct(page_w, page_h, x, y, w, h): an image of w by h points on its own page (sheet null) or on A4 or letter, turned with the image;
    contained: as large as fits, else its own size if that fits."""
    w, h = F.greatest(w, F.lit(0.01)), F.greatest(h, F.lit(0.01))
    own = F.least((MOST_SIDE - 2.0 * margin) / w, (MOST_SIDE - 2.0 * margin) / h, F.lit(1.0))
    ow, oh = F.greatest(w * own, F.lit(1.0)), F.greatest(h * own, F.lit(1.0))
    short, long = F.when(sheet == "a4", A4[0]).otherwise(LETTER[0]), F.when(sheet == "a4", A4[1]).otherwise(LETTER[1])
    pw, ph = F.when(w > h, long).otherwise(short), F.when(w > h, short).otherwise(long)
    fit = F.least(F.greatest(pw - 2.0 * margin, F.lit(1.0)) / w, F.greatest(ph - 2.0 * margin, F.lit(1.0)) / h)
    scale = F.when(contain, fit).otherwise(F.least(fit, F.lit(1.0)))
    iw, ih = w * scale, h * scale
    either = lambda a, b: F.when(sheet.isNull(), a).otherwise(b)
    fields = {"page_w": either(ow + 2.0 * margin, pw), "page_h": either(oh + 2.0 * margin, ph), "x": either(margin, (pw - iw) / 2.0), "y": either(margin, (ph - ih) / 2.0), "w": either(ow, iw), "h": either(oh, ih)}
    return F.struct(*[v.cast("double").alias(k) for k, v in fields.items()])


def resized(left: Column, bottom: Column, right: Column, top: Column, w: Column, h: Column, scaled: Column) -> Column:
    """struct(s, tx, ty): what maps a page's visible box into a page of w by h, scaled to fit or only centred."""
    cw, ch = F.greatest(right - left, F.lit(LEAST_SIDE)), F.greatest(top - bottom, F.lit(LEAST_SIDE))
    s = F.when(scaled, F.least(w / cw, h / ch)).otherwise(1.0)
    return F.struct(s.alias("s"), ((w - cw * s) / 2.0 - left * s).alias("tx"), ((h - ch * s) / 2.0 - bottom * s).alias("ty"))
