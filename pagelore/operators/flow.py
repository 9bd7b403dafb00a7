"""What an edited paragraph does to the rest of its page: what follows it, what is in the way, how far things may move, and the decision.

Boxes (page, item, kind, line, l, b, r, t; y upwards; kind content, paragraph, fixed or widget) are swept from the bottom upwards and from the
obstacle upwards by windows over the page; a page is the only group. The column is the paragraph's old and new width, widened by text below
that shares a margin with it, in rounds until no page's column grows. Left out: list markers and short last lines beside the column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.sources.scratch import stored

#: Fixed values, in sizes of the text: tolerance of "below", reach of a margin. Shares of a width: overlap and overhang of what is in the column,
#: width of a container. Gaps above a footer in line steps: as a rule, for a short one, for a short one in the margin. Shares of a short,
#: narrow and centred footer, of the page's height that is the footer's, of a tall object. Points: margins, tolerances.
BELOW, BLOCK_EDGE = 0.25, 2.5
OVERLAP, OVERHANG, CONTAINER = 0.6, 0.15, 0.5
FOOTER_GAP, FOOTER_GAP_SHORT, FOOTER_GAP_MARGIN = 2.0, 1.5, 0.75
SHORT, NARROW, CENTRED, BAND, TALL = 0.25, 0.8, 0.05, 0.2, 0.5
FOOTER_MARGIN, BOTTOM_MARGIN, INSET, EDGE, MIN_SHIFT = 72.0, 18.0, 3.0, 1.0, 0.05

C = F.col


def overlap() -> Column:
    return F.least("r", "cr") - F.greatest("l", "cl")


def in_column() -> Column:
    slack = OVERHANG * (C("cr") - C("cl"))
    return (overlap() >= OVERLAP * (C("r") - C("l"))) & (C("l") >= C("cl") - slack) & (C("r") <= C("cr") + slack)


def columns(boxes: DataFrame, edits: DataFrame) -> DataFrame:
    """edits with cl, cr: the column of each page's paragraph."""
    lines = stored(boxes.filter("kind = 'content' AND line").select("page", "l", "r", "t"), "lines")
    now = edits.select("page", "ob", "size", F.least("ol", "nl").alias("cl"), F.greatest("or", "nr").alias("cr"))
    while True:
        edge = BLOCK_EDGE * C("size")
        joins = (F.abs(C("l") - C("cl")) <= edge) | (F.abs(C("r") - C("cr")) <= edge) | ((C("l") <= C("cl") + edge) & (C("r") >= C("cr") - edge))
        wide = lines.join(now, "page").filter((C("t") <= C("ob") + BELOW * C("size")) & (overlap() > 0) & ~in_column() & joins)
        grown = wide.groupBy("page").agg(F.min("l").alias("gl"), F.max("r").alias("gr"))
        new = now.join(grown, "page", "left").select("page", "ob", "size", F.least("cl", "gl").alias("cl"), F.greatest("cr", "gr").alias("cr"), (F.least("cl", "gl") < C("cl")).alias("a"), (F.greatest("cr", "gr") > C("cr")).alias("b"))
        new = stored(new, "columns")
        now = new.drop("a", "b")
        if not new.filter("a OR b").head(1):
            return edits.join(now.select("page", "cl", "cr"), "page")


def footers(boxes: DataFrame) -> DataFrame:
    """page, item, footer_top of the boxes at the bottom of the column that look like a running footer: apart from what is above by a gap."""
    tall = C("t") - C("b") <= TALL * (C("ct") - C("cb"))
    body = boxes.filter(C("kind").isin("content", "paragraph") & tall & (C("t") > C("cb")) & (C("b") < C("ct")) & (overlap() > 0))
    up = Window.partitionBy("page").orderBy("b", "item")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    width = C("right") - C("left")
    swept = body.withColumn("top", F.max("t").over(before)).withColumn("left", F.min("l").over(before)).withColumn("right", F.max("r").over(before))
    short, low = width <= SHORT * (C("cr") - C("cl")), C("top") <= C("cb") + FOOTER_MARGIN
    need = F.when(short & low, FOOTER_GAP_MARGIN).when(short, FOOTER_GAP_SHORT).otherwise(FOOTER_GAP) * F.greatest("leading", "size")
    swept = swept.withColumn("gap", C("top").isNotNull() & (C("b") - C("top") >= need))
    swept = swept.withColumn("split", F.max(C("gap").cast("int")).over(up))
    above = swept.withColumn("nth", F.row_number().over(Window.partitionBy("page", "split").orderBy("b", "item"))).filter("split = 1 AND nth = 1")
    centred = (width < NARROW * (C("cr") - C("cl"))) & (F.abs((C("left") + C("right")) / 2 - (C("cl") + C("cr")) / 2) <= CENTRED * (C("cr") - C("cl")))
    found = above.filter((C("top") <= C("cb") + BAND * (C("ct") - C("cb"))) & (short | low | centred)).select("page", C("top").alias("footer_top"))
    own = swept.filter("split = 0").join(found, "page")
    text = own.filter("kind = 'paragraph'").select("page").distinct()
    return own.join(text, "page", "left_anti").select("page", "item", "footer_top")


def plan(boxes: DataFrame, edits: DataFrame) -> DataFrame:
    """For each of edits (page, ol, ob, or, ot: the paragraph before, nl, nr: its new sides, size, leading, cb, ct: bottom and top of the page)
    page, movable (items), room, limited_by, free, gap, nothing_below."""
    edits = columns(boxes, edits)
    rows = boxes.filter("r >= l AND t >= b AND (r > l OR t > b)").join(edits, "page")
    foot = footers(rows)
    rows = rows.join(foot, ["page", "item"], "left")
    below = C("t") <= C("ob") + BELOW * C("size")
    content, own = C("footer_top").isNull() & (C("kind") == "content"), C("footer_top").isNull()
    container = content & ~below & ~C("line") & (C("b") < C("ob") - BELOW * C("size")) & (C("t") - C("b") <= TALL * (C("ct") - C("cb"))) & (overlap() >= CONTAINER * (C("cr") - C("cl")))
    candidate = content & below & in_column()
    across = content & below & ~in_column() & (overlap() > 0)
    fixed = own & C("kind").isin("fixed", "widget") & below & (overlap() > 0)
    stop = F.when(container, C("b") + INSET).when(across | fixed, C("t")).when(~own, C("footer_top"))
    rows = rows.withColumn("candidate", candidate).withColumn("stop", stop).withColumn("something", candidate | across | fixed | ~own)
    # the obstacle rises through what straddles its top: an unbroken chain of candidates from there upwards
    page = Window.partitionBy("page")
    rows = rows.withColumn("y", F.max("stop").over(page))
    up = page.orderBy(F.when(C("candidate"), C("b")), "item").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("so_far", F.greatest("y", F.max(F.when(C("candidate"), C("t"))).over(up)))
    broken = F.when(C("candidate") & (C("b") >= C("so_far") - EDGE), 1).otherwise(0)
    rows = rows.withColumn("broken", F.max(broken).over(page.orderBy(F.when(C("candidate"), C("b")), "item")))
    rows = rows.withColumn("y", F.greatest("y", F.max(F.when(C("candidate") & (C("broken") == 0) & C("y").isNotNull(), C("t"))).over(page)))
    movable = C("candidate") & (C("y").isNull() | (C("b") >= C("y") - EDGE))
    lowest = F.when(C("kind").isin("content", "paragraph") & own & (C("t") - C("b") <= TALL * (C("ct") - C("cb"))) & (C("t") > C("cb")) & (C("b") < C("ct")), C("b"))
    took = rows.groupBy("page").agg(
        F.array_sort(F.collect_list(F.when(movable, C("item")))).alias("movable"),
        F.min(F.when(movable, C("b"))).alias("stack_bottom"),
        F.max(F.when(movable, C("t"))).alias("stack_top"),
        F.max(F.when(C("candidate"), C("t"))).alias("highest"),
        F.first("y").alias("y"),
        F.min(lowest).alias("lowest"),
        F.max(C("something").cast("int")).alias("something"),
    )
    out = edits.join(took, "page", "left")
    floor = F.greatest(F.least("lowest", C("cb") + BOTTOM_MARGIN), C("cb"))
    bottom = F.coalesce("stack_bottom", "ob")
    by_obstacle = C("y").isNotNull() & (bottom - C("y") <= bottom - floor)
    clear = F.greatest(C("leading") - C("size"), F.lit(0.0))
    to_floor = F.greatest(C("ob") - floor, F.lit(0.0))
    content_top = F.greatest("highest", "y")
    free = F.when(content_top.isNull(), to_floor).otherwise(F.least(F.greatest(C("ob") - content_top - clear, F.lit(0.0)), to_floor))
    gap = F.coalesce(F.greatest(C("ob") - C("stack_top") - clear, F.lit(0.0)), F.lit(0.0))
    return out.select(
        "page",
        F.coalesce("movable", F.array().cast("array<bigint>")).alias("movable"),
        F.greatest(F.when(by_obstacle, bottom - C("y")).otherwise(bottom - floor), F.lit(0.0)).alias("room"),
        F.when(by_obstacle, "obstacle").otherwise("pageBottom").alias("limited_by"),
        free.alias("free"),
        gap.alias("gap"),
        (F.coalesce("something", F.lit(0)) == 0).alias("nothing_below"),
    )


def decide(flow: Column, growth: Column, reach: Column) -> tuple[Column, Column, Column, Column]:
    """shift, blocked, overflow, past_bottom, over the columns of a plan. ``growth``: how much taller the paragraph is; ``reach``: how far its ink
    goes below its old bottom."""
    reach = F.greatest(reach, growth)
    push, over, none = flow == "push", reach - C("free"), F.lit(0.0)
    grows = push & (growth > MIN_SHIFT)
    still = grows & ~C("nothing_below") & (F.size("movable") == 0)
    moves = grows & ~C("nothing_below") & (F.size("movable") > 0)
    need = F.greatest(reach - C("gap"), none)
    shift = F.least(F.greatest(growth, need), "room")
    short = moves & (need - shift > MIN_SHIFT)
    pulled = push & (growth < -MIN_SHIFT) & (F.size("movable") > 0)
    beyond = (grows & C("nothing_below")) & (over > MIN_SHIFT)
    stuck = still & (over > MIN_SHIFT)
    laid = ~push
    return (
        F.when(moves & (shift >= MIN_SHIFT), shift).when(pulled, growth).otherwise(none),
        F.when(beyond | stuck | short, C("limited_by")),
        F.when(stuck, over).when(short, need - shift).when(laid & ~C("nothing_below"), F.greatest(over, none)).otherwise(none),
        F.when(beyond, over).when(laid & C("nothing_below"), F.greatest(over, none)).otherwise(none),
    )
