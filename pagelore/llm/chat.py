"""Chat formatting with typed content parts.

A conversation is rows (conv_id, turn, role, parts); parts is an array of PART structs. Each part is visited in order: text is
escaped, any other kind becomes a placeholder, is recorded as an attachment, and adds its expanded token count. Everything is
DataFrame functions, so the work stays in the JVM.

Template: every turn is ``<turn>`` role newline body ``</turn>`` newline. Inside roles and bodies a backslash becomes ``\\s``
and a control string gets ``\\p`` after its first character; undoing the two steps in reverse order restores the text exactly.

Defined cases: a null text, role or parts array counts as empty; a null conv_id is a conversation of its own; turns that share a number
are ordered by role, then body; repeated rows stay repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>"
#: Kinds of attachment and the placeholder of each.
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
#: No control string holds a backslash or overlaps itself, which the escaping relies on.
CONTROLS = (OPEN, CLOSE, *PLACEHOLDERS.values())
PART = "struct<type:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>"
#: Expansion of attachments into model tokens: pixels of a patch's side, milliseconds a token, tokens a page.
PATCH, MILLIS, PAGE_TOKENS = 14, 40, 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\p{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role is one line, so its line feeds are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """The parts array of a turn that is text only."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("bigint").alias("millis"), F.lit(None).cast("int").alias("pages")))


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; unknown sizes count as one patch, step or page."""
    ceil = lambda x, unit: F.ceil(F.coalesce(x, F.lit(1)) / F.lit(unit)).cast("bigint")
    return (
        F.when(part["type"] == "image", ceil(part["width"], PATCH) * ceil(part["height"], PATCH))
        .when(part["type"] == "audio", ceil(part["millis"], MILLIS))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)).cast("bigint") * PAGE_TOKENS)
        .otherwise(F.lit(0).cast("bigint"))
    )


def visit(part: Column) -> Column:
    """What a part becomes in the body."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(part["type"] == kind, F.lit(mark)).otherwise(out)
    return out


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, turns (start, length, loss_start, loss_length: code points in formatted), attachments (ordinal, turn,
    kind, ref, tokens), attachment_tokens. The body of a turn whose role is in loss_roles is under the loss mask."""
    none = F.array().cast(f"array<{PART}>")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", none).alias("parts")).select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        F.array_join(F.transform("parts", visit), "").alias("body"),
        F.transform(
            F.filter("parts", lambda p: p["type"].isin(*PLACEHOLDERS)),
            lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")),
        ).alias("found"),
    )
    rows = rows.withColumn("length", F.length("head") + F.length("body") + len(CLOSE) + 1)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("start"),
        F.coalesce(F.sum(F.size("found")).over(before), F.lit(0)).cast("bigint").alias("attached"),
    )
    under = F.col("role").isin(*loss_roles)
    packed = rows.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "start",
                    F.col("length").cast("bigint").alias("length"),
                    (F.col("start") + F.length("head")).alias("loss_start"),
                    F.when(under, F.length("body")).otherwise(0).cast("bigint").alias("loss_length"),
                    F.concat("head", "body", F.lit(f"{CLOSE}\n")).alias("piece"),
                    F.transform("found", lambda a, i: F.struct((F.col("attached") + i).alias("ordinal"), F.col("turn").alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("found"),
                )
            )
        ).alias("t")
    )
    return packed.select(
        "conv_id",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"), t["loss_start"].alias("loss_start"), t["loss_length"].alias("loss_length"))).alias("turns"),
        F.flatten("t.found").alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_chat(formatted: DataFrame) -> DataFrame:
    """The inverse, from the formatted text and the mask alone: conv_id, formatted, read (role, text, loss_text per turn)."""
    pieces = F.split("formatted", r"\Q</turn>" + r"\E\n")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)  # what follows the last mark is empty
    return formatted.select(
        "conv_id",
        "formatted",
        F.zip_with(
            turns,
            "turns",
            lambda p, t: F.struct(
                unescape_role(F.substring(F.substring_index(p, "\n", 1), len(OPEN) + 1, 2**30)).alias("role"),
                unescape(F.substring(p, F.instr(p, "\n") + 1, F.lit(2**30))).alias("text"),
                unescape(F.substring(p, (t["loss_start"] - t["start"] + 1).cast("int"), t["loss_length"].cast("int"))).alias("loss_text"),
            ),
        ).alias("read"),
    )
