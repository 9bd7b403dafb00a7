"""Queries of annotations: summaries as text and Markdown, kinds, batches, stamps; selections of pages, permissions, queues, references.

No table holds annotations, so turns of conversations stand for them: three to a page, each an answer to another or the top of a thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.functions import text as T
from pagelore.plans.compare import ORACLES as COMPARED
from pagelore.plans.compare import positional_changes
from pagelore.plans.structure import attached, walked
from pagelore.sources import corpus

#: Kinds, those that mark text, the colour of all.
KINDS, MARKUP, COLOR = ("Highlight", "Note", "Underline", "Ink", "Strikeout"), ("Highlight", "Underline", "Strikeout", "Squiggly"), "#ffd400"
#: Permissions by bit, from 1.
PERMISSIONS = (("print", 3), ("modify", 4), ("copy", 5), ("annotate", 6), ("fill", 9), ("assemble", 11))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, note, page, kind, author, contents."""
    turns = corpus.pages(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("page") % len(KINDS) + 1).cast("int"))
    return turns.select("doc_id", F.col("page").alias("note"), F.floor(F.col("page") / 3).alias("page"), kind.alias("kind"), F.coalesce("role", F.lit("")).alias("author"), F.col("text").alias("contents"))


def threaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with their path from the top of the thread, depth, and the page of the top."""
    paths = walked(attached(spark, sf_dir)).select("doc_id", "note", "path", (F.size("path") - 1).alias("depth"))
    return annotations(spark, sf_dir).join(paths, ["doc_id", "note"]).withColumn("page", F.floor(F.col("path")[0] / 3))


def _summary(rows: DataFrame, head: Column, block: Column) -> DataFrame:
    """A text for each document: its head and the blocks of its rows in thread order, as a digest and a length."""
    own = rows.select("doc_id", F.struct("page", "path", block.alias("b")).alias("r"))
    text = F.concat(head, F.array_join(F.sort_array(F.collect_list("r"))["b"], ""))
    return own.groupBy("doc_id").agg(F.sha2(text, 256).alias("sha256"), F.length(text).cast("bigint").alias("length"))


def annotation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotations of a document as plain text: answers under what they answer, indented by depth."""
    rows = threaded(spark, sf_dir)
    pad = F.repeat(F.lit("    "), F.col("depth"))
    names = F.concat(F.col("kind"), F.when(F.col("author") != "", F.concat(F.lit(" · "), "author")).otherwise(""))
    first = F.when(F.col("depth") == 0, F.concat(F.lit("\n[Page "), F.col("page") + 1, F.lit("] "), names, F.lit("\n"))).otherwise(F.concat(pad, F.lit("↳ "), names, F.lit("\n")))
    text = F.replace(F.replace("contents", F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.concat(F.lit("\n"), pad, F.lit("    ")))
    body = F.when(F.trim("contents") != "", F.concat(pad, F.lit("  Comment: "), text, F.lit("\n"))).otherwise("")
    last = F.when(F.col("depth") == 0, f"  Color: {COLOR}\n").otherwise("")
    head = F.concat(F.lit("Annotations — "), F.first("doc_id"), F.lit("\n"), F.count("*"), F.lit(" annotations\n"))
    return _summary(rows, head, F.concat(first, body, last))


def annotation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotations of a document as Markdown: a heading for each page, threads as nested lists."""
    rows = threaded(spark, sf_dir)
    before = F.lag("page").over(Window.partitionBy("doc_id").orderBy("page", "path"))
    rows = rows.withColumn("heading", F.when(before.eqNullSafe(F.col("page")), "").otherwise(F.concat(F.lit("\n## Page "), F.col("page") + 1, F.lit("\n\n"))))
    pad = F.repeat(F.lit("  "), F.col("depth"))
    names = F.concat(F.lit("**"), T.markdown_summary(F.col("kind")), F.lit("**"), F.when(F.col("author") != "", F.concat(F.lit(" · "), T.markdown_summary(F.col("author")))).otherwise(""))
    first = F.when(F.col("depth") == 0, F.concat(F.lit("- "), names, F.lit(f" · `{COLOR}`\n"))).otherwise(F.concat(F.lit("\n"), pad, F.lit("- "), names, F.lit("\n")))
    lines = F.split(F.regexp_replace(F.replace("contents", F.lit("\r\n"), F.lit("\n")), "\\n\\z", ""), "\n")
    quoted = F.transform(lines, lambda x: F.when(F.trim(x) == "", "\n").otherwise(F.concat(pad, F.lit("  "), T.markdown_summary(x), F.lit("\n"))))
    body = F.when(F.trim("contents") != "", F.concat(F.lit("\n"), F.array_join(quoted, ""))).otherwise("")
    head = F.concat(F.lit("# Annotations — "), F.first("doc_id"), F.lit("\n\n"), F.count("*"), F.lit(" annotations\n"))
    return _summary(rows, head, F.concat("heading", first, body))


def annotation_threads_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads whose top marks text, by page: the tops in order."""
    tops = threaded(spark, sf_dir).filter((F.col("depth") == 0) & F.col("kind").isin(*MARKUP))
    return tops.groupBy("doc_id", "page").agg(F.array_join(F.sort_array(F.collect_list("note")), ",").alias("notes"), F.count("*").alias("n"))


def annotation_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of operations on each document's notes, all or nothing: every seventh note from 3 is deleted, every seventh from 4 gets new contents
    and an author, every seventh from 5 a new colour, and beside every seventh from 6 a note is created. Every fourth document's list deletes
    note 12 too, every ninth's updates note 1 to a kind that there isn't: where note 12 isn't there or the kind is none, nothing is done."""
    old = annotations(spark, sf_dir).select("doc_id", "note", "kind", "author", "contents", F.lit(COLOR).alias("color"))
    made = lambda which, op, note, **new: old.filter(which).select("doc_id", F.lit(op).alias("op"), note.cast("bigint").alias("note"), *[new.get(c, F.lit(None).cast("string")).alias(c) for c in ("kind", "author", "contents", "color")])
    text = F.concat(F.lit("seen: "), F.substring("contents", 1, 40))
    asked = made("note % 7 = 3", "delete", F.col("note")).unionByName(made("note % 7 = 4", "update", F.col("note"), contents=text, author=F.lit("editor")))
    asked = asked.unionByName(made("note % 7 = 5", "update", F.col("note"), color=F.lit("#00ff00"))).unionByName(made("note % 7 = 6", "create", F.col("note") + 1000, kind=F.lit("Note"), author=F.lit("editor"), contents=F.lit("new"), color=F.lit(COLOR)))
    asked = asked.unionByName(made("note = 0 AND doc_id % 4 = 0", "delete", F.lit(12))).unionByName(made("note = 0 AND doc_id % 9 = 2", "update", F.lit(1), kind=F.lit("Blot")))
    return batch(old, asked).select("doc_id", "note", "kind", "author", F.md5("contents").alias("md5"), "color")


def batch(old: DataFrame, asked: DataFrame) -> DataFrame:
    """``old`` (doc_id, note, kind, author, contents, color) after the operations ``asked`` (doc_id, op: create, update or delete, note, and what is
    new, null: as it was). A document whose list has an operation that can't be done stays as it is: updating or deleting what isn't there,
    creating what is, a kind that there isn't. A note that is deleted and updated is deleted."""
    there = old.select("doc_id", "note", F.lit(True).alias("there"))
    rows = asked.join(there, ["doc_id", "note"], "left")
    wrong = (F.col("op").isin("update", "delete") & F.col("there").isNull()) | ((F.col("op") == "create") & F.col("there")) | ~F.col("kind").isin(*KINDS)
    refused = rows.filter(wrong).select("doc_id").distinct()
    rows = rows.drop("there").join(refused, "doc_id", "left_anti")
    new = rows.filter("op = 'update'").groupBy("doc_id", "note").agg(*[F.max(c).alias(f"new_{c}") for c in ("kind", "author", "contents", "color")])
    kept = old.join(rows.filter("op = 'delete'").select("doc_id", "note").distinct(), ["doc_id", "note"], "left_anti").join(new, ["doc_id", "note"], "left")
    kept = kept.select("doc_id", "note", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("kind", "author", "contents", "color")])
    return kept.unionByName(rows.filter("op = 'create'").select(*kept.columns))


def annotations_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink is hidden, all else shown: flags after it and whether they changed; every third note was hidden before."""
    was, now = F.col("note") % 3 == 0, F.col("kind") == "Ink"
    return annotations(spark, sf_dir).select("doc_id", "note", now.alias("hidden"), (was != now).alias("changed"))


def stamped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, footer and number on each page but the first, from templates."""
    pages = annotations(spark, sf_dir).select("doc_id", "page").distinct()
    whole = F.max("page").over(Window.partitionBy("doc_id")) + 1
    texts = {"header": F.concat(F.lit("Document "), "doc_id"), "footer": F.concat(F.col("page") + 1, F.lit(" / "), whole), "number": F.concat(F.lit("N-"), F.lpad((F.col("page") + 1).cast("string"), 5, "0"))}
    stamps = F.array(*[F.struct(F.lit(role).alias("role"), text.alias("text")) for role, text in texts.items()])
    return pages.select("doc_id", "page", stamps.alias("s")).filter("page > 0").select("doc_id", "page", F.inline("s"))


def stamps_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers of every second page and all numbers go."""
    return stamped_pages(spark, sf_dir).filter("NOT (role = 'number' OR (role = 'footer' AND page % 2 = 1))")


def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages compared by place those that differ."""
    return positional_changes(spark, sf_dir).filter("changed").select("pair", "page")


def allowed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the permission bits of a document (here its number, spread) allow."""
    bits = F.col("doc_id") * 2654435761 % 65536
    names = [F.when(bits.bitwiseAND(1 << bit - 1) != 0, name) for name, bit in PERMISSIONS]
    return corpus.documents(spark, sf_dir).select("doc_id", F.concat_ws(",", *names).alias("allowed"))


def runnable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a queue that are neither done (purchase) nor active (view)."""
    return corpus.table(spark, sf_dir, "events").filter("event_type NOT IN ('purchase', 'view')").select("event_id", "user_id")


def mark_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of one word in one document are a group: its marks in order, groups by page, then by first mark."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("contents"), F.lit(r"\b(the|of|and)\b"), F.lit(1)))
    marks = T.each(annotations(spark, sf_dir), ["doc_id", "page", "note"], words, "label")
    groups = marks.groupBy("doc_id", "label").agg(F.min("page").alias("page"), F.sort_array(F.collect_list("note")).alias("notes"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", F.col("notes")[0], "label"))
    return groups.select("doc_id", "label", "page", F.array_join("notes", ",").alias("notes"), place.alias("place"))


def page_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection of the pages of each document (those with an even length of text) after a click, a click with range, one that adds a range
    from the first page, a toggle of page 2, a marquee of pages 1 and 2, one that adds, and what each range choice means."""
    pages = corpus.pages(spark, sf_dir)
    own = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.length("text") % 2 == 0, F.col("page").cast("int")))).alias("s"), F.count("*").cast("int").alias("n"))
    arrays = {
        "click": F.array(F.lit(2)),
        "span": F.sequence(F.lit(1), F.lit(3)),
        "added_span": F.array_sort(F.array_union("s", F.sequence(F.lit(0), F.lit(1)))),
        "toggled": F.when(F.array_contains("s", 2), F.filter("s", lambda p: p != 2)).otherwise(F.array_sort(F.array_union("s", F.array(F.lit(2))))),
        "marquee_added": F.array_sort(F.array_union("s", F.array(F.lit(2), F.lit(1)))),
        "all_pages": F.sequence(F.lit(0), F.col("n") - 1),
        "current": F.array(F.greatest(F.lit(0), F.least(F.col("n") - 1, F.lit(5)))),
        "selected": F.when(F.size("s") > 0, F.col("s")),
    }
    return own.select("doc_id", *[F.array_join(a.cast("array<string>"), ",").alias(name) for name, a in arrays.items()])


def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects (notes) that the first of their document leads to; others are dropped."""
    return walked(attached(spark, sf_dir)).groupBy("doc_id").agg(F.sum((F.col("path")[0] == 0).cast("int")).alias("kept"), F.sum((F.col("path")[0] != 0).cast("int")).alias("dropped"))


def form_values_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields (a document's source) after writing every third one, and after a reset to the default, its language."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    writes = docs.filter("doc_id % 3 = 1").select("doc_id", F.concat(F.lit("new "), "doc_id").alias("new"))
    return docs.join(writes, "doc_id", "left").select("doc_id", F.coalesce("new", "source").alias("written"), F.coalesce("lang", F.lit("")).alias("reset"))


QUERIES = {
    f.__name__: f
    for f in (annotation_text, annotation_markdown, annotation_threads_by_page, annotation_batch, annotations_hidden, stamped_pages, stamps_removed, changed_only, allowed_actions, runnable_items, mark_groups, page_selections, reachable_objects, form_values_written)
}

_KIND = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][turn % 5 + 1]"
_ANNOTS = f"(SELECT conv_id AS doc_id, turn AS note, turn // 3 AS page, {_KIND} AS kind, coalesce(role, '') AS author, coalesce(text, '') AS contents FROM conversations)"
_THREADS = f"""
WITH RECURSIVE a AS (SELECT *, CASE WHEN note = 5 OR note = 0 THEN NULL ELSE (note - 1) // 2 END AS up FROM {_ANNOTS}),
tops AS (SELECT a.*, b.note AS parent FROM a LEFT JOIN a b ON b.doc_id = a.doc_id AND b.note = a.up),
t(doc_id, note, page, kind, author, contents, depth, path) AS (
  SELECT doc_id, note, page, kind, author, contents, 0, [note] FROM tops WHERE parent IS NULL
  UNION ALL SELECT x.doc_id, x.note, t.page, x.kind, x.author, x.contents, t.depth + 1, list_append(t.path, x.note) FROM tops x JOIN t ON x.doc_id = t.doc_id AND x.parent = t.note
)
"""
_MD = "regexp_replace({}, '([' || chr(92) || chr(92) || '`*_' || chr(92) || '[' || chr(92) || ']<>#|])', chr(92) || chr(92) || chr(92) || '1', 'g')"
_TEXT = """concat(
  CASE WHEN depth = 0 THEN chr(10) || '[Page ' || (page + 1) || '] ' ELSE repeat('    ', depth) || '↳ ' END, kind, CASE WHEN author <> '' THEN ' · ' || author ELSE '' END, chr(10),
  CASE WHEN trim(contents) <> '' THEN repeat('    ', depth) || '  Comment: ' || replace(replace(contents, chr(13) || chr(10), chr(10)), chr(10), chr(10) || repeat('    ', depth) || '    ') || chr(10) ELSE '' END,
  CASE WHEN depth = 0 THEN '  Color: {color}' || chr(10) ELSE '' END)""".format(color=COLOR)
_MARKDOWN = f"""concat(
  CASE WHEN before IS NOT DISTINCT FROM page THEN '' ELSE chr(10) || '## Page ' || (page + 1) || chr(10) || chr(10) END,
  CASE WHEN depth = 0 THEN '' ELSE chr(10) END, repeat('  ', depth), '- **', {_MD.format("kind")}, '**', CASE WHEN author <> '' THEN ' · ' || {_MD.format("author")} ELSE '' END, CASE WHEN depth = 0 THEN ' · `{COLOR}`' ELSE '' END, chr(10),
  CASE WHEN trim(contents) <> '' THEN chr(10) || list_aggregate(list_transform(string_split(regexp_replace(replace(contents, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)), lambda x: CASE WHEN trim(x) = '' THEN chr(10) ELSE repeat('  ', depth) || '  ' || {_MD.format("x")} || chr(10) END), 'string_agg', '') ELSE '' END)"""
_STAMPS = """
SELECT doc_id, page, role, text FROM (
  SELECT doc_id, page, unnest(['header', 'footer', 'number']) AS role, unnest(['Document ' || doc_id, (page + 1) || ' / ' || n, 'N-' || lpad(CAST(page + 1 AS VARCHAR), 5, '0')]) AS text
  FROM (SELECT DISTINCT conv_id AS doc_id, turn // 3 AS page, max(turn // 3) OVER (PARTITION BY conv_id) + 1 AS n FROM conversations)) WHERE page > 0
"""
_JOINED = lambda x: f"array_to_string({x}, ',')"

ORACLES = {
    "annotation_text": f"{_THREADS} SELECT doc_id, sha256(x) AS sha256, length(x) AS length FROM (SELECT doc_id, 'Annotations — ' || doc_id || chr(10) || count(*) || ' annotations' || chr(10) || string_agg({_TEXT}, '' ORDER BY page, path) AS x FROM t GROUP BY doc_id)",
    "annotation_markdown": f"{_THREADS} SELECT doc_id, sha256(x) AS sha256, length(x) AS length FROM (SELECT doc_id, '# Annotations — ' || doc_id || chr(10) || chr(10) || count(*) || ' annotations' || chr(10) || string_agg({_MARKDOWN}, '' ORDER BY page, path) AS x FROM (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY page, path) AS before FROM t) GROUP BY doc_id)",
    "annotation_threads_by_page": f"{_THREADS} SELECT doc_id, page, string_agg(note, ',' ORDER BY note) AS notes, count(*) AS n FROM t WHERE depth = 0 AND kind IN {MARKUP} GROUP BY doc_id, page",
    "annotation_batch": f"""
WITH a AS (SELECT *, doc_id % 4 = 0 AND NOT bool_or(note = 12) OVER d OR doc_id % 9 = 2 AND bool_or(note = 0) OVER d AS refused, doc_id % 4 = 0 AND bool_or(note = 0) OVER d AS last FROM {_ANNOTS} WINDOW d AS (PARTITION BY doc_id)),
o AS (SELECT *, CASE WHEN refused THEN -1 WHEN last AND note = 12 THEN 3 ELSE note % 7 END AS op FROM a)
SELECT doc_id, note, kind, CASE WHEN op = 4 THEN 'editor' ELSE author END AS author, md5(CASE WHEN op = 4 THEN 'seen: ' || substr(contents, 1, 40) ELSE contents END) AS md5, CASE WHEN op = 5 THEN '#00ff00' ELSE '{COLOR}' END AS color FROM o WHERE op <> 3
UNION ALL SELECT doc_id, note + 1000, 'Note', 'editor', md5('new'), '{COLOR}' FROM a WHERE NOT refused AND note % 7 = 6
""",
    "annotations_hidden": f"SELECT doc_id, note, kind = 'Ink' AS hidden, (note % 3 = 0) <> (kind = 'Ink') AS changed FROM {_ANNOTS}",
    "stamped_pages": _STAMPS,
    "stamps_removed": f"SELECT * FROM ({_STAMPS}) WHERE role = 'header' OR (role = 'footer' AND page % 2 = 0)",
    "changed_only": f"SELECT pair, page FROM ({COMPARED['positional_changes']}) WHERE changed",
    "allowed_actions": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN (doc_id * 2654435761 % 65536) & {1 << bit - 1} <> 0 THEN '{name}' END" for name, bit in PERMISSIONS) + "], lambda x: x IS NOT NULL), ',') AS allowed FROM documents",
    "runnable_items": "SELECT event_id, user_id FROM events WHERE event_type NOT IN ('purchase', 'view')",
    "mark_groups": f"""
SELECT doc_id, label, page, notes, row_number() OVER (PARTITION BY doc_id ORDER BY page, first, label) AS place FROM (
  SELECT doc_id, label, min(page) AS page, string_agg(note, ',' ORDER BY note) AS notes, min(note) AS first
  FROM (SELECT doc_id, page, note, unnest(list_distinct(regexp_extract_all(lower(contents), '\\b(the|of|and)\\b', 1))) AS label FROM {_ANNOTS}) GROUP BY doc_id, label)
""",
    "page_selections": f"""
WITH p AS (SELECT conv_id AS doc_id, coalesce(list_sort(list(CAST(turn AS INTEGER)) FILTER (WHERE length(coalesce(text, '')) % 2 = 0)), []) AS s, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id)
SELECT doc_id, '2' AS click, '1,2,3' AS span, {_JOINED("list_sort(list_distinct(list_concat(s, [0, 1])))")} AS added_span,
  CASE WHEN list_contains(s, 2) THEN {_JOINED("list_filter(s, lambda x: x <> 2)")} ELSE {_JOINED("list_sort(list_append(s, 2))")} END AS toggled,
  {_JOINED("list_sort(list_distinct(list_concat(s, [1, 2])))")} AS marquee_added, {_JOINED("range(n)")} AS all_pages, CAST(greatest(0, least(n - 1, 5)) AS VARCHAR) AS current,
  CASE WHEN len(s) > 0 THEN {_JOINED("s")} END AS selected FROM p
""",
    "reachable_objects": f"{_THREADS} SELECT doc_id, count(*) FILTER (WHERE path[1] = 0) AS kept, count(*) FILTER (WHERE path[1] <> 0) AS dropped FROM t GROUP BY doc_id",
    "form_values_written": "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'new ' || doc_id ELSE source END AS written, coalesce(lang, '') AS reset FROM documents",
}
