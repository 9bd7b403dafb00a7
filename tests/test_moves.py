"""Operators on graphs, grids, page flow, versions, payloads and page jobs, against brute force and on odd rows."""

import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelore.functions import spans
from pagelore.functions import text as T
from pagelore.operators import find, flow, graph, regions
from pagelore.plans import compare, history, jobs
from pagelore.sources import corpus, payload
from pagelore.sources.versions import Versions, apply_run, digest

from conftest import same


def test_components(spark):
    rnd = random.Random(1)
    edges = [(g, rnd.randint(0, 60), rnd.randint(0, 60)) for g in (1, 2, 3) for _ in range(45)] + [(4, k, k + 1) for k in range(100)] + [(4, 7, 7), (5, 3, 0)]
    nodes = {(g, x) for g, a, b in edges for x in (a, b)} | {(9, 9)}
    root = {n: n[1] for n in nodes}
    while True:
        new = {n: min([root[n], *[root[g, b] for g, a, b in edges if (g, a) == n], *[root[g, a] for g, a, b in edges if (g, b) == n]]) for n in nodes}
        if new == root:
            break
        root = new
    got = graph.components(spark.createDataFrame(sorted(nodes), "g int, node int"), spark.createDataFrame(edges, "g int, a int, b int"))
    assert {(r["g"], r["node"]): r["root"] for r in got.collect()} == root


def test_reached(spark):
    """Circles, several referrers, dangling and null references, two roots, a long chain."""
    edges = [(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 3, 2), (1, 2, 5), (1, 1, 5), (1, 5, None), (1, 7, 8), (1, 8, 7), (2, 0, 0)] + [(3, k, k + 1) for k in range(20)]
    got = graph.reached(spark.createDataFrame(edges, "g int, a int, b int"), spark.createDataFrame([(1, 0), (2, 0), (3, 0), (3, 9), (1, 0)], "g int, node int"))
    assert {(r["g"], r["node"]): r["round"] for r in got.collect()} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 5): 2, (2, 0): 0} | {(3, k): k if k < 9 else k - 9 for k in range(21)}
    assert graph.reached(spark.createDataFrame([], "g int, a int, b int"), spark.createDataFrame([], "g int, node int")).count() == 0


def flood(cells, w, h):
    """Tiles of eight cells with three or more, flooded from each corner; the largest 64."""
    tiles = {}
    for x, y in cells:
        tiles[y // 8, x // 8] = tiles.get((y // 8, x // 8), 0) + 1
    left, out = {t for t, n in tiles.items() if n >= 3}, []
    for start in sorted(left):
        if start not in left:
            continue
        todo, seen = [start], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in left:
                left.discard((y, x))
                seen.add((y, x))
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        ys, xs = [t[0] for t in seen], [t[1] for t in seen]
        out.append((min(xs) * 8, min(ys) * 8, min((max(xs) + 1) * 8, w), min((max(ys) + 1) * 8, h)))
    return out if len(out) <= 64 else sorted(out, key=lambda r: -(r[2] - r[0]) * (r[3] - r[1]))[:64]


def test_regions(spark):
    rnd = random.Random(4)
    pages = {1: (200, 130, 900), 2: (64, 400, 1200), 3: (611, 613, 3300), 4: (10, 10, 2), 5: (300, 20, 1500)}
    cells = [(g, rnd.randrange(w) // s * s + rnd.randrange(s) if s < w else 0, rnd.randrange(h)) for g, (w, h, n) in pages.items() for s in [4] for _ in range(n)]
    cells = sorted({(g, min(x, pages[g][0] - 1), y) for g, x, y in cells})
    tiles = regions.changed_tiles(spark.createDataFrame(cells, "g int, x int, y int"))
    got = regions.regions(tiles, spark.createDataFrame([(g, w, h) for g, (w, h, _) in pages.items()], "g int, w int, h int")).collect()
    for g, (w, h, _) in pages.items():
        want = flood([(x, y) for p, x, y in cells if p == g], w, h)
        assert [tuple(r[c] for c in ("x0", "y0", "x1", "y1")) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["region"])] == want
    assert sum(r["g"] == 3 for r in got) == 64


def test_text_tiles(spark):
    rows = [("abc", "abd"), ("ab", "ab  "), ("", "x"), ("é日🙂", "é本🙂"), ("a", "a")]
    assert [regions.differing(a, b).tolist() for a, b in rows] == [[2], [], [0], [1], []]
    rnd = random.Random(9)
    texts = [(k, "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 900))), "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 900)))) for k in range(20)] + [(None, "abc", None), (21, None, None)]
    cells = [(g, int(k) % 30, int(k) // 30) for g, a, b in texts for k in regions.differing(a, b)]
    want = regions.changed_tiles(spark.createDataFrame(cells, "g int, x int, y int"))
    got = regions.text_tiles(spark.createDataFrame(texts, "g int, a string, b string").repartition(3), 30)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


SPEC = "page int, item bigint, kind string, line boolean, l double, b double, r double, t double"
EDIT = "page int, ol double, ob double, or double, ot double, nl double, nr double, size double, leading double, cb double, ct double"


def planned(spark, *pages):
    """A plan for each list of boxes (kind, line, l, b, r, t), around a paragraph at 72..300, 600..612."""
    boxes = [(p, k, *b) for p, page in enumerate(pages) for k, b in enumerate(page)]
    edits = [(p, 72.0, 600.0, 300.0, 612.0, 72.0, 300.0, 12.0, 14.0, 0.0, 842.0) for p in range(len(pages))]
    found = flow.plan(spark.createDataFrame(boxes, SPEC), spark.createDataFrame(edits, EDIT))
    return {r["page"]: r for r in found.collect()}, found


def text(left, right, bottom):
    return ("content", True, left, bottom, right, bottom + 12.0)


def test_flow(spark):
    empty, below = [], [text(72.0, 300.0, 586.0), text(72.0, 250.0, 572.0)]
    other = [*below, text(320.0, 540.0, 586.0)]
    fixed = [*below, ("fixed", False, 0.0, 500.0, 600.0, 520.0)]
    figure = [*below, ("content", False, 200.0, 540.0, 500.0, 580.0)]  # overlaps the column, is not in it
    footer = [*below, text(170.0, 200.0, 30.0)]
    frame = [("content", False, 60.0, 560.0, 310.0, 620.0)]
    wide = [text(72.0, 540.0, 586.0), text(300.0, 540.0, 572.0)]  # shares the left margin, then holds what is below it
    got, _ = planned(spark, empty, below, other, fixed, figure, footer, frame, wide)
    assert got[0]["nothing_below"] and got[0]["movable"] == [] and got[0]["free"] == 600.0 - 18.0
    assert got[1]["movable"] == [0, 1] and got[1]["room"] == 572.0 - 18.0 and got[1]["limited_by"] == "pageBottom" and not got[1]["nothing_below"]
    assert got[2]["movable"] == [0, 1]
    assert got[3]["movable"] == [0, 1] and got[3]["room"] == 572.0 - 520.0 and got[3]["limited_by"] == "obstacle"
    assert got[4]["movable"] == [0] or got[4]["movable"] == []  # the second line straddles the figure's top
    assert got[4]["limited_by"] == "obstacle" and 1 not in got[4]["movable"]
    assert got[5]["movable"] == [0, 1] and got[5]["room"] == 572.0 - 42.0 and got[5]["limited_by"] == "obstacle"
    assert got[6]["movable"] == [] and got[6]["limited_by"] == "obstacle" and got[6]["room"] == 600.0 - 563.0
    assert got[7]["movable"] == [0, 1]


def test_flow_decisions(spark):
    below = [text(72.0, 300.0, 586.0)]
    tight = [text(72.0, 300.0, 586.0), ("fixed", False, 0.0, 560.0, 600.0, 580.0)]
    full = [("fixed", False, 0.0, 580.0, 600.0, 598.0)]
    _, plan = planned(spark, below, tight, full, [])
    names = ("shift", "blocked", "overflow", "past_bottom")

    def decided(how, growth, reach):
        rows = plan.select("page", *[c.alias(n) for n, c in zip(names, flow.decide(F.lit(how), F.lit(growth), F.lit(reach)), strict=True)]).collect()
        return [tuple(r[n] for n in names) for r in sorted(rows, key=lambda r: r["page"])]

    assert decided("push", 14.0, 14.0) == [(14.0, None, 0.0, 0.0), (6.0, "obstacle", 8.0, 0.0), (0.0, "obstacle", 14.0, 0.0), (0.0, None, 0.0, 0.0)]
    assert decided("push", -14.0, -14.0) == [(-14.0, None, 0.0, 0.0), (-14.0, None, 0.0, 0.0), (0.0, None, 0.0, 0.0), (0.0, None, 0.0, 0.0)]
    assert decided("overlap", 28.0, 30.0) == [(0.0, None, 30.0, 0.0), (0.0, None, 30.0, 0.0), (0.0, None, 30.0, 0.0), (0.0, None, 0.0, 0.0)]
    assert decided("push", 0.01, 0.02) == [(0.0, None, 0.0, 0.0)] * 4
    assert decided("push", 700.0, 700.0)[3] == (0.0, "pageBottom", 0.0, 700.0 - 582.0)


def test_versions(spark, tmp_path):
    """A version that reads back differently is not published."""
    rows = spark.createDataFrame([(1, "a"), (2, None), (1, "a")], "k int, v string")
    table = Versions(f"{tmp_path}/t")
    assert table.number(spark) == 0
    assert table.publish(rows) and table.number(spark) == 1 and digest(table.present(spark)) == digest(rows)
    lossy = Versions(f"{tmp_path}/t", lambda r, path: r.limit(2).write.mode("overwrite").parquet(path))
    changed = Versions(f"{tmp_path}/t", lambda r, path: r.withColumn("v", F.lit("a")).write.mode("overwrite").parquet(path))
    assert not lossy.publish(rows.union(rows)) and not changed.publish(rows)
    assert table.number(spark) == 1 and table.present(spark).count() == 3
    assert table.publish(rows.filter("k = 2")) and [tuple(r) for r in table.present(spark).collect()] == [(2, None)]
    assert table.publish(rows.limit(0)) and table.present(spark).count() == 0


def test_runs_replace_only_their_pages(spark, tmp_path):
    table, part = f"{tmp_path}/runs", (F.col("page") % 4).cast("int")
    make = lambda rows: spark.createDataFrame(rows, "doc int, page int, word string")
    apply_run(table, make([(d, p, "old") for d in (1, 2) for p in range(8)]), ["doc", "page"], part, False)
    before = {f.name for f in (tmp_path / "runs" / "part=3").iterdir()}
    apply_run(table, make([(1, 0, "new"), (1, 0, "more"), (2, 9, "new")]), ["doc", "page"], part, True)
    got = sorted((r["doc"], r["page"], r["word"]) for r in spark.read.parquet(table).collect())
    assert got == sorted([(d, p, "old") for d in (1, 2) for p in range(8) if (d, p) != (1, 0)] + [(1, 0, "new"), (1, 0, "more"), (2, 9, "new")])
    assert {f.name for f in (tmp_path / "runs" / "part=3").iterdir()} == before


def test_payload(spark):
    whole = "one two\n\nthree é🙂 "
    row = spark.createDataFrame([(7, whole), (8, "")], "page int, text string").select("page", payload.encoded(F.col("page"), F.col("text")).alias("b"))
    got = {r["page"]: bytes(r["b"]) for r in row.collect()}
    text_ = whole.encode()
    assert got[7] == b"PGLR" + struct.pack("<HHIIII", 1, 0, 7, len(whole), 4, 2) + struct.pack("<8I", 0, 3, 4, 3, 9, 5, 15, 2) + struct.pack("<4I", 0, 7, 9, 9) + struct.pack("<I", len(text_)) + text_
    read = lambda data: spark.createDataFrame([(bytearray(d),) for d in data], "b binary").select(payload.text_of(F.col("b")).alias("t"), payload.header(F.col("b"))["words"].alias("w"), payload.spans_of(F.col("b"), "words").alias("s")).collect()
    assert [r["t"] for r in read(got.values())] == [whole, ""]
    assert [tuple(s) for s in read([got[7]])[0]["s"]] == [(0, 3), (4, 3), (9, 5), (15, 2)]
    cut = read([got[7][:k] for k in range(len(got[7]))])
    assert all(r["t"] is None for r in cut) and all((r["w"] is None) == (k < payload.HEADER) for k, r in enumerate(cut))
    assert [r["t"] for r in read([b"XXXX" + got[7][4:], got[7][:20] + b"\xff\xff\xff\x7f" + got[7][24:], got[7] + b"more"])] == [None, None, whole]


ODD_TEXTS = ["", None, " \n ", "\n\n", "a", "one two\n\nthree é🙂 ", "\u0085x\u2003y\u3000\u00a0ß\u1680", "İx Σ ΑΣ", "tab\there\r\n"]


def test_payload_of_odd_documents(spark, tmp_path):
    """Texts without a word, whole, short and foreign; ids beyond 32 bits."""
    rows = [(7 * (10 * k + j) + k % 7 + high, t) for j, t in enumerate(ODD_TEXTS) for k in range(4) for high in (0, 7 << 32)]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(jobs.payload_round_trip(spark, str(tmp_path)), con.sql(jobs.ORACLES["payload_round_trip"]))


def test_words_with_spans(spark, monkeypatch):
    """One pass in Arrow batches, cut anywhere between texts, against the column functions of before."""
    monkeypatch.setattr(spans, "AT_ONCE", 8)
    rows = spark.createDataFrame([(k, None if k % 2 else "key", t) for k, t in enumerate(ODD_TEXTS)], "doc_id bigint, other string, text string")
    want = rows.select("doc_id", "other", F.posexplode(T.matches(F.col("text"), f"{T.NOT_SPACE}+")).alias("k", "m"))
    want = want.select("doc_id", "other", "k", F.col("m.start").alias("start"), F.col("m.length").alias("length"), T.fold(F.col("m.text")).alias("key"))
    got = find.words(rows.repartition(2), ["doc_id", "other"])
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert find.words(rows.limit(0), ["doc_id"]).count() == 0


def test_word_tokens_is_one_pass(spark, tmp_path):
    """No array of a text's words, gaps and running sums is worked out in interpreted steps."""
    spark.createDataFrame([(1, "a b", "s")], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = compare.word_tokens(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan


def hundredths(rnd, ties):
    """Values of a user whose mean lies halfway between two decimals."""
    n = 10 * rnd.randint(1, 9)
    values = [rnd.randint(0, 20_000) for _ in range(n - 1)]
    return [*values, (5 * n - sum(values)) % (10 * n) + (0 if ties else 1)]


def test_mean_confidence_of_any_order(spark, tmp_path):
    """Sums of doubles hang on the order of rows; halves would go either way."""
    rnd, rows, want = random.Random(5), [], {}
    for user in range(400):
        values = hundredths(rnd, user % 2)
        rnd.shuffle(values)
        rows += [(user, v / 100, "view", user * 1000 + k) for k, v in enumerate(values)]
        total, n = sum(values), len(values)
        want[user] = (total + 5 * n) // (10 * n) / 10
    frame = spark.createDataFrame(rows, "user_id bigint, value double, event_type string, event_id bigint").withColumn("ts", F.timestamp_seconds("event_id"))
    for k, parts in enumerate((1, 7)):
        folder = tmp_path / str(k)
        frame.orderBy(F.xxhash64("event_id")).repartition(parts).write.parquet(str(folder / "events.parquet"))
        got = history.mean_confidence(spark, str(folder)).collect()
        assert {r["user_id"]: r["mean"] for r in got} == want == {r["user_id"]: r["weighted"] for r in got}


def test_mean_confidence_of_odd_values(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    users = [[1.5, None, 2.25, None], [None], [nan, 1.0, 2.0], [inf, 1.0], [1e300, 1e300], [-0.05], [1e-30, 0.15], [0.35, 0.35, None]]
    rows = [(u, v, None if k == 1 else "view", 10 * u + k) for u, vs in enumerate(users) for k, v in enumerate(vs)]
    spark.createDataFrame(rows, "user_id bigint, value double, event_type string, event_id bigint").withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    same(history.mean_confidence(spark, str(tmp_path)), con.sql(history.ORACLES["mean_confidence"]))


def test_find(spark):
    rows = spark.createDataFrame([(1, "The\r\nİthe Σthe", "x"), (2, None, "y"), (3, "", "z"), (None, "the" * 3, None)], "doc_id int, text string, other string")
    got = sorted(((r["doc_id"], r["char_start"], r["context"], r["context_at"]) for r in find.hits(rows, ["doc_id"], "the", around=2).collect()), key=str)
    assert got == sorted([(1, 0, "The  ", 0), (1, 6, "\nİthe Σ".replace("\n", " "), 2), (1, 11, " Σthe", 2), (None, 0, "theth", 0), (None, 3, "hetheth", 2), (None, 6, "hethe", 2)], key=str)
    assert find.places(rows, ["doc_id"], "The", match_case=True).count() == 1
    assert find.hits(rows.limit(0), ["doc_id"], "the").count() == 0


def test_damaged_files_do_not_end_the_run(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in {"a/1.TXT": b"1\tthe the\nend 1\n", "a/2.txt": b"1\tthe\nend 5", "3.txt": b"x", ".4.txt": b"x", "5.pdf": b"x", "6.txt": b"end 0"}.items():
        (tmp_path / name).write_bytes(data)
    from pagelore.plans.jobs import checked_hits

    files = corpus.folder(spark, str(tmp_path), ".txt", most=None, content=True)
    got = {r["path"].rsplit("/", 1)[1]: (r["outcome"], r["reason"], r["hits"]) for r in corpus.run_files(files, checked_hits).collect()}
    assert got == {"1.TXT": ("done", None, 2), "2.txt": ("failed", "documents missing", 0), "3.txt": ("failed", "no last line", 0), "6.txt": ("done", None, 0)}
    assert [r["path"].rsplit("/", 1)[1] for r in corpus.folder(spark, str(tmp_path), ".txt", most=2).collect()] == ["3.txt", "6.txt"]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_page_jobs(spark, tmp_path, order):
    """Jobs that end, that wait too long, and that begin again after either."""
    from pagelore.plans.stream import deliver
    from pagelore.streaming import jobs as J

    t = lambda s: F.timestamp_seconds(F.lit(s))
    page = lambda doc, total, part, at: spark.range(1).select(F.lit(doc).cast("bigint").alias("doc_id"), F.lit(total).cast("bigint").alias("total"), F.lit(10).cast("bigint").alias("chars"), t(at).alias("at"), F.lit(part).alias("part"))
    rows = page(1, 3, 0, 100 + order[0]).union(page(1, 3, 0, 100 + order[1])).union(page(1, 3, 1, 100 + order[2])).union(page(2, 2, 0, 100)).union(page(3, 1, 1, 101))
    rows = rows.union(page(-1, 1, 2, 10_000)).union(page(-1, 1, 3, 10_000)).union(page(2, 1, 3, 10_001)).union(page(-1, 1, 4, 20_000))
    out = f"{tmp_path}/out"
    with J.state_store(spark):
        deliver(spark, rows, "pages", 5, lambda stream: J.page_jobs(stream, "1 minute", 60_000).writeStream.format("parquet").outputMode("append").option("path", out))
    got = sorted(tuple(r[c] for c in ("doc_id", "outcome", "pages", "chars")) for r in spark.read.parquet(out).filter("doc_id > 0").collect())
    assert got == [(1, "finished", 3, 30), (2, "abandoned", 1, 10), (2, "finished", 1, 10), (3, "finished", 1, 10)]
