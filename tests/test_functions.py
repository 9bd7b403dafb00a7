"""Vectors and properties of the order-dependent operators and expressions."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelore.functions import pii, ranges
from pagelore.functions import text as T
from pagelore.operators import compare as C
from pagelore.operators import layout as L
from pagelore.operators import series as S


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("needle", "case", "whole", "starts"),
    [("monkey", False, False, [6, 13, 20]), ("monkey", True, False, [6, 20]), ("monkey", False, True, [6, 13])],
)
def test_search_vectors(spark, needle, case, whole, starts):
    text = F.lit("trace monkey Monkey monkeys")
    hay = text if case else T.fold(text)
    assert [m["start"] for m in one(spark, T.matches(hay, T.literal(needle, whole)))] == starts


def test_fold_keeps_places(spark):
    text = "İSTANBUL ΟΔΟΣ Straße"
    folded = one(spark, T.fold(F.lit(text)))
    assert len(folded) == len(text)
    assert folded == "".join((c.lower() or c)[0] for c in text)


def test_offsets_over_many_blocks(spark):
    text = "ab " * 500 + "x"
    starts = [m["start"] for m in one(spark, T.matches(F.lit(text), "ab"))]
    assert starts == [3 * k for k in range(500)]
    assert one(spark, T.matches(F.lit(""), "ab")) == []


def test_keyword_spans_white_space(spark):
    hits = one(spark, T.matches(T.fold(F.lit("Of  the; of\nthe; ofthe")), T.keyword(" of the ")))
    assert [h["start"] for h in hits] == [0, 9]


def test_merge_keeps_touching_spans_apart(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(k).alias("kind")) for a, b, k in ((5, 9, "b"), (0, 5, "a"), (7, 12, "c"), (20, 21, "d"))])
    assert [tuple(s) for s in one(spark, pii.merge(spans))] == [(0, 5, "a"), (5, 12, "b"), (20, 21, "d")]


def test_numerals(spark):
    assert [one(spark, ranges.roman(F.lit(n))) for n in (4, 9, 14, 1994, 2026)] == ["iv", "ix", "xiv", "mcmxciv", "mmxxvi"]
    assert [one(spark, ranges.letters(F.lit(n))) for n in (1, 26, 27, 28, 53)] == ["a", "z", "aa", "bb", "aaa"]
    assert one(spark, ranges.label(F.lit("romanUpper"), F.lit("p. "), F.lit(3))) == "p. III"
    assert one(spark, ranges.label(F.lit("alphaUpper"), F.lit("App-"), F.lit(2))) == "App-B"
    assert one(spark, ranges.bates("ABC", 6, 101, F.lit(13), "-K")) == "ABC000114-K"
    assert [p + 1 for p in ranges.booklet(8)] == [8, 1, 2, 7, 6, 3, 4, 5]


def test_align_vectors():
    sets = lambda x: [frozenset(s) for s in x]
    assert C.align(sets([[1, 2], [3, 4], [5]]), sets([[1, 2, 9], [5, 9]])) == [(0, 0), (1, None), (2, 1)]
    assert C.align(sets([[7], [8]]), sets([[10], [11]])) == [(0, 0), (1, 1)]
    assert C.jaccard(frozenset({1, 2}), frozenset({2, 3})) == pytest.approx(1 / 3)
    assert C.jaccard(frozenset(), frozenset()) == 1.0


def test_diff_vectors():
    kinds = lambda a, b: [(k, q - p, s - r) for k, p, q, r, s in C.word_diff(a.split(), b.split())]
    assert kinds("a b c", "a x y b c") == [("equal", 1, 1), ("insert", 0, 2), ("equal", 2, 2)]
    assert kinds("one two three four", "one deux trois four") == [("equal", 1, 1), ("replace", 2, 2), ("equal", 1, 1)]
    assert sum(n for k, n, _ in kinds("A B C A B B A", "C B A B A C") if k == "equal") == 4
    assert kinds("", "") == []


@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30))
@settings(max_examples=200, deadline=None)
def test_diff_tiles_both_sides(a, b):
    hunks, x, y = C.word_diff(a, b), 0, 0
    for kind, p, q, r, s in hunks:
        assert (p, r) == (x, y)
        assert kind != "equal" or a[p:q] == b[r:s]
        x, y = q, s
    assert (x, y) == (len(a), len(b))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, v in enumerate(a):
        for j, w in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if v == w else max(table[i][j + 1], table[i + 1][j])
    assert sum(q - p for k, p, q, _, _ in hunks if k == "equal") == table[-1][-1]


def test_sentences():
    assert len(L.sentences("원주율은 3.14입니다. v0.3에서 바뀌었습니다.")) == 2
    assert len(L.sentences("1. one is here. Two?")) == 2
    assert L.sentences("  \n ") == []
    assert L.speakable("com-\npile it") == "compile it"
    long = "this line is long enough to be the longest of all lines here"
    assert len(L.sentences(f"Short title\n{long}\n{long}.")) == 2


def test_paragraphs():
    lines = pd.DataFrame([(0, k, t, s, b, 72.0) for k, (t, s, b) in enumerate([("Title", 24.0, 700.0), ("a hyphen-", 11.0, 660.0), ("ated word", 11.0, 646.0), ("far below", 11.0, 500.0)])], columns=["page", "k", "text", "size", "baseline", "left"])
    assert list(L.paragraphs(lines)["text"]) == ["Title", "a hyphenated word", "far below"]


def test_coalescing_does_not_slide():
    edits = pd.DataFrame([(1, k, "x", t) for k, t in enumerate((0, 300, 500, 600, 1100, 1101))], columns=["user_id", "event_id", "label", "at_ms"])
    assert list(S.coalesce_edits(edits, 500)["at_ms"]) == [0, 600, 1101]


def test_percentiles(spark):
    values = F.array(*[F.lit(float(x)) for x in (4, 1, 3, 2)])
    assert one(spark, S.upper_median(values)) == 3.0
    assert one(spark, S.nearest_rank(values, 0.5)) == 3.0
    assert one(spark, S.nearest_rank(F.array().cast("array<double>"), 0.5)) == 0.0
