"""Hard negatives against brute force over Python integers and against the SQL."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagelore.llm import negatives
from pagelore.llm.queries import OP13_SQL, op13_hard_negatives

from conftest import SF_DIR, same

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int, anchor string, score string"


def brute(rows, is_anchor, positives=5, negatives_=10):
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, own, v in {(i, lab, tuple(v)) for i, lab, v in rows if is_anchor(i)}:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, lab, w in rows if i != a and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2] == own][:positives]:
            fit = [s for s in scored if s[2] != own and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives_]
            out += [(a, pid, k + 1, nid, max(-(2**63) + 1, min(2**63 - 1, -p)), max(-(2**63) + 1, min(2**63 - 1, -n))) for k, (n, nid, _) in enumerate(fit)]
    return out


def vectors(n=400, copies=150):
    rnd = random.Random(3)
    one = lambda k: [rnd.choice([-0.5, -0.25, 0.0, 0.25, 0.5, rnd.random()]) for _ in range(k)]
    hot = one(6)
    out = [(k, hot if k < copies else one(6), rnd.choice([0, 0, 0, 1, 2]), 1, "a", "s") for k in range(n)]
    out += [(1000 + k, one(4), k % 2, 1, "a", "s") for k in range(20)]  # another length
    out += [(2000, None, 1, 1, "a", "s"), (2010, hot, None, 1, "a", "s"), (None, hot, 1, 1, "a", "s"), (2020, [0.1, None, 0.2, 0.1, 0.1, 0.1], 0, 1, "a", "s"), (2030, [math.nan] * 6, 0, 1, "a", "s"), (2040, [math.inf] + [0.5] * 5, 0, 1, "a", "s")]
    out += [(2050, [], 0, 1, "a", "s"), (2060, [], 0, 1, "a", "s"), (2061, [], 1, 1, "a", "s")]
    return out


def found(frame):
    return [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in frame.collect()]


@pytest.mark.parametrize("block_bytes", [negatives.BLOCK_BYTES, 300])
def test_against_brute_force(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 7)
    monkeypatch.setattr(negatives, "WIDTH", 33)
    rows = vectors()
    rows += [rows[10], rows[200]]  # an anchor and another row again
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = found(negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, block_bytes=block_bytes))
    want = brute(rows, lambda i: i % 10 == 0)
    assert sorted(got) == sorted(want)


def test_large_components_stay_exact(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.choice([1.0, 2.0]) * 10.0 ** rnd.randint(0, 9) for _ in range(3)], k % 2, 1, "", "") for k in range(60)] + [(100, [3e37, 1.0, 1.0], 1, 1, "", ""), (101, [2.0**-120, 1e-30, -1e-30], 0, 1, "", "")]
    frame = spark.createDataFrame(rows, SCHEMA.replace("float", "double")).repartition(3)
    got = found(negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, positives=2))
    kept = {(a, b) for a, b, *_ in got}
    want = {w for w in brute(rows, lambda i: i % 10 == 0, 2) if abs(w[4]) < 2**63 - 1}
    assert want and want <= set(got) and kept >= {(w[0], w[1]) for w in want}
    assert all(30 * g[4] <= 100 * g[5] <= 90 * g[4] for g in got)


def test_no_rows(spark):
    frame = negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0)
    assert frame.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and frame.count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, 1, "", "")], SCHEMA)
    assert negatives.hard_negatives(alone, F.col("vec_id") % 10 == 0).count() == 0


def test_query_against_sql(spark, duck):
    same(op13_hard_negatives(spark, SF_DIR), duck.sql(OP13_SQL))
