"""The pipeline's stages, each against a brute-force version on the rows that the stage before kept."""

import collections
import hashlib
import os
import random
import re

import pytest
import regex

import corpus_pipeline
from pagelore.llm import decontam, langid, mixing, sharding, simhash
from pagelore.llm.queries import ORACLES, QUERIES

from conftest import SF_DIR, same
from test_operators import rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and returned, written and read again between them."""
    out, docs, root = [], spark.read.parquet(f"{SF_DIR}/documents.parquet"), tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{root}/{k}"
        stage(spark, docs, SF_DIR).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((docs, new, path))
        docs = new
    return out


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_names_and_columns(stages, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]
    for before, after, _ in stages[:-1]:
        assert before.columns == after.columns
        assert set(ids(after)) <= set(ids(before))
    assert ids(corpus_pipeline.run(spark, SF_DIR)) == ids(stages[-1][1])


def test_language_stage(stages, spark):
    """Every document here is in a taught language; the same words with their letters dealt anew are in none."""
    before, after, _ = stages[0]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    model = langid.fit(before.select("doc_id", "text", "lang"), shares=True)
    assert ids(after) == sorted(d for d, t in texts.items() if explained(model, t))
    rnd = random.Random(2)
    noise = "bcdfghjklmnpqrstvwxz"
    dealt = [(10**6 + d, re.sub(r"[^\W\d_]", lambda _: rnd.choice(noise), t), None, "s", 0) for d, t in texts.items()]
    both = spark.createDataFrame(before.collect() + dealt, before.schema)
    assert ids(corpus_pipeline.language_id(spark, both, SF_DIR)) == ids(after)


def explained(model, text):
    """The rule of the stage, word by word."""
    words = regex.findall(r"\p{L}+", (text or "").lower())
    if not words:
        return False
    grams = model.grams.found
    three = lambda w: [w[k : k + 3] for k in range(max(1, len(w) - 2))]
    shares = [sum(g in grams for g in three(f" {w} ")) / len(three(f" {w} ")) for w in words]
    mean, spread = model.shares[model.languages.index(next(model.scores(iter([text])))[0])]
    return sum(shares) / len(shares) >= langid.FAMILIAR * mean - langid.WIDE * spread / len(shares) ** 0.5


def test_dedup_stage_by_similarity(stages):
    """The stage's contract by comparing all sets of 5-word shingles: of what 0.8 or more connects, the smallest doc_id stays."""
    before, after, _ = stages[1]
    docs = sorted((r["doc_id"], set(simhash.shingle_set(r["text"]).tolist())) for r in before.collect())
    root = list(range(len(docs)))
    for i, (_, a) in enumerate(docs):
        for j, (_, b) in enumerate(docs[:i]):
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert ids(after) == [d for k, (d, _) in enumerate(docs) if root[k] == k]


def test_decontamination_stage(stages, spark):
    before, after, _ = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    gone = set(ids(before)) - set(ids(after))
    whole = [decontam.normal(t) for _, t in items]
    for r in before.collect():
        text = decontam.normal(r["text"])
        near = any(w in text for w in whole) or any(decontam.myers(decontam.masks(w), len(w), text, decontam.budget(len(w)))[0] <= decontam.budget(len(w)) for w in whole)
        assert near == (r["doc_id"] in gone)


def test_mixing_stage(stages):
    before, after, path = stages[3]
    placed = sorted((r["place"], r["doc_id"]) for r in mixing.mix(before).collect())
    assert ids(after) == sorted(d for _, d in placed)
    files = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    import pyarrow.parquet as pq

    assert [d for f in files for d in pq.read_table(f"{path}/{f}")["doc_id"].to_pylist()] == [d for _, d in placed]
    first = collections.Counter(r["source"] for r in before.collect())
    kept = collections.Counter(r["source"] for r in after.collect())
    assert kept == first


def test_place_in_the_mix(stages, spark, tmp_path):
    """The mix comes out of the last stage, which reads files in any order: of equal sources, and of some that run out early."""
    before, after, result = stages[3][0], stages[4][1], corpus_pipeline.run(spark, SF_DIR)
    want = [(k, r["doc_id"], r["in_mix"]) for k, r in enumerate(sorted(mixing.mix(before).collect(), key=lambda r: r["place"]))]
    for frame in (after, result):
        assert sorted((r["place"], r["doc_id"], r["in_mix"]) for r in frame.collect()) == want
    rnd, read = random.Random(4), []
    skewed = [(k, "x" * rnd.randint(0, 300), "en", rnd.choice("aaaaaaaabbc") if k % 50 else None, 1) for k in range(3000)]
    docs = spark.createDataFrame(skewed, before.schema).repartition(7)
    want = [(k, r["doc_id"], r["in_mix"]) for k, r in enumerate(sorted(mixing.mix(docs).collect(), key=lambda r: r["place"]))]
    assert 0 < sum(w[2] for w in want) < len(want)
    mixed = corpus_pipeline.mix_sources(spark, docs, SF_DIR)
    mixed.write.parquet(str(tmp_path / "mixed"))
    for rows in (spark.read.parquet(str(tmp_path / "mixed")), mixed):
        got = corpus_pipeline.shard(spark, rows, SF_DIR)
        assert got.columns == [*docs.columns, "place", "in_mix", "slot", "shard"]
        assert sorted((r["place"], r["doc_id"], r["in_mix"]) for r in got.collect()) == want


def test_sharding_stage(stages):
    before, after, _ = stages[4]
    assert ids(before) == ids(after)
    owner = sharding.fill(sharding.names())
    for r in after.collect():
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.names()[owner[slot]])


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string, score string, n_tokens int, `_row` int, place string"
    for data in (rows(), []):
        docs = spark.createDataFrame(data, schema).select("doc_id", "text", "lang", "source", "n_chars")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{len(data)}-{k}"
            stage(spark, docs, SF_DIR).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() <= len(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck):
    same(QUERIES[name](spark, SF_DIR), duck.sql(ORACLES[name]))


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
