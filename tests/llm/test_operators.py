"""Each operator against a brute-force version, on odd rows and on empty tables."""

import collections
import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelore.llm import brown, chat, decontam, langid, mixing, quality, rangecoder, sharding, simhash, tokencount
from pagelore.llm.common import fold

from conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string, score string, n_tokens int, `_row` int, place string"


def rows():
    """Documents with all that is odd: nulls, blanks, a very long text, repeated rows, clashing columns."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["the", "on", "er", "ti", "ss", "É", "ü", "Ba"]) for _ in range(rnd.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(120)
    texts = [base, base, base + " End", base.replace("the", "THE"), None, "", " \t\n ", "one", "two words", "12 34 !!", text(30_000), "\n".join([text(12)] * 8), "日本語 テキスト です 。", text(60) + " # * $ % & | < >", "x" * 5000]
    out = [(k, t, ("en", "fr", None)[k % 3], ("a", "b", None)[k % 2 + (k % 5 == 0)], 0, "s", "s", 1, 1, "p") for k, t in enumerate(texts)]
    out += [(40 + k, text(rnd.randint(40, 200)), "en" if k % 2 else "fr", "a", 0, "s", "s", 1, 1, "p") for k in range(70)]
    out += [out[0], out[4], out[10]]  # repeated rows
    out += [(None, base, "en", "a", 0, "s", "s", 1, 1, "p"), (None, None, None, None, 0, None, None, None, None, None), (2**60 + 1, base, "fr", "b", 0, "s", "s", 1, 1, "p")]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(low(text))


# chat


def turns(spark, data):
    frame = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    return frame.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))


def test_chat_reads_back_what_it_wrote(spark):
    nasty = ["<turn>", "</turn>\n", r"\p<\p/turn>", r"\s\\s", "<<turn>turn>", "<image>", "a\nb", "", None, "é🙂</turn>"]
    data = [(1, k, "assistant" if k % 2 else "us\ner\\n", t) for k, t in enumerate(nasty)] + [(None, 0, None, "x"), (None, None, "assistant", "y"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    back = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(turns(spark, data))).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["read"]] == [(r, t or "") for _, _, r, t in data[: len(nasty)]]
    assert [t["loss_text"] for t in back[1]["read"]] == [(t or "") if r == "assistant" else "" for _, _, r, t in data[: len(nasty)]]
    assert [t["role"] for t in back[None]["read"]] == ["assistant", ""]
    assert len(back[2]["read"]) == 2
    assert back[1]["formatted"].count(chat.CLOSE) == len(nasty)


def test_chat_attachments(spark):
    parts = spark.sql(f"""
        SELECT CAST(1 AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, from_json('[{{"type":"text","text":"see <image> "}},{{"type":"image","ref":"i.png","width":28,"height":15}},
          {{"type":"audio","ref":"a.wav","millis":81}},{{"type":"document","ref":"d.pdf","pages":2}},{{"type":"text","text":"end"}}]', 'array<{chat.PART}>') AS parts
        UNION ALL SELECT 1, 1, 'assistant', null""")
    row = chat.format_chat(parts).first()
    assert [(a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(0, "image", "i.png", 4), (1, "audio", "a.wav", 3), (2, "document", "d.pdf", 512)]
    assert row["attachment_tokens"] == 519
    assert row["formatted"] == "<turn>user\nsee <\\pimage> <image><audio><document>end</turn>\n<turn>assistant\n</turn>\n"


def test_chat_empty(spark):
    assert chat.read_chat(chat.format_chat(turns(spark, []))).count() == 0


# sharding


def test_lookup_table():
    names = sharding.names(7)
    owner = sharding.fill(names, 101)
    counts = collections.Counter(owner)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(names[:-1], 101)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6) < 30
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 101)
    with pytest.raises(ValueError):
        sharding.fill(names, 100)


def test_placement(spark, odd, none):
    placed = sharding.assign(odd)
    assert placed.count() == odd.count() and placed.columns.count("slot") == 1
    owner = sharding.fill(sharding.names())
    for r in placed.select("doc_id", "slot", "shard").collect():
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.names()[owner[slot]])
    assert sharding.assign(none).count() == 0


# SimHash


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(a))]


def near_fingerprints(n=1500, seed=1):
    """Clusters of every kind: chains, dense balls, shared leading bits, loners."""
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rnd.getrandbits(64) if rnd.random() < 0.5 else rnd.getrandbits(20)
        for _ in range(rnd.choice([1, 1, 5, 40])):
            out.add(x)
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("leaf", [8192, 20])
def test_links_find_every_component(spark, leaf):
    fps = near_fingerprints()
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {r["a"]: r["root"] for r in simhash.components(simhash.links(frame, leaf)).collect()}
    want = brute_components(fps)
    groups = collections.defaultdict(set)
    for x, k in zip(signed, want, strict=True):
        groups[k].add(x)
    for members in groups.values():
        assert {got.get(x, x) for x in members} == {min(members)}


def test_index_prunes_nothing_near():
    rnd = np.random.default_rng(3)
    codes = np.unique(np.concatenate([rnd.integers(0, 2**64, 500, np.uint64), rnd.integers(0, 2**9, 300).astype(np.uint64)]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    q, c = simhash.near(simhash.hierarchy(codes), codes[:100])
    want = {(i, j) for i in range(100) for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert set(zip(q.tolist(), c.tolist(), strict=True)) == want


def test_near_duplicates(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    data = rows()
    fps = [brute_fingerprint(r[1]) for r in data]
    comp = brute_components(fps)
    least = {}
    for r, k in zip(data, comp, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = collections.Counter((r[0], f"{f:016x}", least.get(k)) for r, f, k in zip(data, fps, comp, strict=True))
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def copy_components(texts):
    """Components of a similarity of 0.8 or more of the sets of 5-word shingles, by comparing all of them."""
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = root[i], root[j]
                root = [min(a, b) if k in (a, b) else k for k in root]
    return root


def test_one_of_each(spark, odd, none):
    data = rows()
    least = {}
    for r, k in zip(data, copy_components([r[1] for r in data]), strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    kept = [r["doc_id"] for r in simhash.one_of_each(odd).collect()]
    assert sorted(kept) == sorted(set(least.values()))
    assert simhash.one_of_each(none).count() == 0
    alone = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "not that one"), (7, "other words are here"), (None, "other words are here")], "doc_id bigint, text string")
    got = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(alone).collect()]
    assert sorted(got, key=str) == [(7, "other words are here"), (None, "a b c d"), (None, "not that one")]


@pytest.mark.parametrize("leaf", [8192, 30])
def test_near_copies_are_found(spark, leaf):
    """Of copies with a similarity of 0.8 or more nineteen of twenty meet; unrelated texts never do."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    data, near = [], []
    for k in range(120):
        base = [word() for _ in range(rnd.randint(60, 300))]
        copy = list(base)
        for _ in range(rnd.randint(0, len(base) // 45)):
            copy[rnd.randrange(len(copy))] = word()
        sets = [set(zip(*(x[d:] for d in range(5)), strict=False)) for x in (base, copy)]
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            near.append(k)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(data, "doc_id bigint, text string"), leaf).collect()}
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(120))
    assert len(near) > 60 and sum(got[2 * k + 1] == 2 * k for k in near) >= 0.95 * len(near)


def five_words(text):
    w = text.split()
    return set(zip(*(w[k:] for k in range(5)), strict=False))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def changed(rnd, base, n):
    """``base`` with ``n`` words changed, apart from each other."""
    out = list(base)
    for k in rnd.sample(range(len(base) // 8), n):
        out[8 * k + 4] = f"new{rnd.randrange(10**9)}"
    return out


def test_recall_does_not_depend_on_the_number_of_texts():
    """A text's nodes come from the text alone, as many for ten million texts as for two; pairs barely over 0.8 share one."""
    rnd = random.Random(5)
    pairs = []
    while len(pairs) < 400:
        base = [f"w{rnd.randrange(10**6)}" for _ in range(304)]
        copy = changed(rnd, base, 6)
        if 0.8 <= jaccard(five_words(" ".join(base)), five_words(" ".join(copy))) < 0.83:
            pairs.append((" ".join(base), " ".join(copy)))
    nodes = lambda t: set(simhash.copy_nodes(simhash.shingle_set(t)))
    assert all(len(nodes(a)) == simhash.COPY_BANDS for a, _ in pairs)
    assert sum(bool(nodes(a) & nodes(b)) for a, b in pairs) >= 398
    assert len(set().union(*(nodes(a) for a, _ in pairs))) == 400 * simhash.COPY_BANDS


@pytest.mark.parametrize("leaf", [8192, 6])
def test_large_families_lose_no_link(spark, leaf):
    """Families of which all nodes are over ``leaf``: chains whose ends are unlike, stars whose copies are unlike each other."""
    rnd = random.Random(6)
    texts = []
    for _ in range(2):
        now = [f"w{rnd.randrange(10**6)}" for _ in range(160)]
        for _ in range(60):
            texts.append(" ".join(now))
            now = changed(rnd, now, 2)
        base = [f"w{rnd.randrange(10**6)}" for _ in range(304)]
        texts += [" ".join(base), *(" ".join(changed(rnd, base, rnd.choice([5, 6, 9]))) for _ in range(60))]
    sets, root = [five_words(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), leaf).collect()}
    assert [got[k] for k in range(len(texts))] == root
    assert 4 < len(set(root)) < len(texts) / 2


def test_texts_of_one_template_are_not_compared(spark):
    """Half of each text is the same: they share nodes, but no shingle that is rare among them. Copies of such texts are found all the same."""
    rnd = random.Random(12)
    template = [f"t{k}" for k in range(200)]
    bases = [[*template, *(f"w{rnd.randrange(10**9)}" for _ in range(100))] for _ in range(300)]
    texts = [" ".join(b) for b in bases] + [" ".join(changed(rnd, b, 3)) for b in bases[:40]]
    sets = [simhash.shingle_set(t) for t in texts]
    at = np.unique(np.concatenate(sets), return_inverse=True)[1]
    some = simhash.joinable(at, np.array([len(x) for x in sets]), np.arange(len(sets)))
    assert set(some.tolist()) == {*range(40), *range(300, 340)}
    for leaf in (simhash.COPY_LEAF, 20):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), leaf).collect()}
        assert got == {k: k if k < 300 else k - 300 for k in range(340)}


def test_rare_shingles_lose_no_pair():
    rnd = random.Random(13)
    for _ in range(200):
        pool = list(range(rnd.randint(3, 40)))
        sets = [np.array(sorted(rnd.sample(pool, rnd.randint(1, len(pool))))) for _ in range(12)]
        size, at = np.array([len(x) for x in sets]), np.unique(np.concatenate(sets), return_inverse=True)[1]
        some = set(simhash.joinable(at, size, np.arange(12)).tolist())
        for i in range(12):
            for j in range(i):
                if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                    assert {i, j} <= some


def test_blocks_find_what_the_whole_finds():
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(160)]
    texts = [" ".join(changed(rnd, base, rnd.randrange(1, 5))) for _ in range(40)]
    sets = [simhash.shingle_set(t) for t in texts]
    prints = np.array([np.frombuffer(simhash.wide_fingerprint(t), np.uint64) for t in texts])
    links = simhash.across(sets, prints, np.arange(40))
    close = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    assert links and all(close(sets[i], sets[j]) for i, j in links)
    root = np.arange(40)
    for i, j in links:
        root[root == root[j]] = root[i]
    assert all(root[i] == root[j] for i in range(40) for j in range(i) if close(sets[i], sets[j]))


def test_links_are_similarities_of_sets(spark):
    """Under 0.8 nothing links, not by much-repeated passages either; how often a passage is repeated doesn't matter."""
    rnd = random.Random(8)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        base = new(304)
        texts += [base, changed(rnd, base, 8)]
    passage = new(12)
    texts += [passage * 40 + new(60), passage * 40 + new(60), passage * 3, passage * 9]
    texts = [" ".join(t) for t in texts]
    assert all(0.7 < jaccard(five_words(texts[2 * k]), five_words(texts[2 * k + 1])) < 0.8 for k in range(40))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {k: k for k in range(83)} | {83: 82}


def test_same_id_different_texts(spark):
    """Rows that share an id are rows: only copies go."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue white black grey")
    data = [(1, a), (1, a), (1, b), (2, b + " "), (None, c), (None, a), (3, c)]
    got = sorted((r["doc_id"], r["text"].strip()) for r in simhash.one_of_each(spark.createDataFrame(data, "doc_id bigint, text string")).collect())
    assert got == [(1, a), (1, b), (3, c)]


def test_gray_order_of_wide_codes():
    """Rows of words sort as one long word does, and the hierarchy prunes nothing near."""
    rnd = np.random.default_rng(4)
    codes = rnd.integers(0, 2**64, (300, 4), np.uint64)
    codes[100:200] = codes[:100] ^ (np.uint64(1) << rnd.integers(0, 64, (100, 4)).astype(np.uint64))
    whole = [sum(int(w) << 64 * (3 - k) for k, w in enumerate(row)) for row in codes]

    def rank(x):
        out = 0
        while x:
            out, x = out ^ x, x >> 1
        return out

    order = simhash.gray_order(codes)
    assert order.tolist() == sorted(range(300), key=lambda k: rank(whole[k]))
    q, c = simhash.near(simhash.hierarchy(codes[order]), codes[:150], 110)
    want = {(i, j) for i in range(150) for j in range(300) if (whole[i] ^ whole[j]).bit_count() <= 110}
    assert set(zip(q.tolist(), order[c].tolist(), strict=True)) == want


# language identification


def test_languages(spark, docs, odd, none):
    got = langid.identify(docs.select("doc_id", "text", "lang"), fold("doc_id", 4) != 2).collect()
    held = [r for r in got if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    for r in langid.identify(odd).collect():
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"]))
    assert langid.identify(none).count() == 0 and langid.accepted(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}
    assert langid.accepted(odd).columns == odd.columns
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    # without a label all letters stay; with labels only what the labelled rows explain
    texts = [{r["text"] for r in langid.accepted(x).select("text").collect()} for x in (unlabelled, odd)]
    assert texts[1] < texts[0] and texts[0] - texts[1] == {"two words", "x" * 5000}


def test_rejected_by_prediction(spark):
    """Letters are not enough: text that no taught language knows goes. Columns of any name stay, a null lang is filled."""
    data = [(k, "the house on the hill and the river" if k % 2 else "la maison sur la colline et le fleuve", "en" if k % 2 else "fr", "p", "v") for k in range(40)]
    data += [(50, "привет мир и ещё", None, "p", "v"), (51, "the river", None, "p", "v"), (52, "日本語", "", "p", "v"), (53, "12 !", "en", "p", "v"), (51, "the river", None, None, "v"), (None, "le fleuve", None, "p", None)]
    frame = spark.createDataFrame(data, "doc_id bigint, text string, lang string, _p string, _verdict string")
    taught = frame.filter("lang != '' or lang is null")
    got = langid.accepted(taught)
    assert got.columns == frame.columns
    assert sorted(((r["doc_id"], r["lang"], r["_p"], r["_verdict"]) for r in got.collect()), key=str) == sorted(((d, lang or ("fr" if t.startswith("le") else "en"), p, v) for d, t, lang, p, v in data if d not in (50, 52, 53)), key=str)
    assert {(r["doc_id"], r["_p"], r["_verdict"]) for r in langid.identify(frame).collect()} == {(d, p, v) for d, _, _, p, v in data}


def test_noise_in_known_letters_goes(spark):
    data = [(k, "the house on the hill and the river" if k % 2 else "la maison sur la colline et le fleuve", "en" if k % 2 else "fr") for k in range(40)]
    noise = ["zxqv wvkj qqqx zzzk " * 20, "qqqq", "QQQQ zzzz", "xkcd wvvv"]
    kept = ["hill", "the hous", "fleuves", "colline qqqq la maison"]
    frame = spark.createDataFrame(data + [(100 + k, t, None) for k, t in enumerate(noise)] + [(200 + k, t, None) for k, t in enumerate(kept)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in langid.accepted(frame).collect()}
    assert set(got) == set(range(40)) | {200, 201, 202, 203}
    assert (got[200], got[201], got[202]) == ("en", "en", "fr")
    # a prediction that does not stand out fills nothing
    assert {r["lang"] for r in langid.accepted(frame, edge=1.0).filter("doc_id >= 200").collect()} == {None}


def test_many_labels(spark):
    """A dirty label column ends nothing: the most frequent labels teach."""
    data = [(k, "word aa" if k % 2 else "other bb", "xx" if k % 2 else "yy") for k in range(20)] + [(100 + k, f"t{k}", f"l{k}") for k in range(langid.LANGUAGES + 50)]
    got = langid.identify(spark.createDataFrame(data, "doc_id bigint, text string, lang string")).filter("doc_id < 20").collect()
    assert all(r["lang_pred"] == ("xx" if r["doc_id"] % 2 else "yy") for r in got)


def brute_language(data, text):
    """Word-first backoff as the module says it, for rows (text, lang) that all teach and lists that cut nothing off."""
    letters = lambda t: __import__("regex").findall(r"\p{L}+", t.lower())
    langs = sorted({lang for _, lang in data})
    words, grams = {x: collections.Counter() for x in langs}, {x: collections.Counter() for x in langs}
    for t, lang in data:
        words[lang].update(letters(t))
    for lang in langs:
        for w, n in words[lang].items():
            p = f" {w} "
            for size in range(1, 5):
                for k in range(len(p) - size + 1):
                    grams[lang][p[k : k + size]] += n
        del grams[lang][" "]
    def log(table, x):  # noqa: E301
        return [math.log((table[lang][x] + 0.5) / (sum(table[lang].values()) + 0.5)) for lang in langs]

    total = [0.0] * len(langs)
    for w in letters(text):
        if any(words[lang][w] for lang in langs):
            add = log(words, w)
        else:
            p, k, found = f" {w} ", 0, []
            while k < len(p):
                size = next((z for z in range(min(4, len(p) - k), 0, -1) if any(grams[lang][p[k : k + z]] for lang in langs)), 0)
                if size:
                    found.append(log(grams, p[k : k + size]))
                k += size or 1
            add = [sum(x) / len(found) for x in zip(*found, strict=True)] if found else [0.0] * len(langs)
        total = [a + b for a, b in zip(total, add, strict=True)]
    best = max(range(len(langs)), key=lambda k: (total[k], -k))
    return langs[best], 1 / sum(math.exp(x - total[best]) for x in total)


def test_predictions_against_brute_force(spark, docs):
    """On whole documents of every language, on unseen words, and on texts that mix them."""
    data = [(r["doc_id"], r["text"], r["lang"]) for r in docs.limit(60).collect()]
    asked = [(1000 + k, " ".join(reversed(t.split()))[:400], None) for k, (_, t, _) in enumerate(data[:30])] + [(2000, "Zzyx qwrt ünder", None), (2001, "kkkk", None), (2002, "the de la und", None)]
    model = langid.fit(spark.createDataFrame(data, "doc_id bigint, text string, lang string"), sample=10**9, words=10**6, grams=10**6)
    for _, t, _ in asked:
        got = next(model.scores(iter([t])))
        want = brute_language([(x, lang) for _, x, lang in data], t)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-6)


def test_backoff():
    model = langid.Model(["aa", "bb"], {"word": np.array([-1.0, -2.0])}, {"qu": np.array([-9.0, -1.0]), "q": np.array([-1.0, -9.0]), "u": np.array([-1.0, -9.0])}, np.zeros(2))
    assert list(langid.Model.word(model, "word")) == [-1.0, -2.0]
    assert list(langid.Model.word(model, "qu")) == [-9.0, -1.0]  # the longer n-gram goes first
    assert list(langid.Model.word(model, "uq")) == [-1.0, -9.0]


# language model


def check_scores(frame, teach, data, **sizes):
    got = collections.defaultdict(list)
    for r in brown.language_model(frame, teach, **sizes).collect():
        got[r["doc_id"]].append(r)
    counts = collections.Counter()
    for d, t in data:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            counts.update([*words(t), None])
    whole, kinds = sum(counts.values()), len(counts)
    texts = collections.defaultdict(collections.Counter)
    for d, t in data:
        texts[d][t] += 1
    for d, own in texts.items():
        want = []
        for t, n in own.items():
            w = [*words(t), None]
            base = sum(math.log10((counts[x] + 0.5) / (whole + 0.5 * (kinds + 1))) for x in w)
            want += [(len(w), sum(counts[x] > 0 for x in w), whole, round(base, 6))] * n
        assert sorted(want) == sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got[d])
    return got


def test_scores(spark, docs, odd, none):
    got = check_scores(docs, fold("doc_id", 5) != 1, [(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [r for own in got.values() for r in own if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    got = check_scores(odd, fold("doc_id", 5) != 1, [(r[0], r[1]) for r in rows()], listed=30, own=10, endings=5)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for own in got.values() for r in own)
    assert brown.language_model(none, F.lit(True)).count() == 0
    assert all(r["score"] <= 1e-9 and r["n_known"] == 0 for r in brown.language_model(odd, F.lit(False)).collect())


def test_probabilities_add_up(spark):
    """Over all words of the teaching texts and the end, what may follow a context adds up to no more than one, and nearly to it."""
    texts = ["a b a c", "b a b d e", "c c a b zz"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    counts = brown.word_counts(frame)
    model = brown.fit(frame, counts, listed=3, own=2, endings=2, classes=4)
    known = {bytes(r["word"]): r["n"] for r in counts.collect()}
    item = lambda w: int(brown.item_of(model.items, brown.sequence(model.items, [w], {}))[0])
    for before in range(int(model.own.max()) + 1):
        total = 10 ** (model.step[before, model.own[brown.END]] + model.emit[brown.END])
        for w, n in known.items():
            k = item(w)
            inside = 0.0 if model.share[k] == 0 else math.log10(n + 0.5) - model.share[k]
            total += 10 ** (model.step[before, model.own[k]] + model.emit[k] + inside)
        assert 0.5 < total <= 1 + 1e-9


def brute_score(model, texts, text):
    """The classes are the model's; everything else is worked out again from the texts."""
    number = {None: brown.END}
    number.update({w: int(brown.item_of(model.items, brown.sequence(model.items, [w.encode()], {}))[0]) for t in [*texts, text] for w in words(t)})
    count, pairs, seen, classes = collections.Counter(), collections.Counter(), collections.Counter(), int(model.own.max()) + 1
    of = lambda w: int(model.own[number[w]])
    for t in texts:
        own = [None, *words(t), None]
        count.update(own[1:])
        pairs.update((of(a), of(b)) for a, b in zip(own, own[1:], strict=False))
        seen.update(number[w] for w in own[1:])
    out, into = collections.Counter(), collections.Counter()
    for (a, b), n in pairs.items():
        out[a] += n
        into[b] += n
    whole, total = sum(pairs.values()), 0.0
    own = [None, *words(text), None]
    for a, b in zip(own, own[1:], strict=False):
        prior = (into[of(b)] + 0.5) / (whole + 0.5 * classes)
        total += math.log10((pairs[of(a), of(b)] + 5 * prior) / (out[of(a)] + 5))
        members = int((model.own == of(b)).sum())
        total += math.log10((seen[number[b]] + 0.5) / (into[of(b)] + 0.5 * members))
        first = model.items.n - len(model.items.words)
        if brown.END < number[b] < first:
            kinds = [w for w in count if number[w] == number[b]]
            total += math.log10((count[b] + 0.5) / (sum(count[w] for w in kinds) + 0.5 * (len(kinds) + 1)))
    return total


@pytest.mark.parametrize("sizes", [{"listed": 60, "own": 12, "endings": 8, "classes": 7}, {"listed": 500, "own": 40, "endings": 30, "classes": 10, "rounds": 3}])
def test_score_against_brute_force(spark, docs, sizes):
    data = [(r["doc_id"], r["text"]) for r in docs.limit(40).collect()] + [(9001, None), (9002, "new words only, qq"), (9003, "the the the the")]
    frame = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    teach = fold("doc_id", 5) != 1
    texts = [t for d, t in data if zlib.crc32(str(d).encode()) % 5 != 1]
    model = brown.fit(frame.filter(teach), brown.word_counts(frame.filter(teach)), **sizes)
    got = {r["doc_id"]: r["score"] for r in brown.language_model(frame, teach, **sizes).collect()}
    for d, t in data:
        assert got[d] == pytest.approx(brute_score(model, texts, t), abs=1e-6)


def test_rounds_move_each_word_to_its_best_class(spark):
    """Every word that isn't fixed goes where the likelihood of the whole, worked out again, is highest while the others stay."""
    rnd = np.random.default_rng(3)
    seqs = [rnd.integers(1, 25, rnd.integers(0, 30)) for _ in range(40)] + [np.array([7, 7, 7, 7])]
    texts = spark.createDataFrame([(bytearray(q.astype("<i4").tobytes()),) for q in seqs], "seq binary").repartition(4)
    pairs = np.zeros((26, 26))
    for q in seqs:
        own = [0, *q.tolist(), 0]
        np.add.at(pairs, (own[:-1], own[1:]), 1)
    of = np.append(0, 1 + np.arange(25) % 4)
    fixed = np.arange(26) < 3
    table = brown.pair_table(texts, of, 5)
    one = np.eye(5)[of]
    assert (table == one.T @ pairs @ one).all() and brown.likelihood(table) == pytest.approx(likelihood(pairs, of))
    got = brown.moved(texts, of, table, fixed)
    assert (got[fixed] == of[fixed]).all() and got[25] == of[25] and (got != of).any()
    for k in range(3, 25):
        tried = {}
        for c in range(1, 5):
            other = of.copy()
            other[k] = c
            tried[c] = likelihood(pairs, other)
        assert tried[int(got[k])] == pytest.approx(max(tried.values()))


def test_rounds_raise_the_likelihood_of_all_listed_words(spark, docs):
    """Words beyond the core leave their ending's class, and texts that were not learnt from are more likely by it."""
    teach = fold("doc_id", 5) != 1
    sizes = {"listed": 5000, "own": 100, "endings": 50, "classes": 16}
    counts = brown.word_counts(docs.filter(teach))
    before, after = (brown.fit(docs.filter(teach), counts, rounds=n, **sizes) for n in (0, 2))
    first = after.items.n - len(after.items.words)
    assert (before.own[: first + 100][[0, *range(first, first + 100)]] == after.own[: first + 100][[0, *range(first, first + 100)]]).all()
    assert (before.own != after.own).mean() > 0.2
    score = [sum(r["score"] for r in brown.language_model(docs, teach, rounds=n, **sizes).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for n in (0, 2)]
    assert score[1] > score[0]


def likelihood(pairs, of):
    one = np.eye(of.max() + 1)[of]
    table = one.T @ pairs @ one
    x = lambda a: np.where(a > 0, a * np.log(np.maximum(a, 1)), 0).sum()
    return x(table) - x(table.sum(1)) - x(table.sum(0))


def test_exchange_ends_where_no_move_helps():
    rnd = np.random.default_rng(0)
    pairs = np.zeros((31, 31))
    for _ in range(3000):
        a = rnd.integers(1, 31)
        pairs[a, (a + rnd.integers(0, 3) * 3) % 30 + 1] += 1
    of = brown.exchange(pairs, 5, sweeps=50)
    assert of[0] == 0 and set(of[1:]) <= set(range(1, 5))
    best = likelihood(pairs, of)
    start = np.zeros(31, np.int64)
    start[np.argsort(-pairs.sum(1), kind="stable")[:30]] = 1 + np.arange(30) % 4
    assert best > likelihood(pairs, start)
    for k in range(1, 31):
        for c in range(1, 5):
            moved = of.copy()
            moved[k] = c
            assert likelihood(pairs, moved) <= best + 1e-6


# quality


def brute_statistics(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, odd, none):
    data = [(r[0], r[1]) for r in rows()]
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.judge(odd).collect())
    assert got == collections.Counter((d, *brute_statistics(t)) for d, t in data)
    assert quality.judge(none).count() == 0
    for r in quality.judge(docs).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_robust_estimate(spark):
    """A fifth of far rows moves neither the centre nor the spread, and every far row is rejected."""
    rnd = np.random.default_rng(1)
    good, far = rnd.normal([5, 1, 1, 1], [0.5, 0.3, 0.4, 0.3], (800, 4)), rnd.normal([9, 4, 5, 6], 0.1, (200, 4))
    frame = spark.createDataFrame([("g", *map(float, x)) for x in np.concatenate([good, far])], "g string, " + ", ".join(f"{d} double" for d in quality.DIMS))
    found = quality.robust(frame)
    row = found.first()
    assert np.allclose([row[f"m{k}"] for k in range(4)], [5, 1, 1, 1], atol=0.15)
    apart = [r["d"] for r in frame.join(found, "g").select(quality.distance().alias("d")).orderBy("d").collect()]
    assert sum(d > 4 * quality.chi2_point(1 - quality.TAIL, 4) for d in apart) == 200
    assert quality.chi2_even(quality.chi2_point(0.75, 4), 4) == pytest.approx(0.75)
    assert quality.chi2_point(0.5, 2) == pytest.approx(2 * math.log(2))


def test_each_dimension_rejects_by_itself(spark):
    """Among clean texts a text is rejected for any one statistic, and the clean ones stay."""
    rnd = random.Random(9)
    word = lambda lo=2, hi=9: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(lo, hi)))
    lines = lambda w: "\n".join(" ".join(w[k : k + 7]) for k in range(0, len(w), 7))
    clean = [lines([word() for _ in range(rnd.randint(150, 400))]) for _ in range(150)]
    block = [word() for _ in range(30)]
    repeats = lines([word() for _ in range(55)] + block + [word() for _ in range(20)] + block + [word() for _ in range(35)] + block)
    doubled = "\n".join(x for _ in range(10) for x in (" ".join(word() for _ in range(20)), "one", "two"))
    symbols = lines([word() + ("#" if k % 3 == 0 else "") for k in range(200)])
    long = lines([word(8, 20) for _ in range(200)])
    texts = [*clean, repeats, doubled, symbols, long]
    frame = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge(frame).collect()}
    assert not any(got[k]["base_failed"] for k in range(154))
    assert all(got[k]["kept"] for k in range(150))
    assert [got[k]["kept"] for k in range(150, 154)] == [False] * 4
    assert 0.4 < got[150]["n_repeat_words"] / got[150]["n_words"] < 0.5 and got[151]["n_dup_lines"] == 18 and got[152]["n_symbols"] / got[152]["word_chars"] < 0.087


def brute_mcd(x, tries=60):
    """Mean and covariance of the three quarters of rows with the smallest determinant, from many random starts to the end."""
    rnd, h, best = np.random.default_rng(0), int(np.ceil(0.75 * len(x))), None
    cov = lambda rows: np.cov(rows.T, bias=True) + np.diag(quality.RIDGE)
    for _ in range(tries):
        own = x[rnd.choice(len(x), 12, replace=False)]
        for _ in range(60):
            d = x - own.mean(0)
            own = x[np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov(own)), d), kind="stable")[:h]]
        det = np.linalg.det(cov(own))
        if best is None or det < best[0]:
            best = det, own.mean(0), cov(own)
    return best


def test_verdicts_against_brute_force(spark):
    """Estimate, distance and verdict by numpy from the statistics of whole texts, for two groups with junk of every kind in less than the
    quarter of rows that an estimate bears."""
    rnd = random.Random(12)
    word = lambda lo=2, hi=9: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(lo, hi)))
    data = []
    for k in range(300):
        w = [word() for _ in range(rnd.randint(60, 400))]
        if k % 8 == 0:  # some symbols, long words or repeats, from harmless to heavy
            heavy = rnd.random()
            w = [word(2, 9 + int(20 * heavy)) + ("#" if rnd.random() < heavy / 3 else "") for _ in w]
        lines = [" ".join(w[i : i + 8]) for i in range(0, len(w), 8)]
        if k % 11 == 0:
            lines += lines[: int(len(lines) * rnd.random() * 0.6)]
        data.append((k, "\n".join(lines), "en", "a" if k % 3 else "b"))
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")).collect()}
    widen = 0.75 / quality.chi2_even(quality.chi2_point(0.75, 4), 6)
    limit, near, rejected = quality.chi2_point(1 - quality.TAIL, 4), 0, 0
    for source in "ab":
        stats = {d: brute_statistics(t) + (sum(1 for x in t.split("\n") if WORD.search(x)),) for d, t, _, s in data if s == source}
        vec = {d: np.array([math.log((c + 1) / (n + 1)), math.sqrt(sy / max(c, 1)), math.sqrt(du / max(li, 1)), math.sqrt(max(0, re_ / max(n, 1) - min(n * quality.CHANCE, quality.MOST_CHANCE)))]) for d, (n, c, sy, du, re_, li) in stats.items()}
        passed = [d for d, (n, _, _, _, re_, _) in stats.items() if n >= 50 and 100 * re_ <= 50 * n]
        _, mean, cov = brute_mcd(np.array([vec[d] for d in passed]))
        for d, (n, c, _, _, _, li) in stats.items():
            noise = np.diag([k / 4 / max(m, 1) for k, m in zip(quality.CLUMP, (n, c, li, n), strict=True)])
            x = vec[d] - mean
            far = x @ np.linalg.inv(cov * widen + noise) @ x
            near += abs(math.log(far / got[d]["distance"])) < 0.25
            rejected += d in passed and far > limit
            if d not in passed:
                assert got[d]["base_failed"] and not got[d]["kept"]
            elif not 0.8 < far / limit < 1.25:
                assert got[d]["kept"] == (far <= limit), (d, far, got[d]["distance"])
    assert near >= 285 and rejected > 10


# decontamination


def brute_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_myers():
    rnd = random.Random(2)
    for _ in range(150):
        p, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, n))) for n in (70, 90))
        want = brute_distance(p, t)
        assert decontam.myers(decontam.masks(p), len(p), t, len(p))[0] == min(want, len(p))


def test_decontamination_finds_all_within_budget(spark, none):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcde ") for _ in range(n))
    items = [(k, " ".join(text(rnd.randint(30, 150)).split())) for k in range(12)] + [(50, "short one"), (51, None), (52, "  "), (53, items_dup := "same item text that is twice there"), (53, items_dup)]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            k = rnd.randrange(len(t))
            op = rnd.random()
            t[k : k + 1] = [] if op < 0.3 else ["Z"] if op < 0.7 else [t[k], "q"]
        return "".join(t)

    data = []
    for k in range(150):
        _, t = items[k % 12]
        data.append((k, text(80) + "  " + edited(t, rnd.randint(0, 2 * decontam.budget(len(t)))).upper() + "\n " + text(60)))
    data += [(200, "a SHORT  one is here"), (201, "a shart one"), (202, None), (203, ""), (None, items_dup), (204, items_dup)]
    docs, bench = spark.createDataFrame(data, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = collections.Counter()
    for d, t in data:
        for i, x in items:
            p = decontam.normal(x)
            if p and decontam.normal(t):
                far = brute_distance(p, decontam.normal(t))
                if far <= decontam.budget(len(p)):
                    want[d, i, far] += 1
    for block in (decontam.BLOCK_CHARS, 300):
        got = collections.Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contaminated(docs, bench, block_chars=block).collect())
        assert got == want
    dirty = {d for d, *_ in want}
    assert [r["doc_id"] for r in decontam.clean(docs, bench).orderBy("doc_id").collect()] == sorted(d for d, _ in data if d not in dirty)
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == docs.count()
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


# mixing


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 5, "b": 3, "c": 2}, {k: 1.0 + k % 7 for k in range(40)}, {"a": 0.999, "b": 0.001, None: 0.2}])
def test_schedule_is_within_one_block(weights):
    slots = mixing.shares(weights)
    plan, whole = mixing.schedule(slots), sum(slots.values())
    had = collections.Counter()
    for t, (s, j) in enumerate(plan, 1):
        assert j == had[s]
        had[s] += 1
        for x, n in slots.items():
            assert abs(had[x] - n * t / whole) < 1
    assert had == slots


def test_mix(spark, docs, odd, none):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and [c for c in got.columns if c == "place"] == ["place"]
    per = collections.defaultdict(list)
    for r in got.collect():
        per[r["source"]].append(r)
    for own in per.values():
        assert sorted(r["block"] for r in own) == [k // mixing.BLOCK for k in range(len(own))]
    assert len({r["place"] for own in per.values() for r in own}) == odd.count()
    mixed = mixing.mix(docs, {"src0": 3.0, "src1": 1.0}, block=1).filter("in_mix").orderBy("place").collect()
    for n in range(1, len(mixed)):
        share = sum(r["source"] == "src0" for r in mixed[:n])
        if mixed[n - 1]["slot"] == n - 1:  # no source has run out yet
            assert abs(share - 0.75 * n) < 1.01
    assert mixing.mix(docs, {"nowhere": 1.0}).filter("in_mix or slot is not null").count() == 0
    assert mixing.mix(none).count() == 0 and mixing.interleaved(none).count() == 0
    # a user's own columns stay, also where mix() adds one of the name
    own = odd.withColumn("block", F.lit("mine")).withColumn("in_mix", F.col("doc_id"))
    assert mixing.interleaved(own).columns == own.columns
    assert collections.Counter(map(tuple, mixing.interleaved(own).collect())) == collections.Counter(map(tuple, own.collect()))


def test_mix_leaves_no_row_out(spark):
    """Without weights all rows stay, in the order of the mix; given weights hold within a block to the end of the mix."""
    data = [(k, "large" if k % 3 == 0 else f"s{k % 20}") for k in range(3000)]
    frame = spark.createDataFrame(data, "doc_id bigint, source string")
    got = [(r["doc_id"], r["source"]) for r in mixing.interleaved(frame).collect()]
    assert sorted(got) == data
    assert got == [(r["doc_id"], r["source"]) for r in mixing.mix(frame).orderBy("place").collect()]
    weights = {"large": 1.0, "s1": 1.0, "s2": 2.0}
    slots = mixing.shares(weights)
    mixed = mixing.mix(frame, weights).filter("in_mix").orderBy("place").collect()
    had, whole = collections.Counter(), sum(slots.values())
    for t, r in enumerate(mixed, 1):
        had[r["source"]] += 1
        assert all(abs(had[s] - n * t / whole) < 2 * mixing.BLOCK for s, n in slots.items())
    assert {r["slot"] for r in mixed} == set(range(len(mixed) // mixing.BLOCK + (len(mixed) % mixing.BLOCK > 0)))


@pytest.mark.parametrize("sizes, weights", [({"a": 1000, "b": 100}, {"a": 1.0, "b": 1.0}), ({"a": 1000, "b": 100}, None), ({"a": 900, "b": 50, "c": 333}, {"a": 1, "b": 1, "c": 1}), ({"a": 5, None: 4000, "c": 37}, None)])
def test_skewed_sources_reach_their_weights(spark, sizes, weights):
    """At every slot of the mix each source has had within one block of its share, and the mix ends where a source has none left."""
    data = [(None if k % 9 == 0 else k, s, "u", 7, "w") for s, n in sizes.items() for k in range(n)]
    frame = spark.createDataFrame(data, "doc_id bigint, source string, _s string, _k int, s string")
    got = mixing.mix(frame, weights)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(data, key=str)
    slots = mixing.shares(mixing.softened(sizes, 0.8) if weights is None else weights)
    whole, had, seen = sum(slots.values()), collections.Counter(), collections.defaultdict(set)
    for r in got.filter("in_mix").collect():
        seen[r["slot"]].add((r["source"], r["block"]))
    for t in range(len(seen)):
        [(s, block)] = seen[t]
        assert block == had[s]
        had[s] += 1
        assert all(abs(had[x] - n * (t + 1) / whole) < 1 for x, n in slots.items())
    assert any(had[s] == -(-sizes[s] // mixing.BLOCK) for s in slots)


# token counts

PUBLIC = pytest.importorskip("public_tokenizers")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PUBLIC.path(name))


def test_prefix_counts_are_exact():
    own, lib = tokencount.counter(PUBLIC.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    rnd = random.Random(9)
    texts = ["", "  a   b\n\n c", "don't we're they've I'll 'r 're  'll", "<|endoftext|>hi <|endoftext|>", "a <|endoftext|>  x<|endof", "日本語 テキスト 🙂🙂 é", "x" * 60 + " " * 140 + "y", "   a\u0085b", " \t\n", "fíné  １２３ ½ a b"]
    texts += ["".join(rnd.choice("the on'sreé \n12.!， ñ🙂aaa") for _ in range(60)) for _ in range(60)]
    for t in texts:
        counts = own.counts(t)
        assert len(counts) == len(t)
        for p in range(1, len(t) + 1):
            assert counts[p - 1] == len(lib.encode(t[:p], add_special_tokens=False).ids), (t, p)
        for limit in (0, 1, 5):
            p = own.longest_within(counts, limit)
            assert all(counts[q - 1] > limit for q in range(p + 1, len(t) + 1)) and (p == 0 or counts[p - 1] <= limit)


def test_long_pieces_take_one_pass():
    """A text without a space, of one letter or of many, and long runs of white space and of special strings."""
    own, lib = tokencount.counter(PUBLIC.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefghé") for _ in range(100_000)), "a" * 100_000, "日本語" * 20_000, "x" + " " * 60_000 + "y", "<|endoftext|>" * 300 + "q" * 20_000]
    for t in texts:
        counts = own.counts(t)
        for p in [1, 2, 999, 1000, 1500, len(t) // 2, len(t) - 1, len(t)]:
            assert counts[p - 1] == len(lib.encode(t[:p], add_special_tokens=False).ids), (t[:9], p)
    began = time.perf_counter()
    own.counts("".join(rnd.choice("abcdefgh") for _ in range(300_000)))
    assert time.perf_counter() - began < 10


def test_token_counts(spark, docs, odd, none):
    lib = library("byte_bpe_50k.json")
    for frame in (docs, odd):
        texts = collections.Counter((r["doc_id"], r["text"]) for r in frame.collect())
        want = collections.Counter()
        for (d, t), n in texts.items():
            k = len(lib.encode(t or "", add_special_tokens=False).ids)
            want[d, len((t or "").encode()), k, k > 512] += n
        got = tokencount.count_tokens(frame, PUBLIC.path("byte_bpe_50k.json")).collect()
        assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
        assert all(np.frombuffer(r["counts"], "<u4")[-1] == r["n_tokens"] for r in got if r["n_tokens"])
    assert tokencount.count_tokens(none, PUBLIC.path("byte_bpe_50k.json")).count() == 0


# range coder


def test_large_ids_and_size():
    """Ids of any 32-bit vocabulary, mixed with small blocks; and text ids take clearly less room than zlib needs."""
    rnd = np.random.default_rng(8)
    blocks = [rnd.integers(0, 2**32, 500), rnd.integers(0, 60_000, 700), np.array([2**32 - 1, 0, 65535, 65536]), rnd.zipf(1.2, 4096) % 200_000]
    coded = rangecoder.encode(blocks)
    for want, got in zip(blocks, rangecoder.decode([(len(b), d) for b, d in zip(blocks, coded, strict=True)]), strict=True):
        assert (want == got).all()
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{SF_DIR}/documents.parquet")["text"].to_pylist()
    ids, counts = rangecoder.WordIds(PUBLIC.path("word_bpe_49k.json"), 2).encode(texts)
    assert counts.sum() == len(ids)
    blocks = [ids[k : k + rangecoder.BLOCK] for k in range(0, len(ids), rangecoder.BLOCK)]
    assert sum(map(len, rangecoder.encode(blocks))) < 0.95 * sum(len(zlib.compress(b.astype("<u2").tobytes())) for b in blocks)


def test_ids_of_a_tokenizer_that_joins_words():
    """Byte-level pieces begin with their space, so words alone have other ids: texts are then encoded whole."""
    own, lib = rangecoder.WordIds(PUBLIC.path("byte_bpe_50k.json"), 7), library("byte_bpe_50k.json")
    assert not own.by_word and rangecoder.WordIds(PUBLIC.path("word_bpe_49k.json"), 2).by_word
    texts = ["two words here", None, "", " x  y"]
    ids, counts = own.encode(texts)
    assert ids.tolist() == [x for t in texts for x in [*lib.encode(t or "", add_special_tokens=False).ids, 7]] and counts.sum() == len(ids)


@pytest.mark.parametrize("kind", ["uniform", "skewed", "constant", "repeats", "short"])
def test_coder_round_trip(kind):
    rnd = np.random.default_rng(7)
    n = {"short": 3}.get(kind, rangecoder.BLOCK)
    lengths = [n, n, max(1, n // 3), 1, 65 if n > 65 else 2, 64 if n > 64 else 1]
    make = {
        "uniform": lambda k: rnd.integers(0, 65536, k),
        "skewed": lambda k: rnd.zipf(1.3, k) % 49408,
        "constant": lambda k: np.full(k, 65535),
        "repeats": lambda k: np.tile([5, 9, 9, 2, 40000], k)[:k],
        "short": lambda k: rnd.integers(0, 65536, k),
    }[kind]
    blocks = [make(k) for k in lengths]
    coded = rangecoder.encode(blocks)
    for want, got in zip(blocks, rangecoder.decode([(len(b), d) for b, d in zip(blocks, coded, strict=True)]), strict=True):
        assert (want == got).all()
    if kind == "constant":
        assert len(coded[0]) < 600
    if kind == "uniform":
        assert len(coded[0]) < 2.3 * rangecoder.BLOCK
    assert rangecoder.encode(blocks[:1])[0] == coded[0]  # a block's bytes are its own


def test_damage_is_seen():
    ids = np.arange(50)
    payload = rangecoder.pack(ids, np.zeros(1, rangecoder.PIECE), rangecoder.encode([ids])[0])
    assert rangecoder.unpack(payload)[0] == 50
    with pytest.raises(ValueError):
        rangecoder.unpack(payload[:-3] + b"abc")
    a, b, c = b"abc", b"", os.urandom(100)
    assert rangecoder.crc_joined([(len(x), zlib.crc32(x)) for x in (a, b, c)]) == zlib.crc32(a + b + c)


def test_written_ids(spark, docs, odd, none):
    lib = library("word_bpe_49k.json")
    for frame in (docs, odd):
        data = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
        want, got = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
        for d, t in data:
            ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
            want[d][len(ids), zlib.crc32(ids.tobytes())] += 1
        out = rangecoder.encoded(frame, PUBLIC.path("word_bpe_49k.json")).collect()
        for r in out:
            got[r["doc_id"]][r["n_tokens"], r["ids_crc32"]] += 1
        assert got == want
        at = 0
        for r in sorted(out, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
        assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert rangecoder.encoded(none, PUBLIC.path("word_bpe_49k.json")).count() == 0


def test_words_share_their_letters_ids():
    """Capitals and last punctuation are no new words for the library, except where they change what it does with the letters."""
    own, lib = rangecoder.WordIds(PUBLIC.path("word_bpe_49k.json"), 2), library("word_bpe_49k.json")
    assert own.by_part and not rangecoder.WordIds(PUBLIC.path("byte_bpe_50k.json"), 2).by_part
    asked = []
    batch, plain = own._batch, own._plain
    own._batch, own._plain = lambda x: asked.extend(x) or batch(x), lambda x: asked.extend(x) or plain(x)
    odd = ["\u0130;", "J\u030c.", "\u0958!", "\u00c9T\u00c9,", "don't!", "'TIS,", "x2.", "...", "a.b.", "\ufb01n?", "A\u030a:", "\u65e5\u672c.", "Stra\u00dfe;!", "<|endoftext|>.", "\u212a."]
    texts = ["quoph Quoph, QUOPH! quoph?! quoph.", " ".join(odd), "".join(odd), None, "!quoph Quoph"]
    ids, counts = own.encode(texts)
    want = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == [x for t in want for x in t] and counts.tolist() == [len(t) for t in want]
    assert asked.count("quoph") == 1 and not {"Quoph,", "QUOPH!", "quoph?!", "Quoph"} & set(asked)


@pytest.mark.parametrize("lengths", [[1], [31, 32, 33, 4096], [64, 1023, 1025, 2, 1]])
def test_blocks_of_lengths_about_a_renewal(lengths):
    rnd = np.random.default_rng(len(lengths))
    blocks = [np.where(rnd.random(n) < 0.5, rnd.integers(0, 9, n), rnd.integers(0, 2**32 if k % 2 else 2**16, n)) for k, n in enumerate(lengths)]
    for want, got in zip(blocks, rangecoder.decode([(len(b), d) for b, d in zip(blocks, rangecoder.encode(blocks), strict=True)]), strict=True):
        assert (want == got).all()


def test_words_of_many_texts_are_encoded_once():
    """Symbols after a word and accents don't lead to slow calls for each word, Arrow texts give what a list gives, and nothing is kept."""
    import pyarrow as pa

    own, lib = rangecoder.WordIds(PUBLIC.path("word_bpe_49k.json"), 2), library("word_bpe_49k.json")
    asked = []
    batch = own._batch
    own._batch = lambda x: asked.extend(x) or batch(x)
    texts = ["quoph$$$ \u00e9t\u00e9 na\u00efve%% quoph", None, "", " \t\n", "quoph#|&. \u00e9t\u00e9,\x1cx \u00c9T\u00c9 \u0149 \u00df\u0130 don't'$ a\u0301."]
    want = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for given in (texts, pa.array(texts, pa.large_string()), pa.array(["x", *texts], pa.large_string())[1:]):
        ids, counts = own.encode(given)
        assert ids.tolist() == [x for t in want for x in t] and counts.tolist() == [len(t) for t in want]
    assert not {"quoph", "quoph$$$", "quoph#|&.", "\u00e9t\u00e9", "na\u00efve%%", "na\u00efve"} & set(asked)
    assert own.encode([])[0].tolist() == []


def test_carry_runs_through_digits():
    coder, lane = rangecoder.Coder(2, None), np.array([1])
    coder.lanes, coder.written = [np.array([0, 1]), lane, lane], [np.array([5, 1], np.uint64), *[np.array([0xFFFFFFFF], np.uint64)] * 2]
    coder.used, coder.carries = np.array([1, 3]), [(lane, np.array([3]))]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.close()] == [[5, 0, 0], [2, 0, 0, 0, 0]]


@pytest.mark.parametrize("kinds", [1, 2, 40, 4096])
def test_many_new_ids_between_renewals(kinds):
    rnd = np.random.default_rng(kinds)
    blocks = [rnd.permutation(rangecoder.BLOCK) % kinds, rnd.integers(0, kinds, rangecoder.BLOCK), np.sort(rnd.integers(0, kinds, 3000)), np.arange(kinds)]
    for want, got in zip(blocks, rangecoder.decode([(len(b), d) for b, d in zip(blocks, rangecoder.encode(blocks), strict=True)]), strict=True):
        assert (want == got).all()
