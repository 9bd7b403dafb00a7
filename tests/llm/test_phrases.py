"""Phrases against brute force over Counters and against the SQL."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from pagelore.llm import common, phrases
from pagelore.llm.queries import OP11_SQL, op11_phrases

from conftest import SF_DIR, same

SCHEMA = "doc_id bigint, text string, lang string, word string, n bigint, rank string, id string"


def brute(rows, least=30, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {k: a for k, a in f.items() if a >= least}
    covered = set()
    for (lang, p), a in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 80 * f[lang, p[i : i + k]]:
                    covered.add((lang, p[i : i + k]))
    found = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and (lang, p) not in covered:
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def texts():
    rnd = random.Random(8)
    words = ["the", "New", "york", "city", "é", "日本", "a\xa0b", "x\x1cy", "of", "THE"]
    fixed = ["new york city hall", "new york", "of the", "a a a a a a"]
    piece = lambda: " ".join(rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice([*words, f"r{rnd.randint(0, 500)}"]) for _ in range(rnd.randint(0, 12)))
    text = lambda k: "".join(piece() + rnd.choice([".", ", ", "\n", "!?", ";", "\r\n", "  ", "\t", "\x0b", ":"]) for _ in range(k))
    out = [(k, text(rnd.randint(1, 30)), ("en", "en", "fr", None, "und")[k % 5], "w", 1, "r", "i") for k in range(200)]
    out += [(900, text(3000), "en", "w", 1, "r", "i"), (901, None, "en", "w", 1, "r", "i"), (902, "", "xx", "w", 1, "r", "i"), (903, " .,\t", None, "w", 1, "r", "i"), (None, text(20), "fr", "w", 1, "r", "i")]
    return out + out[:3]


def found(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


@pytest.mark.parametrize("most_words,bits,run", [(phrases.MOST_WORDS, phrases.BITS, phrases.RUN), (0, 64, 50)])
def test_against_brute_force(spark, most_words, bits, run, monkeypatch):
    """The second case: a dictionary too large to broadcast and a table in which every bit is set."""
    monkeypatch.setattr(phrases, "RUN", run)
    monkeypatch.setattr(phrases, "HELD", 1000)
    monkeypatch.setattr(phrases, "SORTED", 10 * run)
    rows = texts()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert len(want) > 50
    assert found(phrases.collocations(frame, most_words=most_words, bits=bits)) == want
    assert found(phrases.collocations(frame, top=7, most_words=most_words, bits=bits)) == brute(rows, top=7)


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Small tables here, which Spark would broadcast without a hint; beyond its bounds the query must not leave that to Spark's sizes."""
    monkeypatch.setattr(common, "MOST_BROADCAST", 0)
    rows = texts()
    frame = spark.createDataFrame(rows, SCHEMA)
    out = phrases.collocations(frame, most_words=0)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert found(out) == brute(rows)
    words = spark.createDataFrame([("en", "a", 40, 1)], "lang string, word string, n bigint, id bigint")
    assert "BroadcastExchange" not in phrases.runs_of(frame, words, 0)._jdf.queryExecution().executedPlan().toString()
    looked = common.looked_up(spark.range(9).select(F.col("id").alias("k")), spark.range(3).select(F.col("id").alias("k")), "k")
    assert "BroadcastExchange" not in looked._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.k for r in looked.collect()) == [0, 1, 2]


@pytest.mark.parametrize("most_words", [1, 9, 40])
def test_rest_of_a_large_dictionary(spark, most_words):
    """Frequent words are numbered where the texts are; a join sees only what these leave over."""
    rows = texts()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counts = phrases.stored(phrases.word_counts(frame), "wordcounts")
    dictionary = phrases.numbered(counts.filter("n >= 3"))
    assert dictionary.count() > 40
    least = phrases.most_frequent(dictionary, most_words)
    assert dictionary.filter(F.col("n") >= least).count() <= most_words < dictionary.filter(F.col("n") >= least - 1).count()
    pieces = lambda runs: collections.Counter(p for r in runs.collect() for p in re.split(b"(?:0 )+", b"".join(b"%d " % k for k in memoryview(bytes(r["run"])).cast("i"))))
    whole, part = pieces(phrases.runs_of(frame, dictionary)), pieces(phrases.runs_of(frame, dictionary, most_words))
    whole.pop(b"", None), part.pop(b"", None)
    assert whole == part


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", 1, "", "")], SCHEMA)).count() == 0


def test_query_against_sql(spark, duck):
    same(op11_phrases(spark, SF_DIR), duck.sql(OP11_SQL))
