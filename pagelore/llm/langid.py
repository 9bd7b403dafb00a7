"""Language identification with word-first backoff.

A known word is scored by its log frequency in each language. An unseen word falls back to character n-grams, the longest known one
at each place first, then shorter ones down to single characters (its border alone says nothing). A text's score is the sum over its words; the posterior over the
languages is the reported score.

The model is fitted on a bounded sample: about SAMPLE labelled rows of each language, by a hash of the id, and of those the WORDS most
frequent words and GRAMS n-grams of each language. So what is broadcast has a fixed bound. Prediction reads whole texts.

``accepted`` keeps the documents that a taught language explains. Each word has the share of its n-grams of FAMILIAR_GRAM letters (borders
included) that the languages' tables know. Of the words of the taught sample each language has the mean share and its spread; a text
stays if the mean share of its words is at least FAMILIAR of that of its predicted language, less WIDE standard errors for the number of its
words. Noise in known letters and text of a script or language that was not taught goes. A null lang is filled with the prediction if its
score is over chance (one of the number of languages) by EDGE of what there is above chance.

Defined cases: null text, or one without a letter: `und`, score 0; ties go to the language first in alphabetical order; rows with null
lang or null text teach nothing; of more than LANGUAGES labels the most frequent ones teach; without a taught language every prediction
is `und`, and ``accepted`` keeps what has a letter; a text without a letter goes; repeated rows are predicted alike; an empty table gives an empty result; other columns
stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import small_batches, stored

#: Rows of a language that teach, words and n-grams of a language that are kept, longest n-gram, languages.
SAMPLE, WORDS, GRAMS, LONGEST, LANGUAGES = 4000, 20_000, 20_000, 4, 500
#: How far a score must be from chance towards 1 to fill a null lang.
EDGE = 0.1
#: Letters of the n-grams that tell familiar words, least share of the taught mean, standard errors that a text may be below it.
FAMILIAR_GRAM, FAMILIAR, WIDE = 3, 0.6, 3.0
LETTER = regex.compile(r"\p{L}")
RUNS = regex.compile(r"\p{L}+")
#: Unseen words whose scores a worker keeps; rows that go to a worker at once.
REMEMBERED, ROWS = 100_000, 1000


class Rows:
    """A table from words to rows of one matrix."""

    def __init__(self, found: dict[str, int], matrix: np.ndarray) -> None:
        self.found, self.matrix = found, matrix

    def get(self, word: str) -> np.ndarray | None:
        k = self.found.get(word)
        return None if k is None else self.matrix[k]


@dataclass
class Model:
    languages: list[str]
    words: Rows | dict[str, np.ndarray] = field(default_factory=dict)
    grams: Rows | dict[str, np.ndarray] = field(default_factory=dict)
    priors: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: mean and standard deviation of the shares of each language's words
    shares: list[tuple[float, float]] = field(default_factory=list)

    def share(self, w: str) -> float:
        """How much of a word the tables know."""
        padded = f" {w} "
        n = max(1, len(padded) - FAMILIAR_GRAM + 1)
        return sum(self.grams.get(padded[k : k + FAMILIAR_GRAM]) is not None for k in range(n)) / n

    def familiar(self, lang: str, shares: np.ndarray) -> bool:
        """Whether words of these shares may be of the language."""
        mean, spread = self.shares[self.languages.index(lang)]
        return bool(shares.mean() >= FAMILIAR * mean - WIDE * spread / np.sqrt(len(shares)))

    def word(self, w: str) -> np.ndarray:
        """Log probability in each language, by the word or else by its n-grams."""
        known = self.words.get(w)
        if known is not None:
            return known
        out, padded, at, n = np.zeros(len(self.languages)), f" {w} ", 0, 0
        while at < len(padded):
            for size in range(min(LONGEST, len(padded) - at), 0, -1):
                found = self.grams.get(padded[at : at + size])
                if found is not None:
                    out, n = out + found, n + 1
                    break
            at += size if found is not None else 1
        return out / max(n, 1)

    def scores(self, texts: Iterator[str | None], memo: Memo | None = None) -> Iterator[tuple[str, float]]:
        for lang, score, _ in self.judged(texts, memo):
            yield lang, score

    def judged(self, texts: Iterator[str | None], memo: Memo | None = None, shares: bool = False) -> Iterator[tuple[str, float, bool]]:
        """(language, score, whether the language explains the text); the last is only worked out if ``shares`` is set."""
        memo = memo or Memo(self)
        for text in texts:
            if not text or not self.languages or not LETTER.search(text):
                yield "und", 0.0, False
                continue
            found = RUNS.findall(text.lower())
            if not found:  # letters that lower-case to none
                yield "und", 0.0, False
                continue
            at = memo.places(found)
            total = self.priors + memo.matrix[at].sum(0)
            best = int(np.argmax(total))
            yield self.languages[best], float(1 / np.exp(total - total[best]).sum()), shares and self.familiar(self.languages[best], memo.shares(found, at))


class Memo:
    """Scores of words: of known ones for good, of others until there are REMEMBERED."""

    def __init__(self, model: Model) -> None:
        self.model = model
        known = model.words if isinstance(model.words, Rows) else Rows({}, np.empty((0, len(model.languages))))
        self.known, self.n = known.found, len(known.found)
        self.matrix = np.concatenate([known.matrix, np.empty((1024, len(model.languages)))])
        self.other: dict[str, int] = {}
        self.share = np.full(len(self.matrix), np.nan)

    def shares(self, words: list[str], at: np.ndarray) -> np.ndarray:
        """What the tables know of each word; ``at`` are the places of the words."""
        if len(self.share) < len(self.matrix):
            self.share = np.concatenate([self.share, np.full(len(self.matrix) - len(self.share), np.nan)])
        for k in np.flatnonzero(np.isnan(self.share[at])).tolist():
            self.share[at[k]] = self.model.share(words[k])
        return self.share[at]

    def places(self, words: list[str]) -> np.ndarray:
        known, other = self.known, self.other
        if len(other) > REMEMBERED:
            other.clear()
            self.share[self.n :] = np.nan
        at = [known.get(w, -1) for w in words]
        for k in [k for k, x in enumerate(at) if x < 0]:
            w = words[k]
            x = other.get(w)
            if x is None:
                x = other[w] = self.n + len(other)
                if x >= len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.empty((len(self.matrix) - self.n, self.matrix.shape[1]))])
                self.matrix[x] = self.model.word(w)
            at[k] = x
        return np.array(at, np.int64)


def _kept(counts: DataFrame, most: int) -> list:
    """The ``most`` most frequent items of each language. Sorted by language and count; a language's rows are ranked in one window, of
    the bounded sample only."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    return counts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).select("lang", "item", "n").collect()


def spreads(counts: DataFrame, grams: list, languages: list[str]) -> list[tuple[float, float]]:
    """Of each language the mean share of the words in ``counts`` (lang, item, n) and its standard deviation. ``grams`` are the tables' n-grams."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(g,) for g in sorted({g for _, g, _ in grams if len(g) == FAMILIAR_GRAM})], "gram string").withColumn("known", F.lit(1))
    padded = F.concat(F.lit(" "), "item", F.lit(" "))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - FAMILIAR_GRAM + 1)), lambda k: F.substring(padded, k, FAMILIAR_GRAM))
    each = counts.select("lang", "item", "n", F.explode(pieces).alias("gram")).join(F.broadcast(known), "gram", "left")  # the tables have a fixed size
    share = each.groupBy("lang", "item", "n").agg(F.avg(F.coalesce("known", F.lit(0))).alias("x"))
    n, x = F.col("n"), F.col("x")
    found = {r["lang"]: r for r in share.groupBy("lang").agg((F.sum(n * x) / F.sum(n)).alias("mean"), (F.sum(n * x * x) / F.sum(n)).alias("square")).collect()}
    return [(found[lang]["mean"], max(0.0, found[lang]["square"] - found[lang]["mean"] ** 2) ** 0.5) if lang in found else (0.0, 0.0) for lang in languages]


def fit(labelled: DataFrame, sample: int = SAMPLE, words: int = WORDS, grams: int = GRAMS, shares: bool = False) -> Model:
    """``labelled``: doc_id, text, lang of the rows that may teach. ``shares``: also what ``accepted`` needs."""
    labelled = labelled.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return Model([])
    languages = sorted(sizes)
    limit = F
    for lang in languages:  # one expression of many cases; other labels teach nothing
        limit = limit.when(F.col("lang") == lang, F.lit(min(1.0, sample / sizes[lang])))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    taught = labelled.filter(chance < limit)
    counts = taught.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("item")).groupBy("lang", "item").agg(F.count("*").alias("n"))
    counts = stored(counts, "taught")
    padded = F.concat(F.lit(" "), "item", F.lit(" "))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.length(padded)), lambda at: F.substring(padded, at, n)), lambda g: (F.length(g) == n) & (g != " "))))
    by_gram = counts.select("lang", F.explode(pieces).alias("item"), "n").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    known, gram_rows = _kept(counts, words), _kept(by_gram, grams)
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    at = {lang: k for k, lang in enumerate(languages)}

    def table(rows: list, size: np.ndarray) -> Rows:
        found: dict[str, int] = {}
        for _, item, _ in rows:
            found.setdefault(item, len(found))
        count = np.zeros((len(found), len(languages)))
        for lang, item, n in rows:
            count[found[item], at[lang]] = n
        return Rows(found, np.log((count + 0.5) / (size + 0.5)))

    size = np.array([float(total.get(x, 0)) for x in languages])
    gram_size = np.zeros(len(languages))
    for lang, _, n in gram_rows:
        gram_size[at[lang]] += n
    return Model(languages, table(known, size), table(gram_rows, gram_size), np.zeros(len(languages)), spreads(counts, gram_rows, languages) if shares else [])


def least_score(languages: int, edge: float) -> float:
    return 1 / max(languages, 1) + edge * (1 - 1 / max(languages, 1))


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """struct(lang_pred, score, known) of each text; known: its language explains it, if the model has shares."""
    small_batches(docs.sparkSession, ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, known boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = Memo(shared.value)
        for texts in batches:
            yield pd.DataFrame(list(shared.value.judged(texts, memo, bool(shared.value.shares))), columns=["lang_pred", "score", "known"])

    # so that a filter on it doesn't run it once more
    return run.asNondeterministic()(F.col(text))


def identify(docs: DataFrame, teach: Column | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, learnt from its rows where ``teach`` holds (all labelled rows if none is given)."""
    model = fit(docs.select("doc_id", "text", "lang") if teach is None else docs.filter(teach).select("doc_id", "text", "lang"))
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(F.struct(*others).alias("kept"), predict(docs, model).alias("found"))
    return out.select("kept.*", "found.lang_pred", "found.score")


def accepted(docs: DataFrame, edge: float = EDGE) -> DataFrame:
    """The rows that a taught language explains; a null lang is filled with a prediction that stands out, all else is as it was. Where no row
    has a label, the texts with a letter stay."""
    model = fit(docs.select("doc_id", "text", "lang"), shares=True)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    out = docs.select(F.struct(*docs.columns).alias("kept"), predict(docs, model).alias("found"))
    filled = F.coalesce(F.col("kept.lang"), F.when(F.col("found.score") >= least_score(len(model.languages), edge), F.col("found.lang_pred")))
    columns = [filled.alias("lang") if c == "lang" else F.col("kept")[c].alias(c) for c in docs.columns]
    return out.filter("found.known").select(*columns)
