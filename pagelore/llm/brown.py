"""Class-based n-gram language model (Brown classes by exchange clustering).

Tokens are lower-cased words and one end per text. log P(text) = sum of log P(class | class before) + log P(token | class).

* Word counts over all teaching texts are a table, of any size; the LISTED most frequent words go to the workers with their counts, and
  the counts of all other words are looked up by a join. So every count is exact and only a list of fixed length is broadcast.
* Every text is written once as numbers of its tokens: a listed word has a number of its own, all other words share that of their last
  letters (the ENDINGS most frequent endings, else a common rest). What follows are passes over these numbers.
* Exchange clustering begins with a core: the OWN most frequent words, and the endings for all others. Each item of it in turn moves to the
  class that raises the class-bigram likelihood most, for SWEEPS rounds; its pair counts are at most (OWN + ENDINGS + 2) squared.
* Then all other listed words and the endings are exchanged in ROUNDS rounds, each a Spark job: (word, side, class beside it) is counted over
  all teaching texts, dealt by word, and each word takes its best class against the class table of before. A round that doesn't raise the
  likelihood of the whole is not taken.
* P(word | class) = P(number | class) * P(word | number); where words share a number by their ending, they share it by
  (c + 0.5) / (n + 0.5 (v + 1)), so a word never seen has a probability too. Class transitions are interpolated with the class's own frequency.

Defined cases: null text is empty and has the end token alone; without teaching texts all counts are zero and scores stay finite; repeated
rows and ids are scored row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelore.llm.common import small_batches, stored

LISTED, OWN, ENDINGS, CLASSES, SWEEPS, ROUNDS = 100_000, 1200, 300, 48, 6, 2
#: Texts of a batch, tasks that choose classes, and rows of counts sent on at once.
ROWS, PARTS, SENT = 2000, 32, 500_000
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
#: Items 0 and 1: the end of a text (also what stands before its first token), and words with no listed ending.
END, REST = 0, 1


def ending(word: bytes) -> bytes:
    """The last two code points."""
    return word.decode("utf-8", "replace")[-2:].encode()


@dataclass
class Items:
    words: dict[bytes, int]  # place in count and item
    count: np.ndarray
    item: np.ndarray  # a number for each listed word
    endings: dict[bytes, int]
    core: np.ndarray  # of each number: its item in the core
    n: int

    def of(self, word: bytes) -> int:
        return self.endings.get(ending(word), REST)


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() and lower() know just the six ASCII white spaces and A-Z."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n over all texts. Each batch is summed before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(words_of(text))
            if len(found) > 200_000:
                yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                found = Counter()
        yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    return docs.select("text").mapInPandas(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def choose(counts: DataFrame, listed: int = LISTED, own: int = OWN, endings: int = ENDINGS) -> tuple[Items, dict[int, tuple[int, int]]]:
    """The items, and for those that stand for many words (n tokens, v words)."""
    found = counts.orderBy(F.desc("n"), "word").limit(listed).toArrow()
    top, times = found["word"].to_pylist(), found["n"].to_numpy()
    words = {w: k for k, w in enumerate(top)}
    last = F.substring(F.col("word").cast("string"), -2, 2)
    groups = counts.groupBy(last.alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    kept = groups.orderBy(F.desc("n"), "e").limit(endings).collect()
    table = {r["e"].encode(): k for k, r in enumerate(kept, 2)}
    first = 2 + len(kept)
    single = np.arange(len(top))
    items = Items(words, np.append(times, 0), first + single, table, np.append(np.arange(first), first + single), first + len(top))
    for k in range(own, len(top)):
        items.core[first + k] = items.of(top[k])
    sizes = {k: [r["n"], r["v"]] for k, r in enumerate(kept, 2)}
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    sizes[REST] = [(whole["n"] or 0) - sum(x[0] for x in sizes.values()), whole["v"] - sum(x[1] for x in sizes.values())]
    for w, n in zip(top, times.tolist(), strict=True):
        size = sizes[items.of(w)]
        size[0] -= n
        size[1] -= 1
    return items, {k: (n, v) for k, (n, v) in sizes.items()}


def sequence(items: Items, words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """Places of the words in items.words; -1 - item for words that aren't listed."""
    for w in {w for w in words if w not in memo}:
        k = items.words.get(w)
        memo[w] = -1 - items.of(w) if k is None else k
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def item_of(items: Items, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, np.append(items.item, REST)[np.clip(at, 0, len(items.item))], -1 - at)


def encoded(docs: DataFrame, teach: Column, items: Items) -> DataFrame:
    """kept (the other columns; what comes from outside stays in one struct, so that its names meet no others), row, teach, and of the text: seq
    (numbers of its words, little-endian), words and times of those that aren't listed. Written once."""
    small_batches(docs.sparkSession, ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(items)
    others = [c for c in docs.columns if c not in ("text", *ADDED)]

    @F.pandas_udf("seq binary, words array<binary>, times array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, memo = shared.value, {}
        for texts in batches:
            rows = []
            for text in texts:
                if len(memo) > 500_000:
                    memo = {}
                words = words_of(text)
                at = sequence(own, words, memo)
                rest = Counter(w for w, x in zip(words, (at < 0).tolist(), strict=True) if x)
                rows.append((item_of(own, at).astype("<i4").tobytes(), list(rest), list(rest.values())))
            yield pd.DataFrame(rows, columns=["seq", "words", "times"])

    kept = F.struct(*others).alias("kept") if others else F.lit(0).alias("kept")
    rows = docs.select(kept, F.coalesce(teach, F.lit(False)).alias("teach"), F.monotonically_increasing_id().alias("row"), run("text").alias("s"))
    return stored(rows.select("kept", "teach", "row", "s.*"), "encoded")


def tokens_of(seqs: pd.Series) -> np.ndarray:
    """All texts of a batch in one row, an end before, between and after them."""
    end = np.int32(END).tobytes()
    return np.frombuffer(end + end.join(seqs) + end, "<i4").astype(np.int64)


def counted(texts: DataFrame, size: int, keys: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """key, n: how often ``keys`` gives each number below ``size`` for the pairs of neighbours. One row for each key and task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if len(batch):
                flat = tokens_of(batch["seq"])
                np.add.at(total, keys(flat[:-1], flat[1:]), 1)
        found = np.flatnonzero(total)
        for k in range(0, len(found), SENT):
            at = found[k : k + SENT]
            yield pd.DataFrame({"key": at, "n": total[at]})

    return texts.select("seq").mapInPandas(count, "key bigint, n bigint")


def pair_table(texts: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """Counts of pairs over all texts, as a square matrix; ``of`` gives a row of it for each number."""
    shared = texts.sparkSession.sparkContext.broadcast(of)
    rows = counted(texts, size * size, lambda a, b: shared.value[a] * size + shared.value[b]).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows["key"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def x_log(a: np.ndarray) -> np.ndarray:
    return np.where(a > 0, a * np.log(np.maximum(a, 1)), 0.0)


def likelihood(table: np.ndarray) -> float:
    """The part of the log likelihood that classes change."""
    return float(x_log(table).sum() - x_log(table.sum(1)).sum() - x_log(table.sum(0)).sum())


def gains(table: np.ndarray, r: np.ndarray, c: np.ndarray, self_n: float) -> np.ndarray:
    """What joining each class adds to the likelihood, for a word that ``table`` leaves out, with ``r`` to each class, ``c`` from each, and
    ``self_n`` after itself: the class's row gets r, its column gets c, its own pair r + c + self_n. END's class takes no other."""
    to, by = np.flatnonzero(r), np.flatnonzero(c)
    right, left = table[:, to], table[by]
    gain = (x_log(right + r[to]) - x_log(right)).sum(1) + (x_log(left + c[by, None]) - x_log(left)).sum(0)
    d, out_n, in_n = np.diag(table), table.sum(1) + c, table.sum(0) + r  # the word's neighbours count it, whatever its class
    gain += x_log(d + r + c + self_n) - x_log(d + r) - x_log(d + c) + x_log(d)
    gain -= x_log(out_n + r.sum() + self_n) - x_log(out_n) + x_log(in_n + c.sum() + self_n) - x_log(in_n)
    gain[0] = -np.inf
    return gain


def moved(texts: DataFrame, own: np.ndarray, table: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """One round for all numbers at once: the class of each that is best while all others stay where they are. ``fixed`` ones stay too."""
    classes = len(table)
    width = 2 * classes + 1  # to each class, from each class, after itself
    size = len(own) * width
    shared = texts.sparkSession.sparkContext.broadcast((own, table, fixed))

    def keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        of, _, stays = shared.value
        same, left, right = a == b, ~stays[a], ~stays[b]
        to, by = left & ~same, right & ~same
        return np.concatenate([a[to] * width + of[b[to]], b[by] * width + classes + of[a[by]], a[same & left] * width + 2 * classes])

    def choose_class(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, before, _ = shared.value
        total = np.zeros(size, np.int64)
        for batch in batches:
            np.add.at(total, batch["key"].to_numpy(), batch["n"].to_numpy())
        total = total.reshape(-1, width)
        found = []
        for k in np.flatnonzero(total.any(1)):
            r, c, self_n, a = total[k, :classes].astype(float), total[k, classes:-1].astype(float), float(total[k, -1]), of[k]
            without = before.copy()
            without[a] -= r
            without[:, a] -= c
            without[a, a] -= self_n
            gain = gains(without, r, c, self_n)
            b = int(np.argmax(gain))
            if gain[b] > gain[a] + 1e-9:
                found.append((k, b))
        yield pd.DataFrame(found, columns=["k", "own"]).astype("int64")

    rows = counted(texts, size, keys).repartition(PARTS, F.floor(F.col("key") / width)).mapInPandas(choose_class, "k bigint, own bigint").toArrow()
    out = own.copy()
    out[rows["k"].to_numpy()] = rows["own"].to_numpy()
    return out


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item. END keeps a class of its own; others start by rank of frequency and move one at a time to the class with
    the highest sum over class pairs of n log n, less the sums over classes, which is the likelihood's part that classes change."""
    size = len(pairs)
    classes = max(2, min(classes, size))
    order = np.argsort(-pairs.sum(1), kind="stable")
    own = np.zeros(size, np.int64)
    rank = [i for i in order if i != END]
    own[rank] = 1 + np.arange(len(rank)) % (classes - 1)
    one = np.eye(classes)[own]
    right, left = pairs @ one, pairs.T @ one  # of an item: to each class, from each class
    table = one.T @ pairs @ one
    for _ in range(sweeps):
        moves = 0
        for i in rank:
            a, self_n = own[i], pairs[i, i]
            r, c = right[i].copy(), left[i].copy()
            r[a] -= self_n
            c[a] -= self_n
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= self_n
            gain = gains(table, r, c, self_n)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += c
            table[b, b] += self_n
            if a != b:
                own[i], moves = b, moves + 1
                right[:, a] -= pairs[:, i]
                right[:, b] += pairs[:, i]
                left[:, a] -= pairs[i]
                left[:, b] += pairs[i]
        if not moves:
            break
    return own


@dataclass
class Model:
    items: Items
    own: np.ndarray  # class of each number
    step: np.ndarray  # log10 P(class | class before)
    emit: np.ndarray  # log10 P(number | class)
    share: np.ndarray  # log10 of what divides c + 0.5 where words share a number; 0 for a number of one word
    tokens: int
    kinds: int
    ends: int


def learn(texts: DataFrame, counts: DataFrame, items: Items, sizes: dict[int, tuple[int, int]], own: int, classes: int, rounds: int) -> Model:
    """``texts``: encoded teaching texts."""
    first = items.n - len(items.words)
    core = first + min(own, len(items.words))
    fixed = np.zeros(items.n, bool)
    fixed[[END, *range(first, core)]] = True
    pairs = pair_table(texts, items.core, core)
    item_class = exchange(pairs, classes)
    of = item_class[items.core]
    one = np.eye(item_class.max() + 1)[item_class]
    table = one.T @ pairs @ one
    for _ in range(rounds):
        better = moved(texts, of, table, fixed)
        found = pair_table(texts, better, len(table))
        if likelihood(found) <= likelihood(table):
            break
        of, table = better, found
    arrive = table.sum(0)
    prior = (arrive + 0.5) / (arrive.sum() + 0.5 * len(arrive))
    weight = 5.0
    step = (table + weight * prior[None, :]) / (table.sum(1, keepdims=True) + weight)
    ends = int(arrive[of[END]])  # END has its class alone
    seen, share = np.zeros(items.n), np.zeros(items.n)
    seen[END], seen[first:] = ends, items.count[:-1]
    for k, (n, v) in sizes.items():
        seen[k], share[k] = n, np.log10(n + 0.5 * (v + 1))
    emit = (seen + 0.5) / (arrive[of] + 0.5 * np.bincount(of, minlength=len(table))[of])
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    return Model(items, of, np.log10(step), np.log10(emit), share, (whole["n"] or 0) + ends, whole["v"] + (ends > 0), ends)


def fit(teaching: DataFrame, counts: DataFrame, listed: int = LISTED, own: int = OWN, endings: int = ENDINGS, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    items, sizes = choose(counts, listed, own, endings)
    return learn(encoded(teaching.select("text"), F.lit(True), items), counts, items, sizes, own, classes, rounds)


def score(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Encoded ``rows`` with n_tokens, n_known, train_tokens, base_score, score. Listed words are scored from their numbers; the rest of a text
    is (row, word, times), is joined with the counts, and comes back as sums."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    base = np.log10(model.tokens + 0.5 * (model.kinds + 1))

    @F.pandas_udf("n_tokens bigint, known bigint, base double, path double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        first = m.items.n - len(m.items.words)
        logs = np.zeros(m.items.n)  # of the base; words that share a number are added later
        logs[END], logs[first:] = np.log10(m.ends + 0.5), np.log10(m.items.count[:-1] + 0.5)
        known = np.arange(m.items.n) >= first
        known[END] = m.ends > 0
        of_number = m.emit - m.share
        for seqs in batches:
            n = seqs.map(len).to_numpy(np.int64) // 4 + 1
            flat = tokens_of(seqs)
            kind, now, starts = m.own[flat], flat[1:], np.cumsum(n) - n
            sums = lambda values, at=starts: np.add.reduceat(values, at) if len(at) else np.zeros(0)
            path = m.step[kind[:-1], kind[1:]] + of_number[now]
            yield pd.DataFrame({"n_tokens": n, "known": sums(known[now].astype(np.int64)).astype(np.int64), "base": sums(logs[now]), "path": sums(path)})

    scored = rows.select("kept", "row", "times", run("seq").alias("s")).select("kept", "row", "times", "s.*")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    # one row for each word that the counts have: its times, and what they add to the sum that takes all as unseen
    gain = F.col("times") * (F.log10(F.col("n") + 0.5) - float(np.log10(0.5)))
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(gain).alias("gain"))
    unseen = F.aggregate("times", F.lit(0).cast("bigint"), lambda a, n: a + n) * float(np.log10(0.5))
    logs = unseen + F.coalesce("gain", F.lit(0.0))
    kept = rows.schema["kept"].dataType
    others = kept.names if isinstance(kept, StructType) else []
    return scored.join(found, "row", "left").select(
        *[F.col("kept")[c].alias(c) for c in others],
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(base)).alias("base_score"),
        (F.col("path") + logs).alias("score"),
    )


def language_model(
    docs: DataFrame, teach: Column, listed: int = LISTED, own: int = OWN, endings: int = ENDINGS, classes: int = CLASSES, rounds: int = ROUNDS
) -> DataFrame:
    """``docs`` (text and what else is to stay) scored by a model learnt from the rows where ``teach`` holds."""
    counts = stored(word_counts(docs.filter(teach).select("text")), "counts")
    items, sizes = choose(counts, listed, own, endings)
    rows = encoded(docs, teach, items)
    return score(rows, learn(rows.filter("teach"), counts, items, sizes, own, classes, rounds), counts)
