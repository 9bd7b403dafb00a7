"""Phrase mining: collocations of 2 to 4 words of each language, with exact counts.

A phrase that is frequent has only frequent words, so words found LEAST times in their language get dense numbers, and a piece ends at every
other word. Texts become runs of 32-bit numbers, stored once. Then, length by length, a task packs its n-grams into fixed-width keys,
sorts them by 16-bit digits and counts runs; the keys with their counts are dealt by range, sorted and counted as runs again. An n-gram is
only packed where both its parts of n - 1 words may be frequent: they are looked up by hash in a bit table of fixed size, built from the
frequent keys. A wrong bit costs work and changes nothing, as every count is a full one.

Of the dictionary the MOST_WORDS most frequent words are broadcast; where there are more, only the words of the texts that these leave over are
joined with the rest, and their numbers are put into the texts. A word's language is part of its entry, so a key needs no language.

Defined cases: null text is empty, null lang is `und`; a text without words adds nothing; repeated rows count each; ties go to the
greater count, then the phrase in byte order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import looked_up, merged, stored

#: Pieces end at these; words are divided by blanks and tabs.
ENDS = ".,;:!?\n\x0b\x0c\r"

#: Words of the longest phrase, least count, score's factor, hundredths of a phrase's count at which a longer one stands for it, rows of a language.
LONGEST, LEAST, FACTOR, COVERED, TOP = 4, 30, 2_000_000, 80, 2000

#: Words of a dictionary that is broadcast, words whose counts a task holds, numbers of a stored run of text (readers take 4,096 rows at once),
#: n-grams that are sorted at once, bits of the table of frequent keys, coded texts that are given out at once.
MOST_WORDS, HELD, RUN, SORTED, BITS, CODED_ROWS = 500_000, 500_000, 1 << 11, 1 << 20, 1 << 26, 500

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lower-cases, and leaves a line end for each end of a piece and a blank for a tab.
PLAIN = str.maketrans(UPPER + ENDS + "\t", LOWER + "\n" * len(ENDS) + " ")


def lang_of(name: str = "lang") -> Column:
    return F.coalesce(F.col(name), F.lit("und"))


def texts(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    for lang, text in zip(batch["lang"], batch["text"], strict=True):
        yield lang.as_py(), (text.as_py() or "").translate(PLAIN)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
        held.clear()
        return pa.RecordBatch.from_pylist([dict(zip(("lang", "word", "n"), r, strict=True)) for r in rows], schema=COUNTS)

    for batch in batches:
        for lang, text in texts(batch):
            counts = held.setdefault(lang, Counter())
            counts.update(text.replace("\n", " ").split(" "))
            del counts[""]
            if sum(map(len, held.values())) > HELD:
                yield out()
    yield out()


COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: the occurrences of all words."""
    found = docs.select(lang_of().alias("lang"), "text").mapInArrow(_word_counts, "lang string, word string, n bigint")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with a dense ``id`` from 1: its place in its partition after those of the partitions before."""
    words = stored(words.withColumn("at", F.monotonically_increasing_id()), "words")
    sizes = words.groupBy((F.shiftright("at", 33)).alias("part")).agg(F.count("*").alias("size"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    out = words.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part")
    return stored(out.select("lang", "word", "n", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("id")), "dictionary")


class Runs:
    """Numbers of words, 0 between pieces, given out in runs of about RUN."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.parts += [ids, np.zeros(1, np.int32)]
        self.size += len(ids) + 1

    def out(self) -> pa.RecordBatch:
        ids = np.concatenate([*self.parts, np.zeros(1, np.int32)]).astype("<i4")
        self.__init__()
        ids = ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])]
        return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], names=["run"])


def _known(dictionary: DataFrame) -> dict[str, dict[str, int]]:
    known: dict[str, dict[str, int]] = {}
    for batch in dictionary.select("lang", "word", "id").toArrow().to_batches(10_000):
        for lang, word, k in zip(*(batch[c].to_pylist() for c in ("lang", "word", "id")), strict=True):
            known.setdefault(lang, {})[word] = k
    return known


def words_and_ends(text: str) -> list[str]:
    """The words of a text; a piece's end becomes a word that no text has."""
    return [w for w in text.replace("\n", " \n ").split(" ") if w]


def _encode(dictionary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, runs = dictionary.value, Runs()
        for batch in batches:
            for lang, text in texts(batch):
                get = known.get(lang, {}).get
                runs.add(np.array([get(w, 0) for w in words_and_ends(text)], dtype=np.int32))
                if runs.size > RUN:
                    yield runs.out()
        if runs.size:
            yield runs.out()

    return run


CODED = pa.schema([("row", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("rest", pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string())])))])


def _encode_in_part(dictionary: Broadcast):
    """Numbers of the words in ``dictionary``; all other words with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row, (lang, text) in zip(batch["row"].to_pylist(), texts(batch), strict=True):
                get, words = known.get(lang, {}).get, words_and_ends(text)
                ids = [get(w, 0) for w in words]
                rest = [{"at": k, "word": w} for k, (w, n) in enumerate(zip(words, ids, strict=True)) if not n and w != "\n"]
                for x, value in zip(out, (row, lang, np.array(ids, "<i4").tobytes(), rest), strict=True):
                    x.append(value)
                if len(out[0]) == CODED_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, CODED, strict=True)], schema=CODED)
                    out = [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, CODED, strict=True)], schema=CODED)

    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of coded texts with the numbers that were found for their other words."""
    runs = Runs()
    for batch in batches:
        for ids, at, number in zip(*(batch[c] for c in ("ids", "at", "id")), strict=True):
            ids = np.frombuffer(ids.as_buffer(), "<i4").astype(np.int32)
            if at.is_valid:
                ids[at.values.to_numpy()] = number.values.to_numpy()
            runs.add(ids)
            if runs.size > RUN:
                yield runs.out()
    if runs.size:
        yield runs.out()


def most_frequent(dictionary: DataFrame, most: int) -> int:
    """The least count at which no more than ``most`` words are found so often or more often."""
    sizes = dictionary.groupBy("n").agg(F.count("*").alias("size"))
    # a row for each count that occurs: their number grows with the root of the texts' words
    reached = sizes.withColumn("words", F.sum("size").over(Window.orderBy(F.desc("n"))))
    return reached.filter(F.col("words") > most).agg(F.max("n")).first()[0] + 1


def runs_of(docs: DataFrame, dictionary: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """run: binary, little-endian 32-bit numbers of the words of the texts, 0 for all that ends a piece."""
    context, docs = docs.sparkSession.sparkContext, docs.select(lang_of().alias("lang"), "text")
    if dictionary.count() <= most_words:
        return docs.mapInArrow(_encode(context.broadcast(_known(dictionary))), "run binary")
    # the most frequent words are broadcast; of the others none is frequent enough to fill a task
    least = most_frequent(dictionary, most_words)
    known = context.broadcast(_known(dictionary.filter(F.col("n") >= least)))
    coded = docs.filter("text is not null").select(F.monotonically_increasing_id().alias("row"), "lang", "text")
    coded = stored(coded.mapInArrow(_encode_in_part(known), "row bigint, lang string, ids binary, rest array<struct<at:int,word:string>>"), "coded")
    rest = coded.select("row", "lang", F.explode("rest").alias("x")).select("row", "lang", "x.at", "x.word")
    others = dictionary.filter(F.col("n") < least).select("lang", "word", F.col("id").cast("int").alias("id"))
    found = rest.join(merged(others), ["lang", "word"]).groupBy("row").agg(F.collect_list(F.struct("at", "id")).alias("found"))
    whole = coded.select("row", "ids").join(merged(found), "row", "left")
    return whole.select("ids", F.col("found.at").alias("at"), F.col("found.id").alias("id")).mapInArrow(_filled, "run binary")


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by 32-bit columns, the first one the most significant: stable counting sorts of 16-bit digits from the least on."""
    order = None
    for column in reversed(columns):
        for digit in (column & 0xFFFF, column >> 16):
            if digit.any():
                digit = digit.astype(np.uint16)
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(columns[0])) if order is None else order


def bit(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """The place of n-grams in the table of frequent keys."""
    mixed = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        mixed = (mixed + column.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(bits)).astype(np.int64)


def packed(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 128 bits as two numbers: four words of 32 bits, 0 where there are fewer."""
    four = [c.astype(np.int64) for c in columns] + [np.int64(0)] * (LONGEST - len(columns))
    return four[0] << 32 | four[1], four[2] << 32 | four[3] | np.zeros_like(four[0])


def unpacked(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    return [high >> 32, high & 0xFFFFFFFF, low >> 32, low & 0xFFFFFFFF]


def _ngrams(n: int, table: Broadcast | None, bits: int):
    def counted(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate([h[k] for h in held]) for k in range(n)]
        order = radix_order(columns)
        columns = [c[order] for c in columns]
        first = np.ones(len(order), bool)
        if len(order):
            first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        at = np.flatnonzero(first)
        high, low = packed([c[at] for c in columns])
        return pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(np.diff(np.append(at, len(order))))], names=["high", "low", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            # each run ends with 0, so a batch is one run
            data, offsets = batch["run"].buffers()[2], np.frombuffer(batch["run"].buffers()[1], np.int32)[batch["run"].offset :][: batch.num_rows + 1]
            whole = np.frombuffer(data, "<i4", (offsets[-1] - offsets[0]) // 4, offsets[0]) if batch.num_rows else np.zeros(0, "<i4")
            for first in range(0, len(whole), SORTED):
                ids = whole[first : first + SORTED + n - 1]
                m = max(0, len(ids) - n + 1)
                part = np.flatnonzero(np.logical_and.reduce([ids[k : k + m] != 0 for k in range(n)]))
                for a in (0, 1) if table is not None else ():
                    where = bit([ids[part + a + k] for k in range(n - 1)], bits)
                    part = part[table.value[where >> 3] >> (where & 7).astype(np.uint8) & 1 == 1]
                held.append([ids[part + k] for k in range(n)])
                size += len(part)
                if size >= SORTED:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    return run


def _run_lengths(least: int):
    """Sums neighbours with one key; keys come in order and a key's rows are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            high, low, n = (np.concatenate([r, batch[c].to_numpy()]) for r, c in zip(rest, ("high", "low", "n"), strict=True))
            if not len(high):
                continue
            at = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
            sums = np.add.reduceat(n, at)
            rest = [high[at[-1:]], low[at[-1:]], sums[-1:]]
            yield frequent(high[at[:-1]], low[at[:-1]], sums[:-1])
        yield frequent(*rest)

    def frequent(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        kept = n >= least
        return pa.RecordBatch.from_arrays([pa.array(high[kept]), pa.array(low[kept]), pa.array(n[kept])], names=["high", "low", "n"])

    return run


KEYS = "high bigint, low bigint, n bigint"


def frequent_ngrams(runs: DataFrame, n: int, table: Broadcast | None, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """high, low, n of the n-grams found at least ``least`` times."""
    spark = runs.sparkSession
    # not stored: counting once more for the sample of the ranges costs less than a copy of all keys
    counted = runs.mapInArrow(_ngrams(n, table, bits), KEYS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored(counted.repartitionByRange(parts, "high", "low").sortWithinPartitions("high", "low").mapInArrow(_run_lengths(least), KEYS), f"frequent{n}")


def bit_table(keys: DataFrame, n: int, bits: int = BITS) -> np.ndarray:
    """The table of frequent keys: BITS bits, however many keys there are."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = bit(unpacked(batch["high"].to_numpy(), batch["low"].to_numpy())[:n], bits)
            yield pa.RecordBatch.from_arrays([pa.array(where >> 5), pa.array(np.int64(1) << (where & 31))], names=["place", "mask"])

    words = keys.mapInArrow(places, "place bigint, mask bigint").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros((bits + 31) // 32, "<u4")
    out[words["place"].to_numpy()] = words["mask"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def part_of(n: int, first: int, size: int) -> tuple[Column, Column]:
    """The key of ``size`` words from ``first`` on, of a key of n words."""
    words = [F.shiftright("high", 32), F.col("high").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("low", 32), F.col("low").bitwiseAND(F.lit(0xFFFFFFFF))][first : first + size]
    words += [F.lit(0).cast("bigint")] * (LONGEST - size)
    return F.shiftleft(words[0], 32).bitwiseOR(words[1]), F.shiftleft(words[2], 32).bitwiseOR(words[3])


def exact(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most_words: int = MOST_WORDS, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    context = docs.sparkSession.sparkContext
    counts = stored(word_counts(docs), "wordcounts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    dictionary = numbered(counts.filter(F.col("n") >= least))
    runs = stored(runs_of(docs, dictionary, most_words), "runs")

    levels = {1: dictionary.select(F.shiftleft("id", 32).alias("high"), F.lit(0).cast("bigint").alias("low"), "n")}
    table = None
    for n in range(2, LONGEST + 1):
        levels[n] = frequent_ngrams(runs, n, table, least, bits)
        table = context.broadcast(bit_table(levels[n], n, bits)) if n < LONGEST else None

    everything = levels[1]
    for n in range(2, LONGEST + 1):
        everything = everything.unionByName(levels[n])
    everything = stored(everything.select(F.struct("high", "low").alias("part"), F.col("n").alias("part_n")), "phrases")

    cuts, longer = None, None
    for n in range(2, LONGEST + 1):
        both = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.struct(*part_of(n, *at)).alias("part")) for k in range(1, n) for side, at in (("l", (0, k)), ("r", (k, n - k)))]
        own = levels[n].select("high", "low", F.col("n").alias("a"), F.explode(F.array(*both)).alias("cut")).select("high", "low", "a", "cut.k", "cut.side", F.struct(F.col("cut.part.col1").alias("high"), F.col("cut.part.col2").alias("low")).alias("part"))
        cuts = own if cuts is None else cuts.unionByName(own)
        inside = [F.struct(*part_of(n, first, size)) for size in range(2, n) for first in range(n - size + 1)]
        if inside:
            own = levels[n].select(F.explode(F.array(*inside)).alias("inner"), "n").select(F.col("inner.col1").alias("high"), F.col("inner.col2").alias("low"), "n")
            longer = own if longer is None else longer.unionByName(own)

    found = looked_up(cuts, everything, "part")
    found = found.groupBy("high", "low", "a", "k").agg(F.sum(F.when(F.col("side") == "l", F.col("part_n"))).alias("l"), F.sum(F.when(F.col("side") == "r", F.col("part_n"))).alias("r"))
    # a quotient of decimals is rounded at its last digit; whole-number division is not
    score = F.expr(f"({FACTOR} * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    found = found.withColumn("score", score).groupBy("high", "low", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    longest = longer.groupBy("high", "low").agg(F.max("n").alias("longer"))
    found = found.join(merged(longest), ["high", "low"], "left").filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * COVERED))
    found = stored(found.select("high", "low", "a", "cut.*"), "cuts")

    ids = F.filter(F.array(*[part_of(LONGEST, k, 1)[0] for k in range(LONGEST)]), lambda x: x != 0)
    each = found.select("high", "low", F.posexplode(ids).alias("at", "word_key"))
    spelt = looked_up(each, stored(dictionary.select(F.shiftleft("id", 32).alias("word_key"), "word", "lang"), "spelling"), "word_key")
    spelt = spelt.groupBy("high", "low").agg(F.first("lang").alias("lang"), F.array_join(F.sort_array(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    found = found.join(merged(spelt), ["high", "low"])

    order = [F.desc("score"), F.desc("a"), "phrase"]
    # of each part of a language the first ones, then of those
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("high", "low"), F.lit(64))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return found.join(F.broadcast(totals) if totals.limit(most_words).count() < most_words else merged(totals), "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("bigint"))
