"""Quality rules: plain limits, then robust multivariate outliers.

Statistics of whole texts are transformed to a vector (DIMS): log mean word length, and the square roots of the symbol, repeated-line and
repeated-word shares, the last without what a text of that length repeats by chance. For each (lang, source) the minimum-covariance-determinant estimate is found from two starts, medians with
spreads and medians with the spatial-sign covariance, each followed by concentration steps: distances, the HALF of rows nearest, their mean
and covariance. The start with the smaller determinant wins. A document is rejected if its squared Mahalanobis distance from that
estimate passes the chi-square point of TAIL; the covariance is the group's and the noise of counting in the document itself, so a short
text is given more room and no other floor is needed. All of it is aggregation by group, and groups' values are broadcast (their number is checked)
or joined by salted keys, so a hot group is summed where its rows are; medians and distance quantiles come from counts of fine bins, so
they don't depend on the partitioning. Concentration ends when no start's determinant falls by more than SETTLED, or after STEPS steps.

Defined cases: null text has no words, which fails the limits; a null lang or source is a group of its own; a group with fewer than LEAST
rows that pass the limits is judged with all such groups together, and if even they are fewer, its rows are kept; repeated rows count each
time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import WORD, looked_up, stored

DIMS = ("x_length", "x_symbols", "x_lines", "x_repeats")
#: Part of a group's rows that an estimate covers, least rows of a group, concentration steps at most and the fall of a log determinant that
#: ends them, chance to reject a normal row.
HALF, LEAST, STEPS, SETTLED, TAIL = 0.75, 60, 20, 0.01, 1e-4
#: Added to variances of an estimate, so that it stays regular. Bins of a unit.
RIDGE, BINS = (0.01**2, 0.003**2, 0.01**2, 0.01**2), 256
#: Words, symbols, lines and repeated words that come at once in a text: its share of n things is as uncertain as one of n / CLUMP.
CLUMP = (1, 4, 1, 6)
#: Two 3-word windows of a clean text are equal with this chance, so a text of n words has a share of n times it repeated; at most so much
#: is taken off.
CHANCE, MOST_CHANCE = 1e-5, 0.1
LONG = "bigint"


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Repeated 3-word windows: 34 bits of a window's hash and its place are sorted as one number, equal neighbours are the candidates,
    and only those are compared as text."""
    mask, low = 2**34 - 1, 2**30 - 1
    text = F.coalesce("text", F.lit(""))
    w = docs.select(*keep, text.alias("_t"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("_w"))
    w = w.select(
        *keep,
        "_w",
        F.size("_w").cast(LONG).alias("n_words"),
        F.length(F.array_join("_w", "")).cast(LONG).alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast(LONG).alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_l"),
    )
    windows = F.transform(
        F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda a, i: F.shiftleft(F.xxhash64(a, F.get("_w", i + 1), F.get("_w", i + 2)).bitwiseAND(mask), 30).bitwiseOR(i.cast(LONG)),
    )
    w = w.select("*", F.size("_l").cast(LONG).alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast(LONG).alias("n_dup_lines"), F.sort_array(windows).alias("_s"))
    part = lambda x: F.shiftright(x, 30)
    beside = F.filter("_s", lambda x, i: ((i > 0) & (part(x) == part(F.get("_s", i - 1)))) | (part(x) == part(F.get("_s", i + 1))))
    w = w.drop("_l").withColumn("_c", beside).drop("_s")
    as_text = F.transform(
        "_c", lambda x: F.struct(F.concat_ws(" ", F.get("_w", x.bitwiseAND(low).cast("int")), F.get("_w", x.bitwiseAND(low).cast("int") + 1), F.get("_w", x.bitwiseAND(low).cast("int") + 2)).alias("t"), x.bitwiseAND(low).cast("int").alias("p"))
    )
    w = w.withColumn("_c", F.sort_array(as_text)).drop("_w")
    same = F.filter("_c", lambda x, i: ((i > 0) & (x["t"] == F.get("_c", i - 1)["t"])) | (x["t"] == F.get("_c", i + 1)["t"]))
    w = w.withColumn("_p", F.sort_array(F.transform(same, lambda x: x["p"]))).drop("_c")
    covered = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3))).cast(LONG))
    w = w.withColumn("_n", covered).drop("_p")
    return w.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.aggregate("_n", F.lit(0).cast(LONG), lambda a, b: a + b).alias("n_repeat_words"))


def vector() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    repeats = F.sqrt(F.greatest(F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)) - F.least(F.col("n_words") * CHANCE, F.lit(MOST_CHANCE)), F.lit(0.0)))
    found = (F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), repeats)
    return [x.alias(name) for x, name in zip(found, DIMS, strict=True)]


def noise() -> list[Column]:
    """Variances of a text's own DIMS by counting: the square root of a share of n has 1 / 4n, and so has a log mean of lengths that spread
    by half their mean."""
    n = lambda c, k: F.lit(CLUMP[k] / 4) / F.greatest(F.col(c), F.lit(1))
    return [n(c, k) for k, c in enumerate(("n_words", "word_chars", "n_lines", "n_words"))]


def chi2_even(x: float, dof: int) -> float:
    """The chi-square distribution for an even number of degrees."""
    term, total = 1.0, 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_point(q: float, dof: int) -> float:
    a, b = 0.0, 1e4
    for _ in range(200):
        a, b = ((a + b) / 2, b) if chi2_even((a + b) / 2, dof) < q else (a, (a + b) / 2)
    return (a + b) / 2


def _cov(i: int, j: int) -> str:
    return f"c{min(i, j)}{max(i, j)}"


def cholesky(moments: DataFrame) -> DataFrame:
    """moments (m0.., c00..) with the lower factor l00.. and det, the determinant."""
    n = len(DIMS)
    for j in range(n):
        for i in range(j, n):
            rest = F.col(_cov(i, j)) - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            moments = moments.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for j in range(n):
        det = det * F.col(f"l{j}{j}") * F.col(f"l{j}{j}")
    return moments.withColumn("det", det)


def distance() -> Column:
    """Squared Mahalanobis distance of DIMS from the moments beside them."""
    y: list[Column] = []
    for i, x in enumerate(DIMS):
        y.append((F.col(x) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _moments(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    n = len(DIMS)
    means = [F.avg(x).alias(f"m{i}") for i, x in enumerate(DIMS)]
    covs = [(F.covar_pop(DIMS[i], DIMS[j]) + F.lit(RIDGE[i] if i == j else 0.0)).alias(_cov(i, j)) for i in range(n) for j in range(i, n)]
    return rows.groupBy(*by).agg(*means, *covs)


def _quantile(rows: DataFrame, by: tuple[str, ...], bin_: Column, q: float) -> DataFrame:
    """by, at: the least bin that q of a group's rows don't pass, from counts of bins."""
    counts = rows.groupBy(*by, bin_.alias("_b")).agg(F.count("*").alias("_n"))
    ahead, whole = Window.partitionBy(*by).orderBy("_b"), Window.partitionBy(*by)
    counts = counts.select(*by, "_b", F.sum("_n").over(ahead).alias("_upto"), F.sum("_n").over(whole).alias("_all"))
    return counts.filter(F.col("_upto") >= F.col("_all") * q).groupBy(*by).agg(F.min("_b").alias("at"))


def _per_dim(rows: DataFrame, values: list[Column]) -> DataFrame:
    return rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(v * BINS).cast("int").alias("bin")) for i, v in enumerate(values)])).alias("d")).select("g", "d.dim", "d.bin")


def _wide(found: DataFrame, prefix: str) -> DataFrame:
    cells = [F.max(F.when(F.col("dim") == i, (F.col("at") + 0.5) / BINS)).alias(f"{prefix}{i}") for i in range(len(DIMS))]
    return found.groupBy("g").agg(*cells)


def robust(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """For each group g of ``rows`` (g and DIMS): m0.., l00.., det of the better start."""
    n = len(DIMS)
    middle = stored(_wide(_quantile(_per_dim(rows, [F.col(x) for x in DIMS]), ("g", "dim"), F.col("bin"), 0.5), "m"), "medians")
    apart = looked_up(rows, middle, "g")
    spread = _wide(_quantile(_per_dim(apart, [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(DIMS)]), ("g", "dim"), F.col("bin"), 0.5), "s")
    size = F.sqrt(sum(((F.col(x) - F.col(f"m{i}")) ** 2 for i, x in enumerate(DIMS)), F.lit(1e-9)))
    signs = apart.select("g", *[((F.col(x) - F.col(f"m{i}")) / size).alias(x) for i, x in enumerate(DIMS)])
    plain = middle.join(spread, "g").select("g", F.lit(0).alias("start"), *[f"m{i}" for i in range(n)], *[(F.pow(1.4826 * F.col(f"s{i}"), F.lit(2)) + RIDGE[i] if i == j else F.lit(0.0)).alias(_cov(i, j)) for i in range(n) for j in range(i, n)])
    signed = _moments(signs, ("g",)).drop(*[f"m{i}" for i in range(n)]).join(middle, "g").withColumn("start", F.lit(1))
    found = stored(cholesky(plain.unionByName(signed.select(plain.columns))), "estimates")
    for _ in range(steps):
        before = found
        far = looked_up(rows, found, "g").withColumn("_bin", F.floor(F.log2(distance() + 1e-6) * 64).cast("int")).select("g", "start", "_bin", *DIMS)
        cut = stored(_quantile(far.withColumn("of", F.struct("g", "start")), ("of",), F.col("_bin"), HALF), "cuts")
        near = looked_up(far.withColumn("of", F.struct("g", "start")), cut, "of").filter("_bin <= at")
        found = stored(cholesky(_moments(near, ("g", "start"))), "estimates")
        fell = before.select("g", "start", F.log("det").alias("was")).join(found.select("g", "start", F.log("det").alias("now")), ["g", "start"])
        if (fell.agg(F.max(F.col("was") - F.col("now"))).first()[0] or 0.0) <= SETTLED:
            break
    best = found.groupBy("g").agg(F.min(F.struct("det", "start")).alias("b")).select("g", F.col("b.start").alias("start"))
    return found.join(best, ["g", "start"]).drop("start")


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, distance (squared, null where no estimate applies)."""
    stats = statistics(docs, ("doc_id", "lang", "source"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stored(stats.select("doc_id", F.concat(name("lang"), F.lit("\n"), name("source")).alias("g"), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *vector()), "statistics")
    passed = stats.filter("not base_failed")
    sizes = stored(passed.groupBy("g").count(), "sizes")
    large = stored(sizes.filter(F.col("count") >= LEAST).select("g", F.lit(True).alias("large")), "large")
    # the small groups together: their name is no group's
    rows = looked_up(stats, large, "g", "left").withColumn("g", F.when(F.col("large"), F.col("g")).otherwise("small")).drop("large")
    rows = stored(rows, "grouped")
    few = sizes.filter(F.col("count") < LEAST).agg(F.sum("count")).first()[0] or 0
    judged = F.lit(True) if few >= LEAST else F.col("g") != "small"
    found = robust(rows.filter(~F.col("base_failed") & judged).select("g", *DIMS))
    # an estimate from the nearest part is too narrow by this factor, were the rows normal
    widen = HALF / chi2_even(chi2_point(HALF, len(DIMS)), len(DIMS) + 2)
    limit, n = chi2_point(1 - tail, len(DIMS)), len(DIMS)
    out = looked_up(rows, found.select("g", *[f"m{i}" for i in range(n)], *[_cov(i, j) for i in range(n) for j in range(i, n)]), "g", "left")
    # the group's spread and the text's own noise
    out = out.withColumns({_cov(i, j): F.col(_cov(i, j)) * widen + (noise()[i] if i == j else F.lit(0.0)) for i in range(n) for j in range(i, n)})
    out = cholesky(out).withColumn("distance", F.when(F.col("m0").isNotNull(), distance()))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)).alias("kept"), "distance")
