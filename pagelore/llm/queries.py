"""The queries of this subpackage, each over its whole table, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm import brown, chat, decontam, langid, mixing, negatives, phrases, private, quality, rangecoder, sharding, simhash, tokencount
from pagelore.llm.common import fold, table

#: What both rows of the added conversation say.
TRICKY = r"\### Assistant: </turn> ok"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    formatted = chat.format_chat(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    back = chat.read_chat(formatted)
    loss = F.array_join(F.col("read.loss_text"), "")
    return back.select(
        "conv_id",
        F.size("read").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 4) == 2)
    return langid.identify(docs, ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 1).alias("held_out"))
    return brown.language_model(docs, ~F.col("held_out"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tables=False)


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangecoder.encoded(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = private.annotated(docs, private.learn(docs))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    kinds = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in private.KINDS]
    return found.select("doc_id", *kinds, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_sharding, op3_simhash_near_dedup, op4_language_id, op5_lm_scoring, op6_quality_rules, op7_benchmark_decontamination, op8_mixing, op9_token_counts, op10_token_id_output, op11_phrases, op12_pii, op13_hard_negatives)
}


def _escaped(x: str) -> str:
    """chat.escape in SQL."""
    out = f"replace({x}, chr(92), chr(92) || 's')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || 'p{c[1:]}')"
    return out


OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, {_escaped("text")})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, {_escaped("text")}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn>') + length(replace({_escaped("role")}, chr(10), chr(92) || 'n')) + 1 + length({_escaped("text")}) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_M, _N = sharding.SLOTS, sharding.SHARDS
OP2_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT k, 'shard-' || lpad(CAST(k AS VARCHAR), 3, '0') AS shard FROM range({_N}) t(k)
), hashed AS (
  SELECT k, CAST('0x' || substr(md5('offset/' || shard), 1, 15) AS BIGINT) % {_M} AS o, CAST('0x' || substr(md5('step/' || shard), 1, 15) AS BIGINT) % {_M - 1} + 1 AS s FROM shards
), prefers AS (
  SELECT k, list((o + s * j) % {_M} ORDER BY j) AS slots FROM hashed, range({_M}) t(j) GROUP BY k
), filled(turn, owner) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range({_M}), lambda x: CAST(-1 AS BIGINT))
  UNION ALL
  SELECT turn + 1, list_concat(owner[:slot], [k], owner[slot + 2:])
  FROM (SELECT turn, owner, k, list_filter(slots, lambda x: owner[x + 1] < 0)[1] AS slot FROM filled JOIN prefers ON k = turn % {_N} WHERE turn < {_M})
), places AS (
  SELECT unnest(range({_M})) AS slot, unnest(owner) AS k FROM filled WHERE turn = {_M}
), docs AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {_M} AS INTEGER) AS slot FROM documents
)
SELECT doc_id, docs.slot, shard FROM docs JOIN places ON places.slot = docs.slot JOIN shards ON shards.k = places.k
"""

_B, _P = mixing.BLOCK, mixing.PERIOD
OP8_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS rows, row_number() OVER (ORDER BY source) AS k, pow(count(*), 0.8) AS w FROM documents GROUP BY source
), exact AS (
  SELECT *, w / (SELECT sum(w) FROM sizes) * ({_P} - (SELECT count(*) FROM sizes)) AS x FROM sizes
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, source) AS r, {_P} - sum(1 + floor(x)) OVER () AS rest FROM exact
), shares AS (
  SELECT source, rows, k, CAST(1 + floor(x) + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM ranked
), all_n AS (
  SELECT list(n ORDER BY k) AS ns FROM shares
), steps(t, had, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ns, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM all_n
  UNION ALL
  SELECT t, list_transform(had, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END), pick FROM (
    SELECT t + 1 AS t, had, list_sort(list_transform(list_filter(range(1, len(ns) + 1), lambda i: had[i] < ns[i] AND had[i] * {_P} // ns[i] <= t + 1), lambda i: [((had[i] + 1) * {_P} + ns[i] - 1) // ns[i], i]))[1][2] AS pick
    FROM steps, all_n WHERE t + 1 < {_P})
), places AS (
  SELECT pick AS k, list(t ORDER BY t) AS slots FROM steps WHERE t >= 0 GROUP BY pick
), sources AS (
  SELECT source, n, slots, (rows + {_B - 1}) // {_B} // n * {_P} + slots[(rows + {_B - 1}) // {_B} % n + 1] AS runs_out FROM shares JOIN places USING (k)
), ends AS (
  SELECT min(runs_out) AS until FROM sources
), numbered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS nth FROM documents
), placed AS (
  SELECT doc_id, source, nth, nth // {_B} AS block, nth // {_B} // n * {_P} + slots[nth // {_B} % n + 1] AS slot FROM numbered JOIN sources USING (source)
)
SELECT doc_id, source, block, slot, slot * {_B} + nth % {_B} AS place, slot < until AS in_mix FROM placed, ends
"""

OP11_SQL = f"""
WITH pieces AS (
  SELECT lang, list_filter(string_split(translate(piece, chr(9), ' '), ' '), lambda w: w <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{phrases.UPPER}', '{phrases.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), grams AS (
  {" UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: w[i:i + {k - 1}])) AS p FROM pieces WHERE len(w) >= {k}" for k in range(1, phrases.LONGEST + 1))}
), f AS (
  SELECT lang, p, count(*) AS a FROM grams GROUP BY lang, p HAVING count(*) >= {phrases.LEAST}
), cuts AS (
  SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1
), scored AS (
  SELECT c.lang, c.p, c.a, c.k, l.a AS l, r.a AS r, CAST({phrases.FACTOR} * CAST(c.a AS HUGEINT) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = c.p[:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:]
), chosen AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, a, p[i:j] AS p FROM (SELECT lang, a, p, i, unnest(range(i + 1, len(p) + 1)) AS j FROM (SELECT lang, a, p, unnest(range(1, len(p))) AS i FROM f WHERE len(p) > 2)) WHERE j - i + 1 < len(p)
), longer AS (
  SELECT lang, p, max(a) AS most FROM inner_parts GROUP BY lang, p
), kept AS (
  SELECT c.lang, array_to_string(c.p, ' ') AS phrase, c.a, l, r, score FROM chosen c LEFT JOIN longer m ON m.lang = c.lang AND m.p = c.p
  WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < {phrases.COVERED} * CAST(c.a AS HUGEINT)
)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER best <= {phrases.TOP}
"""

OP13_SQL = f"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({negatives.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), positives AS (
  SELECT * FROM scored WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label <> n.own AND 100 * n.score BETWEEN {negatives.LOW} * p.score AND {negatives.HIGH} * p.score
WINDOW best AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER best <= {negatives.NEGATIVES}
"""

ORACLES: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op2_sharding": OP2_SQL, "op8_mixing": OP8_SQL, "op11_phrases": OP11_SQL, "op13_hard_negatives": OP13_SQL}
