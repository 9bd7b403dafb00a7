"""Near-duplicates by SimHash fingerprints in a Gray-order hierarchical index.

Fingerprint: 64 bits; a bit is set if over half of the document's 3-word shingles have it set in their XXH64. Two fingerprints link at
``radius`` differing bits or fewer; a component is what links reach.

Only distinct fingerprints are compared. The upper levels of the index are shared masked bit patterns that Spark shuffles by: with
radius 2, of three parts of the free bits two linked fingerprints share one whole, so a fingerprint goes to three nodes. A node with
more than LEAF fingerprints is divided again on its free bits, until 12 or fewer are free; a node is never cut short. Inside a node,
fingerprints are sorted by Gray rank and grouped FAN by FAN; a group's mask holds the bits that all its members share and no upper
group has factored out. A search adds up the differences on the way down and leaves a whole group once they pass the radius.
A node gives a spanning forest of its links, not all pairs. Components come from alternating star contraction, in tables.

The pipeline's stage asks for near copies: texts whose sets of 5-word shingles have a similarity of 0.8 or more. They differ in about 39 of
256 bits, too many for nodes of equal fingerprint bits. So there the uppermost level is bands of COPY_ROWS least hashes of the set, COPY_BANDS
for each text whatever the number of texts: a pair at 0.8 shares a node with a chance of 1 - (1 - 0.8 ** 5) ** 24 = 0.9999, and more above.
Inside a node the 256-bit fingerprints stand in Gray order under groups with their shared masked bits, and a search leaves a group whose
accumulated differences pass COPY_REACH, over five standard deviations beyond a similarity of 0.8. What it finds is a candidate: every
link is checked by the sets themselves. Each member of a node is first compared with the node's first one; only nodes that then still
hold two components are searched, in blocks if they are large. So no node is cut, and no link that shares a node is lost.

Defined cases: null or word-less text has fingerprint zero, linked like any other; fewer than three words are one shingle; exact copies
share a fingerprint; a null doc_id gets its row but never names a component unless no other id is in it; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from pagelore.llm.common import small_batches, stored

RADIUS, LEAF, FAN, SHINGLE = 2, 8192, 16, 3
SEED = 42
#: Shingles and queries that are held at a time; rows that go to a worker at once.
CHUNK, QUERIES, ROWS = 1 << 16, 128, 1000


def fingerprint(text: str | None) -> int:
    """Unsigned."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_digest
    if len(words) < SHINGLE:
        shingles: Iterator = iter([words])
        n = 1
    else:
        shingles, n = zip(*(words[k:] for k in range(SHINGLE)), strict=False), len(words) - SHINGLE + 1
    total = np.zeros(64, np.int64)
    for _ in range(0, n, CHUNK):
        block = b"".join([digest(join(s), SEED) for s, _ in zip(shingles, range(CHUNK), strict=False)]) if n > CHUNK else b"".join([digest(join(s), SEED) for s in shingles])
        total += np.unpackbits(np.frombuffer(block, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).astype(np.int64))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of a code in the Gray sequence: a prefix xor of its bits."""
    out = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Sorts codes of several 64-bit words, a row each, by Gray rank: a word's rank is turned over where the words before have odd parity."""
    rank = gray_rank(codes)
    odd = np.bitwise_xor.accumulate(rank & np.uint64(1), axis=1)
    rank[:, 1:] ^= np.uint64(0) - odd[:, :-1]
    return np.lexsort(rank.T[::-1])


def hierarchy(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the top: (value, mask) of each group of codes in Gray order; the last level is the codes themselves. A mask leaves out
    what the group above has. Codes are words, or rows of words."""
    full = np.full(codes.shape, ~np.uint64(0))
    levels = [(codes, full)]
    while len(levels[0][0]) > FAN:
        value, mask = levels[0]
        at = np.arange(0, len(value), FAN)
        ones = np.bitwise_and.reduceat(value, at)
        differ = np.bitwise_or.reduceat(value, at) & ~ones
        both = np.bitwise_and.reduceat(mask, at) & ~differ
        levels.insert(0, (ones, both))
    for k in range(1, len(levels)):
        value, mask = levels[k]
        levels[k] = (value, mask & ~_whole(levels, k - 1)[np.arange(len(value)) // FAN])
    return levels


def _whole(levels: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """All bits that level k and those above it have factored out."""
    out = levels[k][1]
    for j in range(k - 1, -1, -1):
        out = out | levels[j][1][np.arange(len(out)) // FAN ** (k - j)]
    return out


def near(levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(query's number, code's number) within the radius."""
    top = len(levels[0][0])
    q, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
    far = np.zeros(len(q), np.int64)
    for k, (value, mask) in enumerate(levels):
        if k:
            q, far, node = np.repeat(q, FAN), np.repeat(far, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
            there = node < len(value)
            q, far, node = q[there], far[there], node[there]
        apart = np.bitwise_count((queries[q] ^ value[node]) & mask[node])
        far = far + (apart if apart.ndim == 1 else apart.sum(1, dtype=np.int64))
        keep = far <= radius
        q, far, node = q[keep], far[keep], node[keep]
    return q, node


def forest(codes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each code of one node the first code that its links reach inside the node."""
    order = np.argsort(gray_rank(codes), kind="stable")
    levels, root = hierarchy(codes[order]), np.arange(len(codes))
    for at in range(0, len(codes), QUERIES):
        q, c = near(levels, codes[order[at : at + QUERIES]], radius)
        q = q + at
        q, c = q[q != c], c[q != c]
        while len(q):
            a, b = root[q], root[c]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (root[root] != root).any():
                root = root[root]
    out = np.empty(len(codes), np.int64)
    out[order] = order[root]
    return out


def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (node, fp) of whole nodes, a node's rows together; gives (a, b), b the root of a."""
    held: list[pd.DataFrame] = []

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        node, fp = rows["node"].to_numpy(), rows["fp"].to_numpy()
        edge = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]), True]) if len(node) else np.array([0])
        out = []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            if j - i > 1:
                part = fp[i:j]
                if j - i == 2:
                    if int(np.bitwise_count(np.uint64((int(part[0]) ^ int(part[1])) & (2**64 - 1)))) <= RADIUS:
                        out.append((part[:1], part[1:]))
                    continue
                root = forest(part.astype(np.uint64))
                moved = root != np.arange(j - i)
                out.append((part[moved], part[root[moved]]))
        return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])}) if out else pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})

    for batch in batches:
        held.append(batch)
        rows = pd.concat(held, ignore_index=True)
        last = rows["node"].iloc[-1] if len(rows) else None
        whole = (rows["node"] != last).to_numpy() if len(rows) else np.empty(0, bool)
        yield solve(rows[whole])
        held = [rows[~whole]]
    if held:
        yield solve(pd.concat(held, ignore_index=True))


def parts(free: int) -> list[tuple[int, int]]:
    """(shift, width) of RADIUS + 1 parts of the low ``free`` bits."""
    n = RADIUS + 1
    at = [free * k // n for k in range(n + 1)]
    return [(at[k], at[k + 1] - at[k]) for k in range(n)]


def links(fps: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` that connect all linked ones: a spanning forest for each node of the index."""
    out = None
    # free: bits not yet shared, moved to the low end of code; node: the path and the shared bits
    level, free = fps.select("fp", F.col("fp").alias("code"), F.lit("").alias("node")), 64
    while level is not None:
        moved = []
        for k, (shift, width) in enumerate(parts(free)):
            low = F.col("code") if free == 64 else F.col("code").bitwiseAND(2**free - 1)
            shared = F.shiftrightunsigned(low, shift).bitwiseAND(2**width - 1)
            above = F.lit(0).cast("bigint") if shift + width >= 64 else F.shiftrightunsigned(low, shift + width)
            rest = F.shiftleft(above, shift).bitwiseOR(low.bitwiseAND(2**shift - 1))
            moved.append(F.struct(F.concat("node", F.lit(f"/{k}:"), F.hex(shared)).alias("node"), rest.alias("code")))
        nodes = level.select("fp", F.explode(F.array(*moved)).alias("n")).select("fp", "n.node", "n.code")
        free = free - min(w for _, w in parts(free))
        full = None
        if free > 12:
            full = stored(nodes.groupBy("node").count().filter(F.col("count") > leaf).select("node"), "heavy")
            full = full if full.head(1) else None
        if full is not None:
            light, level = nodes.join(full, "node", "left_anti"), nodes.join(full, "node", "left_semi")
        else:
            light, level = nodes, None
        # two nodes of one hash are searched as one: links are between whole fingerprints
        light = light.select(F.xxhash64("node").alias("node"), "fp").repartition("node").sortWithinPartitions("node", "fp")
        found = light.mapInPandas(leaves, "a bigint, b bigint")
        out = found if out is None else out.union(found)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for each value with a link; root is the smallest value that its links reach. Alternating large and small stars, each
    an aggregation and a join in tables; the rows of a value of many links are joined with its one row, which a skew join may split."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").filter("u != v").distinct()
        new = stored(small, "links")
        same = new.count() == edges.count() and not new.join(edges, ["u", "v"], "left_anti").head(1)
        edges = new
        if same:
            return edges.select(F.col("u").alias("a"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, copies (rows with the same fingerprint) for each row."""
    rows = stored(docs.select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct")
    linked = components(links(fps.select("fp"), leaf))
    of = fps.join(linked.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    least = of.filter(F.col("root") != F.col("fp")).groupBy("root").agg(F.min("first").alias("other"))
    lowest = of.select("fp", "first", "copies", "root").join(least, "root", "left")
    # the root's own row holds its component's smallest id after this; members look it up
    roots = lowest.filter(F.col("root") == F.col("fp")).select("root", F.least("first", "other").alias("component_id"))
    return rows.join(of.join(roots, "root").select("fp", "copies", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


# Near copies of a given similarity: bands of least hashes, and links checked by the sets of shingles.

#: Words of a shingle; bands of a text, least hashes of a band; members and shingles of a node that are compared in one go.
COPY_SHINGLE, COPY_BANDS, COPY_ROWS, COPY_LEAF, COPY_HELD = 5, 24, 5, 1024, 1_000_000
#: Bits of the fingerprint, differing bits that a candidate may have, and those that most pairs at a similarity of 0.8 stay within.
COPY_BITS, COPY_REACH, COPY_RADIUS = 256, 80, 48
#: Factors (odd) and summands of the hashes.
FACTORS, SUMMANDS = np.frombuffer(b"".join(xxhash.xxh3_64_digest(bytes([k]), SEED) for k in range(COPY_BANDS * COPY_ROWS)), np.uint32).reshape(2, -1) | np.array([[1], [0]], np.uint32)


def wide_fingerprint(text: str | None) -> bytes:
    """COPY_BITS bits by majority over the distinct shingles of COPY_SHINGLE words; fewer words are one shingle; none: all zero."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return bytes(COPY_BITS // 8)
    join, digest = b" ".join, xxhash.xxh3_128_digest
    distinct = set(zip(*(words[k:] for k in range(COPY_SHINGLE)), strict=False)) if len(words) >= COPY_SHINGLE else {tuple(words)}
    shingles, n, total = iter(distinct), len(distinct), np.zeros(COPY_BITS, np.int64)
    for _ in range(0, n, CHUNK):
        block = [join(s) for s, _ in zip(shingles, range(CHUNK), strict=False)]
        own = b"".join([digest(s, SEED) + digest(s, SEED + 1) for s in block])
        total += np.unpackbits(np.frombuffer(own, np.uint8)).reshape(-1, COPY_BITS).sum(0, dtype=np.int64)
    return np.packbits(total * 2 > n).tobytes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of COPY_SHINGLE words; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.int64)
    join, digest = b" ".join, xxhash.xxh3_64_digest
    shingles = zip(*(words[k:] for k in range(COPY_SHINGLE)), strict=False) if len(words) >= COPY_SHINGLE else iter([words])
    return np.unique(np.frombuffer(b"".join([digest(join(s), SEED) for s in shingles]), np.int64))


def set_key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes(), SEED)


def copy_nodes(own: np.ndarray) -> list[int]:
    """The node of each band; they depend on the set alone."""
    low, least = own.astype(np.uint32), np.full(COPY_BANDS * COPY_ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, (low[at : at + 1024, None] * FACTORS + SUMMANDS).min(0), out=least)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), k) - 2**63 for k, row in enumerate(least.reshape(COPY_BANDS, COPY_ROWS))]


@F.pandas_udf(StructType().add("set", BinaryType()).add("size", LongType()).add("nodes", ArrayType(LongType())))
def copy_keys(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(x) for x in texts]
    return pd.DataFrame({"set": [set_key(x) for x in sets], "size": [len(x) for x in sets], "nodes": [copy_nodes(x) for x in sets]})


@F.pandas_udf(StructType().add("set", BinaryType()).add("print", BinaryType()).add("shingles", ArrayType(LongType())))
def copy_sets(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(x) for x in texts]
    return pd.DataFrame({"set": [set_key(x) for x in sets], "print": [wide_fingerprint(x) for x in texts], "shingles": sets})


def rarest(size: np.ndarray) -> np.ndarray:
    """How many of its shingles, the rarest first, a set of each size must share one of with any set of similarity 0.8: of a fifth."""
    return size - (4 * size + 4) // 5 + 1


def joinable(at: np.ndarray, size: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The sets that may have a similarity of 0.8 with one of another group: they share one of their ``rarest`` shingles (by the number of these
    sets that hold it) with it. Texts of one template share none, however much of the template they have in common. ``at``: the numbers of all
    shingles, set by set."""
    owner = np.repeat(np.arange(len(size)), size)
    held = np.bincount(at)
    order = np.lexsort((at, held[at], owner))
    nth = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    kept = order[nth < rarest(size)[owner]]
    kept = kept[held[at[kept]] > 1]
    kept = kept[np.lexsort((root[owner[kept]], at[kept]))]
    shingle, group = at[kept], root[owner[kept]]
    edge = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]]) if len(kept) else np.empty(0, np.int64)
    if not len(edge):
        return np.empty(0, np.int64)
    last = np.r_[edge[1:], len(kept)] - 1
    mixed = np.repeat(group[edge] != group[last], np.diff(np.r_[edge, len(kept)]))
    return np.unique(owner[kept[mixed]])


def across(sets: list[np.ndarray], prints: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of different groups (``root`` has each set's) that join all groups with a similarity of 0.8 between any two of
    their sets. ``prints``: the fingerprint of each set, COPY_BITS / 64 words; a set that is ``joinable`` is compared with what the Gray-order
    index of those finds within COPY_REACH of it."""
    size = np.array([len(x) for x in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    start, mark, root, out = np.cumsum(size) - size, np.zeros(len(at), np.int32), root.copy(), []
    some = joinable(at, size, root)
    if not len(some):
        return []
    order = gray_order(prints[some])
    levels = hierarchy(prints[some][order])
    for first in range(0, len(some), QUERIES):
        q, c = near(levels, prints[some[first : first + QUERIES]], COPY_REACH)
        q, c = some[q + first], some[order[c]]
        ahead = (c > q) & (5 * np.minimum(size[c], size[q]) >= 4 * np.maximum(size[c], size[q])) & (size[q] > 0)
        q, c = q[ahead], c[ahead]
        order_q = np.argsort(q, kind="stable")
        q, c = q[order_q], c[order_q]
        edge = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True]) if len(q) else np.array([0])
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            i, others = int(q[x]), c[x:y]
            others = others[root[others] != root[i]]
            if not len(others):
                continue
            own, n = at[start[i] : start[i] + size[i]], size[others]
            begin = np.cumsum(n) - n
            mark[own] = 1
            both = np.add.reduceat(mark[at[np.repeat(start[others] - begin, n) + np.arange(n.sum())]], begin)
            mark[own] = 0
            for j in others[9 * both >= 4 * (n + size[i])].tolist():
                if root[j] != root[i]:
                    out.append((i, j))
                    root[root == root[j]] = root[i]
    return out


def copy_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (node, set, print, root, shingles), a node's rows together; gives links (a, b) across its components."""
    held: list[pd.DataFrame] = []

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        node, own, a, b = rows["node"].to_numpy(), list(rows["set"]), [], []
        edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]) if len(node) else np.array([0])
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            prints = np.frombuffer(b"".join(rows["print"].iloc[i:j]), np.uint64).reshape(j - i, -1)
            for x, y in across(list(rows["shingles"].iloc[i:j]), prints, pd.factorize(rows["root"].iloc[i:j])[0]):
                a.append(own[i + x])
                b.append(own[i + y])
        return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})

    for batch in batches:
        held.append(batch)
        rows = pd.concat(held, ignore_index=True)
        whole = (rows["node"] != rows["node"].iloc[-1]).to_numpy() if len(rows) else np.empty(0, bool)
        yield solve(rows[whole])
        held = [rows[~whole]]
    if held:
        yield solve(pd.concat(held, ignore_index=True))


def copy_links(docs: DataFrame, prints: DataFrame, leaf: int = COPY_LEAF) -> DataFrame:
    """(a, b) of distinct sets (``prints`` has set, size, nodes, text_key) that connect all pairs with a similarity of 0.8 and a node."""
    nodes = prints.select("set", "size", F.explode("nodes").alias("node"))
    shared = nodes.groupBy("node").count().filter("count > 1").select("node")
    members = stored(nodes.join(shared, "node"), "members")
    heads = members.groupBy("node").agg(F.min("set").alias("head"))
    star = stored(members.join(heads, "node").filter("set != head").select("set", "head").distinct(), "star")
    needed = prints.join(members.select("set").distinct(), "set", "left_semi").select("set", "text_key")
    # copies are one before they are dealt; the function is marked so that no filter on its result runs it once more on all rows
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").dropDuplicates(["text_key"]).join(needed.select("text_key"), "text_key", "left_semi")
    sets = stored(texts.select(copy_sets.asNondeterministic()("text").alias("s")).select("s.*").join(needed, "set", "left_semi").dropDuplicates(["set"]), "sets")
    one = sets.select("set", "shingles")
    other = one.toDF("head", "others")
    alike = 9 * F.size(F.array_intersect("shingles", "others")) >= 4 * (F.size("shingles") + F.size("others"))

    def checked(pairs: DataFrame) -> DataFrame:
        return stored(pairs.join(one, "set").join(other, "head").filter(alike).select(F.col("set").alias("a"), F.col("head").alias("b")), "stars")

    def rooted(frame: DataFrame, roots: DataFrame, name: str, root: str) -> DataFrame:
        return frame.join(roots.toDF(name, root), name, "left").withColumn(root, F.coalesce(root, name))

    # most copies are joined by one head each; what other heads could still join is checked after that
    found = checked(star.groupBy("set").agg(F.min("head").alias("head")))
    roots = stored(components(found), "roots")
    apart = rooted(rooted(star, roots, "set", "x"), roots, "head", "y").filter("x != y").select("set", "head")
    found = found.union(checked(apart))
    of = stored(rooted(members, components(found), "set", "root"), "of")
    mixed = of.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("total")).filter("low != high")
    many = mixed.filter((F.col("n") > leaf) | (F.col("total") > COPY_HELD))
    if many.head(1):
        # a large node falls into one for each shingle that is among the rarest of some of its members
        large = of.join(many.select("node"), "node")
        inner = stored(large.join(sets.select("set", "shingles"), "set").select("node", "set", "root", "size", F.explode("shingles").alias("shingle")), "shingles")
        held = inner.groupBy("node", "shingle").count().filter("count > 1")
        # those of no other member come first in a set's order, so they only take places
        alone = F.col("size") - F.count("*").over(Window.partitionBy("node", "set"))
        place = alone + F.row_number().over(Window.partitionBy("node", "set").orderBy("count", "shingle"))
        inner = inner.join(held, ["node", "shingle"]).withColumn("place", place).filter(F.col("place") <= F.col("size") - F.floor((4 * F.col("size") + 4) / 5) + 1)
        inner = stored(inner.select(F.xxhash64("node", "shingle").alias("node"), "set", "root", "size"), "rare")
        of = stored(of.join(many.select("node"), "node", "left_anti").unionByName(inner.select(*of.columns)), "of")
        mixed = of.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("total")).filter("low != high")
    # members of a node that is still large are dealt into parts, and each two parts meet in one block
    parts = F.when((F.col("n") <= leaf) & (F.col("total") <= COPY_HELD), 1).otherwise(F.ceil(2 * F.greatest(F.col("n") / leaf, F.col("total") / COPY_HELD)))
    rows = of.join(mixed.select("node", parts.alias("parts")), "node").withColumn("p", F.pmod(F.xxhash64("set"), F.col("parts")))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("node", F.least("p", "q"), F.greatest("p", "q")).alias("node"), "set", "root").join(sets, "set")
    rest = rows.select("node", "set", "print", "root", "shingles").repartition("node").sortWithinPartitions("node", "set").mapInPandas(copy_leaves, "a binary, b binary")
    return found.union(rest)


def copy_groups(docs: DataFrame, leaf: int = COPY_LEAF) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set) of each row, and of each distinct set (set, root, component_id, and text_key of its first row); component_id is null if
    no row has an id."""
    small_batches(docs.sparkSession, ROWS)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), copy_keys.asNondeterministic()("text").alias("k"))
    rows = stored(keyed.select("doc_id", "text_key", "k.*"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("f")
    prints = stored(rows.groupBy("set", "size", "nodes").agg(first).select("set", "size", "nodes", F.col("f.doc_id").alias("first"), "f.text_key"), "distinct")
    linked = components(copy_links(docs, prints, leaf)).withColumnRenamed("a", "set")
    of = prints.join(linked, "set", "left").select("set", "first", "text_key", F.coalesce("root", "set").alias("root"))
    least = of.filter(F.col("root") != F.col("set")).groupBy("root").agg(F.min("first").alias("other"))
    roots = of.filter(F.col("root") == F.col("set")).join(least, "root", "left").select("root", F.least("first", "other").alias("component_id"))
    return rows, of.join(roots, "root").select("set", "root", "component_id", "first", "text_key")


def near_copies(docs: DataFrame, leaf: int = COPY_LEAF) -> DataFrame:
    """doc_id, component_id for each row: what texts of similarity 0.8 or more connect."""
    rows, groups = copy_groups(docs, leaf)
    return rows.join(groups, "set").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest doc_id (of rows that share it any one of the group), or any one
    if no row has an id. Different texts stay both, whether or not they share an id."""
    _, groups = copy_groups(docs)
    heads = groups.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("nameless"), "first", "text_key")).alias("f"))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    heads = heads.select(named("f.first").alias("id"), "f.text_key")
    # repeated rows are one before the join, which then has its sides dealt as it needs them
    rows = docs.select(F.struct(*docs.columns).alias("kept"), named("doc_id").alias("id"), F.xxhash64("text").alias("text_key"))
    return rows.dropDuplicates(["id", "text_key"]).join(heads, ["id", "text_key"], "left_semi").select("kept.*")
