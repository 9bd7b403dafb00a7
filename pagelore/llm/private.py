"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from one pattern for each kind, leftmost and non-overlapping; a match that fails its kind's check is dropped. The field labels
the tokens that hold a digit or an @ (no other token can be part of an entity, so all others are fixed at "none" and send no message).
Its potentials: features of the token and its neighbours, a chain potential between tokens that stand side by side, and a skip potential
between repeats of a token (the same letters and digits, or the same six digits or more) anywhere in the document. Each repeat is tied to
the first one, so there are fewer ties than tokens. Tokens in base spans are observed; loopy message passing carries their labels to
their repeats. A token with a kind of probability SURE or more that is in no base span is an added span, side by side ones are one; it must
still look like its kind (``plausible``, which asks less than the patterns do).

The field is fitted by its pseudo-likelihood on at most LESSONS documents of at most LESSON_TOKENS such tokens, with base spans as labels;
tokens that are like a labelled one but in no base span are left out, as the patterns cannot tell what they are. The documents are those
with the least hashes of their texts, each text once. All else reads whole texts of all documents.

Defined cases: null or blank text has no spans; a document without digits and @ has none; repeated rows are labelled alike; an empty table
gives an empty result; other columns stay as they are; without lessons the base spans are all there is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: Documents that teach, tokens of such a document, features, steps of fitting.
LESSONS, LESSON_TOKENS, FEATURES, STEPS = 3000, 64, 20_000, 200

#: Prior mean of the skip potential of equal labels, strength of the priors, least probability of an added span, rounds of messages.
AGREE, PRIOR, SURE, ROUNDS = 3.0, 0.02, 0.9, 30

#: Tokens whose messages are worked out together.
TOGETHER = 50_000

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no number is tried again from its middle: what follows it would be the same
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK, BLANK = re.compile(r"[0-9@]"), re.compile(r"[\x20\x09-\x0D]")
TRIM = ".,;:!?\"'<>[]{}=*"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def is_card(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_ip(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def is_phone(match: str) -> bool:
    return 9 <= sum(c.isdigit() for c in match) <= 15


def plausible(kind: int, span: str) -> bool:
    digits = sum("0" <= c <= "9" for c in span)
    return ("@" in span, span.count(".") >= 3 and digits >= 4, 12 <= digits <= 19, 5 <= digits <= 15)[kind]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part before an @ is the whole run of its characters, down to the last match's end."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for kind, (pattern, check) in enumerate(((IP, is_ip), (CARD, is_card), (PHONE, is_phone)), 1):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if check(m.group())]
    return sorted(found)


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """The tokens that hold a digit or an @."""
    end = 0
    while mark := MARK.search(text, end):
        start = mark.start()
        while start > end and text[start - 1] not in BLANKS:
            start -= 1
        stop = BLANK.search(text, mark.end())
        end = stop.start() if stop else len(text)
        yield start, end


def shape(token: str) -> str:
    """Runs of digits with their length, runs of letters, everything else as it is."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 20)}>", token[:200]))[:60]


def near(text: str, at: int, step: int) -> str:
    """The letters of the word before or after a place."""
    a = at - 1 if step < 0 else at
    while 0 <= a < len(text) and text[a] in BLANKS:
        a += step
    b = a
    while 0 <= b < len(text) and text[b] not in BLANKS and abs(b - a) < 30:
        b += step
    word = text[a:b] if step > 0 else text[b + 1 : a + 1]
    return re.sub(r"\W+", "", word.lower()) or ("^" if not word else "_")


def features(text: str, start: int, end: int) -> list[str]:
    token = text[start:end]
    digits = re.sub(r"[^0-9]", "", token)
    form = shape(token)
    return [
        "",
        f"shape {form}",
        f"core {shape(token.strip(TRIM))}",
        f"digits {min(len(digits), 20)}",
        f"ends {form[:1]}{form[-1:]}",
        f"at {'@' in token} {token.count('.') if token.count('.') < 5 else 5}",
        f"check {12 <= len(digits) <= 19 and luhn(digits)}",
        f"letters {any(c.isalpha() for c in token[:200])}",
        f"before {near(text, start, -1)}",
        f"after {near(text, end, 1)}",
    ]


def groups(token: str) -> list[str]:
    """What a token shares with its repeats."""
    same = re.sub(r"\W+", "", token.lower())
    digits = re.sub(r"[^0-9]", "", token)
    return [g for g, least in ((same, 3), (digits, 6)) if len(g) >= least]


@dataclass
class Graph:
    """Tokens of documents with their ties; labels: 0 none, then the kinds; ``observed`` tokens are in a base span."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    traits: list[list[str]] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str, base: list[tuple[int, int, int]]) -> None:
        first: dict[str, int] = {}
        last, k = -1, 0
        for start, end in tokens(text):
            n = len(self.spans)
            while k < len(base) and base[k][2] <= start:
                k += 1
            self.spans.append((start, end))
            self.traits.append(features(text, start, end))
            self.labels.append(base[k][1] + 1 if k < len(base) and base[k][0] < end else 0)
            if last >= 0 and not text[last:start].strip(BLANKS):
                self.chain.append((n - 1, n))
            tied = {first.setdefault(g, n) for g in groups(text[start:end])}
            self.skip += [(m, n) for m in sorted(tied) if m != n]
            last = end

    def __len__(self) -> int:
        return len(self.spans)


def edges(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array(pairs, dtype=np.int64).reshape(-1, 2)


def summed(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(where, values[:, k], n) for k in range(values.shape[1])], axis=1)


def soft(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


LABELS = len(KINDS) + 1


@dataclass
class Model:
    known: dict[str, int]
    weights: np.ndarray  # features + 1 for unknown ones, labels
    chain: np.ndarray
    skip: np.ndarray

    def places(self, traits: list[list[str]]) -> np.ndarray:
        none = len(self.known)
        return np.array([[self.known.get(t, none) for t in row] for row in traits], dtype=np.int64)

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy sum-product messages, all at once in each round, until they stand still."""
        n = len(graph)
        unary = self.weights[self.places(graph.traits)].sum(axis=1)
        seen = np.array(graph.labels)
        at = np.flatnonzero(seen > 0)
        unary[at] = -50.0
        unary[at, seen[at]] = 0.0
        pairs = np.concatenate([edges(graph.chain), edges(graph.skip)])
        kinds = np.repeat([0, 1], [len(graph.chain), len(graph.skip)])
        potential = np.stack([self.chain, self.skip])[kinds]
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        target = np.concatenate([pairs[:, 1], pairs[:, 0]])
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        messages = np.zeros((len(source), LABELS))
        half = len(pairs)
        for _ in range(ROUNDS):
            belief = unary + summed(target, messages, n)
            back = np.concatenate([messages[half:], messages[:half]])
            given = (belief[source] - back)[:, :, None] + potential
            top = given.max(axis=1)
            new = top + np.log(np.exp(given - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - messages).max(initial=0)
            messages = (messages + new) / 2
            if moved < 1e-4:
                break
        return soft(unary + summed(target, messages, n))


def fit(lessons: Iterable[Graph], most: int = FEATURES, steps: int = STEPS) -> Model:
    """Potentials by gradient steps on the pseudo-likelihood: each token's label given its neighbours' labels."""
    whole = Graph()
    for g in lessons:
        n = len(whole)
        whole.spans += g.spans
        whole.traits += g.traits
        whole.labels += g.labels
        whole.chain += [(a + n, b + n) for a, b in g.chain]
        whole.skip += [(a + n, b + n) for a, b in g.skip]
    counts = Counter(t for row in whole.traits for t in row)
    known = {t: k for k, (t, _) in enumerate(sorted(((t, c) for t, c in counts.items() if c > 1), key=lambda x: (-x[1], x[0]))[:most])}
    model = Model(known, np.zeros((len(known) + 1, LABELS)), np.zeros((LABELS, LABELS)), np.eye(LABELS) * AGREE)
    if not len(whole):
        model.weights[-1, 0] = 1.0
        return model
    labels, chain, skip = np.array(whole.labels), edges(whole.chain), edges(whole.skip)
    # what hangs together with a labelled token by repeats but is not labelled
    reached = labels > 0
    for _ in range(len(skip)):
        before = reached.sum()
        reached[skip[reached[skip[:, 0]], 1]] = True
        reached[skip[reached[skip[:, 1]], 0]] = True
        if reached.sum() == before:
            break
    sure = ~reached | (labels > 0)
    places = model.places(whole.traits)
    chain, skip = (e[sure[e].all(axis=1)] for e in (chain, skip))
    truth = np.eye(LABELS)[labels] * sure[:, None]
    params = [model.weights, model.chain, model.skip]
    means = [p.copy() for p in params]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, steps + 1):
        score = model.weights[places].sum(axis=1)
        for e, p in ((chain, model.chain), (skip, model.skip)):
            score += summed(e[:, 1], p[labels[e[:, 0]]], len(labels)) + summed(e[:, 0], p.T[labels[e[:, 1]]], len(labels))
        off = truth - soft(score) * sure[:, None]
        w = np.zeros_like(model.weights)
        for c in range(places.shape[1]):
            w += summed(places[:, c], off, len(w))
        grads = [w]
        for e in (chain, skip):
            g = summed(labels[e[:, 0]], off[e[:, 1]], LABELS) + summed(labels[e[:, 1]], off[e[:, 0]], LABELS).T
            grads.append(g)
        grads[2] = (grads[2] + grads[2].T) / 2
        for k, (p, g) in enumerate(zip(params, grads, strict=True)):
            g = g / sure.sum() - PRIOR * (p - means[k]) / 10
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p += 0.1 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def added(text: str, base: list[tuple[int, int, int]], graph: Graph, odds: np.ndarray, first: int, last: int) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, probability) of the spans that the field adds to a document, whose tokens are first .. last - 1 of the graph."""
    out: list[tuple[int, int, int, float]] = []
    before = -2
    for n in range(first, last):
        kind = int(odds[n].argmax())
        if graph.labels[n] or not kind or odds[n, kind] < SURE:
            continue
        start, end = graph.spans[n]
        sure = float(odds[n, kind])
        if before == n - 1 and out[-1][1] == kind - 1 and not text[out[-1][2] : start].strip(BLANKS):
            start, sure = out[-1][0], min(sure, out.pop()[3])
        out.append((start, kind - 1, end, sure))
        before = n
    trimmed = []
    for start, kind, end, sure in out:
        token = text[start:end]
        start += len(token) - len(token.lstrip(TRIM))
        end -= len(token) - len(token.rstrip(TRIM))
        if start < end and plausible(kind, text[start:end]):
            trimmed.append((start, kind, end, sure))
    return trimmed


def spans(texts: list[str], model: Model | None) -> Iterator[list[tuple[int, int, int, float, bool]]]:
    """For each text (start, kind, end, probability, base) in order."""
    graph, waiting = Graph(), []

    def flush() -> Iterator[list[tuple[int, int, int, float, bool]]]:
        odds = model.marginals(graph) if model and any(k == 0 for k in graph.labels) else None
        for text, base, first, last in waiting:
            found = [(a, k, b, 1.0, True) for a, k, b in base]
            if odds is not None:
                found += [(*x, False) for x in added(text, base, graph, odds, first, last)]
            yield sorted(found)

    for text in texts:
        base, first = base_spans(text), len(graph)
        if model:
            graph.add(text, base)
        waiting.append((text, base, first, len(graph)))
        if len(graph) > TOGETHER:
            yield from flush()
            graph, waiting = Graph(), []
    yield from flush()


def lessons(docs: DataFrame, most: int = LESSONS) -> list[Graph]:
    """Graphs of at most ``most`` documents that have something to label, each text once."""

    @F.pandas_udf("traits array<array<string>>, labels array<int>, chain array<array<int>>, skip array<array<int>>")
    def lesson(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                graph = Graph()
                graph.add(text, base_spans(text))
                rows.append((graph.traits, graph.labels, graph.chain, graph.skip) if len(graph) <= LESSON_TOKENS else (None,) * 4)
            yield pd.DataFrame(rows, columns=["traits", "labels", "chain", "skip"])

    marked = docs.select("text", F.xxhash64("text").alias("h")).filter(F.col("text").rlike("[0-9@]"))
    few = marked.select("h").distinct().orderBy("h").limit(most)
    texts = marked.join(F.broadcast(few), "h").dropDuplicates(["h"])
    rows = texts.select("h", lesson("text").alias("g")).filter("g.labels is not null").orderBy("h").select("g.*").toArrow().to_pylist()
    return [Graph([(0, 0)] * len(r["labels"]), r["traits"], r["labels"], [tuple(e) for e in r["chain"]], [tuple(e) for e in r["skip"]]) for r in rows]


def learn(docs: DataFrame, most: int = LESSONS) -> Model:
    return fit(lessons(docs, most))


def find(docs: DataFrame, model: Model | None) -> Column:
    """array of (kind, start, end, probability, base): code points of ``text``, end exclusive, in order of start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("kind", "start", "end", "probability", "base")

    @F.pandas_udf("kind array<string>, start array<int>, end array<int>, probability array<double>, base array<boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [([KINDS[f[1]] for f in found], *([f[k] for f in found] for k in (0, 2, 3, 4))) for found in spans([t or "" for t in texts], shared.value)]
            yield pd.DataFrame(rows, columns=names)

    return run("text")


def annotated(docs: DataFrame, model: Model | None, name: str = "spans") -> DataFrame:
    """``docs`` with the column ``name``: array of struct(kind, start, end, probability, base)."""
    raw = f"{name}_arrays"
    while raw in docs.columns:
        raw += "_"
    fields = [F.col(raw)[c].alias(c) for c in ("kind", "start", "end", "probability", "base")]
    return docs.withColumn(raw, find(docs, model)).withColumn(name, F.arrays_zip(*fields)).drop(raw)
