"""Toxic passages by maximum-scoring segment search.

Token weights are log-odds with an informative Dirichlet prior, less a drift
that makes ordinary text score below zero. A linear scan (Ruzzo and Tompa 1999)
finds all maximal segments. Extreme-value statistics of clean documents turn a
segment's score into an expected number of such segments by chance, and a
document's passages into one calibrated probability.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, small_batches, staged, text_of, tidied
from .simhash import shingle_hashes

#: Bounds of what is learnt from and kept: labelled rows for each of the two steps, tokens.
MOST_LABELLED, MOST_TOKENS = 20_000, 50_000
#: The prior has this share of each token's documents, on both sides; a weight needs this z and so many documents.
PRIOR, LEAST_Z, LEAST_COUNT = 0.1, 3.7, 5
#: Beginnings of tokens, in bytes, that weigh for tokens which have no weight themselves.
STEMS = (7, 6, 5, 4)
#: Tokens whose weight a worker remembers.
REMEMBERED = 500_000
DRIFT, SIGNIFICANT, THRESHOLD = 0.25, 0.01, 0.7
SPACES = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def tokens(text: str) -> list[bytes]:
    """Lower-case runs without white space and ASCII punctuation."""
    return text.lower().encode().translate(SPACES).split()


def stems(token: bytes) -> list[bytes]:
    """Beginnings of a token that weigh for it, longest first; a mark tells them from whole tokens."""
    return [b"^" + token[:n] for n in STEMS if len(token) >= n]


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, end, score); ``hits`` are weighted tokens in order, others weigh -drift.

    Linear: each hit is pushed once and merged at most once.
    """
    stack: list[list] = []  # first, end, sum before, sum after, index of the last before it with a smaller sum before
    total, at = 0.0, 0
    for i, w in hits:
        total -= drift * (i - at)
        at = i + 1
        before, total = total, total + w
        if w <= 0:
            continue
        new = [i, i + 1, before, total, 0]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], 0]
            prior = stack[j][4]
            del stack[j:]
            j = prior
    return [(a, b, r - l) for a, b, l, r, _ in stack]


@dataclass
class Model:
    weights: dict[bytes, float]
    drift: float = DRIFT
    rate: float = 1.0  # lambda of the extreme-value law of clean documents
    size: float = 1.0  # its K
    coefficients: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])

    seen: dict[bytes, float] = field(default_factory=dict, compare=False, repr=False)

    def weight(self, token: bytes) -> float:
        """A token's own weight, else that of its longest known beginning, else 0."""
        w = self.seen.get(token)
        if w is None:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            w = self.weights.get(token)
            if w is None:
                w = next((self.weights[x] for x in stems(token) if x in self.weights), 0.0)
            self.seen[token] = w
        return w

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of tokens and all maximal segments: first, end, score, expected number by chance."""
        seq, seen, weight = tokens(text), self.seen, self.weight
        hits = [(i, w) for i, t in enumerate(seq) if (w := seen.get(t) if t in seen else weight(t))]
        found = segments(hits, self.drift) if hits else []
        return len(seq), [(a, b, s, self.size * max(1, len(seq)) * math.exp(-min(700.0, self.rate * s))) for a, b, s in found]

    def features(self, text: str) -> tuple[float, float]:
        """Evidence of the best passage and of all significant ones, from their expected numbers."""
        _, found = self.passages(text)
        bits = [-math.log(e) if e > 1e-300 else 690.0 for *_, e in found]
        good = [b for b in bits if b >= -math.log(SIGNIFICANT)]
        return min(30.0, max([0.0, *bits])), math.log1p(sum(good))

    def score(self, text: str) -> float:
        best, every = self.features(text)
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * best + c * every))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; x has a leading column of ones, which is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + shrink @ w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + shrink, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key: str = "doc_id"):
    """The rows that are never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


@tidied
def labelled(docs: DataFrame, labels: DataFrame, label: str, remainders: Sequence[int], most: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Labelled rows (body, y, part) whose crc32 of the id, mod 3, is in ``remainders``; of each at most ``most`` ids, the first by a hash.

    A repeated label counts once; ids without a label of 0 or 1, or with both, and null ids are left out.
    One pass over ``docs``; the rows are staged. Ids that repeat in ``docs`` give a row each.
    """
    part = F.crc32(F.col(key).cast("string").cast("binary")) % 3
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_i")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z"), F.first(part).cast("int").alias("part"))
    first = [one.filter((F.col("part") == r) & F.expr("y = z")).orderBy(F.xxhash64("_i"), "_i").limit(most) for r in remainders]
    chosen = reduce(DataFrame.unionByName, first).select("_i", "y", "part")
    return staged(docs.select(F.col(key).alias("_i"), text_of(text).alias("body")).join(F.broadcast(chosen), "_i").select("body", "y", "part"), "labelled")


def without_copies(rows: DataFrame) -> DataFrame:
    """Rows (body, y, part) of which near copies are mostly left out: of those with equal least shingles one per label stays."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = np.array([[1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9]], np.uint64)
        for part in parts:
            least = []
            for body in part.column(0).to_pylist():
                h = shingle_hashes(body, 5)
                with np.errstate(over="ignore"):
                    least.append((h[:, None] * turns).min(axis=0).view(np.int64).tolist() if len(h) else [0, 0, 0])
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[i] for x in least], pa.int64()) for i in range(3))], names=["body", "y", "part", "a", "b", "c"])

    marked = rows.mapInArrow(batches, "body string, y int, part int, a long, b long, c long")
    for c in ("a", "b", "c"):
        marked = marked.withColumn("i", F.row_number().over(Window.partitionBy("y", c).orderBy("a", "b", "c", "part", "body"))).filter("i = 1")
    return marked.select("body", "y", "part")


def token_counts(rows: DataFrame) -> DataFrame:
    """w, a0, b0, a2, b2: documents of label 0 and 1 of each part (0 or 2) that hold a token or beginning; the empty token counts all.

    Counts are of distinct documents, as a burst of one word says little. They are summed in Spark.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held = {k: Counter() for k in ((0, 0), (1, 0), (0, 2), (1, 2))}
            for body, y, p in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                own = set(tokens(body))
                held[y, p].update(own.union(*map(stems, own)))
                held[y, p][b""] += 1
            words = list(set().union(*held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in held.values())], names=["w", "a0", "b0", "a2", "b2"])

    return rows.mapInArrow(batches, "w binary, a0 long, b0 long, a2 long, b2 long").groupBy("w").agg(*(F.sum(c).alias(c) for c in ("a0", "b0", "a2", "b2")))


def log_odds(a: Column, b: Column, n_a: int, n_b: int) -> tuple[Column, Column]:
    """Log-odds of being in a document of label 1 against label 0, and its z, with a Dirichlet prior of PRIOR times the counts of both."""
    alpha = F.lit(PRIOR) * (a + b)
    odds = lambda k, docs: F.log((k + alpha) / (F.lit((1 + PRIOR) * docs + PRIOR * (n_a + n_b - docs) + 1.0) - k - alpha))
    d = odds(b, n_b) - odds(a, n_a)
    return d, d / F.sqrt(1 / (a + alpha) + 1 / (b + alpha))


def learn_weights(counts: DataFrame, parts: Sequence[int]) -> dict[bytes, float]:
    """Weights of tokens and beginnings from the counts of some parts; the MOST_TOKENS most certain ones are kept."""
    t = counts.select("w", *(reduce(Column.__add__, (F.col(f"{c}{p}") for p in parts)).alias(c) for c in ("a", "b")))
    n = t.filter(F.length("w") == 0).first()
    if n is None or not n.a or not n.b:
        return {}
    d, z = log_odds(F.col("a"), F.col("b"), n.a, n.b)
    kept = t.filter((F.col("a") + F.col("b") >= LEAST_COUNT) & (F.length("w") > 0)).select("w", d.alias("d"), z.alias("z"))
    # A beginning weighs only where it speaks for the label: most words say nothing.
    kept = kept.filter((F.col("z") >= LEAST_Z) | (F.col("z") <= -LEAST_Z) & ~F.startswith("w", F.lit(b"^")))
    return {bytes(r.w): r.d - DRIFT for r in kept.orderBy(F.abs("z").desc(), "w").limit(MOST_TOKENS).collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", most: int = MOST_LABELLED) -> Model:
    """Weights and calibration from the labelled rows with remainders 0 and 2, at most ``most`` of each.

    Calibration is crossed: a row's evidence for it comes from weights of the other
    remainder. The weights that score are those of both. Without labels of both kinds
    there are no weights, or the score is the smoothed share of label 1 for any text.
    """
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, label, (0, 2), most, text, key)
    counts = staged(token_counts(without_copies(rows)), "counts")
    models = {p: Model(learn_weights(counts, [2 - p])) for p in (0, 2)}  # for the rows of part p
    model = Model(learn_weights(counts, [0, 2]))

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [models[p].passages(x) for x, p in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([max([0.0, *(s for _, _, s, _ in f)]) for _, f in found])], names=["y", "n", "s"])

    seen = rows.mapInArrow(best, "y int, n long, s double").collect()  # at most twice ``most`` rows of three numbers
    clean = np.array([(r.n, r.s) for r in seen if r.y == 0] or [(1, 0.0)], dtype=float)
    rate, size = extreme_value_law(clean[:, 0], clean[:, 1])
    for m in (model, *models.values()):
        m.rate, m.size = rate, size

    def evidence(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            f = [models[p].features(x) for x, p in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([a for a, _ in f], pa.float64()), pa.array([b for _, b in f], pa.float64())], names=["y", "a", "b"])

    seen = sorted(rows.mapInArrow(evidence, "y int, a double, b double").collect())
    if len({r.y for r in seen}) == 2:
        model.coefficients = [float(c) for c in logistic(np.array([(1.0, r.a, r.b) for r in seen]), np.array([r.y for r in seen], dtype=float))]
    else:
        share = (sum(r.y for r in seen) + 0.5) / (len(seen) + 1.0)
        model.coefficients = [math.log(share / (1 - share)), 0.0, 0.0]
    drop(counts)
    drop(rows)
    return model


def extreme_value_law(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """Rate and size of Gumbel's law by moments: sd = pi / (rate sqrt 6), mean = (log(size n) + gamma) / rate."""
    rate = float(np.clip(math.pi / (math.sqrt(6) * max(best.std(), 1e-3)), 0.5, 5.0))
    return rate, float(np.exp(np.mean(rate * best - np.log(np.maximum(n, 1))) - np.euler_gamma))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, passages (first and end token, score, expected by chance).

    Passages are the significant ones. Null text is empty; a null id counts as
    not held out. Scores come from the text alone.
    """
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for part in parts:
            texts = part.column(2).to_pylist()
            found = [[dict(zip(("first", "end", "score", "expected"), p, strict=True)) for p in model.passages(x)[1] if p[3] <= SIGNIFICANT] for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([model.score(x) for x in texts], pa.float64()), pa.array(found, kind)], names=["doc_id", "held_out", "score", "passages"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(held_out(key), F.lit(False)).alias("held_out"), text_of(text).alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(batches, f"doc_id {kind}, held_out boolean, score double, passages array<struct<first:long,end:long,score:double,expected:double>>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, fit(docs, labels))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


SQL: dict[str, str] = {}  # no SQL form; tests measure held-out accuracy and check the scan against brute force
QUERIES = {"op6_toxicity": op6_toxicity}
