"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on measures of the text gives each document's evidence.
Posterior means of hosts, and of paths within hosts, shrink sparse ones toward
the level above: the strength of shrinkage is estimated from the spread between
groups. A document's score adds to its own evidence its path's posterior from all
other documents: its own is taken out of the sums first, so it counts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, hot_keys, small_batches, staged, text_of, tidied
from .toxicity import MOST_LABELLED, labelled, logistic

SYMBOLS, DIGITS, SPACE = b"#*$%&|<>!{}[]\\^~=_@", b"0123456789", b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
ENDS = (".", "!", "?", "…", '"', "”", "»")
#: A document is kept from this posterior probability of good quality.
THRESHOLD = 0.5


def measures(text: str) -> list[float]:
    """What the classifier sees of a text: shares and logs, all finite, for any text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, size = len(words), max(1, len(raw.translate(None, SPACE)))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    pairs = set(zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    return [
        math.log1p(n),
        min(30.0, float(lengths.mean())),
        float((lengths > 25).mean()),
        math.sqrt(share(SYMBOLS)),
        math.sqrt(share(DIGITS)),
        share(UPPER),
        len(set(words)) / n if n else 0.0,
        len(pairs) / (n - 1) if n > 1 else 1.0,
        len(set(lines)) / len(lines) if lines else 1.0,
        sum(x.rstrip().endswith(ENDS) for x in lines) / len(lines) if lines else 0.0,
        math.log1p(n / len(lines)) if lines else 0.0,
        1.0 if n < 20 else 0.0,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the first one is the intercept
    base: float  # share of good documents among those learnt from

    def logit(self, text: str) -> float:
        """Log-odds that the text is good, at the base rate of the labelled rows."""
        x = np.clip((np.array(measures(text)) - self.mean) / self.scale, -8, 8)
        return float(np.clip(self.weights[0] + x @ self.weights[1:], -20, 20))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", most: int = MOST_LABELLED) -> Model:
    """Logistic regression on at most 2 * ``most`` labelled rows; those with crc32(id) mod 3 = 1 are left for tests.

    Labels are read as ``toxicity.labelled`` says. With labels of one kind only, or none, the
    model's evidence is their smoothed share for any text.
    """
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array([measures(x) for x in part.column(0).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    learnt = labelled(docs, labels, label, (0, 2), most, text, key)
    rows = learnt.select("body", "y").mapInArrow(batches, "y int, x array<double>").collect()  # of a bounded number of rows
    drop(learnt)
    rows.sort()
    if len({r.y for r in rows}) < 2:
        share = (sum(r.y for r in rows) + 0.5) / (len(rows) + 1.0)
        width = len(measures(""))
        return Model(np.zeros(width), np.ones(width), np.array([math.log(share / (1 - share))] + [0.0] * width), share)
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], dtype=float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    return Model(mean, scale, logistic(np.hstack([np.ones((len(z), 1)), z]), y), float(y.mean()))


def host_of(url: Column) -> Column:
    """Host of a web address, lower case, without www."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def path_of(url: Column) -> Column:
    """First part of an address's path."""
    return F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/([^/]*)/", 1)


def evidence(docs: DataFrame, model: Model, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Columns ``keep`` and the classifier's logit of each document; null text is empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(text_of(text).alias("_body"), *(keep or []))
    names = rows.columns[1:]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([model.logit(x) for x in part.column(0).to_pylist()], pa.float64())], names=[*names, "logit"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(batches, ", ".join([*kinds, "logit double"]))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def site(host: Column, path: Column) -> Column:
    """One string for a host and a path, distinct for distinct pairs, nulls included."""
    return F.to_json(F.struct(host.alias("h"), path.alias("p")))


def strength(mean: str | Column) -> Column:
    """Pseudo-counts of a beta prior whose spread is that of the groups' means beyond chance (moments)."""
    n, good, m = F.col("n"), F.col("good"), mean if isinstance(mean, Column) else F.col(mean)
    chance = F.sum(m * (1 - m)) / F.sum(n)
    spread = F.sum(n * (good / n - m) * (good / n - m)) / F.sum(n) - chance
    total = F.sum(n * m * (1 - m)) / F.sum(n)
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.when(spread > 0, total / spread - 1).otherwise(F.lit(1e6))))


def posteriors(scored: DataFrame) -> DataFrame:
    """Sums and shrinkage of each site, from rows (host, path, logit), by grouped sums and empirical Bayes.

    site, path_n, path_good, path_k, host_n, host_good, host_k, base, and the posterior
    means host_posterior and path_posterior. Rows are summed on the map side, so that a
    host with a third of all rows is one partial sum in each task. Null hosts and paths are
    groups of their own; an empty table has no sites.
    """
    paths = staged(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(sigmoid(F.col("logit"))).alias("good")), "paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    base = hosts.agg((F.sum("good") / F.sum("n")).alias("base")).first().base
    base = 0.5 if base is None else min(1 - 1e-6, max(1e-6, base))
    k = hosts.agg(strength(F.lit(base)).alias("k")).first().k or 1.0
    hosts = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("good").alias("host_good"), F.lit(k).alias("host_k"))
    hosts = hosts.withColumn("host_posterior", (F.col("host_good") + k * base) / (F.col("host_n") + k))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    k = both.agg(strength("host_posterior").alias("k")).first().k or 1.0
    path = (F.col("good") + k * F.col("host_posterior")) / (F.col("n") + k)
    sums = [F.col("n").alias("path_n"), F.col("good").alias("path_good"), F.lit(k).alias("path_k"), "host_n", "host_good", "host_k", F.lit(base).alias("base")]
    return staged(both.select(site(F.col("host"), F.col("path")).alias("site"), *sums, "host_posterior", path.alias("path_posterior")), "posteriors")


def others() -> Column:
    """The path's posterior without the row's own evidence, which is taken out of the sums of its path and its host."""
    own = sigmoid(F.col("logit"))
    host = (F.col("host_good") - own + F.col("host_k") * F.col("base")) / (F.col("host_n") - 1 + F.col("host_k"))
    return (F.col("path_good") - own + F.col("path_k") * host) / (F.col("path_n") - 1 + F.col("path_k"))


def combined() -> Column:
    odds = lambda c: F.log(c / (1 - c))
    prior = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), others()))
    return sigmoid(F.col("logit") + odds(prior) - odds(F.col("base")))


def with_sites(scored: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds the sites' columns to staged rows with a ``site``. Hot sites are joined on the map side, by a broadcast of a bounded number of rows."""
    hot = staged(sites.join(F.broadcast(hot_keys(scored, "site")), "site", "left_semi").withColumn("_hot", F.lit(True)), "hot")
    marked = scored.join(F.broadcast(hot), "site", "left")
    cold = marked.filter("_hot is null").select(*scored.columns).join(sites, "site")
    return marked.filter("_hot").select(*cold.columns).unionByName(cold)


def judged(docs: DataFrame, model: Model, text: str, keep: list[Column], host: Column, path: Column) -> DataFrame:
    """Columns ``keep`` of each row, logit and the columns of ``posteriors``. The classifier reads each text once."""
    scored = staged(evidence(docs, model, text, [*keep, host.alias("host"), path.alias("path"), site(host, path).alias("site")]), "evidence")
    return with_sites(scored.drop("host", "path"), posteriors(scored))


@tidied
def quality(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", host: str | Column = "source", path: str | Column = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, logit, host_posterior, path_posterior, score, kept.

    Null text is empty, null hosts and paths are groups of their own, rows that repeat
    an id are documents of their own. An empty table gives no rows.
    """
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host, path))
    out = judged(docs, model, text, [F.col(key).alias("doc_id")], host, path)
    return out.select("doc_id", "logit", "host_posterior", "path_posterior", combined().alias("score"), (combined() >= threshold).alias("kept"))


@tidied
def good_rows(docs: DataFrame, model: Model, text: str = "text", host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; nothing with text is shuffled unless its site is rare."""
    out = judged(docs, model, text, [F.struct("*").alias("row")], F.col(host), F.col(path))
    return out.filter(combined() >= threshold).select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, fit(docs, labels))


SQL: dict[str, str] = {}  # a fitted model; tests measure held-out accuracy and check the posteriors by hand
QUERIES = {"op7_quality": op7_quality}
