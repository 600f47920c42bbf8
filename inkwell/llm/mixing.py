"""Mixing sources to target weights along a time-varying curriculum (native).

Each source has a weight and a linear schedule over training progress 0..1 whose
integral is its target. Its documents stand in a hashed order on a line of
cumulative words; the inverse of the source's cumulative demand turns a place on
that line into a training position, and documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, text_of, tidied

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Slope of a source's schedule, by the order of sources: falling, even, rising.
TILTS = (-0.5, 0.0, 0.5)
#: Hex digits of a document's hash that name its bin; words are summed by source and bin first.
BIN_DIGITS = 3


def words_of(text: str | Column = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def named(source: Column) -> Column:
    """A source as a string that is never null, distinct for distinct sources."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))


def pick(values: Sequence[float], i: Column) -> Column:
    """values[i mod len], as a literal array lookup."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of ``sources`` (source, source_size, distinct): adds i (order) and target.

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``share`` times all words. A target stops at ``most`` times its source's size;
    the excess is reshared by weight. That is water filling: with sources ordered
    by size over weight, the level that the rest would share rises as long as
    sources are full and falls afterwards, so the true level is its maximum.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("i", F.row_number().over(by_name) - 1)
    w = w.withColumn("w", pick([float(x) for x in weights], F.col("i"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "i")
    before, after, every = (fill.rowsBetween(*x) for x in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    w = w.withColumn("level", left / F.sum("w").over(after)).withColumn("level", F.max("level").over(every))
    return w.select("source", "source_size", "i", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def progress(share: Column, tilt: Column) -> Column:
    """Training progress at which a schedule 1 + tilt * (2x - 1) has met ``share`` of its demand."""
    a = 1 - tilt
    return F.when(tilt == 0, share).otherwise((F.sqrt(a * a + 4 * tilt * share) - a) / (2 * tilt))


def placed_rows(docs: DataFrame, text: str, key: str, source: str, weights: Sequence[float], share: float, most: int, tilts: Sequence[float], carry: bool) -> DataFrame:
    """Columns of ``mix`` and the hash h, not sorted; with ``carry`` a column ``row`` has the input's row."""
    if any(not -1 < t < 1 for t in tilts):
        raise ValueError("a tilt has to be between -1 and 1")
    more = [F.struct("*").alias("row")] if carry else []
    mixed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), named(F.col(source)).alias("s"), words_of(text).alias("size"), mixed.alias("h"), *more)
    sized = (rows if carry else staged(rows, "sizes")).withColumn("bin", F.substring("h", 1, BIN_DIGITS))
    bins = staged(sized.groupBy("source", "s", "bin").agg(F.sum("size").alias("words")), "bins")
    aims = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    before = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = bins.select("s", "bin", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    offsets = ahead.join(aims.withColumn("s", named(F.col("source"))).drop("source"), "s")
    # Both sides grow with the sources, so neither is broadcast; the window below needs this partitioning too.
    # A bin has 1/4096 of a source's documents, so a source is never in one task.
    placed = sized.drop("source").join(staged(offsets, "offsets").hint("merge"), ["s", "bin"])
    inner = Window.partitionBy("s", "bin").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    whole, tilt = F.floor("target").cast("long"), pick([float(t) for t in tilts], F.col("i"))

    def part(e: int) -> Column:  # what pass e over the source takes of the document
        return F.greatest(F.lit(0), F.least("size", whole - e * F.col("source_size") - F.col("start"))).cast("long")

    def at(e: int) -> Column:
        middle = F.col("start") + e * F.col("source_size") + part(e) / 2
        return F.when(part(e) > 0, progress(F.least(F.lit(1.0), middle / F.col("target")), tilt))

    passes = range(int(most))
    positions = F.array(*(at(e) for e in passes))
    taken = sum((part(e) for e in passes), F.lit(0)).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_min(positions).alias("first_position"), F.array_max(positions).alias("last_position"), "h", *(["row"] if carry else []))


@tidied
def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, tilts: Sequence[float] = TILTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_position, last_position.

    The document that a target ends in is taken in part, so that a source's taken
    words are the whole part of its target. Positions are of the middle of a
    document's first and last taking, null where it is not taken. Null text has
    size 0, null is a source of its own, rows that repeat an id are documents of
    their own. Sorted by first position; an empty table gives no rows.
    """
    out = placed_rows(docs, text, key, source, weights, share, most, tilts, False)
    # Documents that are not taken follow in the order of their hash, over many tasks.
    return out.orderBy(F.coalesce("first_position", F.lit(2.0)), F.when(F.col("first_position").isNull(), F.col("h"))).drop("h")


@tidied
def mixed_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, tilts: Sequence[float] = TILTS) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, in training order, all columns kept.

    Whole documents only: a taking in part counts if it is at least half of the
    document. Documents without words cost nothing and stay, once. Null text has no
    words, null is a source of its own, rows that repeat an id are documents of their
    own. An empty table gives no rows.
    """
    placed = placed_rows(docs, text, key, source, weights, share, most, tilts, True)
    times = F.floor((F.col("taken") + F.expr("size div 2")) / F.greatest("size", F.lit(1))).cast("int")
    times = F.when(F.col("size") == 0, 1).otherwise(times)
    again = placed.filter(times > 0).withColumn("e", F.explode(F.sequence(F.lit(1), times)))
    at = F.when(F.col("e") == 1, F.col("first_position")).otherwise(F.col("last_position"))
    return again.orderBy(at.asc_nulls_last()).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][i % 3 + 1] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
f AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, i, least(cap, max(level) OVER () * w) AS target FROM f),
p AS (SELECT doc_id, size, source_size, target, CAST([-0.5, 0.0, 0.5][i % 3 + 1] AS DOUBLE) AS tilt,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - start)) AS a,
             greatest(0, least(size, CAST(floor(target) AS BIGINT) - source_size - start)) AS b FROM p),
g AS (SELECT *, CASE WHEN a > 0 THEN least(CAST(1 AS DOUBLE), (start + a / 2) / target) END AS x,
             CASE WHEN b > 0 THEN least(CAST(1 AS DOUBLE), (start + source_size + b / 2) / target) END AS y FROM q),
o AS (SELECT *, CASE WHEN tilt = 0 THEN x ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * x) - (1 - tilt)) / (2 * tilt) END AS u,
             CASE WHEN tilt = 0 THEN y ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y) - (1 - tilt)) / (2 * tilt) END AS v FROM g)
SELECT doc_id, size, source_size, target, CAST(a + b AS BIGINT) AS taken, least(u, v) AS first_position, greatest(u, v) AS last_position FROM o""",
}
QUERIES = {"op3_mixing": op3_mixing}
