"""Exact dedup by a heavy-hitter split (native).

Misra-Gries (``freqItems``) finds digests that may be frequent; an exact count
verifies them. The winners, at most COUNTERS rows, are broadcast and settle
their copies on the map side. All other digests have at most 1/COUNTERS of the
rows each and go through one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import COUNTERS, hot_keys, staged, text_of, tidied


def digest(text: str | Column = "text") -> Column:
    return F.sha2(text_of(text), 256)


def winners(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests ``k`` with over 1/counters of the rows: k, _n (rows), _top (their largest ``o``)."""
    least = rows.count() / counters
    seen = rows.join(F.broadcast(hot_keys(rows, "k", counters)), "k", "left_semi")
    counted = seen.groupBy("k").agg(F.count("*").alias("_n"), F.max("o").alias("_top"))
    return staged(counted.filter(F.col("_n") > F.lit(least)), "winners")


@tidied
def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text equals the empty text. Of equal texts the row with the largest id
    stays; null ids are smaller than all others. Of rows that repeat both id and
    text one stays. Other columns are ignored; an empty table gives no rows.
    """
    rows = staged(
        docs.select(F.col(key).alias("doc_id"), digest(text).alias("k"), F.monotonically_increasing_id().alias("r")).select("doc_id", "k", F.struct("doc_id", "r").alias("o")),
        "digests",
    )
    won = winners(rows, counters)
    marked = rows.join(F.broadcast(won), "k", "left")
    out = lambda df, keep, n, kept: df.select("doc_id", keep.alias("keep_id"), n.cast("long").alias("group_size"), kept.alias("kept"), F.col("k").alias("text_sha256"))
    hot = out(marked.filter("_n is not null"), F.col("_top.doc_id"), F.col("_n"), F.col("o") == F.col("_top"))
    first = Window.partitionBy("k").orderBy(F.col("o").desc())
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cold = marked.filter("_n is null").select("doc_id", "k", "o").select("doc_id", "k", F.first("doc_id").over(whole).alias("a"), F.count("*").over(whole).alias("n"), (F.row_number().over(first) == 1).alias("kept"))
    return hot.unionByName(out(cold, F.col("a"), F.col("n"), F.col("kept")))


@tidied
def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; semantics as in ``exact_groups``.

    Digests are staged alone, so that the heavy-hitter steps read no text. Rows of
    frequent digests that cannot stay are dropped on the map side; the others are
    shuffled once.
    """
    won = winners(staged(docs.select(digest(text).alias("k"), F.col(key).alias("o")), "digests"), counters)
    rows = docs.select(digest(text).alias("k"), F.col(key).alias("o"), F.struct("*").alias("row"))
    marked = rows.join(F.broadcast(won), "k", "left")
    hot = marked.filter("_n is not null").filter(F.col("o").eqNullSafe(F.col("_top"))).groupBy("k").agg(F.first("row").alias("row"))
    first = Window.partitionBy("k").orderBy(F.col("o").desc_nulls_last())
    cold = marked.filter("_n is null").select("k", "o", "row").withColumn("i", F.row_number().over(first)).filter("i = 1")
    return hot.select("row.*").unionByName(cold.select("row.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
