"""Review samples and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_order(key: Column, seed: int) -> Column:
    """A reproducible random order, the same in any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def stratified(rows: DataFrame, stratum: str, key: str, sizes: int | Mapping[str, int], seed: int) -> DataFrame:
    """At most n rows per stratum, with their place in it (pick); ``sizes`` is one n, or one per stratum."""
    i = F.row_number().over(Window.partitionBy(stratum).orderBy(sample_order(F.col(key), seed), key))
    most = F.lit(sizes) if isinstance(sizes, int) else reduce(lambda c, kv: c.when(F.col(stratum) == kv[0], kv[1]), sizes.items(), F.when(F.lit(False), 0)).otherwise(0)
    return rows.withColumn("pick", i).filter(F.col("pick") <= most)


def round_robin(sample: DataFrame, stratum: str) -> DataFrame:
    """Numbers a stratified sample so that strata take turns: review_order 1.. (the sample is small)."""
    return sample.withColumn("review_order", F.row_number().over(Window.orderBy("pick", stratum)))


def precision(rows: DataFrame, group: str, correct: Column) -> DataFrame:
    """Per group and over all (null group): n, correct, precision."""
    return rows.rollup(group).agg(F.count("*").alias("n"), F.count_if(correct).alias("correct")).withColumn("precision", F.col("correct") / F.col("n"))


def confusion(gold: DataFrame, predicted: DataFrame, page: str, ranks: Sequence[str], none: str = "none") -> DataFrame:
    """predicted label x gold label counts: a prediction takes the best-ranked gold label that its span overlaps.

    Both have page, start, end, label.
    """
    p = predicted.select(page, "start", "end", F.col("label").alias("predicted"), F.monotonically_increasing_id().alias("_id"))
    g = gold.select(F.col(page).alias("_p"), F.col("start").alias("_a"), F.col("end").alias("_b"), "label")
    rank = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in ranks)), F.col("label")), F.lit(0))
    hits = p.join(g, (F.col(page) == F.col("_p")) & (F.col("_a") < F.col("end")) & (F.col("start") < F.col("_b")), "left")
    best = hits.groupBy("_id", "predicted").agg(F.min_by("label", F.when(rank == 0, len(ranks) + 1).otherwise(rank)).alias("gold"))
    return best.groupBy("predicted", F.coalesce("gold", F.lit(none)).alias("gold")).agg(F.count("*").alias("n"))


def scores(matrix: DataFrame, gold: DataFrame, found: DataFrame) -> DataFrame:
    """label, precision (from a confusion matrix) and recall (gold rows that ``found`` holds by id)."""
    p = matrix.groupBy(F.col("predicted").alias("label")).agg((F.sum(F.when(F.col("predicted") == F.col("gold"), F.col("n")).otherwise(0)) / F.sum("n")).alias("precision"))
    r = gold.join(found.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left").groupBy("label").agg((F.count("hit") / F.count("*")).alias("recall"))
    return p.join(r, "label", "full")


def binary_scores(rows: DataFrame, gold: Column, predicted: Column, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall; a ratio without cases is null."""
    t = rows.groupBy(*keys).agg(F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"), F.count_if(~gold & ~predicted).alias("tn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return t.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))


def flag_counts(roles: DataFrame, spans: DataFrame) -> DataFrame:
    """kind, n: pages of each role, and editorial spans of each kind on record pages."""
    record = roles.filter("role = 'record'").select("page_id")
    pages = roles.groupBy(F.concat(F.lit("page: "), F.col("role")).alias("kind")).agg(F.count("*").alias("n"))
    return pages.unionByName(spans.join(record, "page_id", "left_semi").groupBy(F.concat(F.lit("span: "), F.col("kind")).alias("kind")).agg(F.count("*").alias("n")))
