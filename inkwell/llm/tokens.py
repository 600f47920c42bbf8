"""Token counts by an exact length histogram.

Documents are aggregated by encoded length. Sums from either end of the
histogram answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, text_of

VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A byte-level BPE encoder of the file ``vocabulary`` (a path, or a name known to public_tokenizers)."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep`` of each document and n_tokens; null text has none. Kept columns may have any name but n_tokens."""
    small_batches(docs.sparkSession)
    keep = list(keep)
    body = next(n for i in range(len(keep) + 1) if (n := f"_body{i}") not in keep)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for part in parts:
            counts = pa.array([len(encode(x)) for x in part.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[1:], counts], names=[*keep, "n_tokens"])

    rows = docs.select(text_of(text).alias(body), *keep)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(batches, ", ".join([*kinds, "n_tokens long"]))


def length_histogram(lengths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct length, and group ``by``: documents of it, and sums up to and beyond it.

    n_tokens, docs, docs_up_to, share_up_to, docs_beyond, tokens_up_to and
    truncated_total (tokens left if every document is cut to n_tokens). There
    are as many rows as distinct lengths; an empty table gives none.
    """
    by = list(by)
    counts = lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("docs"))
    up, every = Window.partitionBy(*by).orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    h = counts.withColumn("docs_up_to", F.sum("docs").over(up)).withColumn("docs_beyond", F.sum("docs").over(every) - F.col("docs_up_to"))
    h = h.withColumn("tokens_up_to", F.sum(F.col("docs") * F.col("n_tokens")).over(up))
    share = F.col("docs_up_to") / (F.col("docs_up_to") + F.col("docs_beyond"))
    cut = F.col("tokens_up_to") + F.col("n_tokens") * F.col("docs_beyond")
    return h.select(*by, "n_tokens", "docs", "docs_up_to", share.alias("share_up_to"), "docs_beyond", "tokens_up_to", cut.alias("truncated_total"))


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: context, docs_cut, tokens_kept. Any limit is answered, also between two lengths; all are 0 for an empty histogram."""

    def answer(c: int) -> Column:
        cut = F.sum(F.when(F.col("n_tokens") > c, F.col("docs")).otherwise(0))
        return F.struct(F.lit(c).cast("long").alias("context"), F.coalesce(cut, F.lit(0)).alias("docs_cut"), F.coalesce(F.sum(F.least("n_tokens", F.lit(c)) * F.col("docs")), F.lit(0)).alias("tokens_kept"))

    return histogram.agg(F.array(*(answer(int(x)) for x in limits)).alias("a")).select(F.inline("a"))


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of all documents do not exceed; one row, null for an empty histogram."""
    return histogram.filter(F.col("share_up_to") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL: dict[str, str] = {}  # BPE has no SQL form; tests hold it against a second library
QUERIES = {"op4_token_counts": op4_token_counts}
