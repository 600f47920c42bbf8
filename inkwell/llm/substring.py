"""Substring dedup by level-wise doubling.

Words that lie in a window whose words also start elsewhere are removed. A window
can repeat only if the shorter ones in it do, so windows are looked for at a short
length first; those repeated at one length alone are extended to twice that
length, until the window's own length is reached or no candidates survive.

Below the window's length one part of it stands for all: the one of the smallest
hash, which is the same in every copy of the window. So a level sends a fraction
of all places, and no repeat is lost. Equal hashes of a shorter length only name
candidates; at the window's own length 96 bits from two independent hashes decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import COUNTERS, drop, hot_keys, small_batches, staged, text_of, tidied

WINDOW, FIRST = 35, 18
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def levels(window: int = WINDOW, first: int = FIRST) -> list[int]:
    """first, twice that, and so on; the last one is the window."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * MIX[1]
        h = (h ^ (h >> np.uint64(27))) * MIX[2]
        return h ^ (h >> np.uint64(31))


def window_hashes(words: list[bytes], lengths: list[int], word_hash: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> dict[int, np.ndarray]:
    """Per length, the hash of the window that starts at each word; a longer one is made of two shorter ones."""
    h = np.fromiter(map(word_hash, words), np.uint64, len(words))
    steps, out = [1], {1: h}
    for n in lengths:
        while steps[-1] < n:
            have = steps[-1]
            to = min(2 * have, n)
            a, b = out[have][: max(0, len(words) - to + 1)], out[have][to - have :]
            with np.errstate(over="ignore"):
                out[to] = mixed(mixed(a) * MIX[0] + b[: len(a)])
            steps.append(to)
    return out


def anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` hashes the place of its smallest one, the first if several are."""
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    return view.argmin(axis=1) + np.arange(len(view))


def candidates(words: list[bytes], window: int, lengths: list[int], survived: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and checks (0 below the window's length) that the next level sends, given the places that ``survived`` each level before."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    hashes = window_hashes(words, lengths)
    alive = np.ones(len(words) - window + 1, bool)
    for n, places in zip(lengths, survived, strict=False):
        alive &= np.isin(anchors(hashes[n], window - n + 1), places)
    n = lengths[len(survived)]
    if n < window:
        at = np.unique(anchors(hashes[n], window - n + 1)[alive])
        return at, hashes[n][at], np.zeros(len(at), np.int32)
    at = np.flatnonzero(alive)
    check = window_hashes(words, [window], zlib.crc32)[window][at] if len(at) else np.zeros(0, np.uint64)
    return at, hashes[n][at], check.astype(np.uint32).view(np.int32)


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words in windows that start at ``starts``."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def squeezed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """r (a number for each row), doc_id, body (compressed text); staged, so that r stays."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for part in parts:
            body = pa.array([press(x.encode()) for x in part.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), body], names=["r", "doc_id", "body"])

    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("doc_id"), text_of(text).alias("body"))
    return staged(rows.mapInArrow(batches, f"r long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, body binary"), "texts")


def repeated(places: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Rows (r, at) of ``places`` (h, c, r, at) whose h and c occur together twice or more.

    Hashes with over 1/counters of all rows are found by Misra-Gries, counted and
    broadcast, at most ``counters`` of them, and their rows are spread; the others
    meet in one shuffle.
    """
    least = places.count() / counters
    maybe = [r.h for r in hot_keys(places, "h", counters).collect()]  # at most ``counters`` numbers
    hot = places.filter(F.col("h").isin(maybe)).groupBy("h", "c").agg(F.count("*").alias("hot"))
    hot = staged(hot.filter((F.col("hot") > 1) & (F.col("hot") > F.lit(least))), "hot")
    marked = places.join(F.broadcast(hot), ["h", "c"], "left")
    # The count of a hot hash is known, so its rows may be dealt out by their text.
    apart = Window.partitionBy("h", "c", F.when(F.col("hot").isNotNull(), F.col("r")))
    counted = marked.select("r", "at", F.coalesce("hot", F.count("*").over(apart)).alias("n"))
    return counted.filter("n > 1").select("r", "at")


def survivors(texts: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """(r, places): the starts of windows of each text that repeat; texts without any are missing."""
    lengths = levels(window, first)
    known: list[str] = []  # columns of places that survived so far

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor().decompress
        for part in parts:
            cols = [part.column(i).to_pylist() for i in range(2 + len(known))]
            for row in zip(*cols, strict=True):
                at, h, c = candidates(press(row[1]).split(), window, lengths, [np.array(x, np.int64) for x in row[2:]])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(np.full(len(at), row[0])), pa.array(at.astype(np.int32))], names=["h", "c", "r", "at"])

    rows = texts.select("r", "body")
    found = None
    for i in range(len(lengths)):
        places = staged(rows.mapInArrow(batches, "h long, c int, r long, at int"), f"places{i}")
        kept = staged(repeated(places).groupBy("r").agg(F.collect_list("at").alias(f"p{i}")), f"kept{i}")
        drop(places)
        if i + 1 == len(lengths) or kept.isEmpty():
            return kept.select("r", F.col(f"p{i}").alias("places"))
        found = kept if found is None else found.join(kept, "r")
        known = [f"p{j}" for j in range(i + 1)]
        rows = texts.join(found, "r").select("r", "body", *known)
    raise AssertionError


@tidied
def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by a space).

    Null text has no words; rows that repeat an id are documents of their own, so
    repeated rows of ``window`` words or more lose all. An empty table gives no rows.
    """
    texts = squeezed(docs, text, key)
    rows = texts.join(survivors(texts, window, first), "r", "left").select("doc_id", "body", "places")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor().decompress
        for part in parts:
            n, gone, left = [], [], []
            for body, places in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = press(body).split()
                keep = ~covered(len(words), np.array(places, np.int64), window) if places else np.ones(len(words), bool)
                n.append(len(words))
                gone.append(int(len(words) - keep.sum()))
                left.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k) if gone[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in left], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(batches, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT r, i, hash(list_slice(w, i, i + 34)) AS a, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM v) WHERE n > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM s),
k AS (SELECT r, j, x FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d) ANTI JOIN c USING (r, j)),
t AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM k GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (r)""",
}
QUERIES = {"op2_substring_dedup": op2_substring_dedup}
