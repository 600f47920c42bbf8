"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at distance 2r or less have a common value within r of both.
Each distinct fingerprint emits all values within r; those that meet at a value
are linked to the smallest one there. All that meet are within 2r of each other,
so a star keeps the components of the full graph without its pairs.

A radius that the balls allow finds texts of a Jaccard similarity near 1 only, and links
some that share a template. Where a similarity is asked for, these links are checked
on the texts, and min-wise sketches of the same shingles give more to be checked.
Texts that agree in a band meet: all are compared with the one among them that meets
most others. Pairs that this does not put into one component are compared if their
shared shingles may be enough. Such a pair has a rare shingle in common, and is found
by it, or only shingles that are frequent among the texts left over, whose number in
each text bounds what it can share. No pair that meets in a band is left out by that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, drop, join_hot, small_batches, staged, text_of, tidied
from .exact import digest

SHINGLE, RADIUS, SEED, CHUNK = 3, 2, 42, 1 << 16
#: Values of a sketch, 16 bits each, and how many of them a band has. Texts of
#: similarity 0.8 meet in a band with probability 0.998.
BINS, BAND = 128, 6
#: Texts whose sketches' estimate is further below the similarity asked for are not read: six standard errors at 0.8.
ERROR = 0.21
#: A shingle that so many of the texts left over hold, or fewer, is rare: pairs that share one are enumerated.
RARE = 16


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, the whole sequence if there are fewer; empty for a text without words."""
    words = text.encode().lower().split()  # both touch ASCII only
    if not words:
        return np.zeros(0, "<u8")
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8", count=max(1, len(words) - shingle + 1))


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash, as a signed integer; 0 for no hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    return simhash(shingle_hashes(text, shingle))


def sketch(hashes: np.ndarray, bins: int = BINS) -> bytes:
    """For each of ``bins`` orders of all hashes the least one, 16 bits of it; empty for no hashes."""
    if not len(hashes):
        return b""
    orders = np.random.default_rng(SEED).integers(0, 1 << 63, bins, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        least = np.minimum.reduce([(hashes[i : i + 4096, None] * orders).min(axis=0) for i in range(0, len(hashes), 4096)])
        return (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal values of two sketches: an estimate of the Jaccard similarity."""
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    return float((x == y).mean()) if len(x) and len(x) == len(y) else 0.0


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets, as sorted distinct hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, sketches: bool = False) -> DataFrame:
    """doc_id, sha (of the text), fp (signed long), sketch and n (distinct shingles; both empty if not asked for) of each document; null text has fp 0."""
    small_batches(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes = [shingle_hashes(x, shingle) for x in part.column(2).to_pylist()]
            fps = pa.array([simhash(h) for h in hashes], pa.int64())
            sets = [np.unique(h) if sketches else h[:0] for h in hashes]
            marks, sizes = pa.array(map(sketch, sets), pa.binary()), pa.array(map(len, sets), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), fps, marks, sizes], names=["doc_id", "sha", "fp", "sketch", "n"])

    rows = docs.select(F.col(key).alias("doc_id"), digest(text).alias("sha"), text_of(text).alias("body"))
    return rows.mapInArrow(batches, f"doc_id {dict(rows.dtypes)['doc_id']}, sha string, fp long, sketch binary, n int")


def ball(radius: int) -> list[int]:
    """Masks, as signed integers, of up to ``radius`` of 64 bits."""
    masks = [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints ``fp`` that keep their components at ``radius``."""
    if radius % 2:
        raise ValueError("the radius has to be even, so that all that meet in a ball are within it")
    masks = F.array(*(F.lit(m).cast("long") for m in ball(radius // 2)))
    near = fps.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("value"))
    met = near.withColumn("least", F.min("fp").over(Window.partitionBy("value"))).filter("fp <> least")
    return met.select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def banded(own: DataFrame) -> DataFrame:
    """t and band of each band of the sketches of ``own`` (t, sketch); texts without words have none."""
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", 1 + 2 * i, 2 * BAND)) for i in range(0, BINS - BAND + 1, BAND)))
    return own.filter(F.length("sketch") > 0).select("t", F.explode(bands).alias("band"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def shared_bands(flat: DataFrame) -> DataFrame:
    """t, band and w of the bands that hold two texts or more; w is the sum of the sizes of the text's bands."""
    sizes = staged(flat.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
    met = staged(join_hot(flat, sizes, "band").filter("m is not null"), "met")
    out = staged(met.join(met.groupBy("t").agg(F.sum("m").alias("w")), "t").select("t", "band", "w"), "shared")
    for gone in (sizes, met):
        drop(gone)
    return out


def central_pairs(shared: DataFrame) -> DataFrame:
    """Pairs of texts (a, b): each with the one in its band that meets most others.

    It is found by a grouped maximum, so that a group of copies of any size is neither
    gathered nor squared; it becomes one component, whose pairs are not asked for again.
    """
    centre = shared.groupBy("band").agg(F.max(F.struct("w", "t")).alias("x")).select("band", F.col("x.t").alias("b"))
    return ordered(join_hot(shared.select("band", F.col("t").alias("a")), centre, "band").filter("a <> b"))


def may_fit(a: Column, b: Column, na: Column, nb: Column, similarity: float) -> Column:
    """Whether sets of ``na`` and ``nb`` shingles that share at most ``a`` and ``b`` may be so similar."""
    return (1 + similarity) * F.least(a, b) >= similarity * (na + nb) - 1e-6


def in_several(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """t, its component c and band, of bands that hold several components, and the largest of these, top."""
    held = staged(shared.select("t", "band").join(roots, "t", "left").select("t", F.coalesce("root", "t").alias("c"), "band"), "held")
    parts = held.groupBy("band", "c").agg(F.count("*").alias("n"))
    several = parts.groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("band", "top")
    out = staged(join_hot(held, several, "band").filter("top is not null"), "several")
    drop(held)
    return out


def shingle_rows(texts: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """t and h, distinct, of the shingles of ``texts`` (t), from ``docs`` (t, body)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [np.unique(shingle_hashes(x, shingle)).view(np.int64) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["t", "h"])

    bodies = docs.join(texts.select("t"), "t", "left_semi").dropDuplicates(["t"]).select("t", "body")
    return bodies.mapInArrow(batches, "t long, h array<long>").select("t", F.explode("h").alias("h"))


def other_pairs(several: DataFrame, sizes: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Pairs (a, b) of texts in different components of a band that may be so similar: no such pair is missing.

    ``several`` are the rows of ``in_several``, ``sizes`` has t and n. A shingle that one text
    alone holds is shared with none. Pairs that share a rare shingle are found by it, at most RARE
    texts at a time; other pairs share frequent shingles only, and are looked for in their bands.
    """
    texts = staged(several.select("t", "c").distinct().join(sizes, "t"), "texts")
    rows = staged(shingle_rows(texts, docs, shingle), "shingles")
    often = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    known = staged(join_hot(rows, often, "h").filter("df is not null"), "known")
    bounds = known.groupBy("t").agg(F.count("*").alias("u"), F.count_if(F.col("df") > RARE).alias("k"))
    own = staged(texts.join(bounds, "t").filter(may_fit(F.col("u"), F.col("u"), F.col("n"), F.lit(0), similarity)), "bounds")

    def pairs(left: DataFrame, right: DataFrame, on: str, bound: str, more: str) -> DataFrame:
        side = lambda df, x: df.select(on, *(F.col(c).alias(f"{c}{x}") for c in df.columns if c != on))
        fits = may_fit(F.col(f"{bound}a"), F.col(f"{bound}b"), F.col("na"), F.col("nb"), similarity)
        return side(left, "a").join(side(right, "b"), on).filter(F.expr(f"ca <> cb and ({more})") & fits).select(F.col("ta").alias("a"), F.col("tb").alias("b"))

    rare = staged(known.filter(F.col("df") <= RARE).select("t", "h").join(own.drop("k"), "t"), "rare")
    by_rare = pairs(rare, rare, "h", "u", "ta > tb")
    # One text of a pair is outside the band's largest component, so only those outside are joined with the band.
    dense = own.drop("u").filter(may_fit(F.col("k"), F.col("k"), F.col("n"), F.lit(0), similarity))
    banded_ = staged(several.drop("c").join(dense, "t"), "dense")
    by_band = pairs(banded_.filter("c <> top").drop("top"), banded_, "band", "k", "cb = topb or ta > tb")
    out = staged(ordered(by_rare.unionByName(by_band)), "pairs")
    for gone in (texts, rows, known, own, rare, banded_):
        drop(gone)
    return out


def alike(pairs: DataFrame, own: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of texts whose shingle sets have that Jaccard similarity.

    Sketches only spare the reading of texts that are far from it. ``docs`` has t and body.
    Rows of one frequent partner are left to the skew handling of adaptive execution, as a
    text has no bound that would allow a broadcast.
    """
    side = lambda c: own.select(F.col("t").alias(c), F.col("sketch").alias(f"s{c}"))
    schema = "a long, b long"

    def pairs_by(likeness: Callable[[object, object], float], least: float, value: Callable = lambda x: x) -> Callable:
        def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = lru_cache(maxsize=64)(value)
            for part in parts:
                a, b, x, y = (part.column(i) for i in range(4))
                good = pa.array([likeness(of(p), of(q)) >= least for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], names=["a", "b"])

        return compare

    def pressed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([press(x.encode()) for x in part.column(1).to_pylist()], pa.binary())], names=["t", "body"])

    shingles = lambda raw: np.unique(shingle_hashes(zstandard.ZstdDecompressor().decompress(raw).decode(), shingle))
    both = join_hot(join_hot(pairs, side("a"), "a"), side("b"), "b").select("a", "b", "sa", "sb")
    close = staged(both.mapInArrow(pairs_by(lambda p, q: 1.0 if p == q else likeness(p, q), similarity - ERROR), schema), "close")
    asked = close.select(F.col("a").alias("t")).unionByName(close.select(F.col("b").alias("t"))).distinct()
    bodies = docs.join(asked, "t", "left_semi").dropDuplicates(["t"]).select("t", "body")
    bodies = staged(bodies.mapInArrow(pressed, "t long, body binary"), "bodies")
    of = lambda c: bodies.select(F.col("t").alias(c), F.col("body").alias(f"t{c}"))
    both = close.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb")
    good = staged(both.mapInArrow(pairs_by(jaccard, similarity, shingles), schema), "alike")
    for gone in (close, bodies):
        drop(gone)
    return good


def likely(rows: DataFrame, near: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) between texts that are alike, of those that meet in a band or by their fingerprints.

    ``rows`` are those of ``fingerprints`` with node, the text's key, ``near`` the links of fingerprints, ``docs``
    (t, body) the texts. Pairs that are in one component already are not compared.
    """
    own = staged(rows.groupBy(F.col("node").alias("t")).agg(*(F.first(c).alias(c) for c in ("fp", "sketch", "n"))), "texts")
    stands = staged(own.groupBy("fp").agg(F.min("t").alias("m")), "stands")
    same = join_hot(own.select("t", "fp"), stands, "fp").filter("t <> m").select(F.col("t").alias("a"), F.col("m").alias("b"))
    side = lambda c: stands.select(F.col("fp").alias(f"f{c}"), F.col("m").alias(c))
    across = near.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(side("a"), "fa").join(side("b"), "fb").select("a", "b")
    flat = staged(banded(own), "bands")
    shared = shared_bands(flat)
    drop(flat)
    met = staged(ordered(central_pairs(shared).unionByName(same).unionByName(across)), "met")
    first = alike(met, own, docs, similarity, shingle)
    roots = components(first).select(F.col("node").alias("t"), "root")
    several = in_several(shared, roots)
    left = other_pairs(several, own.select("t", "n"), docs, similarity, shingle)
    out = first.unionByName(alike(left, own, docs, similarity, shingle))
    for gone in (own, stands, shared, met, several, left):
        drop(gone)
    return out


@tidied
def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest id reachable), sha, root.

    Null text is empty; all texts without words have fingerprint 0 and are linked like any other.
    Null ids are no component's smallest unless it has no other. An empty table gives no rows.
    With ``similarity`` texts are linked if their shingle sets are so alike (Jaccard), whatever their fingerprints.
    """
    rows = fingerprints(docs, text, key, shingle, similarity is not None)
    rows = staged(rows.withColumn("node", F.col("fp") if similarity is None else F.xxhash64("sha")), "fingerprints")
    own = staged(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "distinct")
    near = links(rows.select("fp").distinct(), radius)
    if similarity is not None:
        bodies = docs.select(F.xxhash64(digest(text)).alias("t"), text_of(text).alias("body"))
        near = likely(rows, near, bodies, similarity, shingle)
    whole = own.join(components(near), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    whole = staged(whole, "roots")
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(join_hot(whole.select("node", "root"), least, "root").select("node", "component_id", "root"), "named")
    drop(whole)
    drop(own)
    return join_hot(rows.drop("sketch", "n"), named, "node").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "sha", "root")


@tidied
def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, of which one per group stays: that of its smallest id (and text digest).

    Null and empty texts are one text without words. A null id is an id of its own,
    which stays only in a group without any other. Of rows that repeat both id and
    text one stays. An empty table gives no rows.
    """
    groups = near_groups(docs, text, key, radius, shingle, similarity)
    own = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = own.groupBy("root").agg(F.min(F.struct("doc_id", "sha")).alias("x")).select("x.*")
    named = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("")).alias("i")
    rows = docs.select(named(key), digest(text).alias("s"), F.struct("*").alias("row"))
    stay = stay.select(named("doc_id"), F.col("sha").alias("s"))
    one = rows.join(stay, ["i", "s"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("i", "s").orderBy(F.lit(1))))
    return one.filter("n = 1").select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")


SQL: dict[str, str] = {}  # XXH64 and components have no DuckDB form; tests hold them against brute force
QUERIES = {"op5_simhash": op5_simhash}
