"""Shared pieces of the training-data operators: staging, hot keys, graph components.

Every operator keeps its working tables in the folder that the cluster names in
``spark.checkpoint.dir``, so that a lost executor costs a task and not the result.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Misra-Gries counters kept for each column whose hot keys are looked for. A key
#: with more than 1/COUNTERS of all rows is always found; at most COUNTERS are.
COUNTERS = 4096
#: A table of narrow rows with so many, or fewer, is small: it may be broadcast whole.
SMALL = 50_000
#: Share of the driver's heap from which garbage is collected before a table is staged.
GROWN = 0.55
#: Documents in one Arrow batch; a batch of very long texts stays within a worker's memory.
BATCH_ROWS = 256

#: Bytes of text that an Arrow batch is cut at, where the Spark version knows this bound.
BATCH_BYTES = 8 << 20

_staged: dict[str, SparkSession] = {}
_own_folders: list[str] = []
_calls = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables. Outside local mode the cluster has to name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    _own_folders.append(tempfile.mkdtemp(prefix="inkwell-"))
    folder = "file://" + _own_folders[-1]
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of this session in rows and bytes, as results of the operators are read later. A smaller bound that is set stays."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(f"spark.sql.execution.arrow.{name}", None) or "").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def settled(spark: SparkSession) -> bool:
    """Collects the driver's garbage if its heap has grown past ``GROWN`` of what it may have, so that it shrinks; whether it did.

    The JVM would rather grow than collect, and keeps what it took. What finished steps have broadcast or shuffled goes too.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    grown = heap.totalMemory() > GROWN * heap.maxMemory()
    if grown:
        jvm.System.gc()
    return grown


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    settled(spark)
    path = f"{shared_folder(spark)}/inkwell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    _staged[path] = spark
    if getattr(_calls, "open", None):
        _calls.open[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkwell_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    remove(getattr(df, "_inkwell_path", None))


def remove(path: str | None) -> None:
    spark = _staged.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def release() -> None:
    """Delete all staged tables. Call it when no result of an operator is read any more."""
    for path in list(_staged):
        remove(path)
    while _own_folders:
        shutil.rmtree(_own_folders.pop(), ignore_errors=True)


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that deletes the tables it staged but for those its result reads, which stay until ``release``."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        if not hasattr(_calls, "open"):
            _calls.open = []
        _calls.open.append([])
        try:
            out = operator(*args, **kwargs)
        finally:
            made = _calls.open.pop()
        read = {part for file in out.inputFiles() for part in file.split("/")[-2:-1]}
        kept = [path for path in made if path.rsplit("/", 1)[1] in read]
        for path in set(made).difference(kept):
            remove(path)
        if len(kept) < len(made):
            # Shuffle files go when the driver's JVM has collected the plans that made them.
            out.sparkSession.sparkContext._jvm.System.gc()
        if _calls.open:
            _calls.open[-1].extend(kept)
        return out

    return run


def text_of(column: str | Column = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def hot_keys(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """Distinct values of ``key`` that may hold over 1/counters of the rows (Misra-Gries, no misses).

    The result has at most ``counters`` rows whatever the size of ``df``. One task
    merges the counters of at most 512 others.
    """
    found = df.select(F.col(key).alias("k")).coalesce(512).freqItems(["k"], 1 / counters)
    return found.select(F.explode("k_freqItems").alias(key)).filter(F.col(key).isNotNull())


def join_hot(left: DataFrame, right: DataFrame, key: str, counters: int = COUNTERS, hot: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """Left join on ``key``; ``right`` has each key once. Rows of hot keys of ``left`` are not shuffled.

    What is broadcast is ``right``, if it is counted to have ``small`` rows at most, or else
    its rows for at most ``counters`` keys; it has narrow rows. ``hot`` are the hot keys
    where they are known already.
    """
    if not hasattr(right, "_inkwell_path"):
        right = staged(right, "side")
    if right.count() <= small:
        return left.join(F.broadcast(right), key, "left")
    keys = hot_keys(left, key, counters) if hot is None else hot
    found = staged(right.join(F.broadcast(keys), key, "left_semi").withColumn("_hot", F.lit(True)), "hot")
    marked = left.join(F.broadcast(found), key, "left")
    cold = marked.filter("_hot is null").select(*left.columns).join(right, key, "left")
    return marked.filter("_hot").select(*cold.columns).unionByName(cold)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """Connected components as (node, root), root being the smallest node; nodes are those in ``edges``.

    Edges that are counted to be ``small`` are joined in one pass of the driver: they are fewer bytes than
    the tables that each round would broadcast. More of them go through ``star_rounds``.
    """
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    mark = _mark(now)
    if mark[0] > small:
        return star_rounds(now, mark, most_rounds, small)
    table = now.toArrow()
    roots = joined(table["u"].to_pylist(), table["v"].to_pylist())
    kind = table.schema.field("u").type
    found = pa.table({"node": pa.array(list(roots), kind), "root": pa.array(list(roots.values()), kind)})
    out = staged(now.sparkSession.createDataFrame(found), "roots")
    drop(now)
    return out


def joined(us: list, vs: list) -> dict:
    """The smallest node that each node of the edges is connected with (union by the smaller root, paths halved)."""
    up: dict = {}

    def top(x: object) -> object:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in zip(us, vs, strict=True):
        x, y = top(u), top(v)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


def star_rounds(now: DataFrame, mark: tuple[int, int], most_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """Components of staged, distinct edges (u, v), u > v, of which ``mark`` is known.

    Alternates the large-star and small-star steps of Kiveris et al. 2014; each
    step is a grouped minimum (combined on the map side) and a join, staged so
    that no plan grows with the number of rounds. Hubs, such as the root of a giant
    component, are joined on the map side, as all nodes are once edges are counted to be
    ``small``. Raises if not converged.
    """
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        few = mark[0] <= small
        # No node has more rows in the second step than in the first, whose rows are at most twice as many.
        hubs = None if few else staged(hot_keys(both, "u", 2 * COUNTERS), "hubs")
        met = lambda left, least: left.join(F.broadcast(least), "u") if few else join_hot(left, least, "u", hot=hubs)  # noqa: B023, E731
        large = met(both, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large if few else staged(large, "large")
        pairs = met(large, large.groupBy("u").agg(F.min("v").alias("m")))
        small_star = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(pairs.select("u", F.col("m").alias("v"))).distinct()
        after = staged(small_star, "edges")
        before, mark = mark, _mark(after)
        for gone in (now, large, hubs):
            drop(gone)
        now = after
        if mark == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError(f"components have not converged after {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum of a table of edges."""
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("s")).first()
    return r.n, r.s or 0
