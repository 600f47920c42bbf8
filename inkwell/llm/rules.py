"""Quality rules: counts within a document and line frequency across documents (native).

Lines are normalised and hashed. For each host the distinct documents that hold
a line are counted; lines above the limits are boilerplate. A document that has
too little left without them is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, join_hot, staged, text_of, tidied

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
#: A line is boilerplate on a host if more documents of it than LINE_DOCS and more
#: than LINE_SHARE of them hold it. Copies of one text count as one document.
LINE_DOCS, LINE_SHARE = 20, 0.02
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.3


def named(host: Column) -> Column:
    """A host as a string that is never null, distinct for distinct hosts."""
    return F.coalesce(F.concat(F.lit("+"), host.cast("string")), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with ``value`` made once: inside a lambda an expression is made anew for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Number of items of the array ``w`` that lie in windows found twice or more in it."""
    last = F.size(w) - window
    hashes = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(w, i, window)))

    def covered(s: Column) -> Column:
        # Windows sorted by hash: equal ones are neighbours.
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        held = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        return F.aggregate(
            F.array_sort(F.transform(held, lambda k: F.get(s, k)["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("p")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["p"])).alias("n"), i.alias("p")),
            lambda a: a["n"],
        )

    def counted(h: Column) -> Column:
        places = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(places, covered))

    return F.when(last < 1, F.lit(0)).otherwise(bound(hashes, counted)).cast("long")


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", extra: list[Column] | None = None) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, sha, lines (hash of host and line, words)."""
    t = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), text_of(text).alias("t"), *(extra or []))
    t = t.withColumn("w", words(F.col("t"))).withColumn("l", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)))
    lines = F.transform("l", lambda x: F.struct(F.xxhash64(normal_line(x), named(F.col("host"))).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return t.select(
        "doc_id",
        "host",
        *[c for c in t.columns if c not in ("doc_id", "host", "t", "w", "l")],
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.sha2("t", 256).alias("sha"),
        lines.alias("lines"),
    )


@tidied
def judged(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, n_left (words without boilerplate lines), kept.

    Null text has no words; null is a host of its own; rows that repeat an id are
    judged each on its own text; equal rows give equal rows. An empty table gives no rows.
    """
    rows = staged(measures(docs, text, key, host, [F.monotonically_increasing_id().alias("r")]), "measures")
    flat = staged(rows.select("r", "sha", named(F.col("host")).alias("site"), F.explode("lines").alias("x")).select("r", "sha", "site", "x.h", "x.n"), "flat")
    # Distinct documents of a line, then of a host; the first step combines hot lines on the map side.
    held = flat.select("site", "h", "sha").distinct().groupBy("h").agg(F.first("site").alias("site"), F.count("*").alias("docs"))
    held = staged(held.filter(F.col("docs") > line_docs), "held")
    hosts = rows.select(named(F.col("host")).alias("site"), "sha").distinct().groupBy("site").agg(F.count("*").alias("of"))
    common = join_hot(held, hosts, "site").filter(F.col("docs") > F.lit(line_share) * F.col("of"))
    common = staged(common.select("h", F.lit(True).alias("common")), "lines")
    # A boilerplate line is in many documents: its rows are met on the map side, and summed there.
    gone = join_hot(flat.select("r", "h", "n"), common, "h").filter("common").groupBy("r").agg(F.sum("n").alias("gone"))
    out = rows.join(gone, "r", "left").withColumn("n_left", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    depleted = (F.col("n_left") < LEAST_WORDS) | (F.col("n_left") < F.lit(least_left) * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_left", (~failed & ~depleted).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda e: regexp_matches(e, '[^\x20\x09-\x0D]')) AS l FROM d),
v AS (SELECT r, i, list_slice(w, i, i + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM x)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM v) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM dup) GROUP BY r),
ln AS (SELECT r, source, t, e, len(regexp_extract_all(e, '[^\x20\x09-\x0D]+')) AS n,
              trim(regexp_replace(regexp_replace(lower(e), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
       FROM (SELECT r, source, t, unnest(l) AS e FROM x)),
held AS (SELECT source, h, count(DISTINCT t) AS docs FROM ln GROUP BY source, h),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
common AS (SELECT a.source, h FROM held a JOIN hosts b ON a.source IS NOT DISTINCT FROM b.source WHERE docs > 20 AND docs > 0.02 * n),
gone AS (SELECT r, sum(n) AS n FROM ln JOIN common c ON ln.h = c.h AND ln.source IS NOT DISTINCT FROM c.source GROUP BY r),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(w) - coalesce(gone.n, 0) AS BIGINT) AS n_left
      FROM x LEFT JOIN cov USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND NOT (n_left < 20 OR n_left < 0.3 * n_words) AS kept FROM f""",
}
QUERIES = {"op10_quality_rules": op10_quality_rules}
