"""Small tables that every operator has to take: nulls, empty and long texts, ties, repeats, clashing names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHES = ["kept", "keep_id", "k", "o", "r", "h", "row", "body", "fp", "sha", "site", "logit", "e", "i", "s", "size", "bin", "_n", "_top", "_body", "ids", "target"]
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"t{r.randrange(vocabulary)}" for _ in range(n)]


def rows():
    base = " ".join(words(1, 300))
    near = base.replace("t1 ", "t2 ", 1)
    out = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, near, "en", None, 1),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n ", "fr", "b", 4),
        (None, "no id here, but text", "en", "a", 3),
        (None, "no id here, but text", "en", "a", 3),
        (8, base, "en", "a", 1),
        (8, base, "en", "a", 1),
        (9, LONG, "de", "a", len(LONG)),
        (10, "one two", "en", "é", 7),
        (10, "another text of the same id", "en", "z", 7),
        (11, "x" * 200_000, "en", "z", 1),
        (12, "Ünïcode — “quotes” 漢字 🙂 " * 30, "de", "漢", 1),
    ]
    return out + [(100 + i, "\n".join(" ".join(words(100 * i + j, 15)) for j in range(1 + i % 7)), "en", f"s{i % 4}", i) for i in range(40)]


def table(spark, extra=False, values=None):
    df = spark.createDataFrame(rows() if values is None else values, SCHEMA)
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES)) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df):
    """The rows as a sorted list of strings."""
    return sorted(map(repr, df.collect()))
