"""Fuzzy lookups: exact keys first, then blocked pairs, the ratio by an Arrow UDF over distinct words."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.text import skeleton


@lru_cache(maxsize=200_000)
def ratio_of(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, arguments in this order."""
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def near(a: str, b: str, least: float) -> Column:
    """A cheap test that no pair of this ratio fails: twice the shared letters is at least ``least`` of all, so few edits are needed."""
    return F.levenshtein(a, b) <= F.floor(F.lit(1 - least + 1e-9) * (F.length(a) + F.length(b)))


def letter_pairs(word: Column) -> Column:
    """Distinct pairs of neighbouring letters; the word itself if it has one letter.

    Two words of a ratio of 0.8 or more, of three letters and more, have a pair in common:
    with T letters in all, at least 0.4 T match in at most 0.2 T + 1 runs.
    """
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - 1)), lambda i: F.substr(word, i, F.lit(2)))
    return F.array_distinct(runs)


def blocked(w: DataFrame, e: DataFrame, on: list[str], word: str, form: str, least: float) -> DataFrame:
    """Rows of both with equal ``on`` that may be so close: those that share a pair of letters, if ``least`` ensures one."""
    if least < 0.8:
        return w.join(e, on)
    a, b = w.withColumn("_pair", F.explode(letter_pairs(F.col(word)))), e.withColumn("_pair", F.explode(letter_pairs(F.col(form))))
    return a.join(b, [*on, "_pair"]).drop("_pair").distinct()


def best_match(words: DataFrame, entries: DataFrame, least: float, slack: int, word: str = "word", form: str = "form") -> DataFrame:
    """Per distinct word the entry form with the highest ratio, of a length within ``slack``; the smallest form wins ties.

    Pairs are blocked by length: each form is copied to the lengths it may match,
    so the join is an equi-join, and pairs that need too many edits do not reach the UDF.
    """
    w = words.select(F.col(word).alias("word")).distinct().withColumn("n", F.length("word"))
    e = entries.select(F.col(form).alias("form")).distinct()
    e = e.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.length("form") - slack), F.length("form") + slack)))
    pairs = blocked(w, e, ["n"], "word", "form", least).filter(near("word", "form", least)).withColumn("score", ratio("word", "form")).filter(F.col("score") >= least)
    i = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "form"))
    return pairs.withColumn("i", i).filter("i = 1").select("word", "form", "score")


def lookup(words: DataFrame, lexicon: DataFrame, least: float = 0.82, shortest: int = 5, rejected: Sequence[str] = ()) -> DataFrame:
    """word -> entity, match_type (exact, variant, fuzzy), score.

    ``lexicon`` has entity, seed, exact_only. A word whose spelling key equals a
    seed's is exact if it is the seed, else a variant unless the entry takes exact
    spellings only. Other words are compared with keys of the same first letter
    and of a length within 0.8 to 1.25, both of at least ``shortest`` letters.
    """
    w = words.select("word").distinct().filter(~F.lower("word").isin(list(rejected)))
    w = w.withColumn("key", skeleton(F.col("word")))
    e = lexicon.withColumn("key", skeleton(F.col("seed"))).filter("key <> ''")
    same = w.join(e, "key").withColumn("exact", F.lower("word") == F.lower("seed")).filter(F.col("exact") | ~F.col("exact_only"))
    first = Window.partitionBy("word").orderBy(F.desc("exact"), "entity", "seed")
    equal = same.withColumn("i", F.row_number().over(first)).filter("i = 1")
    equal = equal.select("word", "entity", F.when(F.col("exact"), "exact").otherwise("variant").alias("match_type"), F.lit(1.0).alias("score"))
    rest = w.join(equal.select("word"), "word", "left_anti").filter(F.length("key") >= shortest)
    block = lambda df: df.withColumn("c", F.left("key", F.lit(1))).withColumn("n", F.length("key"))
    r = block(rest)
    f = block(e.filter(~F.col("exact_only") & (F.length("key") >= shortest)).select("entity", F.col("key")).distinct()).withColumnRenamed("key", "seed_key")
    lengths = F.sequence(F.ceil(F.col("n") * 0.8).cast("int"), F.floor(F.col("n") * 1.25).cast("int"))
    f = f.withColumn("n", F.explode(lengths))
    pairs = blocked(r, f, ["c", "n"], "key", "seed_key", least).filter(near("key", "seed_key", least)).withColumn("score", ratio("key", "seed_key")).filter(F.col("score") >= least)
    best = Window.partitionBy("word").orderBy(F.desc("score"), "entity", "seed_key")
    close = pairs.withColumn("i", F.row_number().over(best)).filter("i = 1").select("word", "entity", F.lit("fuzzy").alias("match_type"), "score")
    return equal.unionByName(close)


def same_surname(pairs: DataFrame, a: str, b: str, least: float = 0.82) -> DataFrame:
    """Pairs of surnames that are one: equal spelling keys, or both of four letters and more and close."""
    t = pairs.withColumn("_a", skeleton(F.replace(F.lower(a), F.lit("ff"), F.lit("f")))).withColumn("_b", skeleton(F.replace(F.lower(b), F.lit("ff"), F.lit("f"))))
    equal = t.filter(F.col("_a") == F.col("_b"))
    long = t.filter((F.col("_a") != F.col("_b")) & (F.length("_a") >= 4) & (F.length("_b") >= 4) & (F.left("_a", F.lit(1)) == F.left("_b", F.lit(1))))
    return equal.unionByName(long.filter(ratio("_a", "_b") >= least)).drop("_a", "_b")


def same_shapes(words: DataFrame, forms: DataFrame, least: float = 0.82) -> DataFrame:
    """word, form: spelling keys of the first columns of both that are one, being equal, or of four letters and more and close.

    Keys are blocked by length: each form is copied to the lengths it may match, which loses no pair.
    """
    w, e = (t.select(F.col(t.columns[0]).alias(c)).filter(F.col(c).isNotNull()).distinct() for t, c in ((words, "word"), (forms, "form")))
    equal = w.join(e, F.col("word") == F.col("form"))
    n = F.length("form")
    lengths = F.sequence(F.greatest(F.lit(4), F.floor(n * (least / (2 - least))).cast("int")), F.ceil(n * ((2 - least) / least)).cast("int"))
    close = blocked(w.withColumn("n", F.length("word")).filter("n >= 4"), e.filter(n >= 4).withColumn("n", F.explode(lengths)), ["n"], "word", "form", least)
    close = close.filter("word <> form").filter(near("word", "form", least)).filter(ratio("word", "form") >= least)
    return equal.unionByName(close.select("word", "form"))


def spelling_review(matches: DataFrame) -> DataFrame:
    """Per (entity, spelling): n, best score, readings, sample; fuzzy ones first."""
    g = matches.groupBy("entity", F.lower("word").alias("spelling"), "match_type")
    out = g.agg(F.count("*").alias("n"), F.max("score").alias("score"), F.array_sort(F.collect_set("reading")).alias("readings"), F.min_by("context", "ord").alias("sample"))
    return out.orderBy(F.col("match_type") != "fuzzy", "entity", F.desc("n"), "spelling")


def reading(category: Column, homonym: Column, plural: Column, before: Column, after: Column) -> Column:
    """What a group's word stands for: a person after king of, a group if plural or before people, a homonymous place, or either."""
    person = before.rlike(r"(?i)\b(?:king|kinge|queen|chief|weroance)\s+of\s+(?:the\s+)?$")
    people = after.rlike(r"(?i)^\W*(?:indians?|people|men|nation|king|savages|saluages)\b")
    return F.when(category != "group", category).when(person, "person").when(plural | people, "group").when(homonym.isNull(), "group").when(after.rlike(r"(?i)^\W*(?:river|riuer|town|towne|creek|hundred)\b"), "place_homonym").otherwise("group_or_homonym")


def reviewed(lexicon: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lexicon with accepted spellings as seeds, rejected spellings)."""
    new = decisions.filter("decision = 'accept'").select("entity", F.col("spelling").alias("seed"), F.lit(False).alias("exact_only"))
    return lexicon.unionByName(new).dropDuplicates(["entity", "seed"]), decisions.filter("decision = 'reject'").select("spelling").distinct()


def merge_names(names: DataFrame, least: float = 0.82) -> DataFrame:
    """Groups new names whose given name is equal and surname one: name, group (its first name in order).

    An ordered scan per given name: a name joins the first group it matches.
    """

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        heads: list[tuple[str, str]] = []
        out = []
        for name, surname in sorted(zip(part["name"], part["surname"], strict=True)):
            head = next((h for h, s in heads if s == surname or (min(len(s), len(surname)) >= 4 and ratio_of(s, surname) >= least)), None)
            if head is None:
                heads.append((name, surname))
            out.append((name, head or name))
        return pd.DataFrame(out, columns=["name", "group"])

    return names.groupBy("given").applyInPandas(scan, "name string, `group` string")


def merged_proposals(proposals: DataFrame, least: float = 0.82) -> DataFrame:
    """proposed -> head of (proposed, given, shape, ord): the first earlier proposal of the given name whose surname is one with its own.

    As ``merge_names``, but in the order of ``ord``, and on spelling keys: a scan per given name.
    """

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        heads: dict[str, str] = {}
        out = []
        for proposed, shape in part.sort_values("i")[["proposed", "shape"]].itertuples(index=False):
            near_ = lambda s: min(len(s), len(shape)) >= 4 and ratio_of(shape, s) >= least
            head = next((h for s, h in heads.items() if s == shape or near_(s)), None)
            out.append((proposed, heads.setdefault(shape, proposed) if head is None else head))
        return pd.DataFrame(out, columns=["proposed", "head"])

    ranked = proposals.withColumn("i", F.row_number().over(Window.partitionBy("given").orderBy("ord"))).select("proposed", "given", "shape", "i")
    return ranked.groupBy("given").applyInPandas(scan, "proposed string, head string")
