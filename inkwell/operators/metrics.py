"""Dated counts, distinctive words, networks and places."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIOR, LEAST_COUNT, LEAST_Z, TOP_WORDS = 500.0, 3, 1.96, 12


def midpoint(start: Column, end: Column) -> Column:
    """Middle of a range of days, half days dropped; the start where the end is missing."""
    end = F.coalesce(end, start)
    return F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))


def half_year(day: Column) -> Column:
    """``1622a`` or ``1622b``."""
    return F.concat(F.year(day).cast("string"), F.when(F.month(day) <= 6, "a").otherwise("b"))


def era(start: Column, end: Column, pivot: Column) -> Column:
    """before, after, or undetermined where the range spans the pivot day."""
    return F.when(F.coalesce(end, start) < pivot, "before").when(start >= pivot, "after").otherwise("undetermined")


def before_after(rows: DataFrame, keys: Sequence[str], eras: str = "era") -> DataFrame:
    """Counts per key and era, one column per era."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(eras) == e).alias(e) for e in ("before", "after", "undetermined")))


def theme_counts(rows: DataFrame, text: str, themes: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose text matches each theme's pattern (RE2-compatible, case ignored), one column per theme."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(text).rlike(f"(?i){p}")).alias(name) for name, p in themes.items()))


def word_volume(rows: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Words of two or more letters a-z per key."""
    return rows.groupBy(*keys).agg(F.sum(F.regexp_count(F.col(text), F.lit("[A-Za-z]{2,}"))).cast("long").alias("words"))


def word_rows(rows: DataFrame, text: str, keys: Sequence[str], least: int = 3, stop: Sequence[str] = ()) -> DataFrame:
    """One row per word of at least ``least`` letters a-z, lower case, without stopwords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    out = rows.select(*keys, F.explode(words).alias("word"))
    return out.filter(~F.col("word").isin(list(stop))) if stop else out


def word_key(word: Column) -> Column:
    """One key for spellings with u or v, i or j."""
    return F.translate(word, "vj", "ui")


def distinctive_words(words: DataFrame, group: str, top: int = TOP_WORDS, prior: float = PRIOR) -> DataFrame:
    """Per group the ``top`` words over-represented against all other groups: group, word, n, z.

    Log-odds with an informative Dirichlet prior. Counts are made per (group, key)
    on the map side; totals are one row per group. The shown form is a key's most
    frequent word, the first in order of several.
    """
    forms = words.withColumn("key", word_key(F.col("word"))).groupBy(group, "key", "word").agg(F.count("*").alias("c"))
    counts = forms.groupBy(group, "key").agg(F.sum("c").alias("n"), F.min_by("word", F.struct(-F.col("c"), "word")).alias("word"))
    keys = counts.groupBy("key").agg(F.sum("n").alias("all"))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    t = counts.filter(F.col("n") >= LEAST_COUNT).join(keys, "key").join(sizes, group).join(F.broadcast(total), F.expr("total > 0"))
    a = F.lit(prior) * F.col("all") / F.col("total")
    inside, outside = F.col("n"), F.col("all") - F.col("n")
    odds = lambda y, size: F.log((y + a) / (size + F.lit(prior) - y - a))
    delta = odds(inside, F.col("size")) - odds(outside, F.col("total") - F.col("size"))
    z = delta / F.sqrt(1 / (inside + a) + 1 / (outside + a))
    t = t.select(group, "word", "n", "key", z.alias("z")).filter(F.col("z") > LEAST_Z)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.round("z", 6).desc(), "key"))
    return t.withColumn("i", rank).filter(F.col("i") <= top).select(group, "word", "n", F.round("z", 1).alias("z"))


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` has to be total."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_i", i).filter(F.col("_i") <= n).drop("_i")


def network(rows: DataFrame, node: str, unit: str, most_nodes: int = 70, least_shared: int = 4, per_node: int = 4, relations: DataFrame | None = None) -> DataFrame:
    """Edges (a, b, shared, jaccard) between the nodes in most units; the ``per_node`` best of each node.

    ``rows`` holds (node, unit). Only the ``most_nodes`` top nodes meet in the
    self-join, so a unit gives at most that many squared pairs. With ``relations``
    (subject, object, relation; one row each) edges have their number, relations, and
    pairs that have any are edges whatever they share; weight adds 0.05 for each.
    """
    from inkwell.operators.graph import weight

    seen = rows.select(F.col(node).alias("node"), F.col(unit).alias("unit")).distinct()
    sizes = seen.groupBy("node").agg(F.count("*").alias("units")).orderBy(F.desc("units"), "node").limit(most_nodes)
    kept = seen.join(F.broadcast(sizes), "node")  # at most ``most_nodes`` rows
    a = kept.select("unit", F.col("node").alias("a"), F.col("units").alias("na"))
    b = kept.select("unit", F.col("node").alias("b"), F.col("units").alias("nb"))
    pairs = a.join(b, "unit").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = pairs.filter(F.col("shared") >= least_shared).select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))
    if relations is not None:
        ends = relations.filter("subject <> object").select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b"))
        known = lambda c: F.broadcast(sizes.select(F.col("node").alias(c)))
        counts = ends.join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi").groupBy("a", "b").agg(F.count("*").alias("relations"))
        pairs = pairs.join(counts, ["a", "b"], "full").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"), F.coalesce("relations", F.lit(0)).alias("relations"))
    ends = pairs.select("*", F.explode(F.array("a", "b")).alias("end"))
    best = top_per_group(ends, ["end"], [F.desc("jaccard"), F.asc("a"), F.asc("b")], per_node).drop("end")
    if relations is None:
        return best.distinct()
    return best.unionByName(pairs.filter("relations > 0")).distinct().withColumn("weight", weight(F.col("jaccard"), F.col("relations")))


def frames(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each point (id, lon, lat) in the first of the boxes (frame, ord, west, south, east, north) that holds it; points without one are left out.

    Boxes are a short list of map frames, so they are the broadcast side.
    """
    inside = F.expr("lon between west and east and lat between south and north")
    return points.join(F.broadcast(boxes), inside).groupBy(*points.columns).agg(F.min_by("frame", "ord").alias("frame"))


#: How strongly a person is tied to a place, fixed values: a stated relation, else the proximity class.
TIERS = {"relation": 4, "close": 3, "near": 2, "same_meeting": 1}


def map_links(located: DataFrame, found: DataFrame) -> DataFrame:
    """target, person, year, tier: each year's strongest tier of located targets (id).

    ``found`` has target, person, start, end, proximity and relations. Rows without a date or a proximity class are left
    out. The year is that of the middle of the dates.
    """
    level = F.element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.col("proximity"))
    tier = F.when(F.coalesce("relations", F.lit("")) != "", TIERS["relation"]).otherwise(level)
    rows = found.filter(F.col("proximity").isin(list(TIERS)) & F.col("start").isNotNull())
    rows = rows.select("target", "person", F.year(midpoint(F.col("start"), F.col("end"))).alias("year"), tier.alias("tier"))
    best = rows.groupBy("target", "person", "year").agg(F.max("tier").alias("tier"))
    return best.join(located.select(F.col("id").alias("target")).distinct(), "target", "left_semi")


def map_mentions(located: DataFrame, mentions: DataFrame) -> DataFrame:
    """target, year, n: dated mentions (target, start, end) of located targets by the year of the middle of their dates."""
    rows = mentions.filter("start is not null").select("target", F.year(midpoint(F.col("start"), F.col("end"))).alias("year"))
    return rows.groupBy("target", "year").agg(F.count("*").alias("n")).join(located.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
