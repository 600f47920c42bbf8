"""Co-occurrence of people and targets within units (meetings, documents, orders).

Units are chains of segments. For each person and target of a unit the nearest
pair of mentions gives a distance and a proximity class; pairs are then rolled
up with lift, and by year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE, NEAR = 300, 1000
#: Best first; anything else ranks with the last.
CONFIDENCE = ("high", "medium", "low", "none")


def chain_units(segments: DataFrame, group: list[str], order: str, starts: Column) -> DataFrame:
    """Gaps and islands: ``unit`` counts the rows of each group that start one. A group's first row always does."""
    w = Window.partitionBy(*group).orderBy(order)
    first = F.row_number().over(w) == 1
    begins = F.when(first | F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    return segments.withColumn("_b", begins).withColumn("unit", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def meeting_units(segments: DataFrame) -> DataFrame:
    """Adds meeting_id and the dates of the unit's first segment.

    A segment starts a unit if it has a heading, is its volume's first one, or does
    not continue a meeting or document. Needs volume, ord, segment_id, heading,
    date_source, date_start, date_end, confidence.
    """
    starts = (F.coalesce("heading", F.lit("")) != "") | ~F.coalesce("date_source", F.lit("")).rlike("^continued_(meeting|document)")
    units = chain_units(segments, ["volume"], "ord", starts)
    w = Window.partitionBy("volume", "unit").orderBy("ord")
    first = lambda c: F.first(c).over(w)
    return units.select(
        *segments.columns,
        F.concat(F.lit("M-"), first("segment_id")).alias("meeting_id"),
        first("date_start").alias("unit_start"),
        first("date_end").alias("unit_end"),
        first("confidence").alias("unit_confidence"),
    )


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Characters between two spans, 0 if they overlap."""
    return F.greatest(F.lit(0), F.greatest(a0, b0) - F.least(a1, b1))


def proximity(mentioned: Column, d: Column) -> Column:
    return F.when(~mentioned, "present_only").when(d <= CLOSE, "close").when(d <= NEAR, "near").otherwise("same_meeting")


def evidence(people: DataFrame, targets: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per (person, target, unit): mentioned, min_distance, proximity, and the nearest pair's positions.

    ``people``: unit, page, person, start, end, present (only in an attendance
    list), ord. ``targets``: unit, page, target, start, end, ord. People that are
    only present have no distance. Ties go to the first mention. Both sides are
    partitioned by unit once; the grouping keeps that partitioning.
    """
    carry = carry or []
    p = people.select("unit", *carry, "person", F.col("page").alias("pp"), F.col("start").alias("p0"), F.col("end").alias("p1"), "present", F.col("ord").alias("po"))
    t = targets.select("unit", "target", F.col("page").alias("tp"), F.col("start").alias("t0"), F.col("end").alias("t1"), F.col("ord").alias("to"))
    pairs = p.join(t, "unit").withColumn("d", F.when(~F.col("present") & (F.col("pp") == F.col("tp")), distance(F.col("p0"), F.col("p1"), F.col("t0"), F.col("t1"))))
    key = F.struct(F.col("d").isNull().alias("none"), F.col("d"), "po", "to", "p0", "p1", "t0", "t1", "pp")
    grouped = pairs.groupBy("unit", *carry, "person", "target").agg(
        F.max(~F.col("present")).alias("mentioned"),
        F.min("d").alias("min_distance"),
        F.min(F.when(F.col("d").isNotNull(), key)).alias("nearest"),
    )
    return grouped.withColumn("proximity", proximity(F.col("mentioned"), F.col("min_distance")))


def pair_links(found: DataFrame, people: DataFrame, targets: DataFrame, date: str = "date") -> DataFrame:
    """Roll-up of ``evidence`` per (person, target) with lift.

    If a pair has any mentioned unit, those where the person is only present do not
    count for dates and distances. A person's frequency leaves out attendance, a
    target's does not. Lift is null where the pair is never mentioned together.
    """
    m = F.col("mentioned")
    pairs = found.groupBy("person", "target").agg(
        F.count_if(m).alias("meetings"),
        F.count_if(F.col("proximity") == "close").alias("close_meetings"),
        F.count_if(F.col("proximity").isin("close", "near")).alias("near_meetings"),
        F.count_if(~m).alias("present_meetings"),
        F.min("min_distance").alias("min_distance"),
        F.coalesce(F.min(F.when(m, F.col(date))), F.min(date)).alias("first_date"),
        F.coalesce(F.max(F.when(m, F.col(date))), F.max(date)).alias("last_date"),
    )
    pf = people.filter(~F.col("present")).select("person", "unit").distinct().groupBy("person").agg(F.count("*").alias("pf"))
    tf = targets.select("target", "unit").distinct().groupBy("target").agg(F.count("*").alias("tf"))
    n = people.select("unit").union(targets.select("unit")).distinct().agg(F.count("*").alias("n"))
    # One row: the number of units.
    out = pairs.join(pf, "person", "left").join(tf, "target").join(F.broadcast(n), F.expr("n >= 0"))
    lift = F.col("meetings").cast("double") * F.col("n") / (F.col("pf") * F.col("tf"))
    return out.select(*pairs.columns, F.when((F.col("meetings") > 0) & F.col("pf").isNotNull(), F.round(lift, 2)).alias("lift"))


def with_relations(links: DataFrame, found: DataFrame, relations: DataFrame, keys: list[str]) -> DataFrame:
    """Adds relations to a roll-up of ``evidence`` over ``keys``: the summary of those found in the pair's units, empty for none.

    ``relations`` has unit, person, target and relation, one row each, and optionally ord; ``found`` carries the keys.
    """
    order = "ord" if "ord" in relations.columns else None
    rows = found.select("unit", *{*keys, "person", "target"}).join(relations, ["unit", "person", "target"])
    text = summarize(rows, keys, "relation", order)
    return links.join(text, keys, "left").withColumn("relations", F.coalesce("relations", F.lit("")))


def by_year(found: DataFrame, date: str = "date", confidence: str | None = None) -> DataFrame:
    """Roll-up of ``evidence`` per (year, person, target); rows without a date are left out.

    With ``confidence`` the best one of a group's dates is added.
    """
    m = F.col("mentioned")
    best = [] if confidence is None else [best_confidence(F.col(confidence)).alias("date_confidence")]
    return found.filter(F.col(date).isNotNull()).groupBy(F.year(date).alias("year"), "person", "target").agg(
        F.count_if(m).alias("meetings"),
        F.count_if(F.col("proximity") == "close").alias("close_meetings"),
        F.count_if(~m).alias("present_meetings"),
        F.min("min_distance").alias("min_distance"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        *best,
    )


def best_confidence(c: Column) -> Column:
    """The best of a group's confidences, by rank."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in CONFIDENCE)), c), F.lit(0))
    return F.min_by(c, F.when(rank == 0, len(CONFIDENCE)).otherwise(rank))


def summarize(rows: DataFrame, keys: list[str], name: str = "relation", order: str | None = None) -> DataFrame:
    """Per group a string ``name×n; name`` by falling count; ties by first place, or by name without ``order``."""
    counts = rows.groupBy(*keys, name).agg(F.count("*").alias("n"), F.min(order or name).alias("o"))
    part = F.concat(F.col(name), F.when(F.col("n") > 1, F.concat(F.lit("×"), F.col("n").cast("string"))).otherwise(""))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "o", part.alias("s"))))
    return counts.groupBy(*keys).agg(items.alias("i")).select(*keys, F.array_join(F.transform("i", lambda x: x["s"]), "; ").alias("relations"))


def expand_summary(summary: Column) -> Column:
    """The relations that a summary stands for, as an array."""
    part = lambda x: F.split(x, "×")
    times = lambda x: F.coalesce(F.get(part(x), F.lit(1)).try_cast("int"), F.lit(1))
    return F.flatten(F.transform(F.filter(F.split(summary, "; "), lambda x: x != ""), lambda x: F.array_repeat(F.get(part(x), F.lit(0)), times(x))))


def margin_mentions(margin: DataFrame, segments: DataFrame) -> DataFrame:
    """Mentions of margin notes as extra mentions in the page's largest segment, on a page of their own (page#noteN)."""
    size = F.col("char_end") - F.col("char_start")
    main = segments.groupBy("page_id").agg(F.max_by("segment_id", F.struct(size, -F.col("ord"))).alias("segment_id"))
    role = F.when(F.col("note_kind") == "attendance_fragment", "present").otherwise("mentioned")
    return margin.join(main, "page_id").withColumn("mention_role", role).withColumn("page_id", F.concat("page_id", F.lit("#note"), F.col("note_index").cast("string")))


def relation_index(relations: DataFrame, meetings: DataFrame) -> DataFrame:
    """(meeting_id, subject_key, object_key) with the relations found there, in order."""
    rows = relations.filter("subject_key <> '' and object_key <> '' and subject_type = 'person'")
    return rows.join(meetings.select("segment_id", "meeting_id"), "segment_id").groupBy("meeting_id", "subject_key", "object_key").agg(F.collect_list("relation").alias("relations"))


def explorer(rows: DataFrame, year_from: int, year_to: int, text: str = "", close_only: bool = False, most: int = 200) -> DataFrame:
    """Filter by-year rows and re-aggregate them per pair: sums, least distance; the first ``most`` by meetings."""
    kept = rows.filter(F.col("year").between(year_from, year_to))
    if text:
        kept = kept.filter(F.contains(F.lower(F.concat_ws(" ", "person", "target")), F.lit(text.lower())))
    if close_only:
        kept = kept.filter("close_meetings > 0")
    sums = [F.sum(c).alias(c) for c in ("meetings", "close_meetings", "present_meetings")]
    pairs = kept.groupBy("person", "target").agg(*sums, F.min("min_distance").alias("min_distance"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return pairs.orderBy(F.desc("meetings"), F.desc("close_meetings"), "person", "target").limit(most)


def per_year(rows: DataFrame) -> DataFrame:
    """How many rows, pairs' meetings and close meetings each year has."""
    return rows.groupBy("year").agg(F.count("*").alias("rows"), F.sum("meetings").alias("meetings"), F.sum("close_meetings").alias("close_meetings"))


def tiers(found: DataFrame, place: str, year: Column, person: str, tier: Column) -> DataFrame:
    """Per (place, year, person) the best tier and distinct units; per (place, year) people and those of tier 3 or more."""
    best = found.groupBy(F.col(place).alias("place"), year.alias("year"), F.col(person).alias("person")).agg(F.max(tier).alias("tier"), F.count_distinct("unit").alias("units"))
    return best.groupBy("place", "year").agg(F.count("*").alias("people"), F.count_if(F.col("tier") >= 3).alias("strong"), F.sum("units").alias("units"))
