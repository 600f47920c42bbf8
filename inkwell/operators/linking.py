"""Lookups that link mentions to segments, roles and authority keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import clean_form, folded, normalized_phrase


def segment_ranges(segments: DataFrame, page: str = "page_id", start: str = "char_start", order: str = "ord") -> DataFrame:
    """Segments with the half-open range of places they answer for: the first one of a page also those before it."""
    w = Window.partitionBy(page).orderBy(start, order)
    low = F.when(F.row_number().over(w) == 1, F.lit(None)).otherwise(F.col(start))
    return segments.withColumn("_from", low).withColumn("_to", F.lead(start).over(w))


def locate(mentions: DataFrame, segments: DataFrame, page: str = "page_id", at: str = "span_start") -> DataFrame:
    """As-of lookup: the last segment that starts at or before the mention, else the page's first; null without segments.

    An equi-join on the page with a range condition, so a page's segments are read once.
    """
    s = segment_ranges(segments, page)
    s = s.select(F.col(page).alias("_page"), "_from", "_to", *[c for c in s.columns if c not in (page, "_from", "_to") and c not in mentions.columns])
    hit = (F.col(page) == F.col("_page")) & (F.col("_from").isNull() | (F.col(at) >= F.col("_from"))) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    return mentions.join(s, hit, "left").drop("_page", "_from", "_to")


def usable(located: DataFrame, roles: DataFrame, editorial: DataFrame, kinds: Sequence[str] = (), row: str = "mention_id", page: str = "page_id", last: str | None = None) -> DataFrame:
    """Adds page_role (``record`` by default), editorial_span (kind of the overlapping span of the least ord) and usable.

    Of spans with one ord, a number, the one with the largest ``last`` counts, where that column is named.
    """
    place = F.struct(-F.col("ord"), *([F.col(last)] if last else []))
    e = editorial.select(F.col(page).alias("_p"), F.col("char_start").alias("_a"), F.col("char_end").alias("_b"), "kind", place.alias("_o"))
    hits = located.join(e, (F.col(page) == F.col("_p")) & (F.col("_a") < F.col("span_end")) & (F.col("span_start") < F.col("_b")))
    first = hits.groupBy(row).agg(F.max_by("kind", "_o").alias("editorial_span"))
    out = located.join(first, row, "left").join(roles.select(page, F.col("role").alias("page_role")), page, "left")
    out = out.withColumn("page_role", F.coalesce("page_role", F.lit("record"))).withColumn("editorial_span", F.coalesce("editorial_span", F.lit("")))
    return out.withColumn("usable", (F.col("page_role") == "record") & ((F.col("editorial_span") == "") | F.col("editorial_span").isin(list(kinds))))


def alias_index(people: DataFrame) -> DataFrame:
    """key -> candidates, from (person, key) rows."""
    return people.groupBy("key").agg(F.array_sort(F.collect_set("person")).alias("people"))


def resolve(mentions: DataFrame, aliases: DataFrame, excluded: DataFrame, contextual: DataFrame, volume: str = "volume") -> DataFrame:
    """Adds person and method to mentions with observed_key and name_key.

    In order: a contextual alias for the volume, the observed span (an excluded
    key stops everything, one candidate resolves, several are ambiguous), then the
    name string alike. ``contextual`` has (key, volume, person), its last rule wins.
    """
    index = alias_index(aliases)
    side = lambda df, key, name: df.select(F.col("key").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "key"])
    gone = excluded.select("key").distinct().withColumn("out", F.lit(True))
    rules = contextual.groupBy("key", F.col("volume").alias(volume)).agg(F.max_by("person", "ord").alias("person"))
    m = mentions.join(rules.select(F.col("key").alias("observed_key"), volume, F.col("person").alias("c_person")), ["observed_key", volume], "left")
    for key, name in (("observed_key", "o"), ("name_key", "n")):
        m = m.join(side(index, key, name), key, "left").join(side(gone, key, name), key, "left")
    one = lambda name: F.size(f"{name}_people") == 1
    many = lambda name: F.size(f"{name}_people") > 1
    method = (
        F.when(F.col("c_person").isNotNull(), "contextual")
        .when(F.col("o_out"), "excluded")
        .when(one("o"), "alias")
        .when(many("o"), "ambiguous")
        .when(F.col("n_out"), "excluded")
        .when(one("n"), "name")
        .when(many("n"), "ambiguous")
        .otherwise("unresolved")
    )
    person = F.coalesce("c_person", F.when(method == "alias", F.get("o_people", F.lit(0))).when(method == "name", F.get("n_people", F.lit(0))))
    return m.select(*mentions.columns, person.alias("person"), method.alias("method"))


def first_per(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in a total order: dedupe by span, source or name."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_i = 1").drop("_i")


def without_overlaps(rows: DataFrame, taken: DataFrame, page: str = "page_id", same: Sequence[str] = ()) -> DataFrame:
    """Rows whose span overlaps none of ``taken`` on the page (with equal ``same`` columns, if any)."""
    t = taken.select(F.col(page).alias("_p"), F.col("span_start").alias("_a"), F.col("span_end").alias("_b"), *(F.col(c).alias(f"_{c}") for c in same))
    hit = (F.col(page) == F.col("_p")) & (F.col("_a") < F.col("span_end")) & (F.col("span_start") < F.col("_b"))
    return rows.join(t, reduce(lambda a, c: a & (F.col(c) == F.col(f"_{c}")), same, hit), "left_anti")


def inside(rows: DataFrame, blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """Rows whose span lies fully in one of the blocks."""
    b = blocks.select(F.col(page).alias("_p"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    return rows.join(b, (F.col(page) == F.col("_p")) & (F.col("_a") <= F.col("span_start")) & (F.col("span_end") <= F.col("_b")), "left_semi")


def name_groups(rows: DataFrame, key: str, form: str) -> DataFrame:
    """Per key, in key order: group_id, count, distinct forms sorted.

    Ids are dense over all keys: keys are range-partitioned and the ranks of the
    partitions before are added, so no task sees all keys.
    """
    groups = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(form)).alias("forms"))
    return with_ids(groups, "key", "group_id")


def with_ids(rows: DataFrame, order: str, name: str, first: int = 1, bins: int = 256) -> DataFrame:
    """Numbers rows 1.. in the order of a unique column without one task for all.

    Bounds between ``bins`` ranges come from a sample of eight values a range, chosen by
    hash. A rank within a range plus the rows in the ranges before is the number, whatever the bounds are.
    """
    chosen = [r[0] for r in rows.select(order).filter(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(8 * bins).collect()]
    bounds = sorted(chosen)[8::8]
    bin_ = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    binned = rows.withColumn("_bin", F.when(F.col(order).isNull(), -1).otherwise(bin_))
    sizes = binned.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy(order))
    return binned.withColumn("_rank", rank).join(before, "_bin").withColumn(name, (F.col("_rank") + F.col("_before") + (first - 1)).cast("long")).drop("_bin", "_rank", "_before")


def frequent(rows: DataFrame, key: str, form: str, least: int, most_forms: int = 8) -> DataFrame:
    """Keys seen ``least`` times or more: key, n and their ``most_forms`` most frequent forms, ties by form."""
    forms = rows.groupBy(F.col(key).alias("key"), F.col(form).alias("form")).agg(F.count("*").alias("c"))
    groups = forms.groupBy("key").agg(F.sum("c").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "form"))), 1, most_forms).alias("f"))
    return groups.filter(F.col("n") >= least).select("key", "n", F.transform("f", lambda x: x["form"]).alias("forms"))


def linked_people(people: DataFrame, titled: DataFrame) -> DataFrame:
    """Mentions of people, resolved and titled ones together: mention_id, page_id, span_start, span_end, person, method.

    ``people`` has ord, person and method; the first of a span counts. ``titled`` has person and rule instead. It is
    left out where a resolved mention overlaps it: one of its person, or any if it has none.
    """
    columns = ["mention_id", "page_id", "span_start", "span_end", "person", "method"]
    once = first_per(people, ["page_id", "span_start", "span_end"], ["ord"]).select(*columns)
    known = once.filter("person is not null").select(F.col("page_id").alias("_p"), F.col("span_start").alias("_a"), F.col("span_end").alias("_b"), F.col("person").alias("_known"))
    hit = (F.col("page_id") == F.col("_p")) & (F.col("_a") < F.col("span_end")) & (F.col("span_start") < F.col("_b"))
    free = titled.join(known, hit & (F.col("person").isNull() | (F.col("person") == F.col("_known"))), "left_anti")
    method = F.when(F.col("person").isNull(), "unresolved_title").otherwise(F.concat(F.lit("territorial_title:"), F.col("rule")))
    return once.unionByName(free.withColumn("method", method).select(*columns))


def extension_log(occurrences: DataFrame, aliases: DataFrame, decided: DataFrame, skipped: DataFrame, least: int, most_forms: int = 8) -> DataFrame:
    """What frequent names add to a dictionary: rank, key, name, n, action, person, added (spellings), basis.

    ``occurrences`` has name and span, ``aliases`` and ``skipped`` person and alias (a person's own name is an alias too),
    ``decided`` key, action, person (null for excluded keys) and basis. A key that nobody decided on is a
    matched_existing_alias of one person, an ambiguous_alias of several, or unreviewed. A person gets the ``most_forms``
    most frequent spellings of a key, each once, unless known or skipped. Ranks fall with n, ties by key.
    """
    seen = occurrences.select(normalized_phrase(F.col("name")).alias("key"), clean_form(F.col("name")).alias("name"), clean_form(F.col("span")).alias("span")).filter("key <> ''")
    both = F.explode(F.array(F.struct(F.col("name").alias("form"), F.lit(1).alias("own")), F.struct(F.col("span").alias("form"), F.lit(0).alias("own"))))
    forms = seen.select("key", both.alias("f")).groupBy("key", "f.form").agg(F.count("*").alias("c"), F.sum("f.own").alias("own"))
    w = Window.partitionBy("key")
    ranked = forms.withColumn("n", F.sum("own").over(w)).withColumn("name", F.first("form").over(w.orderBy(F.desc("own"), "form"))).withColumn("i", F.row_number().over(w.orderBy(F.desc("c"), "form")))
    top = ranked.filter((F.col("n") >= least) & (F.col("i") <= most_forms))
    groups = top.groupBy("key").agg(F.first("n").alias("n"), F.first("name").alias("name"), F.array_sort(F.collect_list(F.struct("i", "form"))).alias("forms"))
    groups = with_ids(groups.withColumn("_o", F.concat(F.lpad((F.lit(10**15) - F.col("n")).cast("string"), 16, "0"), F.col("key"))), "_o", "rank").drop("_o")
    people = alias_index(aliases.select("person", normalized_phrase(F.col("alias")).alias("key")).filter("key <> ''"))
    mine = decided.select("key", F.col("action").alias("_action"), F.col("person").alias("_person"), F.col("basis").alias("_basis"))
    t = groups.join(people, "key", "left").join(mine, "key", "left")
    found = F.when(F.size("people") == 1, "matched_existing_alias").when(F.size("people") > 1, "ambiguous_alias").otherwise("unreviewed")
    t = t.withColumn("action", F.coalesce("_action", found))
    t = t.withColumn("person", F.when(F.col("_action").isNotNull(), F.col("_person")).when(F.col("action") == "matched_existing_alias", F.get("people", F.lit(0))))
    several = F.when(F.col("action") == "ambiguous_alias", F.concat(F.lit("Matches aliases of: "), F.array_join("people", "; ")))
    t = t.withColumn("basis", F.when(F.col("_action").isNotNull(), F.col("_basis")).otherwise(several)).drop("people", "_action", "_person", "_basis")
    fold = lambda df: df.select("person", folded(clean_form(F.col("alias"))).alias("_f")).distinct()
    new = t.filter("person is not null").select("person", "key", "rank", F.explode("forms").alias("f")).select("person", "key", "rank", "f.i", "f.form", folded(F.col("f.form")).alias("_f"))
    new = new.filter("form <> ''").join(fold(aliases.unionByName(skipped.select(*aliases.columns))), ["person", "_f"], "left_anti")
    new = first_per(new, ["person", "_f"], ["rank", "i"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "form"))).alias("_new"))
    out = t.drop("forms").join(new, "key", "left")
    added = F.coalesce(F.transform("_new", lambda x: x["form"]), F.array().cast("array<string>"))
    return out.select("rank", "key", "name", "n", "action", "person", added.alias("added"), "basis")


def reasons(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``reason``: the first rule that holds, or null where the row is kept."""
    case = reduce(lambda c, kv: c.when(kv[1], kv[0]), rules.items(), F.when(F.lit(False), ""))
    return rows.withColumn("reason", case)


def merge_aliases(authority: DataFrame, queue: DataFrame) -> DataFrame:
    """Aliases of both sides, one row per (place_id, folded alias): the authority's spelling first, then the queue's."""
    both = authority.select("place_id", "alias", F.lit(0).alias("o")).unionByName(queue.select("place_id", "alias", F.lit(1).alias("o")))
    both = both.withColumn("alias", F.trim("alias")).filter("alias <> ''").withColumn("folded", F.lower("alias"))
    return first_per(both, ["place_id", "folded"], ["o", "alias"]).select("place_id", "alias", (F.col("o") == 1).alias("added"))


def next_ids(new: DataFrame, known: DataFrame, prefix: str, name: str, key: str = "id") -> DataFrame:
    """Ids ``PREFIX-007`` for new rows: per prefix the highest known number and on, in the order of names."""
    top = known.groupBy(F.regexp_extract(key, "^([A-Z]+)-", 1).alias("_x")).agg(F.max(F.regexp_extract(key, "-([0-9]+)$", 1).cast("int")).alias("_top"))
    rank = F.row_number().over(Window.partitionBy(prefix).orderBy(name))
    out = new.withColumn("_r", rank).join(top, F.col(prefix) == F.col("_x"), "left")
    number = F.lpad((F.coalesce("_top", F.lit(0)) + F.col("_r")).cast("string"), 3, "0")
    return out.withColumn(key, F.concat_ws("-", F.col(prefix), number)).drop("_r", "_x", "_top")


def checked(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows``, failing where a key is not among the known ones."""
    k = known.select(F.col(key).alias("_k")).distinct().withColumn("_ok", F.lit(True))
    bad = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.join(k, F.col(key) == F.col("_k"), "left").withColumn("_ok", F.when(F.col("_ok"), True).otherwise(bad.cast("boolean"))).filter("_ok").drop("_k", "_ok")


def shared_context(names: DataFrame, people: DataFrame, least: int = 3, ratio: int = 2) -> DataFrame:
    """Per unreviewed name the person in most of its segments, if at least ``least`` and ``ratio`` times the next.

    Both sides hold (name or person, segment), repeats counted: a segment adds the
    smaller count of the two.
    """
    a = names.groupBy("name", "segment").agg(F.count("*").alias("x"))
    b = people.groupBy("person", "segment").agg(F.count("*").alias("y"))
    return clear_best(a.join(b, "segment").groupBy("name", "person").agg(F.sum(F.least("x", "y")).alias("score")), least, ratio)


def clear_best(scores: DataFrame, least: int = 3, ratio: int = 2) -> DataFrame:
    """Per name of (name, person, score) the person with the highest score, if at least ``least`` and ``ratio`` times the next."""
    w = Window.partitionBy("name").orderBy(F.desc("score"), "person")
    best = scores.withColumn("i", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0))).filter("i = 1")
    return best.filter((F.col("score") >= least) & (F.col("score") >= ratio * F.col("next"))).select("name", "person", "score", "next")
