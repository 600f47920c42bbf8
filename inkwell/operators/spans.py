"""Spans: offsets of matches, dictionary matching by n-gram joins, packing without overlaps.

Offsets are code points, ends are exclusive. The dictionary matcher gives each token
the words after it and joins it to the aliases that begin with it, so its cost grows
with the text and not with the number of aliases.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.text import folded

TOKEN, BETWEEN = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"


def matches(rows: DataFrame, text: str, pattern: str, keys: Sequence[str]) -> DataFrame:
    """keys, i, start, end, span of each match of a Java pattern that never matches nothing.

    Lengths of matches and of the gaps before them are summed in a window per key,
    so long texts with many matches stay linear.
    """
    m = rows.select(*keys, F.col(text).alias("_t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("_m")).filter(F.size("_m") > 0)
    gaps = F.slice(F.split("_t", pattern, -1), F.lit(1), F.size("_m"))
    flat = m.select(*keys, F.posexplode(F.arrays_zip(F.col("_m").alias("m"), gaps.alias("g"))).alias("i", "x"))
    flat = flat.select(*keys, "i", F.col("x.m").alias("span"), F.length("x.g").alias("_g"))
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("_g") + F.length("span")).over(w)
    return flat.select(*keys, "i", (end - F.length("span")).cast("int").alias("start"), end.cast("int").alias("end"), "span")


def squeezed(s: Column) -> Column:
    """Folded text with single spaces, cut to its first and last letter or digit."""
    bare = F.regexp_replace(s, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.regexp_replace(folded(bare), r"\s+", " ")


def alias_keys(aliases: DataFrame, form: str = "form") -> DataFrame:
    """Adds key (folded, single spaces, inner marks kept) and n (its words); forms without words are dropped."""
    n = F.regexp_count(F.col(form), F.lit(TOKEN))
    return aliases.withColumn("key", squeezed(F.col(form))).withColumn("n", n).filter("n > 0")


def longest_form(aliases: DataFrame) -> int:
    """Words in the longest alias, one number."""
    return aliases.agg(F.max("n")).first()[0] or 1


def token_tails(rows: DataFrame, text: str, keys: Sequence[str], words: int) -> DataFrame:
    """keys, i, span, _g (length of the gap before) and tail of each token: the text from it over ``words`` tokens.

    One pass over each text, and one row per token.
    """
    m = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    t = rows.select(*keys, m.alias("_m"), F.split(text, TOKEN, -1).alias("_s")).filter(F.size("_m") > 0)
    # Each token with the gap after it; the last gap is the end of the text.
    t = t.withColumn("_p", F.zip_with("_m", F.slice("_s", F.lit(2), F.size("_m")), lambda x, g: F.concat(x, g)))
    tail = lambda i: F.array_join(F.slice("_p", i + 1, F.lit(words)), "")
    items = F.transform("_m", lambda x, i: F.struct(x.alias("span"), F.length(F.get(F.col("_s"), i)).alias("g"), tail(i).alias("tail")))
    flat = t.select(*keys, F.posexplode(items).alias("i", "x"))
    return flat.select(*keys, "i", "x.span", F.col("x.g").alias("_g"), F.col("x.tail").alias("tail"))


def alias_starts(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tokens joined to the aliases that stand there: white space of any length between words, no letter or digit next to it."""
    first = F.regexp_extract("key", f"^{TOKEN}", 0)
    a = aliases.withColumn("_first", first)
    t = tokens.join(a, F.expr("_first") == folded(F.col("span")))
    here = F.regexp_replace(folded(F.col("tail")), r"\s+", " ")
    ends = ~F.substr(here, F.length("key") + 1, F.lit(1)).rlike(TOKEN)
    return t.filter(F.startswith(here, F.col("key")) & ends).drop("_first")


def one_entity(aliases: DataFrame) -> DataFrame:
    """label, key, n, entity, priority: of equal forms of a label the smallest (priority, entity) names the span."""
    return alias_keys(aliases).groupBy("label", "key", "n").agg(F.min_by("entity", F.struct("priority", "entity")).alias("entity"), F.min("priority").alias("priority"))


def dictionary_hits(rows: DataFrame, text: str, keys: Sequence[str], aliases: DataFrame) -> DataFrame:
    """keys, i (token), label, entity, priority of all places of aliases; nothing of the text is shuffled or sorted."""
    a = one_entity(aliases)
    return alias_starts(token_tails(rows, text, keys, longest_form(a)), a).select(*keys, "i", "label", "entity", "priority")


def dictionary_spans(rows: DataFrame, text: str, keys: Sequence[str], aliases: DataFrame, longest: int | None = None) -> DataFrame:
    """All places of aliases (label, entity, form, priority): keys, start, end, label, entity, priority.

    With ``longest``, which spares a look at the table, aliases of more words are left out.
    """
    a = one_entity(aliases)
    a = a if longest is None else a.filter(F.col("n") <= longest)
    t = token_tails(rows, text, keys, longest_form(a) if longest is None else longest)
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("start", F.sum(F.col("_g") + F.length("span")).over(before) - F.length("span"))
    whole = F.regexp_substr("tail", F.concat(F.lit(f"^{TOKEN}(?:{BETWEEN}{TOKEN}){{"), (F.col("n") - 1).cast("string"), F.lit("}")))
    found = alias_starts(t, a).withColumn("end", F.col("start") + F.length(whole))
    return found.select(*keys, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label", "entity", "priority")


def packed(spans: DataFrame, keys: Sequence[str], order: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Greedy packing per page: in the given total order a span stays if it overlaps none that stays.

    One group is one page's spans. Kept spans are searched by bisection.
    """
    from bisect import bisect_left

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([c.lstrip("-") for c in order], ascending=[not c.startswith("-") for c in order], kind="stable")
        starts: list[int] = []
        ends: list[int] = []
        keep = []
        for a, b in zip(part[start], part[end], strict=True):
            i = bisect_left(starts, a)
            free = (i == 0 or ends[i - 1] <= a) and (i == len(starts) or b <= starts[i])
            if free:
                starts.insert(i, a)
                ends.insert(i, b)
            keep.append(free)
        return part[keep]

    return spans.groupBy(*keys).applyInPandas(pack, spans.schema)


def leftmost(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """What a scanner with longest-first alternatives finds: at each place the longest, then on from its end."""

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([start, end], ascending=[True, False], kind="stable")
        keep, at = [], -1
        for a, b in zip(part[start], part[end], strict=True):
            keep.append(a >= at)
            at = b if a >= at else at
        return part[keep]

    return spans.groupBy(*keys).applyInPandas(scan, spans.schema)


def authority_spans(rows: DataFrame, text: str, keys: Sequence[str], aliases: DataFrame, longest: int | None = None, first: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Non-overlapping places of aliases: leftmost-longest within a label, then over labels the longest first.

    ``first`` has (name, pattern) of phrases that claim their text before all
    aliases, in their order, and are no entities.
    """
    found = leftmost(dictionary_spans(rows, text, keys, aliases, longest), [*keys, "label"]).withColumn("rank", F.lit(len(first)))
    for i, (name, pattern) in enumerate(first):
        hits = matches(rows, text, pattern, keys).select(*keys, "start", "end", F.lit("NOT_ENTITY").alias("label"), F.lit(name).alias("entity"), F.lit(0).alias("priority"), F.lit(i).alias("rank"))
        found = found.unionByName(hits)
    found = found.withColumn("size", F.col("end") - F.col("start"))
    return packed(found, keys, ["rank", "-size", "priority", "start", "label"]).drop("size", "rank")


def not_nested(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Drops spans inside one that starts before, or at the same place and is longer; of equal spans one stays."""
    w = Window.partitionBy(*keys).orderBy(start, F.desc(end), *[c for c in spans.columns if c not in (*keys, start, end)])
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col(end) > F.col("_reach"))).drop("_reach")


def merge_overlaps(rows: DataFrame, hits: DataFrame, keys: Sequence[str], weak: Column, linked: Column) -> DataFrame:
    """Hits replace rows they overlap, unless the row is linked and the hit weak: then the hit is left out.

    ``weak`` is over hits, ``linked`` over rows. Both have start and end.
    """
    h = hits.withColumn("_weak", weak).withColumn("_h", F.monotonically_increasing_id())
    r = rows.withColumn("_linked", linked)
    on = [F.col(f"r.{k}") == F.col(f"h.{k}") for k in keys]
    over = [*on, F.col("r.start") < F.col("h.end"), F.col("h.start") < F.col("r.end")]
    lost = h.alias("h").join(r.filter("_linked").alias("r"), [*over, F.col("h._weak")], "left_anti")
    kept = r.alias("r").join(lost.alias("h"), over, "left_anti")
    return kept.drop("_linked").withColumn("origin", F.lit("row")).unionByName(lost.drop("_weak", "_h").withColumn("origin", F.lit("hit")), allowMissingColumns=True)


def context_columns(rows: DataFrame, text: str, before: int, after: int) -> DataFrame:
    """Adds ``before`` and ``after``: the text next to a span."""
    low = F.greatest(F.lit(0), F.col("start") - before)
    return rows.withColumn("before", F.substr(F.col(text), low + 1, F.col("start") - low)).withColumn("after", F.substr(F.col(text), F.col("end") + 1, F.lit(after)))


def nearest_place(rows: DataFrame, text: str, span: str, expected: str) -> DataFrame:
    """Finds a span again in another text: all words with anything but word characters between, nearest to ``expected`` (0..1).

    Without such a place the span's longest word is looked for. Adds found_start, found_end.
    """
    import re

    out_schema = T.StructType([*rows.schema.fields, T.StructField("found_start", T.IntegerType()), T.StructField("found_end", T.IntegerType())])

    def find(text: str, span: str, share: float) -> tuple[int | None, int | None]:
        words = re.findall(r"\w+", span or "")
        if not words or not text:
            return None, None
        for pattern in (r"\W+".join(map(re.escape, words)), re.escape(max(words, key=len))):
            spots = [(m.start(), m.end()) for m in re.finditer(rf"(?<!\w){pattern}(?!\w)", text, re.IGNORECASE)]
            if spots:
                return min(spots, key=lambda s: abs(s[0] - share * len(text)))
        return None, None

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            spots = [find(t, s, e or 0.0) for t, s, e in zip(part[text], part[span], part[expected], strict=True)]
            part["found_start"] = pd.array([a for a, _ in spots], dtype="Int32")
            part["found_end"] = pd.array([b for _, b in spots], dtype="Int32")
            yield part

    return rows.mapInPandas(each, out_schema)
