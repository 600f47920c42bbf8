"""Mentions: decisions on authority spans, titled and shaped names, groups and discovered places."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import lexicon as V
from inkwell.functions.text import dehyphenate, folded, geographic_context, phrase_tokens, title_and_name
from inkwell.operators import fuzzy, spans


def title_class(before: Column) -> Column:
    """Class of the territorial title that ends the text before a place, the first that fits."""
    return reduce(lambda c, kv: c.when(before.rlike(rf"(?i)\b{kv[1]}"), kv[0]), V.TERRITORIAL, F.when(F.lit(False), ""))


def titled(rows: DataFrame, before: Column) -> DataFrame:
    """Adds title: a territorial class, or a personal title right before the span."""
    personal = F.nullif(F.lower(F.regexp_extract(before, rf"(?i)(?:^|\W)({V.TITLES})\s*[,;:—–-]?\s*$", 1)), F.lit(""))
    return rows.withColumn("title", F.coalesce(title_class(before), personal))


def suggested_person(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds person: the first rule (place_id, title, volumes, person, ord) for a place, its title class and the volume.

    The rules are a curated list; without volumes a rule holds for all.
    """
    hit = F.expr("r.place_id = m.place_id and r.title = m.title and (r.volumes is null or array_contains(r.volumes, m.volume))")
    m = rows.withColumn("_id", F.monotonically_increasing_id())
    first = m.alias("m").join(rules.alias("r"), hit).groupBy("_id").agg(F.min_by("r.person", "r.ord").alias("person"))
    return m.join(first, "_id", "left").drop("_id")


def looks_like_person(span: Column, has_title: Column) -> Column:
    """Shape of a name: with a title a capital word after it, else two or three capital words, none an office or commodity."""
    flat = F.trim(F.regexp_replace(span, r"\s+", " "))
    flat = F.regexp_replace(flat, r"(?i)(?<=\S\s\S{1,30})\s(?:" + "|".join(V.TRADES) + r")[.,]*$", "")
    words = F.regexp_extract_all(flat, F.lit("[A-Za-z’']+"), F.lit(0))
    own = F.when(has_title, F.slice(words, 2, F.greatest(F.lit(1), F.size(words) - 1))).otherwise(words)
    bad = F.exists(own, lambda w: F.btrim(F.lower(w), F.lit("’'")).isin(V.NON_NAMES)) | F.forall(own, lambda w: F.length(w) <= 2)
    shape = F.when(has_title, flat.rlike(r"\s(?:\p{Lu}[\p{L}’'.-]+|ff[a-z]{2,})")).otherwise(flat.rlike(r"^\p{Lu}[\p{L}’'.-]+(?:\s\p{Lu}[\p{L}’'.-]*)?\s(?:\p{Lu}|ff)[\p{L}’'.-]+$"))
    return shape & ~bad


def trimmed(span: Column) -> Column:
    """A model's span without what runs on from a name: leaders, amounts, the next paragraph, closing marks."""
    cut = F.regexp_extract(span, r"(?s)^(.+?)(?:_+|\s*\n\s*\n|\s+\d|[-.~]{3,}|\s*[-—–]{2,}|$)", 1)
    return F.regexp_replace(cut, r"[ .,:;'’]+$", "")


def extension(span: Column, after: Column, has_title: Column) -> Column:
    """Characters by which a cut name goes on: after a hyphen, a short given name, or a title and one name."""
    short = r"(?i)\b(?:" + "|".join(V.SHORT_NAMES) + ")$"
    word = lambda p: F.regexp_extract(after, p, 0)
    known = lambda s: F.lower(F.regexp_extract(s, r"([\p{L}’']+)$", 1)).isin(V.NON_NAMES)
    given, surname = word(r"^[?:.’']*\s*(?:ff|[A-Z])[A-Za-z’']{2,}"), word(r"^[^\S\n]*\n?[^\S\n]*(?<=\s)[A-Z][a-z]{2,}\b")
    two = F.regexp_count(span, F.lit("[A-Za-z’']{2,}")) == 2
    return (
        F.when(span.endswith("-"), F.length(word(r"^\s+[a-z]{2,}")))
        .when(span.rlike(short) & (given != "") & ~known(given), F.length(given))
        .when(has_title & two & (surname != "") & ~known(surname), F.length(surname))
        .otherwise(0)
    )


def decided(found: DataFrame, before: Column, after: Column) -> DataFrame:
    """Label and reason of authority spans from the text around them, in this order."""
    place = F.col("label") == "PLACE"
    company = after.rlike(r"(?i)^\W{0,4}(?:courte?|co\b|compan(?:y|ie|ies)|societ(?:y|ie))") | before.rlike(r"(?i)\bcompan(?:y|ie|ies)\s+of\s+(?:the\s+)?$")
    ship = after.rlike(r"(?i)^\W{0,3}(?:being\s+a\s+(?:new\s+)?(?:shipp?|pinnace)|shipp?)\b")
    latin = before.rlike(r"(?i)\b(?:dno|dño|domin(?:o|um|us)|dom)\.?\s*$")
    territorial = title_class(before)
    reason = (
        F.when(F.col("label") == "NOT_ENTITY", "not_entity")
        .when(place & territorial.isNotNull(), F.concat(F.lit("title_"), territorial))
        .when(place & company, "company")
        .when(place & latin, "latin_name")
        .when(place & ship, "ship")
        .otherwise("authority")
    )
    label = F.when(reason == "authority", F.col("label")).when(reason.startswith("title_") | (reason == "latin_name"), "PERSON").otherwise("NOT_ENTITY")
    return found.select(*[c for c in found.columns if c != "label"], label.alias("label"), reason.alias("source"))


def entries(people: DataFrame, contextual: DataFrame, places: DataFrame, excluded: DataFrame, place_excluded: DataFrame) -> DataFrame:
    """The matcher's entries: label, entity, form, priority and ord; of equal forms the smallest (priority, ord) counts.

    ``people`` has person and aliases, ``contextual`` ord and form, ``places`` place_id and aliases (arrays),
    ``excluded`` and ``place_excluded`` name and reason. Contextual forms come first. People's forms of one word
    count only if they are known to stand alone. Excluded names are no entities if their reason says that they
    are no person, places' ones unless they are compounds of places.
    """
    flat = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))
    row = lambda label, entity, form, priority, ord_: [F.lit(label).alias("label"), entity.alias("entity"), flat(form).alias("form"), F.lit(priority).alias("priority"), F.lit(ord_).alias("ord")]
    named = people.select("person", F.explode(F.array_union(F.array("person"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    alone = (F.size(F.split(flat(F.col("form")), " ")) > 1) | F.lower(flat(F.col("form"))).isin(V.SINGLE_NAMES)
    parts = [
        contextual.select(*row("PERSON", F.concat(F.lit("CONTEXT:"), F.col("ord").cast("string")), F.col("form"), 0, 0)),
        named.filter(alone).select(*row("PERSON", F.col("person"), F.col("form"), 0, 1)),
        places.select("place_id", F.explode("aliases").alias("form")).select(*row("PLACE", F.col("place_id"), F.col("form"), 0, 2)),
    ]
    none = excluded.filter(F.col("reason").rlike(V.NO_PERSON_REASON)).select("name")
    none = none.unionByName(place_excluded.filter(~F.startswith(F.lower("reason"), F.lit("compound"))).select("name"))
    general = F.explode(F.array(*map(F.lit, V.NO_ENTITIES)))
    none = none.unionByName(none.sparkSession.range(1).select(general.alias("name"))).distinct()
    parts.append(none.select(*row("NOT_ENTITY", F.lit(""), F.col("name"), 1, 3)))
    return reduce(DataFrame.unionByName, parts).filter("form <> ''").distinct()


def surnames(people: DataFrame) -> DataFrame:
    """Distinct surnames: last words of names and aliases of two words or more before a comma, without any ``of``."""
    names = people.select(F.explode(F.array_union(F.array("person"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    words = phrase_tokens(F.substring_index("name", ",", 1))
    return names.select(words.alias("w")).filter((F.size("w") >= 2) & ~F.array_contains("w", "of")).select(F.element_at("w", -1).alias("surname")).distinct()


def bare_surnames(found: DataFrame, names: DataFrame, places: DataFrame, sentence: Column, prepositions: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Place spans of one word that are known surnames of an ambiguous place, without a place's context: to be left out.

    ``found`` has entity and span, ``places`` place_id and matching_policy.
    """
    policy = places.filter("matching_policy = 'ambiguous_contextual'").select(F.col("place_id").alias("_place"))
    one = found.filter((F.col("label") == "PLACE") & ~F.btrim("span").rlike(r"\s")).join(policy, F.col("entity") == F.col("_place"), "left_semi")
    one = one.join(names.select(F.col("surname").alias("_s")), F.lower("span") == F.col("_s"), "left_semi")
    return one.filter(~geographic_context(F.col("span"), sentence, prepositions, features))


def trim_span(observed: Column) -> Column:
    """A span cut to the titled name, or the name of capital words, that it begins with, without outer marks."""
    bare = F.btrim(observed, F.lit(" \t\n\r.,;:!?()[]{}\"“”"))
    word = r"(?:\p{Lu}[\p{L}’'.-]+|ff[a-z]{2,})"
    title = F.regexp_extract(bare, rf"^(?i:{V.TITLES})\s+{word}(?:\s+{word})?", 0)
    name = F.regexp_extract(bare, rf"^{word}(?:\s+{word}){{1,2}}", 0)
    return F.rtrim(F.coalesce(F.nullif(title, F.lit("")), F.nullif(name, F.lit("")), bare), F.lit(" .,:;!?)]}"))


def cleaned(mentions: DataFrame) -> DataFrame:
    """Mentions (page_id, start, end, span) trimmed and labelled anew; ids and offsets follow the trimmed span.

    Adds raw_span, span_was_trimmed, title, name_string, label and mention_kind. A span that is a role,
    a body or no entity has the label of that word; one word, or a title, is a reference to a person.
    """
    m = mentions.withColumn("raw_span", F.col("span")).withColumn("span", trim_span(F.col("span")))
    m = m.withColumn("start", (F.col("start") + F.position("span", "raw_span") - 1).cast("int")).withColumn("end", (F.col("start") + F.length("span")).cast("int"))
    m = m.withColumn("span_was_trimmed", F.col("span") != F.col("raw_span"))
    parts = title_and_name(F.col("span"), V.TITLES)
    m = m.withColumn("title", F.nullif(parts["title"], F.lit(""))).withColumn("name_string", F.btrim(parts["name"], F.lit(" ,;:")))
    roles = F.create_map(*(F.lit(x) for kv in V.ROLE_LABELS.items() for x in kv))
    key = F.lower("span")
    role = F.get(F.array(F.try_element_at(roles, key)), F.lit(0))
    one = ~F.col("name_string").rlike(r"\s")
    empty = F.col("title").isNotNull() & F.lower("name_string").isin("the", "one", "of")
    kind = F.when(role == "TITLE_OR_ROLE", "role_reference").when(role.isNotNull(), "relational_reference").when(empty, "role_reference")
    kind = kind.when(F.col("title").isNotNull(), "title_surname").when(one, "surname_only").otherwise("explicit_name")
    label = F.when(role.isNotNull(), role).when(empty, "TITLE_OR_ROLE").when(one | F.col("title").isNotNull(), "PERSON_REF").otherwise("PERSON_NAME")
    nobody = role.isin("TITLE_OR_ROLE", "EDITORIAL_REFERENCE", "NOT_ENTITY")
    title = F.when(key.isin("deputy", "deputie"), "Deputy").when(role == "TITLE_OR_ROLE", F.col("span")).when(~F.coalesce(nobody, F.lit(False)), F.col("title"))
    m = m.withColumn("label", label).withColumn("mention_kind", kind).withColumn("_title", title)
    m = m.withColumn("name_string", F.when(~(F.coalesce(nobody, F.lit(False)) | empty), F.col("name_string"))).withColumn("title", F.col("_title")).drop("_title")
    return m.withColumn("mention_id", F.format_string("%s-M%05d-%05d", F.col("page_id"), F.col("start"), F.col("end")))


def note_mentions(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions in margin notes (page_id, margin_notes of text): page_id, note_index, note_kind, and those of ``extract``.

    Contextual aliases are left out, as a note has no page around it. A note of three entries
    of an attendance list is a piece of one.
    """
    notes = pages.select("page_id", F.posexplode("margin_notes").alias("note_index", "note")).select("page_id", "note_index", F.col("note.text").alias("text"))
    kind = F.when(F.regexp_count("text", F.lit(V.LIST_ENTRY)) >= 3, "attendance_fragment").otherwise("summary")
    keyed = notes.select(F.concat_ws("#", "page_id", F.col("note_index").cast("string")).alias("page_id"), "text")
    found = extract(keyed, aliases.filter(~F.startswith("entity", F.lit("CONTEXT:")))).filter("label <> 'NOT_ENTITY'").withColumnRenamed("page_id", "_key")
    info = notes.withColumn("note_kind", kind).withColumn("_key", F.concat_ws("#", "page_id", F.col("note_index").cast("string"))).drop("text")
    return info.join(found, "_key").drop("_key", "mention_id")


def extract(pages: DataFrame, aliases: DataFrame, longest: int | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Mentions of pages (page_id, text): page_id, start, end, span, label, entity, source.

    Authority spans are decided on their context. Titled names, then names of a
    known given name's shape, are taken from text that nothing has taken.
    ``extra`` are spans of an outside model (page_id, start, end, label); they come
    after the authority's and have to look like a name.
    """
    text = pages.select("page_id", "text")
    authority = spans.authority_spans(pages, "text", ["page_id"], aliases, longest, V.STYLES)
    authority = spans.context_columns(authority.join(text, "page_id"), "text", 40, 40)
    out = decided(authority, F.col("before"), F.col("after")).select("page_id", "start", "end", "label", "entity", "source")
    passes = [(spans.matches(pages, "text", rf"(?<![A-Za-z])(?i:{V.TITLES})[ \t]+(?:\p{{Lu}}[\p{{L}}’']+|ff[a-z]{{2,}})(?:[ \t]+(?:\p{{Lu}}[\p{{L}}’']+|ff[a-z]{{2,}}))?", ["page_id"]), "title", True)]
    if extra is not None:
        model = spans.context_columns(extra.filter("label = 'PERSON'").join(text, "page_id"), "text", 40, 40)
        own = trimmed(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
        more = F.when(F.length(own) == F.col("end") - F.col("start"), extension(own, F.col("after"), F.lit(False))).otherwise(0)
        model = model.withColumn("end", (F.col("start") + F.length(own) + more).cast("int"))
        model = model.select("page_id", "start", "end", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("span"))
        passes.insert(0, (model, "model", False))
    for found, source, has_title in passes:
        names = found.filter(looks_like_person(F.col("span"), F.lit(has_title)))
        taken = out.select(F.col("page_id").alias("_p"), F.col("start").alias("_a"), F.col("end").alias("_b"))
        free = names.join(taken, (F.col("page_id") == F.col("_p")) & (F.col("_a") < F.col("end")) & (F.col("start") < F.col("_b")), "left_anti")
        out = out.unionByName(free.select("page_id", "start", "end", F.lit("PERSON").alias("label"), F.lit(None).cast("string").alias("entity"), F.lit(source).alias("source")))
    out = out.join(text, "page_id").withColumn("span", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
    mention = F.format_string("%s-N%05d-%05d", F.col("page_id"), F.col("start"), F.col("end"))
    return out.select(mention.alias("mention_id"), "page_id", "start", "end", "span", "label", "entity", "source")


def groups(pages: DataFrame, lexicon: DataFrame, exclusions: Sequence[str] = (), rejected: Sequence[str] = ()) -> DataFrame:
    """Mentions of groups of a lexicon (category, entity, seed, homonym, exact_only): exact, variant or fuzzy spellings, with a reading.

    Passes claim their text in turn: names of several words, phrases that are no
    group, collective terms, names of one word, and titles in lower case. Words broken over
    lines are joined first, so places are those of the joined text. Single words are
    looked up as distinct words, once for the corpus; ``rejected`` spellings never match.
    """
    joined = pages.select("page_id", dehyphenate(F.col("text")).alias("text"))
    several = F.size(F.split(F.btrim("seed"), r"\s+")) > 1
    collective = F.col("category") == "collective"
    phrase = lambda rows, label: rows.select(F.lit(label).alias("label"), "entity", F.col("seed").alias("form"), F.lit(0).alias("priority"))
    none = lexicon.sparkSession.createDataFrame([(x, x) for x in exclusions], "entity string, seed string")
    exact = phrase(lexicon.filter(several & ~collective), "0").unionByName(phrase(none, "1")).unionByName(phrase(lexicon.filter(collective), "2"))
    phrases = spans.dictionary_spans(joined, "text", ["page_id"], exact).withColumn("rank", F.col("label").cast("int"))
    phrases = phrases.select("page_id", "start", "end", "rank", F.lit(None).cast("string").alias("word"), "entity", F.lit("exact").alias("match_type"), F.lit(1.0).alias("score"))
    words = spans.matches(joined, "text", r"\p{L}{4,}", ["page_id"]).withColumnRenamed("span", "word")
    single = lexicon.filter(~several & ~collective)
    found = fuzzy.lookup(words, single.select("entity", "seed", "exact_only"), rejected=rejected)
    kinds = lexicon.groupBy("entity").agg(F.first("category").alias("category"), F.max("homonym").alias("homonym"))
    capital = F.col("word").rlike(r"^\p{Lu}")
    hits = words.join(found, "word").join(kinds.select("entity", "category"), "entity").filter(capital | (F.col("category") == "title") & (F.col("score") >= 0.9))
    hits = hits.select("page_id", "start", "end", F.when(capital, 3).otherwise(4).alias("rank"), "word", "entity", "match_type", "score")
    kept = spans.packed(phrases.unionByName(hits), ["page_id"], ["rank", "start", "end", "entity"]).filter("rank <> 1")
    kept = kept.join(kinds, "entity").join(joined, "page_id")
    kept = spans.context_columns(kept, "text", 40, 20).withColumn("word", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
    plural = F.col("word").rlike("s$") & ~F.col("entity").rlike("s$")
    reading = fuzzy.reading(F.col("category"), F.col("homonym"), plural, F.col("before"), F.col("after"))
    return kept.select("page_id", "start", "end", "word", "entity", "category", "match_type", "score", F.when(F.col("rank") == 0, F.col("category")).otherwise(reading).alias("reading"))


def discovered(hits: DataFrame, page: str, least: int, most_forms: int = 8) -> DataFrame:
    """Groups shape hits (page, span) by folded form: key, n, pages, forms by frequency, first page."""
    forms = hits.groupBy(folded(F.col("span")).alias("key"), "span").agg(F.count("*").alias("c"))
    shown = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "span"))), 1, most_forms), lambda x: x["span"])
    g = hits.groupBy(folded(F.col("span")).alias("key")).agg(F.count("*").alias("n"), F.count_distinct(page).alias("pages"), F.min(page).alias("first"))
    return g.filter(F.col("n") >= least).join(forms.groupBy("key").agg(shown.alias("forms")), "key")


def flagged(groups_: DataFrame, people: DataFrame, surnames: DataFrame, lower: DataFrame) -> DataFrame:
    """Adds conflict flags to discovered groups: a known person's form, a surname, a word mostly in lower case."""
    mark = lambda df, name: df.select(F.col("key")).distinct().withColumn(name, F.lit(True))
    out = groups_
    for df, name in ((people, "person_form"), (surnames, "surname"), (lower, "common_word")):
        out = out.join(mark(df, name), "key", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    level = F.when(F.col("person_form") | F.col("common_word"), "low").when(F.col("surname") | (F.col("pages") < 2), "medium").otherwise("high")
    return out.withColumn("confidence", level)


def page_matches(pages: DataFrame, places: DataFrame, longest: int | None = None) -> DataFrame:
    """All places of aliases (place_id, form) that are not nested in an earlier one; partial overlaps stay."""
    a = places.select(F.lit("PLACE").alias("label"), F.col("place_id").alias("entity"), "form", F.lit(0).alias("priority"))
    return spans.not_nested(spans.dictionary_spans(pages, "text", ["page_id"], a, longest), ["page_id"])


def untitled_alias(rows: DataFrame, span: str, aliases: DataFrame) -> DataFrame:
    """Person rows x places: the first alias (place_id, form, pattern) found in the span that no title precedes.

    Spans meet the aliases that begin with one of their words, and patterns test these.
    """
    word = lambda c: F.regexp_extract_all(folded(c), F.lit(spans.TOKEN), F.lit(0))
    keyed = aliases.withColumn("_word", F.get(word(F.col("form")), F.lit(0)))
    r = rows.withColumn("_word", F.explode(F.array_distinct(word(F.col(span)))))
    found = r.join(keyed, "_word").drop("_word").filter(F.expr(f"{span} rlike pattern") & ~F.col(span).rlike(rf"(?i)^(?:{V.TITLES})\s"))
    return found.withColumn("_i", F.row_number().over(Window.partitionBy(*rows.columns, "place_id").orderBy(F.desc(F.length("form")), "form"))).filter("_i = 1").drop("_i", "pattern")
