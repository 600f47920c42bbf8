"""Text scalars as Spark columns: normal forms, keys, parts of names, context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ]"


def folded(s: Column) -> Column:
    """Lower case, with the two letters that case folding changes further."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "ß", "ss"), "ſ", "s")


def phrase_tokens(s: Column) -> Column:
    """Folded words of Latin letters; a possessive 's joins its word."""
    plain = F.regexp_replace(folded(F.coalesce(s, F.lit(""))), "['’]s\\b", "s")
    return F.regexp_extract_all(plain, F.lit(LETTERS + "+"), F.lit(0))


def normalized_phrase(s: Column) -> Column:
    return F.array_join(phrase_tokens(s), " ")


def match_key(s: Column, given: Mapping[str, str]) -> Column:
    """The phrase before ``. `` if two words precede it, with given names in their standard form."""
    head = F.when(F.size(phrase_tokens(F.substring_index(s, ". ", 1))) >= 2, F.substring_index(s, ". ", 1)).otherwise(s)
    names = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else None
    tokens = phrase_tokens(head)
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.get(F.array(names[t]), F.lit(0)), t)) if given else tokens, " ")


def skeleton(word: Column) -> Column:
    """Spelling key: one letter for v and u, j, y and i; single consonants; no plural ending if four letters stay.

    A c before a, o, u, k or l is a k, and so is a c before that one.
    """
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    w = F.translate(w, "vjyw", "uiiu")
    for old, new in (("ph", "f"), ("ck", "k"), ("q", "k")):
        w = F.replace(w, F.lit(old), F.lit(new))
    for _ in range(2):
        w = F.regexp_replace(w, "c(?=[aoukl])", "k")
    w = F.regexp_replace(w, r"(.)\1+", "$1")
    cut = [F.when(w.endswith(end) & (F.length(w) - len(end) >= 4), F.expr("1") * 0 + len(end)) for end in ("ies", "es", "s")]
    return F.left(w, F.length(w) - F.coalesce(*cut, F.lit(0)))


def surname_shape(surname: Column) -> Column:
    return skeleton(F.replace(F.lower(surname), F.lit("ff"), F.lit("f")))


def name_parts(name: Column, titles: Sequence[str]) -> Column:
    """struct(given, surname) of a name without its leading title; given is empty for one word."""
    bare = F.trim(F.regexp_replace(name, r"(?i)^(?:" + "|".join(titles) + r")[.:’'*]*\s+", ""))
    words = F.filter(F.split(F.trim(bare), r"\s+"), lambda x: x != "")
    last = F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
    return F.struct(F.array_join(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), " ").alias("given"), last.alias("surname"))


def dehyphenate(s: Column) -> Column:
    """Joins words broken by a hyphen and white space before a lower-case letter."""
    return F.regexp_replace(s, r"(?<=[A-Za-z])-\s+(?=[a-z])", "")


def removed_by_dehyphenation(s: Column) -> Column:
    """array of (at, n): places in the joined text and the characters dropped there, to map offsets back."""
    p = r"(?<=[A-Za-z])-\s+(?=[a-z])"
    gaps = F.regexp_extract_all(s, F.lit(p), F.lit(0))
    parts = F.slice(F.split(s, p, -1), F.lit(1), F.size(gaps))
    ends = F.transform(F.sequence(F.lit(1), F.size(gaps)), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)))
    zipped = F.arrays_zip(ends.alias("at"), F.transform(gaps, lambda g: F.length(g)).alias("n"))
    return F.when(F.size(gaps) > 0, zipped).otherwise(F.array().cast("array<struct<at:int,n:int>>"))


def normalized_gap(s: Column) -> Column:
    """Text between mentions: lower case, hyphens joined, scribal with/the/that expanded, marks dropped, spaces squeezed."""
    steps = [
        (r"(?<=[a-z])-\s*\n\s*(?=[a-z])", ""),
        (r"\bw[™*'’]+(?:h|t)?\b|\bwth\b|\bw'h\b", "with"),
        (r"\by[°®*e]\b|\by°", "the"),
        (r"\byt\b", "that"),
        (r"[™*§|°®¢€]+", ""),
        (r"\s+", " "),
    ]
    return F.trim(reduce(lambda c, kv: F.regexp_replace(c, *kv), steps, F.lower(s)))


def leading_words_length(s: Column, stop: Sequence[str]) -> Column:
    """Characters of the leading stopwords, their white space included."""
    return F.length(F.regexp_extract(s, r"(?i)^(?:(?:" + "|".join(stop) + r")\s+)*", 0))


def title_and_name(span: Column, titles: str) -> Column:
    """struct(title, name) for a span that may start with a title (a pattern); m' and its like become Mr."""
    title = F.regexp_extract(span, rf"(?i)^({titles})(?=[\s,;:—–-]|$)", 1)
    name = F.trim(F.regexp_replace(F.substr(span, F.length(title) + 1), r"^[\s,;:—–-]+", ""))
    return F.struct(F.when(title.rlike(r"(?i)^m[’'*]+$|^mt$"), "Mr").otherwise(title).alias("title"), name.alias("name"))


def clean_name(s: Column) -> Column:
    """Without editor's marks and outer punctuation, spaces squeezed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[\[\]()]", ""), r"\s+", " "), r"^[ .,:;]+|[ .,:;]+$", "")


def clean_alias(s: Column) -> Column:
    """Spaces squeezed, without outer spaces, commas, full stops and semicolons."""
    return F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" ,.;"))


def clean_form(s: Column) -> Column:
    """A spelling without the marks of insertions (§ and ||) and without outer punctuation, spaces squeezed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(s, r"§|\|\|", ""), r"\s+", " "), F.lit(" ,.;:-'’"))


def name_of(name: Column, span: Column, titles: str) -> Column:
    """The name where there is one; else the span without leading titles (a pattern) if two words stay, else the whole span."""
    flat = F.btrim(F.regexp_replace(span, r"\s+", " "))
    bare = F.regexp_replace(flat, rf"^(?:(?i:{titles})(?![A-Za-z])\s*[,;:—–-]?\s*)+", "")
    return F.when(F.coalesce(name, F.lit("")) != "", name).when(F.regexp_count(bare, F.lit("[A-Za-z]{2,}")) >= 2, bare).otherwise(flat)


def standard_name(name: Column, given: Mapping[str, str]) -> Column:
    """First and last word of a name, the given name in its standard form, ``ff`` as ``F``; unchanged for one word."""
    words = F.regexp_extract_all(name, F.lit(LETTERS + "+"), F.lit(0))
    first = F.lower(F.get(words, F.lit(0)))
    if given:
        names = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
        first = F.coalesce(F.get(F.array(names[first]), F.lit(0)), first)
    last = F.try_element_at(words, F.lit(-1))
    last = F.when(F.lower(last).startswith("ff"), F.concat(F.lit("F"), F.substr(last, F.lit(3)))).otherwise(F.concat(F.upper(F.left(last, F.lit(1))), F.substr(last, F.lit(2))))
    first = F.concat(F.upper(F.left(first, F.lit(1))), F.lower(F.substr(first, F.lit(2))))
    return F.when(F.size(words) < 2, name).otherwise(F.concat_ws(" ", first, last))


def passage(text: Column, start: Column, end: Column) -> Column:
    """The text around a span between the nearest full stops, semicolons or blank lines; the closing mark stays."""
    marks = (".", ";", "\n\n")
    head, tail = F.left(text, start), F.substr(text, end + 1)
    before = F.least(*(F.length(F.substring_index(head, m, -1)) for m in marks))
    after = F.coalesce(F.least(*(F.nullif(F.instr(tail, m), F.lit(0)) for m in marks)), F.length(tail))
    return F.regexp_replace(F.substr(text, start - before + 1, before + (end - start) + after), r"^\s+|\s+$", "")


def bracketed(sentence: Column, span: Column) -> Column:
    """The first place of ``span`` in double brackets; unchanged where it does not occur."""
    at = F.locate(span, sentence) if isinstance(span, str) else F.position(span, sentence)
    marked = F.concat(F.left(sentence, at - 1), F.lit("[["), span, F.lit("]]"), F.substr(sentence, at + F.length(span)))
    return F.when(at > 0, marked).otherwise(sentence)


def clip(s: Column, n: int) -> Column:
    """At most n characters, cut after a whole word, with an ellipsis."""
    flat = F.trim(F.regexp_replace(s, r"\s+", " "))
    head = F.left(flat, F.lit(n))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit(" …")))


def form_pattern(form: str) -> str:
    """Pattern of an alias: any white space between words, no letter or digit next to it."""
    import re

    return r"(?<![\p{L}\p{N}])(?i:" + r"\s+".join(re.escape(x) for x in form.split()) + r")(?![\p{L}\p{N}])"


def geographic_shape(s: Column, first: Sequence[str], last: Sequence[str]) -> Column:
    """Whether a phrase of two words or more starts or ends with a geographic word."""
    t = phrase_tokens(s)
    return (F.size(t) > 1) & (F.coalesce(F.get(t, F.lit(0)).isin(list(first)), F.lit(False)) | F.coalesce(F.try_element_at(t, F.lit(-1)).isin(list(last)), F.lit(False)))


def geographic_context(s: Column, sentence: Column, prepositions: Sequence[str], features: Sequence[str], reach: int = 3) -> Column:
    """Whether a place preposition is within ``reach`` tokens before the phrase, or a feature word around it."""
    t, own = phrase_tokens(sentence), phrase_tokens(s)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - F.size(own) + 1)), lambda i: F.slice(t, i, F.size(own)) == own)

    def near(i: Column) -> Column:
        low = F.greatest(F.lit(1), i - reach)
        before = F.slice(t, low, i - low)
        after = F.slice(t, i + F.size(own), F.lit(reach))
        words = lambda values: F.array(*(F.lit(v) for v in values))
        return F.arrays_overlap(before, words(prepositions)) | F.arrays_overlap(F.concat(before, after), words(features))

    return (F.size(own) > 0) & F.exists(places, near)


def denied(s: Column, phrases: Sequence[str], first: Sequence[str] = (), last: Sequence[str] = (), but: Sequence[str] = ()) -> Column:
    """Whether a phrase is on a deny-list, or its first or last word is, unless it is in ``but``."""
    t = phrase_tokens(s)
    p = F.array_join(t, " ")
    edge = F.coalesce(F.get(t, F.lit(0)), F.lit("")).isin(list(first)) | F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit("")).isin(list(last))
    return (p.isin(list(phrases)) | edge) & ~p.isin(list(but))


def index_ratio(s: Column) -> Column:
    """Share of non-blank lines that end in page references."""
    number = r"(?:[IV]{1,3}[,.]\s*)?\d{1,3}(?:\s*[-–]\s*\d{1,3})?"
    lines = F.filter(F.split(s, "\n", -1), lambda x: F.trim(x) != "")
    hits = F.filter(lines, lambda x: x.rlike(rf"[,.]\s*{number}(?:\s*[,;]\s*{number})*\s*[.;,]?\s*$"))
    return F.when(F.size(lines) == 0, F.lit(0.0)).otherwise(F.size(hits) / F.size(lines))


def is_list_line(line: Column, allowed: Sequence[str]) -> Column:
    """A line of names: under 35% and under four of its words of three letters are lower-case prose."""
    content = F.filter(F.regexp_extract_all(line, F.lit(LETTERS + "+"), F.lit(0)), lambda w: F.length(w) >= 3)
    prose = F.filter(content, lambda w: w.rlike(r"^\p{Ll}") & ~F.lower(w).isin(list(allowed)))
    return (F.size(content) == 0) | ((F.size(prose) < 4) & (F.size(prose) < F.lit(0.35) * F.size(content)))


def first_line(s: Column) -> Column:
    """The first non-blank line, trimmed; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(s, "\n", -1), lambda x: F.btrim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))


def printed_number(s: Column) -> Column:
    """A number of one to three digits at the end, else the start, of the first non-blank line."""
    line = first_line(s)
    end, start = F.regexp_extract(line, r"(?<!\d)(\d{1,3})\W*$", 1), F.regexp_extract(line, r"^\W*(\d{1,3})(?!\d)", 1)
    return F.coalesce(F.nullif(end, F.lit("")), F.nullif(start, F.lit(""))).try_cast("int")


def word_set(s: Column, least: int = 4) -> Column:
    """Distinct words of at least ``least`` letters a-z, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """|A and B| over the smaller set's size; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))
