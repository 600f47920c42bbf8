"""Page layout from OCR words, and matching pages of two editions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import overlap, word_set

GAP, WIDE, SMALL, LOWER = 0.04, 0.45, 0.8, 0.62
WORDS = "leaf int, block int, par int, line int, word int, text string, x0 int, y0 int, x1 int, y1 int, conf int"


def box(title: str) -> tuple[int, int, int, int] | None:
    """x0, y0, x1, y1 of a ``bbox`` entry."""
    for part in title.split(";"):
        f = part.split()
        if f[:1] == ["bbox"] and len(f) >= 5:
            return tuple(int(float(x)) for x in f[1:5])  # type: ignore[return-value]
    return None


class Page(HTMLParser):
    """Words of an hOCR page with the ordinals of their block, paragraph and line. Other elements with text are lines without boxes."""

    KINDS = {"ocr_carea": "block", "ocr_par": "par", "ocr_line": "line", "ocr_header": "line", "ocr_textfloat": "line", "ocr_caption": "line"}

    def __init__(self) -> None:
        super().__init__()
        self.at = {"block": 0, "par": 0, "line": 0}
        self.words: list[list] = []
        self.open: list | None = None
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        kind = a.get("class") or ""
        if kind in self.KINDS:
            self.at[self.KINDS[kind]] += 1
        if self.open is not None:
            self.depth += 1
        elif kind == "ocrx_word":
            title = a.get("title") or ""
            conf = next((int(float(p.split()[1])) for p in title.split(";") if p.split()[:1] == ["x_wconf"]), 0)
            self.open, self.depth = [*self.at.values(), "", *(box(title) or (0, 0, 0, 0)), conf], 1

    def handle_endtag(self, tag: str) -> None:
        if self.open is not None:
            self.depth -= 1
            if self.depth <= 0:
                self.open[3] = self.open[3].strip()
                if self.open[3]:
                    self.words.append(self.open)
                self.open = None

    def handle_data(self, data: str) -> None:
        if self.open is not None:
            self.open[3] += data


def ocr_words(pages: DataFrame, leaf: str, html: str) -> DataFrame:
    """One row per word of hOCR pages; blank words are dropped."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for n, text in zip(part["leaf"], part["html"], strict=True):
                p = Page()
                p.feed(text or "")
                rows += [(n, b, r, i, k, *rest) for k, (b, r, i, *rest) in enumerate(p.words)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WORDS.split(", ")])

    return pages.select(F.col(leaf).cast("int").alias("leaf"), F.col(html).alias("html")).mapInPandas(parse, WORDS)


class Lines(HTMLParser):
    """Visible text of any HTML by the tag that holds it."""

    HIDDEN = {"script", "style", "head", "title"}

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[str] = []
        self.rows: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in ("br", "img", "meta", "link", "hr", "input"):
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if data.strip() and not self.HIDDEN & set(self.stack):
            self.rows.append((self.stack[-1] if self.stack else "", " ".join(data.split())))


def html_lines(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, i, tag, text of the visible lines of HTML pages."""
    schema = f"key {pages.schema[key].dataType.simpleString()}, i int, tag string, text string"

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for n, text in zip(part["key"], part["html"], strict=True):
                p = Lines()
                p.feed(text or "")
                rows += [(n, i, tag, line) for i, (tag, line) in enumerate(p.rows)]
            yield pd.DataFrame(rows, columns=["key", "i", "tag", "text"])

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(parse, schema)


def line_segments(words: DataFrame, width: str = "width") -> DataFrame:
    """Splits lines where the room between two words is over GAP of the page's width: box, median height, text, mean confidence."""
    w = Window.partitionBy("leaf", "block", "par", "line").orderBy("x0", "word")
    new = F.when(F.col("x0") - F.lag("x1").over(w) > F.lit(GAP) * F.col(width), 1).otherwise(0)
    t = words.withColumn("_n", new).withColumn("part", F.sum("_n").over(w))
    words_in_order = F.array_sort(F.collect_list(F.struct("x0", "word", "text")))
    out = t.groupBy("leaf", width, "block", "par", "line", "part").agg(
        *(F.min(c).alias(c) for c in ("x0", "y0")),
        *(F.max(c).alias(c) for c in ("x1", "y1")),
        F.median(F.col("y1") - F.col("y0")).alias("height"),
        F.avg("conf").alias("conf"),
        words_in_order.alias("_w"),
    )
    return out.withColumn("text", F.array_join(F.transform("_w", lambda x: x["text"]), " ")).drop("_w")


def classify(segments: DataFrame, head: str, width: str = "width", page_height: str = "page_height") -> DataFrame:
    """Adds role: head (matches ``head`` at the top), footnote (small type at the foot), margin (outside the wide lines), or body.

    The text block is the median of the wide segments of a page; a page without any has body only.
    """
    wide = segments.filter(F.col("x1") - F.col("x0") > F.lit(WIDE) * F.col(width)).groupBy("leaf").agg(F.median("x0").alias("_l"), F.median("x1").alias("_r"), F.median("height").alias("_h"))
    t = segments.join(wide, "leaf", "left")
    t = t.withColumn("_small", F.coalesce((F.col("height") < F.lit(SMALL) * F.col("_h")) & (F.col("y0") > F.lit(LOWER) * F.col(page_height)), F.lit(False)))
    up = Window.partitionBy("leaf").orderBy(F.desc("y0"), F.desc("x0"), "block", "line", "part")
    t = t.withColumn("_foot", F.min("_small").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    down = Window.partitionBy("leaf").orderBy("y0", "x0", "block", "line", "part")
    side = (F.col("x1") < F.col("_l")) | (F.col("x0") > F.col("_r"))
    role = F.when((F.row_number().over(down) == 1) & F.col("text").rlike(head), "head").when(F.col("_foot"), "footnote").when(side, "margin").otherwise("body")
    return t.withColumn("role", role).withColumn("side", F.when(role == "margin", F.when(F.col("x1") < F.col("_l"), "left").otherwise("right"))).drop("_l", "_r", "_h", "_small", "_foot")


def rebuilt_text(classified: DataFrame) -> DataFrame:
    """leaf, role, text: segments of one line joined by a space, lines by a break, paragraphs by a blank line."""
    w = Window.partitionBy("leaf", "role").orderBy("y0", "x0", "block", "line", "part")
    same_line = (F.lag("block").over(w) == F.col("block")) & (F.lag("line").over(w) == F.col("line"))
    same_par = (F.lag("block").over(w) == F.col("block")) & (F.lag("par").over(w) == F.col("par"))
    lead = F.when(F.row_number().over(w) == 1, "").when(same_line, " ").when(same_par, "\n").otherwise("\n\n")
    t = classified.withColumn("_s", F.concat(lead, F.col("text"))).withColumn("_i", F.row_number().over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]), "")
    return t.groupBy("leaf", "role").agg(joined.alias("text"), F.avg("conf").alias("conf"))


def margin_notes(classified: DataFrame) -> DataFrame:
    """leaf, block, side, text of notes: margin segments of one block and side, hyphens closed; two words of three letters at least."""
    m = classified.filter("role = 'margin'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "line", "part", "text"))), lambda x: x["text"]), " ")
    out = m.groupBy("leaf", "block", "side").agg(F.min("y0").alias("y"), F.regexp_replace(text, r"(?<=[A-Za-z])-\s+(?=[a-z])", "").alias("text"))
    return out.filter(F.regexp_count("text", F.lit("[A-Za-z]{3,}")) >= 2)


def set_key(words: Column) -> Column:
    """One number for a set of words, whatever their order."""
    return F.xxhash64(F.array_sort(words))


def set_pairs(p: DataFrame, q: DataFrame, least: float) -> DataFrame:
    """(ka, kb, score) of distinct word sets (k, w) on both sides that share ``least`` of the smaller one.

    The smaller set of such a pair has one of its rarest words, so many as may be missing and one more, in the other:
    sets are looked up by these.
    """
    words = p.unionByName(q).dropDuplicates(["k"]).select("k", F.size("w").alias("size"), F.explode(F.transform("w", lambda v: F.xxhash64(v))).alias("word"))
    ranked = words.join(words.groupBy("word").agg(F.count("*").alias("n")), "word")
    rank = F.row_number().over(Window.partitionBy("k").orderBy("n", "word"))
    rare = ranked.withColumn("i", rank).filter(F.col("i") <= F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1).select("k", "word", "size")
    met = rare.alias("s").join(words.alias("l"), F.expr("s.word = l.word and s.size <= l.size")).select(F.col("s.k").alias("s"), F.col("l.k").alias("l")).distinct()
    met = met.unionByName(met.select(F.col("l").alias("s"), F.col("s").alias("l"))).distinct()
    scored = met.join(p.select(F.col("k").alias("s"), F.col("w").alias("ws")), "s").join(q.select(F.col("k").alias("l"), F.col("w").alias("wl")), "l")
    return scored.select(F.col("s").alias("ka"), F.col("l").alias("kb"), overlap(F.col("ws"), F.col("wl")).alias("score")).filter(F.col("score") >= least)


def set_overlaps(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """(a, b, score) of all pairs of x (a, wa) and y (b, wb) whose word sets share ``least`` of the smaller one; equal sets are looked up once."""
    x, y = (t.filter(F.size(w) > 0).withColumn(k, set_key(F.col(w))) for t, w, k in ((x, "wa", "ka"), (y, "wb", "kb")))
    p, q = (t.select(F.col(k).alias("k"), F.col(w).alias("w")).dropDuplicates(["k"]) for t, w, k in ((x, "wa", "ka"), (y, "wb", "kb")))
    return set_pairs(p, q, least).join(x.select("a", "ka"), "ka").join(y.select("b", "kb"), "kb").select("a", "b", "score")


def page_overlaps(a: DataFrame, b: DataFrame, candidates: DataFrame | None = None, least: float = 0.25) -> DataFrame:
    """(a, b, score) for pages of two editions, each with id and text: shared words over the smaller set.

    Without ``candidates`` all pairs (a, b) are searched.
    """
    x = a.select(F.col("id").alias("a"), word_set(F.col("text")).alias("wa"))
    y = b.select(F.col("id").alias("b"), word_set(F.col("text")).alias("wb"))
    if candidates is None:
        return set_overlaps(x, y, least)
    t = candidates.select("a", "b").distinct().join(x, "a").join(y, "b")
    return t.select("a", "b", overlap(F.col("wa"), F.col("wb")).alias("score")).filter(F.col("score") >= least)


#: Counters of words by hash, and bits for the words that are looked up: bounds on what tasks are sent, whatever the data.
COUNTS, BITS = 1 << 21, 1 << 22
#: Rare words looked up beyond those that settle it, so that a pair met by chance is not read.
MORE = 2
#: Numbers of sets sent in one pass, or fours of letters, for each set: what a pass shuffles stays in proportion to the input.
SENT = 500
#: Ids in one list of a word or of a group of copies.
CHUNK = 256


def page_sets(pages: DataFrame) -> DataFrame:
    """id, k, size and t, the sorted words of a page as one string; k is null without words."""
    sets = pages.select("id", F.sort_array(word_set(F.col("text"))).alias("w"))
    return sets.select("id", F.when(F.size("w") > 0, F.xxhash64("w")).alias("k"), F.size("w").alias("size"), F.array_join("w", " ").alias("t"))


def keyed_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, k) of the pages, and their ``set_classes``; texts are read once."""
    from inkwell.llm.common import drop, staged

    whole = staged(page_sets(pages), "pages")
    classes = set_classes(whole)
    keys = staged(whole.select("id", "k"), "keys")
    drop(whole)
    return keys, classes


def set_classes(sets: DataFrame) -> DataFrame:
    """Of ``page_sets``: k, class_id (smallest id), n, size, t and i of the distinct word sets; i counts them from 0 by size."""
    from inkwell.llm.common import staged

    found = sets.filter("k is not null").groupBy("k").agg(F.min("id").alias("class_id"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("t").alias("t"))
    kept = staged(found.repartitionByRange("size", "k").sortWithinPartitions("size", "k"), "sets")
    sizes = sorted((r.file, r.n) for r in kept.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")).collect())
    starts = [(file, sum(n for _, n in sizes[:j])) for j, (file, _) in enumerate(sizes)]
    starts = kept.sparkSession.createDataFrame(starts, "_file string, _start long")
    placed = kept.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return placed.join(F.broadcast(starts), "_file").withColumn("i", (F.col("_start") + F.col("_row")).cast("int")).drop("_file", "_row", "_start")


def near_sets(sets: DataFrame, least: float) -> DataFrame:
    """(s, l, score), numbers i of distinct word sets (i by size, t) that share ``least`` of the smaller one, s.

    A set may miss m words in a larger one. Words counted once are in no other set; of its m + 1 rarest others, less those counted
    once, one is in the larger set, and of ``MORE`` rare words beyond, as many more. So a set is sent the lists of
    larger sets of these words, in passes of a bounded size, and sets in enough lists are compared, but for those whose shared words were all
    looked up, as their lists tell the score. Rarity is by counters of hashed words: that they are shared costs time, but no pair.
    """
    from inkwell.llm.common import tidied

    return tidied(compared)(sets, least)


def compared(sets: DataFrame, least: float) -> DataFrame:
    """``near_sets``, with the tables it stages on the way."""
    from inkwell.llm.common import drop, small_batches, staged

    small_batches(sets.sparkSession)
    hashed = sets.select("i", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h"))
    counted = hashed.select(F.explode("h").alias("h")).groupBy(F.pmod("h", F.lit(COUNTS)).cast("int").alias("b")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(COUNTS, np.uint32)
    counts[counted["b"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 2**32 - 1)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for i, h in zip(batch["i"].to_pylist(), batch["h"], strict=True):
                h = h.values.to_numpy()
                n = counts[h % COUNTS]
                missed = len(h) - int(np.ceil(least * len(h) - 1e-9)) - int((n == 1).sum())
                if missed >= 0:
                    size, h, n = len(h), h[n > 1], n[n > 1]
                    whole = len(h) <= missed + 1 + MORE
                    first = np.lexsort((h, n))[: missed + 1 + MORE]
                    h = h[first]
                    out[0].append(h)
                    out[1].append(np.full(len(h), i, np.int32))
                    out[2].append(np.full(len(h), len(h) - missed, np.int32))
                    out[3].append(np.full(len(h), size if whole else 0, np.int32))
                    out[4].append(n[first].astype(np.int64))
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in out], ["w", "s", "need", "size", "n"])

    asked = staged(hashed.mapInArrow(rare, "w long, s int, need int, size int, n long"), "rare")
    bits = np.zeros(BITS, bool)
    bits[asked.select(F.pmod("w", F.lit(BITS)).cast("int").alias("b")).distinct().toArrow()["b"].to_numpy()] = True
    bits = np.packbits(bits)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = batch["h"].values.to_numpy(), np.diff(batch["h"].offsets.to_numpy())
            h = h[batch["h"].offsets[0].as_py() : batch["h"].offsets[-1].as_py()]
            b = h % BITS
            keep = (bits[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1
            yield pa.record_batch([pa.array(h[keep]), pa.array(np.repeat(batch["i"].to_numpy(), n)[keep])], ["w", "l"])

    lists = hashed.mapInArrow(listed, "w long, l int").repartition("w").groupBy("w", F.expr(f"l div {CHUNK * 256}").alias("c")).agg(F.sort_array(F.collect_list("l")).alias("ls"))
    lists = staged(lists, "lists")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(s: int, need: int, size: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(parts), return_counts=True)
            found, times = found[times >= need], times[times >= need]
            score = pa.array(times / size) if size else pa.nulls(len(found), pa.float64())
            return pa.record_batch([pa.array(np.full(len(found), s, np.int32)), pa.array(found), score], ["s", "l", "score"])

        now, parts = None, []
        for batch in batches:
            for s, need, size, ls in zip(*(batch[c].to_pylist() for c in ("s", "need", "size")), batch["ls"], strict=True):
                if now is not None and s != now[0]:
                    yield close(*now, parts)
                    parts = []
                now = s, need, size
                parts.append(ls.values.to_numpy())
        if now is not None:
            yield close(*now, parts)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, words = "", None
        for batch in batches:
            out = [], [], []
            for l, s, t in zip(*(batch[c].to_pylist() for c in ("l", "s", "t")), strict=True):  # noqa: E741
                if s < 0:
                    text, words = t, None
                    continue
                words = set(text.split(" ")) if words is None else words
                own = t.split(" ")
                for c, x in zip(out, (s, l, len(words.intersection(own)) / len(own)), strict=True):
                    c.append(x)
            yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64())], ["s", "l", "score"])

    passes = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // (SENT * max(1, sets.count()))))
    parts = []
    for i in range(passes):
        sets.sparkSession.sparkContext._jvm.System.gc()  # shuffle files of the step before go
        some = asked.filter(F.pmod(F.xxhash64("s"), F.lit(passes)) == i)
        sent = some.join(lists, "w").select("s", "need", "size", F.filter("ls", lambda x: x > F.col("s")).alias("ls")).filter(F.size("ls") > 0)
        parts.append(staged(sent.repartition("s").sortWithinPartitions("s").mapInArrow(met, "s int, l int, score double"), "met"))
    drop(lists)
    sets.sparkSession.sparkContext._jvm.System.gc()
    pairs = reduce(DataFrame.unionByName, parts)
    left = pairs.filter("score is null").select("s", "l")
    volume = left.join(sets.select(F.col("i").alias("s"), F.length("t").alias("n")), "s").agg(F.sum("n")).first()[0]
    passes = max(1, -(-(volume or 0) // (4 * SENT * max(1, sets.count()))))
    near = [staged(pairs.filter(F.col("score") >= least), "near")]
    for i in range(passes):
        sets.sparkSession.sparkContext._jvm.System.gc()
        turn = lambda c: F.pmod(F.xxhash64(c), F.lit(passes)) == i  # noqa: B023, E731
        # A set stands before the smaller ones that it is compared with, so that its text is sent once.
        some = left.filter(turn("l")).join(sets.select(F.col("i").alias("s"), "t"), "s").select("l", "s", "t")
        some = some.unionByName(sets.filter(turn("i")).select(F.col("i").alias("l"), F.lit(-1).alias("s"), "t"))
        read = some.repartition("l").sortWithinPartitions("l", "s").mapInArrow(scores, "s int, l int, score double")
        near.append(staged(read.filter(F.col("score") >= least), "near"))
    return reduce(DataFrame.unionByName, near)


def near_page_classes(pages: DataFrame, least: float = 0.9) -> DataFrame:
    """id, class_id, links for pages (id, text): pages of one word set share a class, named by its smallest id.

    ``links`` counts the other pages that share ``least`` of the smaller word set with it, those of its class too. Pairs are
    formed between classes only, so a group of copies costs one of them. A page without words is a class of its own.
    """
    own, classes = keyed_pages(pages)
    near = near_sets(classes, least).select("s", "l")
    sizes = classes.select("k", "i", "class_id", "n")
    both = near.unionByName(near.select(F.col("l").alias("s"), F.col("s").alias("l")))
    links = both.join(sizes.select(F.col("i").alias("l"), "n"), "l").groupBy(F.col("s").alias("i")).agg(F.sum("n").alias("links"))
    known = sizes.join(links, "i", "left").select("k", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = own.select("id", "k").join(known, "k", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_page_pairs(pages: DataFrame, least: float = 0.9) -> DataFrame:
    """(a, b, score), a < b, of all pages (id, text) whose word sets share ``least`` of the smaller one.

    Sets are compared once for all their copies. Pairs of copies come from lists of at most about ``CHUNK`` ids, so they are
    made where they are read and are not shuffled.
    """
    own, classes = keyed_pages(pages.filter("id is not null"))
    near = near_sets(classes, least)
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK)).cast("int")
    ids = own.select("id", "k").filter("k is not null").join(classes.select("k", "i", "n"), "k")
    ids = ids.groupBy("i", chunk.alias("c"), "n").agg(F.collect_list("id").alias("ids"))
    x, y = ids.select(F.col("i").alias("s"), F.col("c").alias("ca"), F.col("ids").alias("xs")), ids.select(F.col("i").alias("l"), F.col("c").alias("cb"), F.col("ids").alias("ys"))
    copies = x.join(y, (F.col("s") == F.col("l")) & (F.col("ca") <= F.col("cb"))).select("xs", "ys", F.lit(1.0).alias("score"), (F.col("ca") == F.col("cb")).alias("same"))
    other = near.join(x, "s").join(y, "l").select("xs", "ys", "score", F.lit(False).alias("same"))
    met = copies.unionByName(other).select(F.explode("xs").alias("x"), "ys", "score", "same").select("x", F.explode("ys").alias("y"), "score", "same")
    met = met.filter((F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & ~F.col("same")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def greedy_match(scores: DataFrame, group: Sequence[str], a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """One-to-one assignment per group: the best remaining (score, a, b), falling, again and again."""
    schema = scores.schema

    def match(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([score, a, b], ascending=False, kind="stable")
        left, right, keep = set(), set(), []
        for x, y in zip(part[a], part[b], strict=True):
            free = x not in left and y not in right
            if free:
                left.add(x), right.add(y)
            keep.append(free)
        return part[keep]

    return scores.groupBy(*group).applyInPandas(match, schema)


def best_candidates(scores: DataFrame, n: int = 5, least: float = 0.25) -> DataFrame:
    """The ``n`` best pages b of each a."""
    i = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return scores.filter(F.col("score") >= least).withColumn("i", i).filter(F.col("i") <= n).drop("i")


#: Where the text of a page comes from, fixed values: the new edition, nowhere (a copy of a matched page), the old edition.
NEW, COPY, OLD = "tesseract_reocr", "duplicate", "original"


def edition_matches(old: DataFrame, new: DataFrame, least: float = 0.25, most: int = 5, reach: int = 3, same: float = 0.9, fewest: int = 20) -> DataFrame:
    """volume, ord, page_id, leaf, score, source, duplicate_of: the leaf of a new edition that each page of the old one is.

    ``old`` has volume, ord, page_id, number and text, ``new`` volume, leaf, printed and text. A page's candidates share
    ``least`` of their words with it and stand within ``reach`` leaves of its printed number or of the leaf after the last page's
    best one; without any, all leaves of the volume count. The ``most`` best are kept and taken one-to-one, the best score
    first. A blank page takes the free leaf that follows from the matched page before it. An unmatched page of ``fewest``
    words that shares ``same`` of them with a matched one is a duplicate of it, of the first of several.

    Scores are computed for all volumes at once; only numbers of one volume meet in a task.
    """
    words = lambda: F.transform(word_set(F.col("text")), lambda w: F.concat_ws(" ", F.col("volume").cast("string"), w))
    x = old.select(F.struct("volume", "ord").alias("a"), words().alias("wa"))
    y = new.select(F.struct("volume", "leaf").alias("b"), words().alias("wb"))
    shape = "kind string, ord long, leaf long, number long, score double, page_id string, blank boolean"
    names = [c.split()[0] for c in shape.split(", ")]
    nothing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in shape.split(", ")}
    facts = lambda df, kind, **given: df.select(F.col("volume"), *(F.lit(kind).alias(c) if c == "kind" else given.get(c, nothing[c]).alias(c) for c in names))
    long = lambda c: F.col(c).cast("long")
    blank = ~F.coalesce("text", F.lit("")).rlike(r"\S")
    scores = set_overlaps(x, y, least).select("a.volume", "a.ord", "b.leaf", "score")
    copies = set_overlaps(x.filter(F.size("wa") >= fewest), x.select(F.col("a").alias("b"), F.col("wa").alias("wb")), same).filter("a.ord <> b.ord").select("a.volume", "a.ord", F.col("b.ord").alias("leaf"))
    all_ = facts(old, "page", ord=long("ord"), number=long("number"), page_id=F.col("page_id").cast("string"), blank=blank)
    for part in (facts(new, "leaf", leaf=long("leaf"), number=long("printed")), facts(scores, "score", ord=long("ord"), leaf=long("leaf"), score=F.col("score")), facts(copies, "copy", ord=long("ord"), leaf=long("leaf"))):
        all_ = all_.unionByName(part)
    volume = old.schema["volume"].dataType.simpleString()

    def match(part: pd.DataFrame) -> pd.DataFrame:
        of = dict(tuple(part.groupby("kind")))
        none = part.iloc[:0]
        pages = of.get("page", none).sort_values("ord").reset_index(drop=True)
        leaves, scores, copies = (of.get(kind, none) for kind in ("leaf", "score", "copy"))
        by_number = {n: g.to_numpy() for n, g in leaves.dropna(subset=["number"]).groupby("number")["leaf"]}
        by_page = {n: g.sort_values(["score", "leaf"], ascending=False) for n, g in scores.groupby("ord")}
        chosen, follows = [none], np.array([])
        for i, page in pages.iterrows():
            found = by_page.get(page["ord"])
            if found is None:
                continue
            spots = np.concatenate([by_number.get(page["number"], np.array([])), follows])
            close = found[(np.abs(found["leaf"].to_numpy()[:, None] - spots[None, :]) <= reach).any(axis=1)]
            best = (close if len(close) else found).head(most)
            follows = best["leaf"].to_numpy()[:1] + 1
            chosen.append(best.assign(ord=i))
        leaf_of, score_of, free = {}, {}, set(leaves["leaf"])
        for c in pd.concat(chosen).sort_values(["score", "ord", "leaf"], ascending=False).itertuples():
            if c.ord not in leaf_of and c.leaf in free:
                leaf_of[c.ord], score_of[c.ord] = c.leaf, c.score
                free.discard(c.leaf)
        shift = None
        for i, page in pages.iterrows():
            if i not in leaf_of and page["blank"] and shift is not None and shift + i in free:
                leaf_of[i], score_of[i] = shift + i, 0.0
                free.discard(shift + i)
            shift = leaf_of[i] - i if i in leaf_of else shift
        matched = set(pages["ord"][list(leaf_of)])
        twins = copies[copies["leaf"].isin(matched) & ~copies["ord"].isin(matched)].groupby("ord")["leaf"].min()
        twin_id = pages["ord"].map(twins).map(pages.set_index("ord")["page_id"])
        position = pages.index.to_series()
        out = pages.assign(leaf=position.map(leaf_of).astype("Int64"), score=position.map(score_of).fillna(0.0).astype(float), duplicate_of=twin_id.astype(object).where(twin_id.notna(), None))
        out["source"] = np.where(out["leaf"].notna(), NEW, np.where(out["duplicate_of"].notna(), COPY, OLD))
        return out[["volume", "ord", "page_id", "leaf", "score", "source", "duplicate_of"]]

    return all_.groupBy("volume").applyInPandas(match, f"volume {volume}, ord long, page_id string, leaf long, score double, source string, duplicate_of string")


def editions_compared(old: DataFrame, new: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Measures of pages with one printed number in both editions, side by side; the first page of a number counts."""
    from inkwell.operators.linking import first_per

    side = lambda df, name: first_per(df, ["printed"], ["ord"]).select("printed", *(F.col(m).alias(f"{name}_{m}") for m in measures))
    return side(old, "old").join(side(new, "new"), "printed")


def glued(pages: DataFrame, note: str, text: str) -> DataFrame:
    """Adds glued: a line of the text holds the note's first two words and over three words more."""
    first = F.regexp_extract(F.trim(F.col(note)), r"^(\S+\s+\S+)", 1)
    extra = lambda x: F.size(F.split(F.trim(x), r"\s+")) > F.size(F.split(F.trim(F.col(note)), r"\s+")) + 3
    return pages.withColumn("glued", (first != "") & F.exists(F.split(F.col(text), "\n", -1), lambda x: F.contains(x, first) & extra(x)))
