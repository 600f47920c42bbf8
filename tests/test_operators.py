import json
import random
import re
import struct
from datetime import date

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import associations as A
from inkwell.operators import fuzzy as Z
from inkwell.operators import graph as G
from inkwell.operators import layout as L
from inkwell.operators import linking as K
from inkwell.operators import mentions as N
from inkwell.operators import relations as R
from inkwell.operators import spans as P
from inkwell.plans import catalogue
from inkwell.sources import readers, writers
from inkwell.streaming import events as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return getattr(v, "isoformat", lambda: v)() if not hasattr(v, "tzinfo") else v.replace(tzinfo=None).isoformat()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_duckdb(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    want = c.sql(catalogue.SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.collect())
    at = [want.columns.index(x) for x in df.columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x


def test_text_scalars(spark):
    assert column(spark, "The Duke’s Straße, 12", X.normalized_phrase) == "the dukes strasse"
    assert column(spark, "Powhatans", X.skeleton) == column(spark, "Povvhattan".replace("vv", "w"), X.skeleton) == "pouhatan"
    assert column(spark, "Chickahominies", X.skeleton) == "chikahomin"
    assert column(spark, "Pow- hatans came", X.dehyphenate) == "Powhatans came"
    assert [tuple(x) for x in column(spark, "Pow- hatans and Chick-\nahominies", X.removed_by_dehyphenation)] == [(3, 2), (19, 2)]
    assert column(spark, "y° Court wth them-\nselues", X.normalized_gap) == "the court with themselues"
    assert tuple(column(spark, "m’ Iohn Smith", lambda c: X.title_and_name(c, "m’|sir"))) == ("Mr", "Iohn Smith")
    assert tuple(column(spark, "Sir Thomas  Dale", lambda c: X.name_parts(c, ["sir"]))) == ("Thomas", "Dale")
    assert column(spark, "one two three", lambda c: X.clip(c, 9)) == "one two …"
    assert column(spark, "\n\n  262 RECORDS 13 \nx 9", X.printed_number) == 13
    assert column(spark, "of the river", lambda c: X.leading_words_length(c, ["of", "the"])) == 7
    assert column(spark, "Adams, 12, 14.\nplain\n\n", X.index_ratio) == 0.5
    assert column(spark, "say it now", lambda c: X.bracketed(c, F.lit("it"))) == "say [[it]] now"


def test_geographic_context(spark):
    f = lambda s, t: spark.createDataFrame([(s, t)], "s string, t string").select(X.geographic_context(F.col("s"), F.col("t"), ["at", "in"], ["river"]).alias("x")).first().x
    assert f("Point Comfort", "he came to be at the Point Comfort") and f("James", "the great James riuer and river")
    assert not f("Iohn Smith", "then Iohn Smith spake") and not f("", "anything")


def test_match_offsets_and_empty(spark):
    rows = [(1, "a1 🙂22\n333é4444"), (2, "none"), (3, ""), (4, None)]
    got = P.matches(spark.createDataFrame(rows, "id int, t string"), "t", "[0-9]+", ["id"]).collect()
    assert {(r.start, r.end, r.span) for r in got} == {(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", rows[0][1])}


ALIASES = [
    ("PERSON", "John Martin", "Capt. John Martin’s", 0), ("PERSON", "Richard Holland", "Richard Holland", 0), ("PLACE", "NW-X", "John Martin’s Plantation", 0),
    ("PLACE", "NW-020", "Somer Iland", 0), ("PLACE", "OW-H", "Holland", 0), ("PLACE", "OW-E", "England", 0), ("PLACE", "OW-I", "Ireland", 0), ("NOT_ENTITY", "", "Cape Marchant", 1),
]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("the Company of the Somer Iland¢ doth", [("Somer Iland", "PLACE")]),
        ("sent to Somer\nIland", [("Somer\nIland", "PLACE")]),
        ("at Capt. John Martin’s Plantation", [("John Martin’s Plantation", "PLACE")]),
        ("Richard Holland said", [("Richard Holland", "PERSON")]),
        ("the Cape Marchant reported", [("Cape Marchant", "NOT_ENTITY")]),
        ("King of England Scotland ffraunce and Ireland Defender in Ireland", [("England Scotland ffraunce and Ireland", "NOT_ENTITY"), ("Ireland", "PLACE")]),
    ],
)
def test_authority_spans(spark, text, want):
    from inkwell.functions.lexicon import STYLES

    pages = spark.createDataFrame([("p", text)], "page_id string, text string")
    got = P.authority_spans(pages, "text", ["page_id"], spark.createDataFrame(ALIASES, "label string, entity string, form string, priority int"), 4, STYLES).orderBy("start").collect()
    assert [(text[r.start : r.end], r.label) for r in got] == want


def test_packing_equals_a_plain_scan(spark):
    r = random.Random(0)
    rows = [(p, a, a + r.randrange(1, 9), i) for p in range(20) for i, a in enumerate(r.randrange(60) for _ in range(25))]
    df = spark.createDataFrame(rows, "p int, start int, end int, i int").withColumn("size", F.col("end") - F.col("start"))
    got = {(x.p, x.i) for x in P.packed(df, ["p"], ["-size", "start", "i"]).collect()}
    want = set()
    for p in range(20):
        kept = []
        for _, a, b, i in sorted((x for x in rows if x[0] == p), key=lambda x: (x[1] - x[2], x[1], x[3])):
            if all(b <= c or d <= a for c, d in kept):
                kept.append((a, b))
                want.add((p, i))
    assert got == want


def test_merge_replaces_candidates_but_keeps_links(spark):
    rows = spark.createDataFrame([("p", 10, 21, "CANDIDATE", ""), ("p", 40, 48, "PLACE", "NW")], "page string, start int, end int, label string, key string")
    hits = spark.createDataFrame([("p", 10, 21, "PERSON", "strong"), ("p", 40, 48, "GROUP", "weak")], "page string, start int, end int, label string, reading string")
    got = P.merge_overlaps(rows, hits, ["page"], F.col("reading") == "weak", F.col("key") != "").collect()
    assert sorted((r.start, r.label) for r in got) == [(10, "PERSON"), (40, "PLACE")]


@pytest.mark.parametrize(
    ("span", "title", "want"),
    [("Zachary Jones", False, True), ("m’ Meuerell", True, True), ("Worke", False, False), ("the Common", False, False), ("m* Atturney", True, False), ("Silke Coddes", False, False), ("T. Ro", False, False), ("Iohn White Carpenter", False, True)],
)
def test_person_shapes(spark, span, title, want):
    assert column(spark, span, lambda c: N.looks_like_person(c, F.lit(title))) is want


@pytest.mark.parametrize(("span", "after", "title", "want"), [("m’ Nich", "? ffarrar Dpt.", True, "? ffarrar"), ("m’ Dan", ": Peeker Gookin", True, ": Peeker"), ("Sir Humfry", " May knighte", True, " May"), ("William Throk-", " mortun y® rest", False, " mortun"), ("Iohn Smith", " went", False, "")])
def test_cut_names_go_on(spark, span, after, title, want):
    n = spark.createDataFrame([(span, after)], "s string, a string").select(N.extension(F.col("s"), F.col("a"), F.lit(title)).alias("n")).first().n
    assert after[:n] == want


def test_trimmed_spans(spark):
    assert column(spark, "John Whittingham___.-.__-", N.trimmed) == "John Whittingham" and column(spark, "Iohn Smith 12", N.trimmed) == "Iohn Smith"


def test_titles_before_places(spark):
    rows = spark.createDataFrame([("the Earle of ", "OW-008", 2), ("Lord Bishop of ", "OW-001", 1), ("sent to ", "OW-001", 1)], "before string, place_id string, volume int")
    rules = spark.createDataFrame([("OW-008", "earl", None, "Wriothesley", 1), ("OW-001", "bishop", [1], "King", 2)], "place_id string, title string, volumes array<int>, person string, ord int")
    got = N.suggested_person(N.titled(rows, F.col("before")), rules).collect()
    assert {(r.title, r.person) for r in got} == {("earl", "Wriothesley"), ("bishop", "King"), (None, None)}


def relations_of(spark, text, names):
    m = [("p", kind, name, text.index(name), text.index(name) + len(name)) for name, kind in names]
    got = R.relations(spark.createDataFrame(m, "page_id string, type string, name string, start int, end int"), spark.createDataFrame([("p", text)], "page_id string, text string"))
    return {(r.subject, r.relation, r.object) for r in got.collect()}


def test_relations(spark):
    text = "Sir Francis Wyatt knight Governor and Captaine generall of Virginia. At Weynoack of Sir George Yeardley his people. Thomas Tracy his wife Mary Tracy. Robert Iordan, his wife, Richard Rowles. Capt. Smith lately come from Jamestown, and Henrico."
    got = relations_of(spark, text, [("Sir Francis Wyatt", "person"), ("Virginia", "place"), ("Weynoack", "place"), ("Sir George Yeardley", "person"), ("Thomas Tracy", "person"), ("Mary Tracy", "person"), ("Robert Iordan", "person"), ("Richard Rowles", "person"), ("Capt. Smith", "person"), ("Jamestown", "place"), ("Henrico", "place")])
    assert {("Sir Francis Wyatt", "office_in", "Virginia"), ("Sir George Yeardley", "people_at", "Weynoack"), ("Mary Tracy", "kin_of", "Thomas Tracy"), ("Capt. Smith", "travel_from", "Jamestown"), ("Capt. Smith", "travel_from", "Henrico")} <= got
    assert not any("Richard Rowles" in (s, o) for s, _, o in got)


def test_sentence_boundaries(spark):
    for s, want in ((" Capt. ", False), (" S' Tho: ", False), (" was ordered. The ", True), (" Court.\n\nIt ", True), (" Mr. Smith", False)):
        assert column(spark, s, R.has_boundary) is want


def test_links_prefer_the_nearest_pair(spark):
    people = spark.createDataFrame([(1, "a", "X", 0, 5, False, 1), (1, "a", "X", 900, 905, False, 2), (1, "a", "Y", 10, 15, True, 3), (2, "b", "X", 0, 5, False, 1)], "unit int, page string, person string, start int, end int, present boolean, ord int").withColumn("date", F.lit(date(1620, 1, 1)))
    targets = spark.createDataFrame([(1, "a", "T", 1000, 1005, 1), (2, "c", "T", 0, 5, 1)], "unit int, page string, target string, start int, end int, ord int")
    ev = A.evidence(people, targets, ["date"])
    got = {(r.unit, r.person): (r.min_distance, r.proximity) for r in ev.collect()}
    assert got == {(1, "X"): (95, "close"), (1, "Y"): (None, "present_only"), (2, "X"): (None, "same_meeting")}
    link = {r.person: r for r in A.pair_links(ev, people, targets).collect()}
    assert (link["X"].meetings, link["X"].close_meetings, link["X"].lift, link["Y"].lift) == (2, 1, 1.0, None)


def test_summaries(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "c", 4)], "k int, relation string, o int")
    s = A.summarize(rows, ["k"], order="o")
    assert s.first().relations == "a×2; b; c"
    assert s.select(A.expand_summary(F.col("relations")).alias("x")).first().x == ["a", "a", "b", "c"]


def test_fuzzy_lookup_and_merge_equal_plain_search(spark):
    from difflib import SequenceMatcher

    r = random.Random(2)
    words = {"".join(r.choice("abcdeo") for _ in range(r.randrange(6, 10))) for _ in range(60)}
    forms = {w[:3] + r.choice("xyz") + w[4:] for w in list(words)[:20]}
    got = {x.word: (x.form, x.score) for x in Z.best_match(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(f,) for f in forms], "form string"), 0.84, 4).collect()}
    want = {}
    for w in words:
        s, f = max(((SequenceMatcher(None, w, f).ratio(), f) for f in sorted(forms, reverse=True)), key=lambda x: x[0])
        if s >= 0.84:
            want[w] = (min(f for f in forms if SequenceMatcher(None, w, f).ratio() == s), s)
    assert got == want
    lexicon = spark.createDataFrame([("G1", "Powhatan", False), ("G2", "Pamunkey", True)], "entity string, seed string, exact_only boolean")
    hits = {x.word: (x.entity, x.match_type) for x in Z.lookup(spark.createDataFrame([(w,) for w in ("Powhatan", "Powhattan", "Powhotan", "Pamunkie", "Pamunkey", "Table")], "word string"), lexicon).collect()}
    assert hits["Powhatan"] == ("G1", "exact") and hits["Powhattan"] == ("G1", "variant") and hits["Powhotan"] == ("G1", "fuzzy") and hits["Pamunkey"] == ("G2", "exact")
    assert "Table" not in hits and "Pamunkie" not in hits


def test_locate_takes_the_first_segment_before_any(spark):
    seg = spark.createDataFrame([("p", "s1", 10, 1), ("p", "s2", 20, 2)], "page_id string, segment_id string, char_start int, ord int")
    m = spark.createDataFrame([("p", 5), ("p", 10), ("p", 19), ("p", 25), ("q", 1)], "page_id string, span_start int")
    assert [r.segment_id for r in K.locate(m, seg).orderBy("page_id", "span_start").collect()] == ["s1", "s1", "s1", "s2", None]


def test_unknown_keys_fail(spark):
    with pytest.raises(Exception, match="unknown k"):
        K.checked(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",)], "k string"), "k").collect()


def test_layout_of_made_up_pages(spark):
    from inkwell.plans.texts import hocr

    words = L.ocr_words(hocr(spark), "leaf", "html").withColumn("width", F.lit(1000))
    roles = L.classify(L.line_segments(words).withColumn("page_height", F.lit(1500)), "COURT").filter("leaf = 1").collect()
    by = {}
    for r in roles:
        by.setdefault(r.role, []).append(r.text)
    assert by["head"] == ["A COURT HELD"] and len(by["body"]) == 10 and by["footnote"] == ["1 See the note"] and by["margin"]


def test_greedy_match_is_one_to_one(spark):
    rows = [(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.85), (1, "b", "y", 0.1), (2, "a", "x", 0.5)]
    got = {(r.g, r.a, r.b) for r in L.greedy_match(spark.createDataFrame(rows, "g int, a string, b string, score double"), ["g"]).collect()}
    assert got == {(1, "a", "x"), (1, "b", "y"), (2, "a", "x")}


def test_graph_and_geometry(spark):
    edges = [(1, a, b, 1.0) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(1, 4, 5, 0.1)]
    got = {r.node: r.community for r in G.communities(spark.createDataFrame(edges, "graph int, a int, b int, weight double")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9]
    square = [(-1.0, -1.0), (3.0, -1.0), (3.0, 3.0), (-1.0, 3.0)]
    assert {tuple(p) for p in G.clip_ring(square, (0, 0, 2, 2))} == {(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)}
    assert G.clip_ring(square, (5, 5, 6, 6)) == [] and G.clip_line([(0, 0), (1, 1), (9, 9), (1, 0), (0, 1)], (0, 0, 2, 2)) == [[(0.0, 0.0), (1.0, 1.0)], [(1.0, 0.0), (0.0, 1.0)]]
    assert G.simplify([(0, 0), (1, 0.01), (2, 0), (2, 5)], 0.1) == [(0.0, 0.0), (2.0, 0.0), (2.0, 5.0)]


def test_sources(spark, tmp_path):
    page = {"page_id": "V01-P0001", "section_id": "s", "volume": 1, "source_id": "x", "source_page_key": "1", "layer": "primary_text", "text": "a"}
    (tmp_path / "p.json").write_text(json.dumps([page, {**page, "page_id": "V01-P0002"}]))
    assert [r.ord for r in readers.read_pages(spark, str(tmp_path / "p.json")).orderBy("page_id").collect()] == [1, 2]
    for bad in ([page, page], [{**page, "layer": "other"}], [{k: v for k, v in page.items() if k != "text"}]):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="repeats|layer|missing"):
            readers.read_pages(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "a.csv").write_bytes('﻿id,name\n1,"two\nlines ""q"""\n2,\n'.encode())
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'two\nlines "q"'), ("2", "")]
    book = {"people": {"John Smith": {"aliases": ["Iohn Smith", "Capt Smith"], "skip_aliases": ["Capt Smith"]}}, "excluded": {"Smith": "too many"}, "contextual_aliases": [{"forms": ["Lord"], "by_volume": {"1": "X", "2": "Y"}, "basis": "b"}]}
    (tmp_path / "d.json").write_text(json.dumps(book))
    d = readers.read_dictionary(spark, str(tmp_path / "d.json"))
    assert [tuple(r) for r in readers.aliases(d["people"]).collect()] == [("John Smith", "Iohn Smith")]
    assert {(r.form, r.volume, r.person) for r in d["contextual"].collect()} == {("Lord", 1, "X"), ("Lord", 2, "Y")}
    assert json.loads(writers.dictionary_json(d["people"]).first().json)["aliases"] == ["Iohn Smith", "Capt Smith"]
    (tmp_path / "old.json").write_text("{}")
    with pytest.raises(Exception, match="people is missing"):
        readers.read_dictionary(spark, str(tmp_path / "old.json"))["people"].collect()
    (tmp_path / "h.html").write_text("<div class='ocr_page' title='ppageno 7'>a</div><div class='ocr_page'>b</div>")
    assert [r.leaf for r in readers.hocr_pages(spark, str(tmp_path / "h.html")).collect()] == [7, 1]
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}))
    assert readers.read_geojson(spark, str(tmp_path / "g.json")).count() == 3
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, 4, 0) + struct.pack("<8d", *[x for p in ring for x in p])
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    assert [(q.lon, q.lat) for q in readers.read_shapes(spark, str(tmp_path / "s.shp")).first().ring] == [tuple(p) for p in ring]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None, date(1620, 1, 2), True), (1, "a,\"b", None, False)], "id int, s string, d date, ok boolean")
    writers.write_csv(df, str(tmp_path / "o"), ["id", "s", "d", "ok", "none"], ["id"], one_file=True)
    back = readers.read_csv(spark, str(tmp_path / "o"))
    assert [tuple(r) for r in back.orderBy("id").collect()] == [("1", 'a,"b', "", "no", ""), ("2", "", "1620-01-02", "yes", "")]
    assert writers.html_page(df.select(F.lit("</script>").alias("x")).limit(1), "<b>__DATA__</b>") == '<b>[{"x":"<\\/script>"}]</b>'


def test_streams_equal_batches(spark, tmp_path):
    src = f"{SF}/events.parquet"
    events = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    events.orderBy("ts", "event_id").coalesce(1).write.parquet(str(tmp_path / "in/part"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in/part"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    got = E.run_to_end(E.carried_units(stream), str(tmp_path), "units").select("user_id", "event_id", "unit")
    want = A.chain_units(events.withColumn("o", F.struct("ts", "event_id")), ["user_id"], "o", F.col("event_type") == "signup").select("user_id", "event_id", "unit")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert E.deduplicated(events.union(events)).count() == events.select("event_id").distinct().count()


def test_near_pages_equal_brute_force(spark, tmp_path):
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(80)]
    texts = [" ".join(r.choices(vocabulary, k=r.choice([3, 12, 30]))) for _ in range(30)]
    texts += [t + " newword" for t in texts[:12]] + [texts[20][:40]] + ["copies of the largest group here"] * 25 + ["", "a b", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [set(re.findall("[a-z]{4,}", (t or "").lower())) for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.9 * min(len(sets[a]), len(sets[b]))}
    assert any((a - b) % 2 == 0 for a, b in want) and len(want) > 300
    got = [(x.a, x.b) for x in catalogue.QUERIES["near_pages"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_network_with_relations(spark):
    from inkwell.operators import metrics as M

    rows = [(n, u) for u in range(6) for n in ("a", "b")] + [("c", 0), ("c", 9), ("d", 1)]
    relations = spark.createDataFrame([("b", "a", "kin_of"), ("c", "a", "letter_to"), ("a", "c", "married"), ("a", "a", "kin_of"), ("z", "a", "kin_of")], "subject string, object string, relation string")
    got = {(r.a, r.b): (r.shared, r.relations, round(r.weight, 3)) for r in M.network(spark.createDataFrame(rows, "node string, unit int"), "node", "unit", relations=relations).collect()}
    assert got == {("a", "b"): (6, 1, 1.05), ("a", "c"): (0, 2, 0.1)}


def test_numbers_follow_the_order_whatever_the_ranges(spark):
    names = [f"Customer#{i:09d}" for i in range(300)]
    got = K.with_ids(spark.createDataFrame([(n,) for n in names], "n string").repartition(7), "n", "id", bins=8).collect()
    assert {r.n: r.id for r in got} == {n: i + 1 for i, n in enumerate(names)}


def test_long_gaps_and_long_aliases_match(spark):
    text = "the Isle  \n   of\tWight, and the Isle of Wightman; of, Wight"
    pages = spark.createDataFrame([("p", text)], "page_id string, text string")
    aliases = spark.createDataFrame([("PLACE", "IW", "Isle of Wight", 0), ("PLACE", "W", "of Wight", 0)], "label string, entity string, form string, priority int")
    got = {(r.start, r.end, r.entity) for r in P.dictionary_spans(pages, "text", ["page_id"], aliases).collect()}
    end = text.index("Wight") + len("Wight")
    assert got == {(text.index("Isle"), end, "IW"), (text.index("of"), end, "W")}


def test_pages_without_a_volume_are_dated(spark):
    from inkwell.operators import segments as S

    pages = spark.createDataFrame([("a", None, 1, "JULY 9, 1620 1"), ("b", 9, 1, "JULY 9, 1621 1")], "page_id string, volume int, ord long, text string")
    assert {(r.page_id, r.start) for r in S.date_pages(pages).collect()} == {("a", date(1620, 7, 9)), ("b", date(1621, 7, 9))}


def test_near_page_classes_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(60)]
    texts = [" ".join(r.choices(vocabulary, k=r.choice([3, 12, 30]))) for _ in range(25)]
    texts += [t + " newword" for t in texts[:10]] + ["copies of the largest group here"] * 20 + ["", "a b", None]
    sets = [frozenset(re.findall("[a-z]{4,}", (t or "").lower())) for t in texts]
    near = lambda a, b: a and b and len(a & b) >= 0.9 * min(len(a), len(b))
    want = {(i, min(j for j, t in enumerate(sets) if t == s) if s else i, sum(1 for j, t in enumerate(sets) if j != i and near(s, t))) for i, s in enumerate(sets)}
    pages = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {tuple(x) for x in L.near_page_classes(pages).collect()} == want
    assert L.near_page_classes(pages.limit(0)).collect() == []


def brute_editions(old, new):
    """One volume by the words of the docstring: {ord: (leaf, score, source, duplicate_of)}; rows are (ord, page_id, number, text) and (leaf, printed, text)."""
    words = lambda t: set(re.findall("[a-z]{4,}", (t or "").lower()))
    share = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0.0
    leaves, claims, last = {x[0]: words(x[2]) for x in new}, [], None
    for i, (_, _, number, text) in enumerate(old):
        spots = [x[0] for x in new if number is not None and x[1] == number] + ([last + 1] if last is not None else [])
        rank = lambda some: sorted(((share(words(text), leaves[x]), x) for x in some), reverse=True)[:5]  # noqa: B023, E731
        best = rank([x for x in leaves if any(abs(x - s) <= 3 for s in spots)])
        if not best or best[0][0] < 0.25:
            best = rank(leaves)
        claims += [(s, i, x) for s, x in best if s >= 0.25]
        last = best[0][1] if best and best[0][0] >= 0.25 else last
    got = {}
    for s, i, x in sorted(claims, reverse=True):
        if i not in got and x not in [y for y, _ in got.values()]:
            got[i] = (x, s)
    for i, row in enumerate(old):
        before = [j for j in range(i) if j in got]
        if i not in got and before and not (row[3] or "").strip():
            x = got[before[-1]][0] + i - before[-1]
            if x in leaves and x not in [y for y, _ in got.values()]:
                got[i] = (x, 0.0)
    out = {}
    for i, row in enumerate(old):
        twins = [old[j][1] for j in sorted(got) if len(words(row[3])) >= 20 and share(words(row[3]), words(old[j][3])) >= 0.9]
        if i in got:
            out[row[0]] = (got[i][0], round(got[i][1], 9), "tesseract_reocr", None)
        else:
            out[row[0]] = (None, 0.0, "duplicate" if twins else "original", twins[0] if twins else None)
    return out


def test_editions_equal_brute_force(spark):
    r = random.Random(3)
    olds, news, want = [], [], {}
    for volume in range(6):
        vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(150)]
        texts = [" ".join(r.choices(vocabulary, k=r.choice([6, 40, 60]))) for _ in range(14)]
        old = [(i, f"{volume}-{i}", r.choice([None, i + 1, i + 1, 7]), "" if r.random() < 0.15 else t) for i, t in enumerate(texts)]
        old += [(20 + i, f"{volume}-{20 + i}", None, t) for i, t in enumerate(r.sample(texts, 3))] + [(30, f"{volume}-30", None, None)]
        new = [(i + 4, r.choice([None, i + 1]), " ".join(w for w in t.split() if r.random() < 0.8)) for i, t in enumerate(texts) if r.random() < 0.85] + [(2, None, "")]
        want |= {(volume, k): v for k, v in brute_editions(old, new).items()}
        olds += [(volume, *x) for x in old]
        news += [(volume, *x) for x in new]
    a = spark.createDataFrame(olds, "volume int, ord int, page_id string, number int, text string")
    b = spark.createDataFrame(news, "volume int, leaf int, printed int, text string")
    got = {(x.volume, x.ord): (x.leaf, round(x.score, 9), x.source, x.duplicate_of) for x in L.edition_matches(a, b).collect()}
    assert got == want
    assert {x[2] for x in want.values()} == {"tesseract_reocr", "duplicate", "original"} and any(x[0] and not x[1] for x in want.values())
    assert {x.source for x in L.edition_matches(a, b.limit(0)).collect()} == {"original"} and L.edition_matches(a.limit(0), b).count() == 0


def test_names_aliases_and_words_of_names(spark):
    from inkwell.operators import review as W

    assert column(spark, " §Iohn ||  Smith, ", X.clean_form) == "Iohn Smith" and column(spark, "Lord  Bishop.;", X.clean_alias) == "Lord Bishop"
    name = lambda c: X.name_of(F.lit(None), c, r"captain|capt\.?|mr\.?")
    assert column(spark, "Capt. Iohn  Smith", name) == "Iohn Smith" and column(spark, "mr Wrote", name) == "mr Wrote"
    rows = spark.createDataFrame([("1622a", "r1", "n", "Opechancanough", "then opochancano came with corne corne corne", 1), ("1622a", "r1", "n", "Opechancanough", "corne", 2), ("1622b", None, "n", None, None, 3)], "b string, r string, who string, s string, t string, o int")
    assert {x.word for x in W.name_words(rows, "s", "t").collect()} == {"opechancanough", "opochancano"}
    assert [tuple(x) for x in W.examples(rows, "b", "r", "t", "o").collect()] == [("1622a", "r1", 2, "then opochancano came with corne corne corne")]
    parts = W.breakdown(rows, "b", "r", "who", "t", {"corn": "corne"}, records=0, span="s")
    assert {(x.b, x.total, x.more_records) for x in parts["more_records"].collect()} == {("1622a", 2, 1), ("1622b", 1, 0)}
    assert "opochancano" not in {x.word for x in parts["words"].collect()}


def test_skeleton_equals_duckdb_on_odd_words(spark, tmp_path):
    words = "cca ccac ccca accord aterstkccl rqsxyccwq cck ccq cc c ckca acquaccies ieies ces İstanbul aİccord \u212aelvin ſcca ccos, CCLN".split()
    spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.word, r.skeleton) for r in catalogue.QUERIES["skeleton"](spark, str(tmp_path)).collect())
    assert got == sorted(c.sql(catalogue.SQL["skeleton"]).fetchall()) and ("cca", "ka") in got


def test_usable_mentions_of_equal_lines_take_the_last_in_the_file(spark, tmp_path):
    r = random.Random(3)
    lines = [(r.randrange(1500), r.randint(1, 3), r.choice("RNA"), r.choice([0.01, 0.05, 0.07])) for _ in range(9000)]
    (tmp_path / "lineitem.parquet").mkdir()
    for i, part in enumerate((lines[:1500], lines[1500:])):
        pd.DataFrame(part, columns=["l_orderkey", "l_linenumber", "l_returnflag", "l_discount"]).astype({"l_linenumber": "int32"}).to_parquet(f"{tmp_path}/lineitem.parquet/part-{i}.parquet")
    spark.createDataFrame([(i, "PO"[i % 2]) for i in range(1500)], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    kinds = {}
    for k, n, f, discount in lines:
        if discount >= 0.05:
            kinds[k, n] = "running_head" if f == "R" else "document_heading"
    want = sorted((k * 10 + n, kinds.get((k, n - 1), kinds.get((k, n), ""))) for k, n, _, _ in lines)
    got = catalogue.QUERIES["usable_mentions"](spark, str(tmp_path)).collect()
    assert sorted((x.mention_id, x.editorial_span) for x in got) == want


def most_joined(df):
    """Rows out of the largest join of a collected query."""

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().get("numOutputRows")
        kids = p.children()
        return max([own.get().value() if "Join" in name and own.isDefined() else 0, *(walk(kids.apply(i)) for i in range(kids.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_suggested_people_form_no_pairs(spark):
    from inkwell.operators import review as V

    r = random.Random(4)
    some = lambda *values: r.choice([*values, None])
    names = [(i // 2 if i < 20 else i, some("Ann", "Bob", "", "Cay"), some("holt", "gora", "lamo"), some(1600, 1601, 1605), r.randrange(9)) for i in range(1500)]
    people = [(r.randrange(10**6), some("ann", "Bob", ""), some("gora", "holt", "fimo"), a := some(1600, 1602), None if a is None else a + r.randrange(3)) for _ in range(1500)]
    n = spark.createDataFrame(names, "name long, given string, surname string, year int, n int")
    p = spark.createDataFrame(people, "person long, given string, surname string, first_year int, last_year int")
    context = spark.createDataFrame([(i, 7) for i in range(0, 1500, 10)], "name long, person long")
    df = V.suggestions(n, p, context, ["holt"], 4)
    got = sorted(map(repr, df.collect()))
    assert most_joined(df) < 20_000
    alive = lambda y, a, b: True if y is None else False if (a is not None and y < a) or (b is not None and y > b) else True
    facts = {}
    for name, given, surname, year, _ in names:
        met = [x for x in people if surname is not None and x[2] == surname]
        living = [x for x in met if alive(year, x[3], x[4])]
        same = [x[0] for x in living if given is not None and x[1] is not None and x[1].lower() == given.lower()]
        f = facts.setdefault(name, [0, 0, [], []])
        f[0], f[1] = f[0] + len(met), f[1] + len(living)
        f[2] += same
        f[3] += [x[0] for x in living]
    want = []
    for name, given, surname, _, times in names:
        met, living, same, by = facts[name]
        kind, who = "unknown", None
        if surname == "holt":
            kind = "not_a_name"
        elif met and not living:
            kind = "date_conflict"
        elif len(same) == 1:
            kind, who = "given_and_surname", min(same)
        elif living == 1 and given == "":
            kind, who = "only_person_with_surname", min(by)
        elif name % 10 == 0:
            kind, who = "context", 7
        elif living > 1:
            kind = "ambiguous"
        elif given and times >= 4:
            kind = "new_person"
        want.append(repr(Row(name=name, kind=kind, person=who)))
    assert got == sorted(want)


def test_suggestions_match_surnames_that_are_close_and_all_of_a_given_name_nobody_has(spark):
    from inkwell.operators import review as V

    names = [(1, "", "Dauers", 1620, 1), (2, "John", "Shippard", 1620, 1), (3, "", "Farrar", 1640, 1), (4, "", "Farrar", 1622, 1), (5, "Ann", "Ab", 1622, 9), (6, "Ann", "Rolfe", 1622, 9)]
    people = [(11, "ann", "Danvers", 1619, 1621), (12, "mary", "Sheppard", 1619, 1621), (13, "bob", "ffarrar", 1619, 1620)]
    n = spark.createDataFrame(names, "name long, given string, surname string, year int, n int")
    p = spark.createDataFrame(people, "person long, given string, surname string, first_year int, last_year int")
    context = spark.createDataFrame([], "name long, person long")
    got = {x.name: (x.kind, x.person) for x in V.suggestions(n, p, context, ["holt"], 4).collect()}
    assert got == {
        1: ("only_person_with_surname", 11), 2: ("given_and_surname", 12), 3: ("date_conflict", None),
        4: ("only_person_with_surname", 13), 5: ("skip", None), 6: ("new_person", None),
    }


def test_suggestions_equal_the_method_name_by_name(spark):
    from collections import Counter
    from difflib import SequenceMatcher

    from inkwell.operators import review as V

    r = random.Random(6)
    words = "danvers dauers farrar ffarrar sheppard shippard newport nuport holt ab gizmo gizmow gismow wolsey wolsie wolsye bull kupo kupou".split()
    shapes = {x.w: x.s for x in spark.createDataFrame([(w,) for w in words], "w string").select("w", X.surname_shape(F.col("w")).alias("s")).collect()}
    one = lambda a, b: a == b or (min(len(a), len(b)) >= 4 and SequenceMatcher(None, a, b).ratio() >= 0.82)
    some = lambda *values: r.choice([*values, None])
    rows, names = [], {}
    for i in range(160):
        names[i] = (some("", "", "Ann", "bob", "cay"), some(*words, *words), r.randrange(9), [some(1600, 1604, 1609) for _ in range(r.randint(1, 3))])
        rows += [(i, *names[i][:2], y, names[i][2]) for y in names[i][3]]
    people = [(100 + i // 2 * (i % 3 > 0) + 50 * (i % 3 == 0), some("ann", "Bob", ""), words[i], a := 1600 if i % 3 else some(1600, 1604), None if a is None else a + r.randrange(3)) for i in range(8)]
    seen = [(r.randrange(160), r.randrange(30)) for _ in range(4000)]
    met = [(x[0], r.randrange(30)) for x in people for _ in range(r.choice([1, 2, 30]))]
    named = [(r.choice(["", "Ann", "bob"]), w, r.randrange(1, 4)) for w in words[10:16] for _ in range(3)]
    written = [(r.choice(["Ann", "bob"]), w.upper(), r.randrange(1, 4)) for w in words[12:17]]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    got = V.suggestions(
        frame(rows, "name long, given string, surname string, year int, n int"), frame(people, "person long, given string, surname string, first_year int, last_year int"), None, ["holt"], 3,
        frame(seen, "name long, segment int"), frame(met, "person long, segment int"), frame(named, "given string, surname string, n int"), frame(written, "given string, surname string, n int"), {"bob": "robert"},
    ).distinct().collect()

    want, new = {}, []
    of = lambda p, i: {x[i] for x in people if x[0] == p} - {None}
    for name, (given, surname, _, years) in sorted(names.items(), key=lambda x: (-x[1][2], x[0])):
        given, years = (given or "").lower(), set(years) - {None}
        if surname is None or len(surname) < 3 or surname == "holt":
            want[name] = ({None: "unknown", "holt": "not_a_name"}.get(surname, "skip"), None, None)
            continue
        found = [p for p in {x[0] for x in people} if any(len(s) >= 3 and one(shapes[surname], shapes[s]) for s in of(p, 2))]
        found = [p for p in found if given and given in {g.lower() for g in of(p, 1)}] or found
        if len(found) == 1:
            a, b = of(found[0], 3), of(found[0], 4)
            beyond = [y for y in years if a and not min(a) - 2 <= y <= max(b) + 2]
            want[name] = ("date_conflict", None, None) if 2 * len(beyond) > len(years) else ("given_and_surname" if given else "only_person_with_surname", found[0], None)
        elif found:
            own = Counter(s for n, s in seen if n == name)
            score = sorted(((sum(min(c, met.count((p, s))) for s, c in own.items()), p) for p in found), reverse=True)
            want[name] = ("context", score[0][1], None) if score[0][0] >= max(3, 2 * score[1][0]) else ("ambiguous", None, None)
        else:
            full = Counter()
            for g, s, c in named:
                full[f"{g} {s}"] += c if g and shapes[s] == shapes[surname] else 0
            for g, s, c in written:
                full[f"{g} {s}"] += c if s.lower() == surname else 0
            full = sorted((-c, f) for f, c in full.items() if c >= 3)
            if full:
                g, s = full[0][1].split()
                g, s = {"bob": "robert"}.get(g.lower(), g.lower()).capitalize(), s[0].upper() + s[1:]
                head = next((h for h in new if h[0] == g and one(shapes[s.lower()], shapes[h[1].lower()])), None)
                if head is None:
                    new.append(head := (g, s))
            else:
                head = next((h for h in new if one(shapes[surname], shapes[h[1].lower()])), None)
            want[name] = ("new_person" if head else "unknown", None, head and " ".join(head))
    assert {x.name: (x.kind, x.person, x.proposed) for x in got} == want and len(got) == len(want)
    assert {k for k, _, _ in want.values()} == set("skip not_a_name date_conflict given_and_surname only_person_with_surname context ambiguous new_person unknown".split())


def test_full_names_in_texts_may_share_a_word(spark):
    from inkwell.operators import review as V

    texts = spark.createDataFrame([("Io: Francis Bacon and fra. \n Bacon, wfra Bacon, io Rolfes2",), (None,), ("Io Rolfe’s",)], "t string")
    got = {(x.given, x.surname): x.n for x in V.full_names(texts, "t", {"io": "john", "fra": "francis"}).collect()}
    assert got == {("Io:", "Francis"): 1, ("Francis", "Bacon"): 1, ("fra.", "Bacon"): 1, ("io", "Rolfes"): 1, ("Io", "Rolfe"): 1}


def test_near_page_classes_compare_few_sets_that_meet_by_chance(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(120)]
    texts = [" ".join(r.sample(vocabulary, 12)) for _ in range(400)]
    df = L.near_page_classes(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    assert len(df.collect()) == 400 and most_joined(df) < 5000


@pytest.mark.parametrize("sent", [L.SENT, 40])
def test_near_pages_read_texts_only_where_lists_do_not_tell_the_score(spark, monkeypatch, sent):
    from inkwell.llm import common

    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(40)]
    texts = [" ".join(vocabulary[i : i + 2]) for i in range(0, 20, 2)] + [" ".join(r.sample(vocabulary, 30)) for _ in range(60)]
    texts += [t.replace(t.split()[5], "other" + t.split()[5]) for t in texts[10:20]]
    sets = [set(t.split()) for t in texts]
    pages = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    kept = []
    monkeypatch.setattr(L, "SENT", sent)
    monkeypatch.setattr(common, "staged", lambda t, name, f=common.staged: kept.append((name, f(t, name))) or kept[-1][1])
    monkeypatch.setattr(common, "remove", lambda path: None)
    got = {(x.a, x.b): x.score for x in L.near_page_pairs(pages).collect()}
    share = lambda a, b: len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b]))
    assert got == {(a, b): share(a, b) for b in range(len(texts)) for a in range(b) if share(a, b) >= 0.9} and min(got.values()) < 1
    names = [name for name, _ in kept]
    assert names.count("pages") == 1 and (names.count("met") > 1) == (sent == 40)
    assert sum(df.filter("score is not null").count() for name, df in kept if name == "met") > 10
