"""Queries on texts: normal forms, spans, dates, fuzzy lookup, relations, layout, streams."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import dates as D
from inkwell.functions import lexicon as V
from inkwell.functions import text as X
from inkwell.operators import fuzzy as Z
from inkwell.operators import layout as L
from inkwell.operators import linking as K
from inkwell.operators import mentions as N
from inkwell.operators import relations as R
from inkwell.operators import segments as S
from inkwell.operators import spans as P
from inkwell.plans.expected import EXPECTED
from inkwell.sources.readers import table
from inkwell.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql or f.__name__ in EXPECTED:
            SQL[f.__name__] = sql or EXPECTED[f.__name__]
        return f

    return add


LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


PHRASE = f"regexp_extract_all(replace(lower(X), 'ß', 'ss'), '{LETTERS}')"


@query(f"""WITH t AS (SELECT doc_id, {PHRASE.replace("X", "text")} AS p, {PHRASE.replace("X", "split_part(text, '. ', 1)")} AS h FROM documents)
SELECT doc_id, md5(array_to_string(p, ' ')) AS phrase, md5(array_to_string(list_transform(CASE WHEN len(h) >= 2 THEN h ELSE p END, lambda w: CASE w WHEN 'iohn' THEN 'john' WHEN 'the' THEN 'ye' ELSE w END), ' ')) AS key FROM t""")
def normalize_phrase(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalized_phrase(t)).alias("phrase"), F.md5(X.match_key(t, {"iohn": "john", "the": "ye"})).alias("key"))


DOUBLES = "w"
for _c in "abcdefghijklmnopqrstuvwxyz":
    DOUBLES = f"regexp_replace({DOUBLES}, '{_c}+', '{_c}', 'g')"


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
a AS (SELECT word, replace(replace(replace(translate(word, 'vjyw', 'uiiu'), 'ph', 'f'), 'ck', 'k'), 'q', 'k') AS x FROM t),
b AS (SELECT word, regexp_replace(regexp_replace(x, 'c([aoukl])', 'k\\1', 'g'), 'c([aoukl])', 'k\\1', 'g') AS w FROM a),
c AS (SELECT word, {DOUBLES} AS k FROM b)
SELECT word, CASE WHEN k LIKE '%ies' AND length(k) >= 7 THEN left(k, length(k) - 3) WHEN k LIKE '%es' AND length(k) >= 6 THEN left(k, length(k) - 2)
                  WHEN k LIKE '%s' AND length(k) >= 5 THEN left(k, length(k) - 1) ELSE k END AS skeleton FROM c""")
def skeleton(spark: SparkSession, d: str) -> DataFrame:
    # DuckDB lowers the dotted capital I to one letter, Spark to an i and a mark.
    t = F.lower(F.replace(F.col("text"), F.lit("İ"), F.lit("i")))
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", X.skeleton(F.col("word")).alias("skeleton"))


@query("""WITH s AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[0-9]+')) AS span, generate_subscripts(regexp_extract_all(text, '[0-9]+'), 1) AS i, string_split_regex(text, '[0-9]+') AS g, regexp_extract_all(text, '[0-9]+') AS m FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start,
       CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS INTEGER) AS "end", span FROM s""")
def span_offsets(spark: SparkSession, d: str) -> DataFrame:
    return P.matches(table(spark, d, "documents"), "text", "[0-9]+", ["doc_id"])


ALIASES = "('PLACE', 'P1', 'of the', 1), ('PLACE', 'P2', 'the and', 1), ('PERSON', 'A1', 'and', 1), ('PERSON', 'A2', 'is a', 0), ('PERSON', 'A3', 'and the', 1), ('NOT_ENTITY', 'X', 'it is', 2)"


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT col1 AS label, col2 AS entity, col3 AS form, col4 AS priority FROM VALUES {ALIASES}")


@query(f"""WITH a(label, entity, form, priority) AS (VALUES {ALIASES}),
t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS m, string_split_regex(text, '[\\p{{L}}\\p{{N}}]+') AS g FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, g FROM t),
n AS (SELECT doc_id, lower(m[i]) AS key FROM x UNION ALL SELECT doc_id, lower(m[i]) || ' ' || lower(m[i + 1]) FROM x WHERE i < len(m) AND regexp_full_match(g[i + 1], '\\s+'))
SELECT doc_id, label, entity, count(*) AS n FROM n JOIN a ON key = form GROUP BY ALL""")
def dict_counts(spark: SparkSession, d: str) -> DataFrame:
    found = P.dictionary_hits(table(spark, d, "documents"), "text", ["doc_id"], dictionary(spark))
    return found.groupBy("doc_id", "label", "entity").agg(F.count("*").alias("n"))


@query(f"""WITH a(label, entity, form, priority) AS (VALUES {ALIASES}),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS m, string_split_regex(text, '[\\p{{L}}\\p{{N}}]+') AS g FROM documents),
x AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda w: length(w))) AS len, unnest(list_transform(g[1:len(m)], lambda w: length(w))) AS gap FROM t),
p AS (SELECT *, sum(len + gap) OVER (PARTITION BY doc_id ORDER BY i) - len AS start, sum(len + gap) OVER (PARTITION BY doc_id ORDER BY i) AS "end" FROM x),
n AS (SELECT doc_id, start, "end", lower(m[i]) AS key FROM p UNION ALL SELECT doc_id, start, lead("end") OVER (PARTITION BY doc_id ORDER BY i), CASE WHEN i < len(m) AND regexp_full_match(g[i + 1], '\\s+') THEN lower(m[i]) || ' ' || lower(m[i + 1]) END FROM p)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", label, entity, CAST(priority AS INTEGER) AS priority FROM n JOIN a ON key = form""".replace("\\\\", "\\"))
def dict_spans(spark: SparkSession, d: str) -> DataFrame:
    return P.dictionary_spans(table(spark, d, "documents"), "text", ["doc_id"], dictionary(spark))


@query(f"""WITH h AS ({SQL["dict_spans"]}), i AS (SELECT *, sum(CASE WHEN start >= reach OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, label ORDER BY start, "end" DESC) AS island FROM (SELECT *, max("end") OVER (PARTITION BY doc_id, label ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h)),
q AS (SELECT doc_id, label, island, list(struct_pack(n := "end" - start, s := start, label := label, entity := entity, priority := priority) ORDER BY start, "end" DESC) AS vs FROM i GROUP BY ALL),
l AS (SELECT doc_id, unnest(list_reduce(list_transform(vs, lambda z: [z]), lambda x, z: CASE WHEN x[-1].s + x[-1].n <= z[1].s THEN list_concat(x, z) ELSE x END)) AS v FROM q),
c AS (SELECT doc_id, v, sum(CASE WHEN v.s >= reach OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY v.s, v.n, v.label) AS island FROM (SELECT *, max(v.s + v.n) OVER (PARTITION BY doc_id ORDER BY v.s, v.n, v.label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM l)),
k AS (SELECT doc_id, island, list(v ORDER BY v.n DESC, v.priority, v.s, v.label) AS vs FROM c GROUP BY ALL),
r AS (SELECT doc_id, unnest(list_reduce(list_transform(vs, lambda z: [z]), lambda x, w: CASE WHEN len(list_filter(x, lambda y: y.s < w[1].s + w[1].n AND w[1].s < y.s + y.n)) = 0 THEN list_concat(x, w) ELSE x END)) AS v FROM k)
SELECT doc_id, v.s AS start, v.s + v.n AS "end", v.label AS label, v.entity AS entity, v.priority AS priority FROM r""")
def dict_spans_packed(spark: SparkSession, d: str) -> DataFrame:
    return P.authority_spans(table(spark, d, "documents"), "text", ["doc_id"], dictionary(spark))


SPANS = "r AS (SELECT l_orderkey AS page, l_linenumber * 10 AS s, l_linenumber * 10 + 1 + CAST(l_quantity AS INTEGER) % 25 AS e FROM lineitem)"


def line_spans(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") * 10
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("start"), (n + 1 + F.col("l_quantity").cast("int") % 25).alias("end"), "l_returnflag", "l_linestatus")


@query(f"""WITH {SPANS} SELECT page, s AS start, e AS "end" FROM (SELECT *, max(e) OVER (PARTITION BY page ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r) WHERE m IS NULL OR e > m""")
def nested_longest(spark: SparkSession, d: str) -> DataFrame:
    return P.not_nested(line_spans(spark, d).select("page", "start", "end"), ["page"])


MERGE = "q AS (SELECT row_number() OVER () AS i, l_orderkey AS page, l_linenumber * 10 AS s, l_linenumber * 10 + 1 + CAST(l_quantity AS INTEGER) % 25 AS e, l_returnflag AS f, l_linestatus AS t FROM lineitem)"


@query(f"""WITH {MERGE}, h AS (SELECT * FROM q a WHERE f = 'R' AND NOT (t = 'O' AND EXISTS (SELECT 1 FROM q b WHERE b.f <> 'R' AND b.f = 'N' AND a.page = b.page AND b.s < a.e AND a.s < b.e)))
SELECT page, s AS start, e AS "end", 'hit' AS origin FROM h UNION ALL SELECT page, s, e, 'row' FROM q a WHERE f <> 'R' AND NOT EXISTS (SELECT 1 FROM h WHERE h.page = a.page AND h.s < a.e AND a.s < h.e)""")
def overlap_merge(spark: SparkSession, d: str) -> DataFrame:
    t = line_spans(spark, d)
    out = P.merge_overlaps(t.filter("l_returnflag <> 'R'"), t.filter("l_returnflag = 'R'"), ["page"], F.col("l_linestatus") == "O", F.col("l_returnflag") == "N")
    return out.select("page", "start", "end", "origin")


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ (?:of|de|von) [A-Za-z]+')) AS span FROM documents)
SELECT lower(span) AS key, count(*) AS n, count(DISTINCT doc_id) AS pages FROM m GROUP BY ALL HAVING count(*) >= 2""")
def discover_groups(spark: SparkSession, d: str) -> DataFrame:
    hits = P.matches(table(spark, d, "documents"), "text", "[A-Z][a-z]+ (?:of|de|von) [A-Za-z]+", ["doc_id"])
    return N.discovered(hits, "doc_id", 2).select("key", "n", "pages")


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+ (?:Hundred|Island|River)')) AS INTEGER) AS suffix, CAST(len(regexp_extract_all(text, 'Cape [A-Z][a-z]+')) AS INTEGER) AS cape FROM documents""")
def shape_hits(spark: SparkSession, d: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("int")
    return table(spark, d, "documents").select("doc_id", count("[A-Z][a-z]+ (?:Hundred|Island|River)").alias("suffix"), count("Cape [A-Z][a-z]+").alias("cape"))


PAGES = [
    ("V01-P0001", 1, 1, "APRIL 28, 1619 3\nA COURT HELD FOR VIRGINIA THE 28 OF APRIL 1619\nPRESENT\nSir Edwin Sandys.\nmr Iohn Ferrar. mr Wrote\nLord Sheffield\n\nThe court was moved to consider of the land that was graunted last yeare to them."),
    ("V01-P0002", 1, 2, "MAY 1619 4\nIt was ordered that Captaine Argall, late Governor of Virginia, should come home. Sir Thomas Smith went to Virginia, and Bermuda.\nCaptain Smith his wife Mary Smith was there."),
    ("V01-P0003", 1, 3, "no date here\nMAY THE 26 1619\nPRESENT\nMr Treasuror Sir Edwin Sandys\nMr Deputie Ferrar\nMr Wolstenholme"),
    ("V01-P0004", 1, 4, "JUNE 8, 1619 6\nMr Abdy\nSir Iohn Dauers\nThe said Sir John was by the court at length desired to write home."),
    ("V01-P0005", 1, 5, "JUNE 9, 1628 7\nA note of the shipping men and prouisions sent to Virginia by the treasurer"),
    ("V01-P0006", 1, 6, "Adams, Thomas, 12, 14.\nBacon, 22; 31-33.\nCape Henry, 4."),
    ("V01-P0007", 1, 7, "A plate"),
    ("V01-P0008", 1, 8, "Dale, Sir Thomas, 7, 9.\nElizabeth City, 22."),
    ("V03-P0001", 3, 1, "1607 1\nI. COUNCIL IN VIRGINIA. LETTER TO THE COUNCIL IN ENGLAND\nJUNE 22, 1607\nDocument in the Library\nWe acknowledge our selves."),
    ("V03-P0002", 3, 2, "1607 2\nand so wee rest.\nII. A LETTER OF IOHN PORY\n20 JANUARY 1620\nList of Records No. 12\nFrom Virginia with great hast."),
]


def book(spark: SparkSession) -> DataFrame:
    """A small book in the shape of the historical pages, as the driver's texts have no dates."""
    return spark.createDataFrame(PAGES, "page_id string, volume int, ord long, text string")


@query()
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    lines = book(spark).select("page_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.withColumn("d", D.parsed(F.col("line"), year_only=True)).select("page_id", "i", "line", "d.*")


@query()
def date_pages(spark: SparkSession, d: str) -> DataFrame:
    return S.date_pages(book(spark))


@query()
def segments(spark: SparkSession, d: str) -> DataFrame:
    pages = book(spark)
    return S.segments(S.date_pages(pages).join(pages.select("page_id", "text"), "page_id"))


@query()
def page_roles(spark: SparkSession, d: str) -> DataFrame:
    return S.page_roles(book(spark)).select("page_id", "role")


@query("""WITH t AS (SELECT conv_id, turn, length(trim(text)) AS n, regexp_matches(text, '[0-9]') AS hit FROM conversations),
b AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS block FROM t),
l AS (SELECT *, sum(CASE WHEN NOT hit THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, block ORDER BY turn DESC) > 2 AS long FROM b),
s AS (SELECT *, max(CASE WHEN NOT hit AND (n >= 400 OR long OR block = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS over FROM l)
SELECT conv_id, turn, over = 0 AND max(CASE WHEN hit AND over = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS in_tail FROM s""")
def index_tail_run(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    return S.trailing_run(t, ["conv_id"], "turn", F.col("text").rlike("[0-9]"), F.length(F.trim("text")) < 400, 2).select("conv_id", "turn", "in_tail")


@query()
def attendance_carry(spark: SparkSession, d: str) -> DataFrame:
    return S.attendance(book(spark), V.LIST_WORDS)


@query(r"""WITH x AS (SELECT doc_id, text, strpos(text, chr(10)) AS b FROM documents)
SELECT doc_id AS page_id, CAST(length(text) - length(ltrim(text)) AS INTEGER) AS start, CAST(CASE WHEN b > 0 THEN b - 1 ELSE length(text) END AS INTEGER) AS "end", 'running_head' AS kind FROM x WHERE trim(text) <> ''""")
def running_heads(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return S.editorial_spans(pages, "no such line").filter("kind = 'running_head'")


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
l AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS s FROM p), x AS (SELECT doc_id, text, strpos(text, chr(10)) AS b FROM documents)
SELECT doc_id AS page_id, CAST(s AS INTEGER) AS start, CAST(s + length(line) AS INTEGER) AS "end", 'editorial_metadata' AS kind FROM l WHERE i > 1 AND regexp_matches(line, '(?i)licen[cs]ed\s+under|public\s+license')
UNION ALL SELECT doc_id, CAST(length(text) - length(ltrim(text)) AS INTEGER), CAST(CASE WHEN b > 0 THEN b - 1 ELSE length(text) END AS INTEGER), 'running_head' FROM x WHERE trim(text) <> ''""".replace("\\\\", "\\"))
def editorial_spans(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return S.editorial_spans(pages, r"Licen[cs]ed\s+under|Public\s+License")


MENTIONS = [
    ("V01-P0002", "Captaine Argall", "person"), ("V01-P0002", "Virginia, should", "none"), ("V01-P0002", "Sir Thomas Smith", "person"),
    ("V01-P0002", "Virginia, and", "place"), ("V01-P0002", "Bermuda", "place"), ("V01-P0002", "Captain Smith", "person"), ("V01-P0002", "Mary Smith", "person"),
]


def book_mentions(spark: SparkSession) -> DataFrame:
    m = spark.createDataFrame(MENTIONS, "page_id string, span string, type string").filter("type <> 'none'").join(book(spark).select("page_id", "text"), "page_id")
    name = F.regexp_extract("span", "^[A-Za-z ]+", 0)
    start = F.position("span", "text") - 1
    return m.select("page_id", "type", name.alias("name"), start.alias("start"), (start + F.length(name)).alias("end"))


@query()
def relations_neighbour(spark: SparkSession, d: str) -> DataFrame:
    return R.relate(R.neighbours(book_mentions(spark), book(spark))).select("page_id", "name", "b_name", "relation", "confidence", "cue")


#: Sentences, the names in them in order, and their types: one for each rule and for what no rule takes.
SENTENCES = [
    ("Sir Iohn Wyatt Gouernor and Captaine generall of Virginia.", "Sir Iohn Wyatt:person Virginia:place"),
    ("Mr Pountis hath the command of Henrico.", "Mr Pountis:person Henrico:place"),
    ("Mr Bland his house at Kent.", "Mr Bland:person Kent:place"),
    ("Thomas Rich had 50 acres of land neere Henrico.", "Thomas Rich:person Henrico:place"),
    ("George Poole was slayne at Henrico.", "George Poole:person Henrico:place"),
    ("Anne Wood went to Bermuda, and Virginia.", "Anne Wood:person Bermuda:place Virginia:place"),
    ("Capt. Poole lately come from Bermuda.", "Capt. Poole:person Bermuda:place"),
    ("Iane Moore dwelling in the parish of Kent.", "Iane Moore:person Kent:place"),
    ("[Indorsed:] Mr Pory: from Virginia.", "Mr Pory:person Virginia:place"),
    ("a note to Mr Pory: from Virginia.", "Mr Pory:person Virginia:place"),
    ("Capt. Poole marched vpon Nansamums, & Wariscoyacks.", "Capt. Poole:person Nansamums:group Wariscoyacks:group"),
    ("Capt. Poole had trade with Patawomecks.", "Capt. Poole:person Patawomecks:group"),
    ("Mr Wood made a peace with Patawomecks.", "Mr Wood:person Patawomecks:group"),
    ("Mary Moore the daughter of Iohn Moore, and Thomas Bland.", "Mary Moore:person Iohn Moore:person Thomas Bland:person"),
    ("Thomas Bland his wife Anne Bland.", "Thomas Bland:person Anne Bland:person"),
    ("Robert Cole, his wife, Richard Rowe.", "Robert Cole:person Richard Rowe:person"),
    ("Iohn Rowe servant to Robert Cole.", "Iohn Rowe:person Robert Cole:person"),
    ("Robert Cole his man Iohn Rowe.", "Robert Cole:person Iohn Rowe:person"),
    ("Mr Wood. A letter to Mr Pory.", "Mr Wood:person Mr Pory:person"),
    ("Mr Wood wrote vnto Mr Pory.", "Mr Wood:person Mr Pory:person"),
    ("Mr Cole complayned of Mr Rowe.", "Mr Cole:person Mr Rowe:person"),
    ("Mr Cole his suit against the said Mr Rowe.", "Mr Cole:person Mr Rowe:person"),
    ("Mr Cole passed three shares vnto Mr Rowe.", "Mr Cole:person Mr Rowe:person"),
    ("Mr Cole to Mr Rowe for 3 shares.", "Mr Cole:person Mr Rowe:person"),
    ("Anne Wood maried to Iohn Rowe.", "Anne Wood:person Iohn Rowe:person"),
    ("At Henrico of Mr Bland his people.", "Henrico:place Mr Bland:person"),
    ("the Gouernor of Virginia, Mr Bland came.", "Virginia:place Mr Bland:person"),
    ("Mr Bland was heard. Virginia is far.", "Mr Bland:person Virginia:place"),
]


@query()
def relation_rules(spark: SparkSession, d: str) -> DataFrame:
    pages, mentions = [], []
    for i, (text, names) in enumerate(SENTENCES):
        page, at = f"s{i:02d}", 0
        pages.append((page, text))
        for name, kind in (x.rsplit(":", 1) for x in re.findall(r"\S.*?:(?:person|place|group)", names)):
            at = text.index(name, at)
            mentions.append((page, kind, name, at, at + len(name), f"K-{name}"))
            at += len(name)
    m = spark.createDataFrame(mentions, "page_id string, type string, name string, start int, end int, key string")
    return R.relations(m, spark.createDataFrame(pages, "page_id string, text string"))


@query()
def relations_spread(spark: SparkSession, d: str) -> DataFrame:
    return R.relations(book_mentions(spark), book(spark))


@query()
def titled_context(spark: SparkSession, d: str) -> DataFrame:
    pages = book(spark).select("page_id", "text")
    hits = P.matches(pages, "text", r"\b[A-Z][a-z]{3,}\b", ["page_id"]).join(pages, "page_id")
    found = P.context_columns(hits, "text", 40, 20)
    return N.titled(found, F.col("before")).filter("title is not null").select("page_id", "start", "span", "title")


@query()
def mention_decisions(spark: SparkSession, d: str) -> DataFrame:
    return N.extract(book(spark), dictionary_of_book(spark))


def dictionary_of_book(spark: SparkSession) -> DataFrame:
    rows = [("PLACE", "NW-001", "Virginia", 0), ("PLACE", "NW-002", "Bermuda", 0), ("PERSON", "Sandys, Edwin", "Sir Edwin Sandys", 0), ("PERSON", "Smith, Thomas", "Thomas Smith", 0), ("NOT_ENTITY", "court", "Court", 1)]
    return spark.createDataFrame(rows, "label string, entity string, form string, priority int")


@query()
def group_mentions(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.createDataFrame([("p1", "The Powhatans and the Chickahominys came. King of Nansamund river, and the Pamunkies Indians."), ("p2", "Pow-\nhatan sent corne; the sauages fled.")], "page_id string, text string")
    rows = [("group", "Powhatan", "Powhatan", None, False), ("group", "Chickahominy", "Chickahominy", None, False), ("group", "Nansemond", "Nansemond", "river", False), ("group", "Pamunkey", "Pamunkey", None, False), ("collective", "savages", "sauages", None, False)]
    lexicon = spark.createDataFrame(rows, "category string, entity string, seed string, homonym string, exact_only boolean")
    return N.groups(pages, lexicon)


PEOPLE = [("Sandys, Edwin", ["Sir Edwin Sandys", "Sandys", "Edwin  Sandys"]), ("Pocahontas", ["Matoaka", "Lady Rebecca"]), ("Bishop of London", ["John King"]), ("Argall", None)]


def people_of_book(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PEOPLE, "person string, aliases array<string>")


@query()
def matcher_entries(spark: SparkSession, d: str) -> DataFrame:
    contextual = spark.createDataFrame([(0, "the lord  Treasuror"), (1, "my lord")], "ord int, form string")
    places = spark.createDataFrame([("NW-001", ["Virginia", " Virginia  Colony "]), ("NW-002", [""])], "place_id string, aliases array<string>")
    excluded = spark.createDataFrame([("Smith", "too many people"), ("Tiger", "ship of 1620"), ("Ibid", "phrase")], "name string, reason string")
    more = spark.createDataFrame([("Henrico and Charles Citty", "Compound of two places"), ("Old Court", "a building")], "name string, reason string")
    return N.entries(people_of_book(spark), contextual, places, excluded, more)


@query()
def surname_set(spark: SparkSession, d: str) -> DataFrame:
    return N.surnames(people_of_book(spark))


@query()
def bare_surnames(spark: SparkSession, d: str) -> DataFrame:
    rows = [("p1", "PLACE", "OW-1", "Sandys", "mr Sandys moved the court"), ("p2", "PLACE", "OW-1", "Sandys", "they sailed from Sandys parish"), ("p3", "PLACE", "OW-2", "Sandys", "mr Sandys spoke"), ("p4", "PLACE", "OW-1", "Bacon", "mr Bacon spoke"), ("p5", "PERSON", "x", "Sandys", "mr Sandys")]
    found = spark.createDataFrame(rows, "page_id string, label string, entity string, span string, sentence string")
    places = spark.createDataFrame([("OW-1", "ambiguous_contextual"), ("OW-2", "exact")], "place_id string, matching_policy string")
    return N.bare_surnames(found, N.surnames(people_of_book(spark)), places, F.col("sentence"), ["from", "at", "in"], ["parish", "town"])


@query()
def cleaned_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = [("p", 10, "Sir Edwin Sandys moued"), ("p", 40, "Deputie"), ("p", 60, "(Sandys)."), ("p", 80, "Nos."), ("p", 90, "Counsell"), ("p", 100, "Edwin Sandys,"), ("p", 120, "Iohn Smith and others")]
    m = spark.createDataFrame(rows, "page_id string, start int, span string").withColumn("end", F.col("start") + F.length("span"))
    return N.cleaned(m)


@query()
def note_mentions(spark: SparkSession, d: str) -> DataFrame:
    notes = [("V01-P0002", [("Land graunted in Virginia to Sir Edwin Sandys.",), ("m' Steward. m' Binge. m' Tomlins.",)]), ("V01-P0003", None)]
    pages = spark.createDataFrame(notes, "page_id string, margin_notes array<struct<text:string>>")
    return N.note_mentions(pages, dictionary_of_book(spark))


@query()
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.operators.quality import flag_counts as counted

    return counted(S.page_roles(book(spark)), S.editorial_spans(book(spark), r"Document\s+in"))


def known_words(spark: SparkSession, d: str, least: int) -> DataFrame:
    """Distinct words of the benchmark texts, as a lexicon."""
    return table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{least},}}"), F.lit(0))).alias("word")).distinct()


@query()
def fuzzy_lookup(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))).alias("word")).distinct()
    lexicon = known_words(spark, d, 6).select(F.concat(F.lit("E-"), F.col("word")).alias("entity"), F.col("word").alias("seed"), (F.length("word") > 12).alias("exact_only"))
    return Z.lookup(words, lexicon)


@query()
def suggest_merge(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("word")).distinct()
    return Z.best_match(words, known_words(spark, d, 10), 0.84, 4, form="word")


@query()
def spelling_review(spark: SparkSession, d: str) -> DataFrame:
    words = fuzzy_lookup(spark, d).withColumn("reading", F.lit("group")).withColumn("context", F.col("word")).withColumn("ord", F.length("word"))
    return Z.spelling_review(words)


@query()
def merged_names(spark: SparkSession, d: str) -> DataFrame:
    rows = [("John Smith", "John", "Smith"), ("John Smyth", "John", "Smyth"), ("John Smythe", "John", "Smythe"), ("Mary Smith", "Mary", "Smith"), ("John Rolfe", "John", "Rolfe")]
    return Z.merge_names(spark.createDataFrame(rows, "name string, given string, surname string"))


@query("""WITH w AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.w AS x, b.w AS y FROM w a JOIN w b ON b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 3)
SELECT a, b, len(list_intersect(x, y)) / least(len(x), len(y)) AS score FROM p WHERE least(len(x), len(y)) > 0 AND len(list_intersect(x, y)) / least(len(x), len(y)) >= 0.25""")
def page_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    near = docs.select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 3)).alias("b"))
    return L.page_overlaps(docs, docs, near)


NEAR = """d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}'))) AS w FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM d x JOIN d y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY ALL)"""
PAIRS = """SELECT a, b, k / least(p.n, q.n) AS score FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE k / least(p.n, q.n) >= 0.9"""


@query(f"WITH {NEAR} {PAIRS}")
def near_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.near_page_pairs(docs)


@query(f"""WITH RECURSIVE {NEAR}, p AS ({PAIRS}), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS i FROM p),
o AS MATERIALIZED (SELECT a, b, score, row_number() OVER (ORDER BY score DESC, a DESC, b DESC) AS i FROM k WHERE i <= 5),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS score, false AS free, CAST([] AS BIGINT[]) AS x, CAST([] AS BIGINT[]) AS y
  UNION ALL SELECT i, a, b, score, free, CASE WHEN free THEN list_append(x, a) ELSE x END, CASE WHEN free THEN list_append(y, b) ELSE y END
  FROM (SELECT o.i, o.a, o.b, o.score, NOT list_contains(x, o.a) AND NOT list_contains(y, o.b) AS free, x, y FROM g JOIN o ON o.i = g.i + 1))
SELECT a, b, score FROM g WHERE free""")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return L.greedy_match(L.best_candidates(near_pages(spark, d)).withColumn("g", F.lit(1)), ["g"]).drop("g")


@query()
def html_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.html_lines(table(spark, d, "pages"), "page_id", "html")


@query()
def layout_classify(spark: SparkSession, d: str) -> DataFrame:
    return L.rebuilt_text(L.classify(L.line_segments(L.ocr_words(hocr(spark), "leaf", "html").withColumn("width", F.lit(1000)).withColumn("page_height", F.lit(1500))).withColumn("page_height", F.lit(1500)), "RECORDS|COURT"))


@query()
def layout_notes(spark: SparkSession, d: str) -> DataFrame:
    words = L.ocr_words(hocr(spark), "leaf", "html").withColumn("width", F.lit(1000))
    return L.margin_notes(L.classify(L.line_segments(words).withColumn("page_height", F.lit(1500)), "RECORDS|COURT"))


def hocr(spark: SparkSession) -> DataFrame:
    """Two made-up hOCR pages: a head, wide lines, a margin note and a footnote."""
    rows = []
    for leaf in (1, 2):
        lines = [(0, 40, 30, ["A", "COURT", "HELD"], 300)]
        lines += [(1, 100 + 60 * i, 30, f"the {i} line of the body runs over the whole width here".split(), 250) for i in range(10)]
        lines += [(2, 300, 20, ["Land", "graunted"], 20), (2, 340, 20, ["to", "Smith"], 20), (3, 1400, 12, ["1", "See", "the", "note"], 250)]
        html = ""
        for block, y, height, words, x in lines:
            spans = ""
            for word in words:
                spans += f"<span class='ocrx_word' title='bbox {x} {y} {x + 40} {y + height}; x_wconf 90'>{word}</span> "
                x += 48
            html += f"<div class='ocr_carea'><p class='ocr_par'><span class='ocr_line' title='bbox 0 {y} 1000 {y + height}'>{spans}</span></p></div>" if block != 2 or y == 300 else f"<span class='ocr_line'>{spans}</span>"
        rows.append((leaf, html))
    return spark.createDataFrame(rows, "leaf int, html string")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(table(spark, d, "events"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, i""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events"))


@query("""WITH w AS (SELECT unnest(range(0, 4)) AS k, ts FROM events)
SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start, count(*) AS n FROM w GROUP BY ALL""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return E.sliding(table(spark, d, "events"))


@query()
def sentences(spark: SparkSession, d: str) -> DataFrame:
    hits = P.matches(table(spark, d, "documents"), "text", "[0-9]{4,}", ["doc_id"]).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return hits.select("doc_id", "start", R.sentence(F.col("text"), F.col("start"), F.col("end")).alias("sentence"))


@query()
def found_again(spark: SparkSession, d: str) -> DataFrame:
    hits = P.matches(table(spark, d, "documents"), "text", "[A-Z][a-z]+ [a-z]+", ["doc_id"]).join(table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"), F.length("text").alias("size")), "doc_id")
    return P.nearest_place(hits.withColumn("expected", F.col("start") / F.col("size")), "text", "span", "expected").select("doc_id", "start", "span", "found_start", "found_end")


@query()
def map_rings(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.operators.graph import clipped

    ring = F.expr("transform(sequence(0, 40), i -> struct(cast(10 * cos(i * pi() / 20) as double) as lon, cast(10 * sin(i * pi() / 20) as double) as lat))")
    return clipped(spark.range(1).select("id", ring.alias("ring")), "ring", (0.0, 0.0, 20.0, 20.0), 0.05).select("id", F.to_json("clipped").alias("clipped"))


@query("""WITH o AS (SELECT o_custkey AS id, min(o_orderkey) AS first FROM orders GROUP BY 1) SELECT c_custkey, first FROM customer LEFT JOIN o ON c_custkey = id""")
def first_lookup(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    first = K.first_per(orders, ["o_custkey"], ["o_orderkey"]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first"))
    return table(spark, d, "customer").select("c_custkey").join(first, "c_custkey", "left")

