"""Queries on review queues and breakdowns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import review as V
from inkwell.plans.expected import EXPECTED
from inkwell.sources.readers import table
from inkwell.sources.writers import hard_negatives as negatives
from inkwell.sources.writers import review_queue as queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql or f.__name__ in EXPECTED:
            SQL[f.__name__] = sql or EXPECTED[f.__name__]
        return f

    return add


@query("SELECT event_id, user_id, event_type, '' AS decision, '' AS note FROM events WHERE event_type IN ('error', 'signup')")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return queue(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type", ["error", "signup"], ["decision", "note"])


@query("""WITH f(form, proposed) AS (VALUES ('Brand#11', 'office'), ('brand#22', 'place'))
SELECT p_partkey, p_brand, proposed FROM part JOIN f ON lower(p_brand) = lower(form)""")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    forms = spark.createDataFrame([("Brand#11", "office"), ("brand#22", "place")], "form string, proposed string")
    return negatives(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", forms)


@query("""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+\\s+[A-Z][a-z]+') AS m FROM documents)
SELECT doc_id, m[-1] AS name FROM p WHERE len(m) > 0""".replace("\\\\", "\\"))
def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.operators.linking import first_per
    from inkwell.operators.spans import matches

    hits = matches(table(spark, d, "documents"), "text", r"[A-Z][a-z]+\s+[A-Z][a-z]+", ["doc_id"])
    return first_per(hits.withColumn("o", -F.col("i")), ["doc_id"], ["o"]).select("doc_id", F.col("span").alias("name"))


PAIR = r"\p{Lu}[\p{L}’']+\s+(?:\p{Lu}|ff)[\p{L}’']+"
TITLED = rf"(?i:\b(?:sir|captain|master|lady))[.:]?\s+{PAIR}"


def places(pattern: str, name: str) -> str:
    """CTE of doc_id, span, start and end of a pattern's places."""
    q = pattern.replace("'", "''")
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(text, '{q}') AS m, string_split_regex(text, '{q}') AS g FROM documents),
{name}_x AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name} AS (SELECT doc_id, m[i] AS span, list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e FROM {name}_x)"""


@query(f"""WITH {places(PAIR, "b")}, {places(TITLED, "t")}, r AS (SELECT b.doc_id, b.span AS name, b.e - length(b.span) AS start, t.e IS NOT NULL AS titled FROM b LEFT JOIN t ON b.doc_id = t.doc_id AND b.e = t.e)
SELECT doc_id, name, CAST(start AS INTEGER) AS start, titled FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY titled DESC, start DESC) AS i FROM r) WHERE i = 1""")
def titled_names(spark: SparkSession, d: str) -> DataFrame:
    return V.name_candidates(table(spark, d, "documents"), "doc_id", "text", "sir|captain|master|lady")


# Customers are unreviewed names, suppliers people, part names the text; four orders with consecutive keys are a meeting.
GIVEN = ("hot", "cold", "old", "new")
UNREVIEWED = ("dauers", "ffarrar", "meuerell", "shippard", "holt", "newport", "gizmo", "gizmow", "wolsey", "wolsie", "ab", "kupo")
PEOPLE = ("farrar", "meverell", "sheppard", "holt", "newport", "rolfe")


@query(f"""WITH u AS (SELECT c_custkey AS name, ({list(UNREVIEWED)})[c_nationkey % 12 + 1] AS surname, CAST(1992 + c_custkey % 7 AS INTEGER) AS year, c_custkey % 9 AS n,
       CASE WHEN c_custkey % 3 = 0 OR c_nationkey % 12 IN (7, 11) THEN '' WHEN c_nationkey % 12 IN (8, 9) THEN 'new' ELSE ({list(GIVEN)})[c_custkey % 4 + 1] END AS given FROM customer),
p AS (SELECT s_suppkey AS person, CASE WHEN s_suppkey = 1 THEN 'danvers' ELSE ({list(PEOPLE)})[s_nationkey % 6 + 1] END AS surname, ({list(GIVEN)})[s_suppkey % 4 + 1] AS given,
       CAST(1992 + s_suppkey % 3 AS INTEGER) AS a, CAST(1994 + s_suppkey % 3 AS INTEGER) AS b FROM supplier),
one(s, t) AS (VALUES ('dauers', 'danvers'), ('ffarrar', 'farrar'), ('meuerell', 'meverell'), ('shippard', 'sheppard'), ('holt', 'holt'), ('newport', 'newport')),
k AS (SELECT s, person, given, a, b FROM p JOIN one ON surname = t),
g AS (SELECT s, given, count(*) AS c, min(person) AS w FROM k GROUP BY ALL), h AS (SELECT s, sum(c) AS c, min(w) AS w FROM g GROUP BY s),
c AS (SELECT u.*, coalesce(g.c, h.c, 0) AS c, coalesce(g.w, h.w) AS w, g.c IS NOT NULL AS own FROM u LEFT JOIN g ON g.s = surname AND g.given = u.given LEFT JOIN h ON h.s = surname),
x AS (SELECT o_custkey AS name, o_orderkey // 4 AS m, count(*) AS x FROM orders GROUP BY ALL), y AS (SELECT l_suppkey AS person, l_orderkey // 4 AS m, count(*) AS y FROM lineitem GROUP BY ALL),
z AS (SELECT c.name, k.person, sum(least(x, y)) AS z FROM c JOIN x USING (name) JOIN y USING (m) JOIN k ON k.person = y.person AND k.s = surname AND (NOT own OR k.given = c.given) WHERE c.c > 1 GROUP BY ALL),
i AS (SELECT name, person FROM (SELECT *, row_number() OVER w AS i, coalesce(lead(z) OVER w, 0) AS next FROM z WINDOW w AS (PARTITION BY name ORDER BY z DESC, person)) WHERE i = 1 AND z >= 3 AND z >= 2 * next),
d AS (SELECT c.name, surname, n, CASE WHEN length(surname) < 3 THEN 'skip' WHEN surname = 'holt' THEN 'not_a_name' WHEN c = 1 AND year NOT BETWEEN k.a - 2 AND k.b + 2 THEN 'date_conflict' WHEN c = 1 AND c.given <> '' THEN 'given_and_surname'
       WHEN c = 1 THEN 'only_person_with_surname' WHEN i.person IS NOT NULL THEN 'context' WHEN c > 1 THEN 'ambiguous' END AS kind, w, i.person AS met FROM c LEFT JOIN k ON k.person = w AND k.s = surname LEFT JOIN i ON i.name = c.name),
f AS (SELECT given || ' ' || surname AS f, surname, n FROM u WHERE given <> '' UNION ALL SELECT p_name, split_part(p_name, ' ', 2), 1 FROM part WHERE split_part(p_name, ' ', 1) IN {GIVEN}),
e AS (SELECT surname, arg_min(f, (-n, f)) AS f FROM (SELECT surname, f, sum(n) AS n FROM f GROUP BY ALL HAVING sum(n) >= 4) GROUP BY surname),
o AS (SELECT name, d.surname, row_number() OVER (ORDER BY n DESC, name) AS r, split_part(f, ' ', 1) AS given, upper(f[1]) || split_part(f, ' ', 1)[2:] || ' ' || upper(d.surname[1]) || d.surname[2:] AS f FROM d LEFT JOIN e USING (surname) WHERE kind IS NULL),
like_(s, t) AS (VALUES ('gizmo', 'gizmow'), ('gizmow', 'gizmo'), ('wolsey', 'wolsie'), ('wolsie', 'wolsey')),
q AS (SELECT surname, given, f, min(r) AS r FROM o WHERE f IS NOT NULL GROUP BY ALL),
m AS (SELECT q.*, CASE WHEN a.r < q.r THEN a.f ELSE q.f END AS head FROM q LEFT JOIN like_ ON s = surname LEFT JOIN q a ON a.surname = t AND a.given = q.given),
v AS (SELECT s AS surname, arg_min(head, r) AS head, min(r) AS r FROM m JOIN like_ ON t = surname WHERE head = f GROUP BY s),
l AS (SELECT name, coalesce(m.head, CASE WHEN v.r < o.r THEN v.head END) AS proposed FROM o LEFT JOIN m USING (surname) LEFT JOIN v USING (surname))
SELECT name, coalesce(kind, CASE WHEN proposed IS NULL THEN 'unknown' ELSE 'new_person' END) AS kind, CASE WHEN kind IN ('given_and_surname', 'only_person_with_surname') THEN w WHEN kind = 'context' THEN met END AS person, proposed
FROM d LEFT JOIN l USING (name)""")
def suggest_people(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    k, s, nation = F.col("c_custkey"), F.col("s_suppkey"), F.col("c_nationkey") % 12
    given = F.when((k % 3 == 0) | nation.isin(7, 11), "").when(nation.isin(8, 9), "new").otherwise(pick(GIVEN, k))
    names = table(spark, d, "customer").select(k.alias("name"), given.alias("given"), pick(UNREVIEWED, nation).alias("surname"), (1992 + k % 7).cast("int").alias("year"), (k % 9).alias("n"))
    surname = F.when(s == 1, "danvers").otherwise(pick(PEOPLE, F.col("s_nationkey")))
    people = table(spark, d, "supplier").select(s.alias("person"), pick(GIVEN, s).alias("given"), surname.alias("surname"), (1992 + s % 3).cast("int").alias("first_year"), (1994 + s % 3).cast("int").alias("last_year"))
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.expr("o_orderkey div 4").alias("segment"))
    met = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("person"), F.expr("l_orderkey div 4").alias("segment"))
    written = V.full_names(table(spark, d, "part"), "p_name", {x: x for x in GIVEN})
    return V.suggestions(names, people, None, ["holt"], 4, seen, met, names.select("given", "surname", "n"), written)


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS i FROM c)
SELECT lang, source, n FROM r WHERE i <= 8""")
def peak_records(spark: SparkSession, d: str) -> DataFrame:
    return V.breakdown(table(spark, d, "documents"), "lang", "source", "source", "text", {"number": "[0-9]"})["records"]


WORDS = """f AS (SELECT lang, translate(word, 'vj', 'ui') AS key, word, count(*) AS c FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM (SELECT DISTINCT lang, source, text FROM documents)) GROUP BY ALL),
c AS (SELECT lang, key, sum(c) AS n, arg_min(word, (-c, word)) AS word FROM f GROUP BY lang, key),
t AS (SELECT lang, key, word, CAST(n AS BIGINT) AS n, sum(n) OVER (PARTITION BY key) AS a, sum(n) OVER (PARTITION BY lang) AS s, sum(n) OVER () AS t FROM c),
p AS (SELECT *, CAST(500 AS DOUBLE) * a / t AS p, a - n AS o, t - s AS r FROM t WHERE n >= 3),
z AS (SELECT *, (ln((n + p) / (s + 500 - n - p)) - ln((o + p) / (r + 500 - o - p))) / sqrt(1 / (n + p) + 1 / (o + p)) AS z FROM p)"""


@query(f"""WITH {WORDS} SELECT lang, word, n, round(z, 1) AS z FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(z, 6) DESC, key) AS i FROM z WHERE z > 1.96) WHERE i <= 12""")
def peak_words(spark: SparkSession, d: str) -> DataFrame:
    return V.breakdown(table(spark, d, "documents"), "lang", "source", "source", "text", {"number": "[0-9]"})["words"]


@query("SELECT lang, count(*) AS total, CAST(greatest(0, count(DISTINCT source) - 2) AS BIGINT) AS more_records FROM documents GROUP BY lang")
def peak_totals(spark: SparkSession, d: str) -> DataFrame:
    return V.breakdown(table(spark, d, "documents"), "lang", "source", "source", "text", {"number": "[0-9]"}, records=2)["more_records"]


@query(r"""WITH c AS (SELECT lang, source, count(*) AS n, arg_min(text, doc_id) AS text FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS i, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM c)
SELECT lang, source, n, CASE WHEN length(t) <= 240 THEN t ELSE regexp_replace(left(t, 240), ' [^ ]*$', '') || ' …' END AS text FROM r WHERE i <= 3""")
def peak_examples(spark: SparkSession, d: str) -> DataFrame:
    return V.examples(table(spark, d, "documents"), "lang", "source", "text", "doc_id")


@query()
def record_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = [("CCLXXX. COUNCIL IN VIRGINIA. LETTER TO THE COMPANY JANUARY 20, 1622 Manuscript Records",), ("I. SIR THOMAS GATES. A COMMISSION 1609 Document in the Library",), ("Short",)]
    return spark.createDataFrame(rows, "heading string").select("heading", V.document_title(F.col("heading")).alias("title"))


@query()
def listed_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, "LIST\n 1. A letter to Sir Thomas Smith. \n2. A note of shipping\n2. A double entry"), (2, "3. The last one ...")]
    return V.list_entries(spark.createDataFrame(rows, "page int, text string"), "page", "text")


@query("""SELECT lang, array_to_string(list_sort(list(DISTINCT source))[1:3], ' | ') AS contexts FROM documents GROUP BY lang""")
def gathered_contexts(spark: SparkSession, d: str) -> DataFrame:
    return V.contexts(table(spark, d, "documents"), "lang", "source")
