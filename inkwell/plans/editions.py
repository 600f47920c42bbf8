"""Queries on editions, dictionaries and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import layout as L
from inkwell.operators import linking as K
from inkwell.operators import metrics as M
from inkwell.operators import review as V
from inkwell.operators import spans as P
from inkwell.plans.counts import BOXES, place_frames
from inkwell.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Lines of an order are mentions on a page, two of which may share a span; returned ones are titled.
@query("""WITH l AS (SELECT l_orderkey AS page_id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS ord, l_linenumber // 2 * 10 AS s, l_linenumber // 2 * 10 + 5 + CAST(l_quantity AS INTEGER) % 3 * 5 AS e,
  CASE WHEN l_suppkey % 4 > 0 THEN 'S' || l_suppkey % 4 END AS person, l_returnflag AS f, l_linestatus AS t FROM lineitem),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, s, e ORDER BY ord) AS i FROM l WHERE f <> 'R') WHERE i = 1)
SELECT page_id || '-' || ord AS mention_id, page_id, CAST(s AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end, person, CASE WHEN person IS NULL THEN 'unresolved' ELSE 'alias' END AS method FROM o
UNION ALL SELECT page_id || '-' || ord, page_id, CAST(s AS INTEGER), CAST(e AS INTEGER), person, CASE WHEN person IS NULL THEN 'unresolved_title' ELSE 'territorial_title:' || t END FROM l
WHERE f = 'R' AND NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = l.page_id AND o.person IS NOT NULL AND o.s < l.e AND l.s < o.e AND (l.person IS NULL OR l.person = o.person))""")
def linked_people(spark: SparkSession, d: str) -> DataFrame:
    n = (F.floor(F.col("l_linenumber") / 2) * 10).cast("int")
    t = table(spark, d, "lineitem").withColumn("ord", F.col("l_linenumber") * F.lit(10**10) + F.col("l_partkey") * 10000 + F.col("l_suppkey"))
    person = F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("S"), (F.col("l_suppkey") % 4).cast("string")))
    mention = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("ord").cast("string"))
    m = t.select(mention.alias("mention_id"), F.col("l_orderkey").alias("page_id"), n.alias("span_start"), (n + 5 + F.col("l_quantity").cast("int") % 3 * 5).alias("span_end"), person.alias("person"), "ord", "l_returnflag", F.col("l_linestatus").alias("rule"))
    people = m.filter("l_returnflag <> 'R'").withColumn("method", F.when(F.col("person").isNull(), "unresolved").otherwise("alias"))
    return K.linked_people(people, m.filter("l_returnflag = 'R'"))


KNOWN = "('A', 'red widget'), ('A', 'Red  ring'), ('B', 'small ring'), ('C', 'small ring'), ('D', 'Dale')"
DECIDED = "('blue widget', 'excluded', NULL, 'a thing'), ('small bolt', 'curated_key', 'D', 'seen'), ('large widget', 'curated_key', 'D', 'seen')"


@query(f"""WITH a(person, alias) AS (VALUES {KNOWN}), x(key, action, person, basis) AS (VALUES {DECIDED}),
o AS (SELECT p_name AS key, p_name AS form, 1 AS own FROM part UNION ALL SELECT p_name, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type ELSE upper(p_name) END, 0 FROM part),
f AS (SELECT key, form, count(*) AS c, sum(own) AS own FROM o GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, form) AS i, sum(own) OVER (PARTITION BY key) AS n FROM f),
g AS (SELECT key, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY n DESC, key) AS rank FROM (SELECT DISTINCT key, n FROM r) WHERE n >= 3),
p AS (SELECT regexp_replace(lower(alias), ' +', ' ', 'g') AS key, list_sort(list(DISTINCT person)) AS people FROM a GROUP BY 1),
t AS (SELECT g.*, people, x.action IS NOT NULL AS mine, coalesce(x.action, CASE WHEN len(people) = 1 THEN 'matched_existing_alias' WHEN len(people) > 1 THEN 'ambiguous_alias' ELSE 'unreviewed' END) AS action,
        CASE WHEN x.action IS NOT NULL THEN x.person WHEN len(people) = 1 THEN people[1] END AS person, CASE WHEN x.action IS NOT NULL THEN x.basis WHEN len(people) > 1 THEN 'Matches aliases of: ' || array_to_string(people, '; ') END AS basis
      FROM g LEFT JOIN p USING (key) LEFT JOIN x USING (key)),
w AS (SELECT t.person, t.key, rank, i, form, row_number() OVER (PARTITION BY t.person, lower(form) ORDER BY rank, i) AS j FROM t JOIN r ON t.key = r.key WHERE t.person IS NOT NULL AND i <= 8
      AND lower(form) <> 'red widget promo' AND NOT EXISTS (SELECT 1 FROM a WHERE a.person = t.person AND regexp_replace(lower(a.alias), ' +', ' ', 'g') = lower(form))),
s AS (SELECT key, string_agg(form, '|' ORDER BY i) AS added FROM w WHERE j = 1 GROUP BY key)
SELECT rank, t.key, t.key AS name, n, action, person, coalesce(added, '') AS added, basis FROM t LEFT JOIN s ON t.key = s.key""")
def extension_log(spark: SparkSession, d: str) -> DataFrame:
    name, i = F.col("p_name"), F.col("p_partkey") % 3
    span = F.when(i == 0, F.concat(name, F.lit(" ,"))).when(i == 1, F.concat_ws(" ", name, "p_type")).otherwise(F.upper(name))
    known = spark.sql(f"SELECT col1 AS person, col2 AS alias FROM VALUES {KNOWN}")
    decided = spark.sql(f"SELECT col1 AS key, col2 AS action, col3 AS person, col4 AS basis FROM VALUES {DECIDED}")
    skipped = spark.sql("SELECT 'A' AS person, 'red widget  PROMO' AS alias")
    out = K.extension_log(table(spark, d, "part").select(name.alias("name"), span.alias("span")), known, decided, skipped, 3)
    return out.withColumn("added", F.array_join("added", "|"))


SEEDS = "('s30', 'Seed'), ('s30', 'SUPPLIER#000000070'), ('s3', 'never')"


@query(f"""WITH p AS (SELECT 's' || s_nationkey AS person, s_name AS alias FROM supplier), z(person, alias) AS (VALUES {SEEDS}),
w AS (SELECT CASE WHEN c_custkey % 5 > 0 THEN 's' || c_custkey % 40 ELSE '' END AS person, CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, 'Customer', 'SUPPLIER') ELSE c_mktsegment END AS alias, 1 AS k, c_custkey AS ord FROM customer),
r AS (SELECT * FROM w WHERE person <> '' UNION ALL SELECT person, alias, 0, 0 FROM z WHERE person IN (SELECT person FROM w) AND person NOT IN (SELECT person FROM p)),
i AS (SELECT *, row_number() OVER (PARTITION BY person, lower(alias) ORDER BY k, ord, alias) AS i FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.person = r.person AND lower(p.alias) = lower(r.alias)))
SELECT person, alias, person NOT IN (SELECT person FROM p) AS new_person FROM i WHERE i = 1""")
def updated_aliases(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    people = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("person"), F.col("s_name").alias("alias"))
    person = F.when(key % 5 > 0, F.concat(F.lit("s"), (key % 40).cast("string"))).otherwise("")
    span = F.when(key % 2 == 0, F.concat(F.replace("c_name", F.lit("Customer"), F.lit(" SUPPLIER")), F.lit(" ,"))).otherwise(F.col("c_mktsegment"))
    return V.updated_aliases(people, table(spark, d, "customer").select(key.alias("ord"), person.alias("person"), span.alias("span")), spark.sql(f"SELECT col1 AS person, col2 AS alias FROM VALUES {SEEDS}"))


@query("""SELECT * FROM (VALUES ('Rich: Rogers', 'Richard Rogers'), ('Tho: ffelgate', 'Thomas Felgate'), ('iohn van  smith', 'John Smith'), ('Argall', 'Argall'), ('', '')) v(name, standard)""")
def standard_names(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("Rich: Rogers",), ("Tho: ffelgate",), ("iohn van  smith",), ("Argall",), ("",)], "name string")
    return names.withColumn("standard", X.standard_name(F.col("name"), {"rich": "richard", "tho": "thomas", "iohn": "john"}))


@query("""WITH s AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS span, generate_subscripts(regexp_extract_all(text, '[0-9]{4,}'), 1) AS i, string_split_regex(text, '[0-9]{4,}') AS g, regexp_extract_all(text, '[0-9]{4,}') AS m FROM documents),
p AS (SELECT doc_id, text, span, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM s),
h AS (SELECT *, left(text, CAST(a AS BIGINT)) AS head, substr(text, CAST(a AS BIGINT) + length(span) + 1) AS tail FROM p),
q AS (SELECT *, least(length(split_part(head, '.', -1)), length(split_part(head, ';', -1)), length(split_part(head, chr(10) || chr(10), -1))) AS b,
             coalesce(least(nullif(instr(tail, '.'), 0), nullif(instr(tail, ';'), 0), nullif(instr(tail, chr(10) || chr(10)), 0)), length(tail)) AS c FROM h)
SELECT doc_id, CAST(a AS INTEGER) AS start, regexp_replace(right(head, b) || span || left(tail, c), '^\\s+|\\s+$', '', 'g') AS passage FROM q""")
def passages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = P.matches(docs, "text", "[0-9]{4,}", ["doc_id"]).join(docs.select("doc_id", "text"), "doc_id")
    return hits.select("doc_id", "start", X.passage(F.col("text"), F.col("start"), F.col("end")).alias("passage"))


@query("""WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}'))) AS w FROM documents),
s AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY w) AS k FROM d GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM d x JOIN d y ON x.w = y.w AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, count(*) AS links FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE c.k / least(p.n, q.n) >= 0.9 GROUP BY a)
SELECT t.doc_id AS id, coalesce(min(t.doc_id) OVER (PARTITION BY s.k, CASE WHEN s.k IS NULL THEN t.doc_id END), t.doc_id) AS class_id, coalesce(links, 0) AS links FROM documents t LEFT JOIN s ON s.doc_id = t.doc_id LEFT JOIN l ON a = t.doc_id""")
def near_page_classes(spark: SparkSession, d: str) -> DataFrame:
    return L.near_page_classes(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query()
def edition_matches(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as volumes: turns are pages, and the new edition has them two leaves later; every ninth page is blank in the old one."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("volume"), F.col("turn").alias("ord"), "text")
    page = F.concat_ws("-", F.col("volume").cast("string"), F.col("ord").cast("string"))
    old = t.select("volume", "ord", page.alias("page_id"), F.when(F.col("ord") % 3 != 1, F.col("ord")).alias("number"), F.when(F.col("ord") % 9 == 8, "").otherwise(F.col("text")).alias("text"))
    return L.edition_matches(old, t.select("volume", (F.col("ord") + 2).alias("leaf"), F.col("ord").alias("printed"), "text"))


FOUND = """f AS (SELECT o_custkey AS target, l_suppkey AS person, CAST(o_orderdate AS DATE) AS s, CAST(l_shipdate AS DATE) AS e, l_linenumber % 5 AS p, l_linenumber = 1 AND l_returnflag = 'R' AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b(frame, ord, west, south, east, north) AS (VALUES """ + BOXES + """), q AS (SELECT DISTINCT c_custkey AS id FROM customer JOIN b ON c_acctbal BETWEEN west AND east AND c_custkey BETWEEN south AND north)"""


@query(f"""WITH {FOUND}, t AS (SELECT target, person, CAST(year(s + CAST(floor((coalesce(e, s) - s) / 2) AS INTEGER)) AS INTEGER) AS year, CASE WHEN r THEN 4 ELSE 4 - p END AS tier FROM f WHERE p BETWEEN 1 AND 3)
SELECT target, person, year, CAST(max(tier) AS INTEGER) AS tier FROM t WHERE target IN (SELECT id FROM q) GROUP BY ALL""")
def map_links(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    near = F.element_at(F.array(*map(F.lit, ("far", "close", "near", "same_meeting", "none"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    relation = F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"), "kin_of").otherwise("")
    found = t.select(F.col("o_custkey").alias("target"), F.col("l_suppkey").alias("person"), F.to_date("o_orderdate").alias("start"), F.to_date("l_shipdate").alias("end"), near.alias("proximity"), relation.alias("relations"))
    return M.map_links(place_frames(spark, d), found)


@query(f"""WITH {FOUND} SELECT o_custkey AS target, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_custkey IN (SELECT id FROM q) GROUP BY ALL""")
def map_mentions(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return M.map_mentions(place_frames(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("target"), day.alias("start"), day.alias("end")))
