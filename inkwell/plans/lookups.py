"""Queries on lookups, deduplication, ids and ordered fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import dates as D
from inkwell.functions import text as X
from inkwell.operators import linking as K
from inkwell.operators import segments as S
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


# Orders are pages; lines are mentions at their number; every second line begins a segment.
LINE = "m AS (SELECT l_orderkey * 10 + l_linenumber AS mention_id, l_orderkey AS page_id, l_linenumber AS s, l_linenumber + 1 AS e FROM lineitem)"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("mention_id"), F.col("l_orderkey").alias("page_id"), n.alias("span_start"), (n + 1).alias("span_end"))


def segment_table(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").filter("l_linenumber % 2 = 0")
    return t.select(F.col("l_orderkey").alias("page_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("segment_id"), F.col("l_linenumber").alias("char_start"), F.col("l_linenumber").alias("ord"))


@query(f"""WITH {LINE}, s AS (SELECT l_orderkey AS page_id, l_linenumber AS c, l_orderkey || '-' || l_linenumber AS segment_id FROM lineitem WHERE l_linenumber % 2 = 0),
h AS (SELECT mention_id, m.page_id, arg_max(segment_id, c) FILTER (c <= s) AS a, arg_min(segment_id, c) AS b FROM (SELECT *, row_number() OVER () AS r FROM m) m LEFT JOIN s ON m.page_id = s.page_id GROUP BY mention_id, m.page_id, r)
SELECT mention_id, page_id, coalesce(a, b) AS segment_id FROM h""")
def locate_asof(spark: SparkSession, d: str) -> DataFrame:
    return K.locate(mentions(spark, d), segment_table(spark, d)).select("mention_id", "page_id", "segment_id")


@query(f"""WITH {LINE}, e AS (SELECT l_orderkey AS page_id, l_linenumber AS a, l_linenumber + 2 AS b, CASE WHEN l_returnflag = 'R' THEN 'running_head' ELSE 'document_heading' END AS kind, l_linenumber AS o FROM lineitem WHERE l_discount >= 0.05),
k AS (SELECT mention_id, arg_min(kind, o) AS kind FROM m JOIN e ON m.page_id = e.page_id AND a < m.e AND m.s < b GROUP BY mention_id),
r AS (SELECT o_orderkey AS page_id, 'index' AS role FROM orders WHERE o_orderstatus = 'P')
SELECT m.mention_id, coalesce(role, 'record') AS page_role, coalesce(kind, '') AS editorial_span,
       coalesce(role, 'record') = 'record' AND (coalesce(kind, '') = '' OR kind = 'document_heading') AS usable
FROM m LEFT JOIN k USING (mention_id) LEFT JOIN r USING (page_id)""")
def usable_mentions(spark: SparkSession, d: str) -> DataFrame:
    # Lines of an order may share a number; the last one of them in the file counts, as in DuckDB with one thread.
    line = table(spark, d, "lineitem").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("row")).filter("l_discount >= 0.05")
    n = F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "R", "running_head").otherwise("document_heading")
    editorial = line.select(F.col("l_orderkey").alias("page_id"), n.alias("char_start"), (n + 2).alias("char_end"), kind.alias("kind"), n.alias("ord"), "row")
    roles = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("page_id"), F.lit("index").alias("role"))
    return K.usable(mentions(spark, d), roles, editorial, ["document_heading"], last="row").select("mention_id", "page_role", "editorial_span", "usable")


ALIASES = "('A', 'almond'), ('B', 'almond'), ('C', 'antique'), ('D', 'blue'), ('E', 'green'), ('F', 'green'), ('G', 'red'), ('H', 'part 1'), ('I', 'part 2'), ('J', 'part 3'), ('K', 'part 3')"


@query(f"""WITH a(person, key) AS (VALUES {ALIASES}), i AS (SELECT key, list_sort(list(DISTINCT person)) AS people FROM a GROUP BY key),
x(key) AS (VALUES ('blue'), ('part 2')), c(key, volume, person) AS (VALUES ('red', 1, 'Z'), ('part 5', 2, 'Y')),
m AS (SELECT p_partkey AS id, lower(p_name) AS name, split_part(lower(p_name), ' ', 1) AS w, 'part ' || p_partkey % 7 AS n, p_size % 3 AS volume FROM part),
o AS (SELECT m.*, c.person AS cp, io.people AS op, xo.key IS NOT NULL AS ox, i2.people AS np, xn.key IS NOT NULL AS nx
      FROM m LEFT JOIN c ON m.n = c.key AND m.volume = c.volume LEFT JOIN i io ON m.n = io.key LEFT JOIN x xo ON m.n = xo.key LEFT JOIN i i2 ON m.w = i2.key LEFT JOIN x xn ON m.w = xn.key),
r AS (SELECT *, CASE WHEN cp IS NOT NULL THEN 'contextual' WHEN ox THEN 'excluded' WHEN len(op) = 1 THEN 'alias' WHEN len(op) > 1 THEN 'ambiguous'
                     WHEN nx THEN 'excluded' WHEN len(np) = 1 THEN 'name' WHEN len(np) > 1 THEN 'ambiguous' ELSE 'unresolved' END AS method FROM o)
SELECT id, method, coalesce(cp, CASE method WHEN 'alias' THEN op[1] WHEN 'name' THEN np[1] END) AS person FROM r""")
def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.sql(f"SELECT col1 AS person, col2 AS key FROM VALUES {ALIASES}")
    excluded = spark.sql("SELECT col1 AS key FROM VALUES ('blue'), ('part 2')")
    rules = spark.sql("SELECT col1 AS key, col2 AS volume, col3 AS person, 1 AS ord FROM VALUES ('red', 1, 'Z'), ('part 5', 2, 'Y')")
    m = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("part "), (F.col("p_partkey") % 7).cast("string")).alias("observed_key"), F.substring_index(F.lower("p_name"), " ", 1).alias("name_key"), (F.col("p_size") % 3).alias("volume"))
    return K.resolve(m, aliases, excluded, rules).select("id", "method", "person")


@query("SELECT DISTINCT text, lang FROM documents")
def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("text", "lang").distinct()


@query("""SELECT page, start, source, event_id FROM (SELECT *, row_number() OVER (PARTITION BY page, start ORDER BY source, event_id) AS i
FROM (SELECT user_id AS page, hour(ts) AS start, event_type AS source, event_id FROM events)) WHERE i = 1""")
def dedupe_span(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select(F.col("user_id").alias("page"), F.hour("ts").cast("long").alias("start"), F.col("event_type").alias("source"), "event_id")
    return K.first_per(t, ["page", "start"], ["source", "event_id"])


@query("""SELECT p_type AS key, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS forms, row_number() OVER (ORDER BY p_type) AS group_id FROM part GROUP BY p_type""")
def name_groups(spark: SparkSession, d: str) -> DataFrame:
    return K.name_groups(table(spark, d, "part"), "p_type", "p_brand").withColumn("forms", F.array_join("forms", "|"))


@query("""WITH f AS (SELECT c_mktsegment AS key, CAST(c_nationkey AS VARCHAR) AS form, count(*) AS c FROM customer GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, form) AS i, sum(c) OVER (PARTITION BY key) AS n FROM f)
SELECT key, CAST(n AS BIGINT) AS n, string_agg(form, '|' ORDER BY i) AS forms FROM r WHERE i <= 8 AND n >= 20 GROUP BY key, n""")
def frequent_forms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").select("c_mktsegment", F.col("c_nationkey").cast("string").alias("form"))
    return K.frequent(t, "c_mktsegment", "form", 20).withColumn("forms", F.array_join("forms", "|"))


@query("""SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN regexp_matches(text, '[0-9]{4}') THEN 'number' WHEN lang <> 'en' THEN 'foreign' END AS reason FROM documents""")
def reason_filter_split(spark: SparkSession, d: str) -> DataFrame:
    rules = {"short": F.col("n_chars") < 200, "number": F.col("text").rlike("[0-9]{4}"), "foreign": F.col("lang") != "en"}
    return K.reasons(table(spark, d, "documents"), rules).select("doc_id", "reason")


@query("""WITH b AS (SELECT s_nationkey AS place_id, trim(s_name) AS alias, 0 AS o FROM supplier UNION ALL SELECT c_nationkey, replace(c_name, 'Customer', 'SUPPLIER'), 1 FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY place_id, lower(alias) ORDER BY o, alias) AS i FROM b)
SELECT place_id, alias, o = 1 AS added FROM r WHERE i = 1""")
def alias_merge_log(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("place_id"), F.col("s_name").alias("alias"))
    q = table(spark, d, "customer").select(F.col("c_nationkey").alias("place_id"), F.replace("c_name", F.lit("Customer"), F.lit("SUPPLIER")).alias("alias"))
    return K.merge_aliases(a, q)


@query("""WITH k AS (SELECT upper(r_name) AS x, count(*) AS top FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
n AS (SELECT DISTINCT upper(r_name) AS prefix, p_brand AS name FROM part JOIN region ON p_size % 5 = r_regionkey)
SELECT prefix, name, prefix || '-' || lpad(CAST(top + row_number() OVER (PARTITION BY prefix ORDER BY name) AS VARCHAR), 3, '0') AS id FROM n JOIN k ON prefix = x WHERE NOT contains(prefix, ' ')""")
def next_ids(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    region = table(spark, d, "region").select("r_regionkey", F.upper("r_name").alias("prefix")).filter(~F.contains("prefix", F.lit(" ")))
    i = F.row_number().over(Window.partitionBy("prefix").orderBy("n_nationkey"))
    known = table(spark, d, "nation").join(region, F.expr("n_regionkey = r_regionkey")).select(F.concat_ws("-", "prefix", F.lpad(i.cast("string"), 3, "0")).alias("id"))
    new = table(spark, d, "part").join(region, F.expr("p_size % 5 = r_regionkey")).select("prefix", F.col("p_brand").alias("name")).distinct()
    return K.next_ids(new, known, "prefix", "name")


@query("""WITH a AS (SELECT 'n' || user_id % 9 AS name, hour(ts) AS segment, count(*) AS x FROM events WHERE event_type = 'click' GROUP BY ALL),
b AS (SELECT 'p' || user_id % 11 AS person, hour(ts) AS segment, count(*) AS y FROM events WHERE event_type = 'view' GROUP BY ALL),
s AS (SELECT name, person, CAST(sum(least(x, y)) AS BIGINT) AS score FROM a JOIN b USING (segment) GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS i, coalesce(lead(score) OVER w, 0) AS next FROM s WINDOW w AS (PARTITION BY name ORDER BY score DESC, person))
SELECT name, person, score, next FROM r WHERE i = 1 AND score >= 3 AND score >= next""")
def suggest_context(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("segment", F.hour("ts"))
    name = lambda p, n: F.concat(F.lit(p), (F.col("user_id") % n).cast("string"))
    a = e.filter("event_type = 'click'").select(name("n", 9).alias("name"), "segment")
    b = e.filter("event_type = 'view'").select(name("p", 11).alias("person"), "segment")
    return K.shared_context(a, b, ratio=1)


# A user's events are the pages of a volume; errors are heads that cannot be read.
HEADS = """e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord,
             CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) + CASE WHEN event_id % 11 = 0 THEN 40 ELSE 0 END END AS start FROM events)"""


def heads(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    day = F.date_add(F.to_date("ts"), F.when(F.col("event_id") % 11 == 0, 40).otherwise(0))
    e = table(spark, d, "events").withColumn("ord", o).withColumn("start", F.when(F.col("event_type") != "error", day))
    return e.select("user_id", "event_id", "ord", "start", F.col("start").alias("end"), F.when(F.col("start").isNotNull(), "running_header").alias("source"))


CHECKED = f"""{HEADS}, n AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(start IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM e),
c AS (SELECT user_id, event_id, ord, start, CASE WHEN start IS NULL THEN NULL WHEN a <= b AND NOT start BETWEEN a AND b THEN 'low' ELSE 'high' END AS confidence FROM n)"""


@query(f"WITH {CHECKED} SELECT user_id, event_id, start, confidence FROM c")
def order_check(spark: SparkSession, d: str) -> DataFrame:
    return S.order_check(heads(spark, d), ["user_id"], "ord", "start", "end", F.lit(False)).select("user_id", "event_id", "start", "confidence")


@query(f"""WITH {CHECKED}, t AS (SELECT *, CASE WHEN confidence = 'high' THEN start END AS h FROM c),
f AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM t),
g AS (SELECT *, least(coalesce(a, b), coalesce(b, a)) AS lo, greatest(coalesce(a, b), coalesce(b, a)) AS hi FROM f)
SELECT user_id, event_id, coalesce(start, lo) AS "start", coalesce(start, hi) AS "end",
       CASE WHEN start IS NOT NULL THEN 'running_header' WHEN lo IS NULL THEN 'undated' WHEN lo = hi THEN 'inherited' ELSE 'between_headers' END AS source,
       CASE WHEN start IS NOT NULL THEN confidence WHEN lo IS NULL THEN 'none' WHEN hi - lo <= 31 THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def head_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    t = S.order_check(heads(spark, d), ["user_id"], "ord", "start", "end", F.lit(False))
    return S.fill_gaps(t, ["user_id"], "ord").select("user_id", "event_id", "start", "end", "source", "confidence")


@query(f"""WITH RECURSIVE {HEADS}, s AS MATERIALIZED (SELECT user_id, event_id, ord, CAST(CASE WHEN event_id % 7 = 0 THEN start - INTERVAL 12 MONTH ELSE start END AS DATE) AS d FROM e),
n AS MATERIALIZED (SELECT *, CASE WHEN month(d) = 2 AND day(d) = 29 THEN NULL ELSE CAST(d + INTERVAL 1 YEAR AS DATE) END AS m FROM s),
g AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DATE) AS start, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS DATE) AS latest FROM s
  UNION ALL SELECT user_id, ord, event_id, v, kind, greatest(latest, v) FROM (
    SELECT n.user_id, n.ord, n.event_id, g.latest, CASE WHEN d < g.latest - 30 AND m BETWEEN g.latest - 30 AND g.latest + 120 THEN m ELSE d END AS v,
           CASE WHEN d < g.latest - 30 AND m BETWEEN g.latest - 30 AND g.latest + 120 THEN CASE WHEN month(d) * 100 + day(d) <= 324 THEN 'old_style' ELSE 'year_fixed' END END AS kind
    FROM g JOIN n ON n.user_id = g.user_id AND n.ord = g.ord + 1))
SELECT user_id, event_id, start, start AS "end", kind FROM g WHERE ord > 0""")
def step_back(spark: SparkSession, d: str) -> DataFrame:
    t = heads(spark, d).withColumn("start", F.when(F.col("event_id") % 7 == 0, F.add_months("start", -12)).otherwise(F.col("start"))).withColumn("end", F.col("start"))
    return S.step_back(t, ["user_id"], "ord").select("user_id", "event_id", "start", "end", "kind")


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER w AS i, CASE WHEN event_type <> 'view' THEN row_number() OVER w + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, last_value(CASE WHEN n IS NOT NULL THEN n - i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first_value(CASE WHEN n IS NOT NULL THEN n - i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e)
SELECT user_id, event_id, CAST(CASE WHEN n IS NOT NULL THEN n WHEN b IS NULL THEN a + i WHEN a = b THEN a + i END AS INTEGER) AS filled FROM f""")
def number_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("i", i)
    e = e.withColumn("n", F.when(F.col("event_type") != "view", F.col("i") + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)))
    return S.fill_numbers(e, ["user_id"], "i", "n").select("user_id", "event_id", F.col("filled").cast("int").alias("filled"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, last_day(d) AS month_end, CASE WHEN month(d) < 3 OR (month(d) = 3 AND day(d) <= 24) THEN coalesce(try_cast((year(d) + 1) || '-' || month(d) || '-' || day(d) AS DATE), d) ELSE d END AS new_style,
       try_cast(year(d) || '-02-' || lpad(CAST(day(d) AS VARCHAR), 2, '0') AS DATE) AS february FROM o""")
def date_scalars(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.last_day(day).alias("month_end"), D.old_style_date(day).alias("new_style"), D.safe_date(F.year(day), F.lit(2), F.dayofmonth(day)).alias("february"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type FROM events),
m AS (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'error') THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i) AS o FROM e)
SELECT m.user_id, m.event_id, CASE WHEN x.event_type = 'signup' THEN o END AS unit FROM m LEFT JOIN e x ON m.user_id = x.user_id AND m.o = x.i""")
def segments_carry(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    return S.carry_units(e, ["user_id"], "i", F.col("event_type") == "signup", F.col("event_type") == "error").select("user_id", "event_id", "unit")


@query("""WITH p AS (SELECT l_orderkey AS page, l_linenumber AS i, l_linenumber * 10 AS s, l_linenumber * 10 + 5 AS e FROM lineitem), b AS (SELECT o_orderkey AS page, 10 AS a, 10 + o_custkey % 40 AS z FROM orders)
SELECT p.page, p.i AS line FROM p WHERE EXISTS (SELECT 1 FROM b WHERE b.page = p.page AND a <= s AND e <= z)""")
def present_role(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("line"), (n * 10).alias("span_start"), (n * 10 + 5).alias("span_end"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.lit(10).alias("start"), (10 + F.col("o_custkey") % 40).alias("end"))
    return K.inside(p, b, "page").select("page", "line")


@query("""WITH r AS (SELECT l_orderkey AS page, l_linenumber AS i, l_linenumber * 10 AS s, l_linenumber * 10 + 1 + CAST(l_quantity AS INTEGER) % 20 AS e, l_returnflag FROM lineitem)
SELECT page, i AS line FROM r a WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM r b WHERE b.l_returnflag = 'R' AND a.page = b.page AND b.s < a.e AND a.s < b.e)""")
def overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("line"), (n * 10).alias("span_start"), (n * 10 + 1 + F.col("l_quantity").cast("int") % 20).alias("span_end"), "l_returnflag")
    return K.without_overlaps(r.filter("l_returnflag <> 'R'"), r.filter("l_returnflag = 'R'"), "page").select("page", "line")


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey % 60 AS printed, o_orderkey AS ord, CAST(length(o_orderpriority) AS INTEGER) AS names FROM orders),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id % 2, printed ORDER BY ord) AS i FROM a) WHERE i = 1)
SELECT o.printed, o.names AS old_names, n.names AS new_names FROM f o JOIN f n ON o.printed = n.printed AND o.id % 2 = 0 AND n.id % 2 = 1""")
def ocr_compare(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.operators.layout import editions_compared

    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 60).alias("printed"), F.col("o_orderkey").alias("ord"), F.length("o_orderpriority").alias("names"))
    return editions_compared(a.filter("id % 2 = 0"), a.filter("id % 2 = 1"), ["names"])


@query("""SELECT p_partkey, CASE WHEN len(w) >= 2 AND (w[1] IN ('small', 'large') OR w[-1] IN ('part', 'copper')) THEN true ELSE false END AS strong,
       array_to_string(w, ' ') IN ('small part') OR coalesce(w[1], '') IN ('economy') AS denied
FROM (SELECT p_partkey, regexp_extract_all(lower(p_type), '[a-z]+') AS w FROM part)""")
def phrase_rules(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", X.geographic_shape(t, ["small", "large"], ["part", "copper"]).alias("strong"), X.denied(t, ["small part"], ["economy"]).alias("denied"))
