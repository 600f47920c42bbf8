"""Queries on associations, dated counts and networks.

Roles of the tables: an order is a meeting, a supplier a person, a part's brand a
target, a line's number its place; a returned line is a mere attendance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import associations as A
from inkwell.operators import metrics as M
from inkwell.operators import quality as Q
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


STEP = 300


def lines(spark: SparkSession, d: str) -> DataFrame:
    """unit, person, target, place, present, ord and date of each line."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    order = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    t = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    place = F.col("l_linenumber") * STEP
    return t.select(F.col("l_orderkey").alias("unit"), F.lit("page").alias("page"), F.col("l_suppkey").alias("person"), F.col("p_brand").alias("target"), place.alias("start"), place.alias("end"), (F.col("l_returnflag") == "R").alias("present"), F.col("l_linenumber").alias("ord"), "date")


LINES = f"""
l AS (SELECT l_orderkey AS unit, l_suppkey AS person, p_brand AS target, l_linenumber * {STEP} AS p, l_returnflag = 'R' AS present, CAST(o_orderdate AS DATE) AS date
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT a.unit, a.date, a.person, b.target, bool_or(NOT a.present) AS mentioned, min(CASE WHEN NOT a.present THEN abs(a.p - b.p) END) AS min_distance
      FROM l a JOIN l b ON a.unit = b.unit GROUP BY ALL),
x AS (SELECT *, CASE WHEN NOT mentioned THEN 'present_only' WHEN min_distance <= 300 THEN 'close' WHEN min_distance <= 1000 THEN 'near' ELSE 'same_meeting' END AS proximity FROM e)"""


def found(spark: SparkSession, d: str) -> DataFrame:
    t = lines(spark, d)
    return A.evidence(t, t, ["date"])


@query(f"""WITH {LINES}
SELECT unit, person, target, mentioned, CAST(min_distance AS INTEGER) AS min_distance, proximity FROM x""")
def assoc_evidence(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("unit", "person", "target", "mentioned", "min_distance", "proximity")


@query(f"""WITH {LINES},
pf AS (SELECT person, count(DISTINCT unit) AS pf FROM l WHERE NOT present GROUP BY person),
tf AS (SELECT target, count(DISTINCT unit) AS tf FROM l GROUP BY target),
n AS (SELECT count(DISTINCT unit) AS n FROM l),
g AS (SELECT person, target, count(*) FILTER (mentioned) AS meetings, count(*) FILTER (proximity = 'close') AS close_meetings,
             count(*) FILTER (proximity IN ('close', 'near')) AS near_meetings, count(*) FILTER (NOT mentioned) AS present_meetings,
             CAST(min(min_distance) AS INTEGER) AS min_distance, coalesce(min(date) FILTER (mentioned), min(date)) AS first_date,
             coalesce(max(date) FILTER (mentioned), max(date)) AS last_date FROM x GROUP BY person, target)
SELECT g.*, CASE WHEN meetings > 0 AND pf IS NOT NULL THEN round(CAST(meetings AS DOUBLE) * n / (pf * tf), 2) END AS lift
FROM g LEFT JOIN pf USING (person) JOIN tf USING (target), n""")
def assoc_links(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: pairs of people and targets with distances, dates and lift."""
    t = lines(spark, d)
    return A.pair_links(A.evidence(t, t, ["date"]), t, t)


YEARLY = f"""{LINES},
y AS (SELECT CAST(year(date) AS INTEGER) AS year, person, target, count(*) FILTER (mentioned) AS meetings, count(*) FILTER (proximity = 'close') AS close_meetings,
             count(*) FILTER (NOT mentioned) AS present_meetings, CAST(min(min_distance) AS INTEGER) AS min_distance, min(date) AS first_date, max(date) AS last_date
      FROM x GROUP BY ALL)"""


@query(f"WITH {YEARLY} SELECT * FROM y")
def assoc_by_year(spark: SparkSession, d: str) -> DataFrame:
    return A.by_year(found(spark, d))


@query(f"""WITH {LINES}, r AS (SELECT l_suppkey AS person, p_brand AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS relation FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3),
c AS (SELECT person, target, relation, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT person, target, string_agg(relation || CASE WHEN n > 1 THEN '×' || n ELSE '' END, '; ' ORDER BY n DESC, relation) AS relations FROM c GROUP BY ALL),
p AS (SELECT person, target, count(*) AS units FROM x GROUP BY ALL)
SELECT p.person, p.target, units, coalesce(relations, '') AS relations FROM p LEFT JOIN s ON p.person = s.person AND p.target = s.target""")
def assoc_links_relations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with the relations found in their units; the first three lines of an order stand for relations."""
    t = lines(spark, d)
    relations = t.filter("ord <= 3").select("unit", "person", "target", F.when(F.col("ord") % 2 == 0, "even").otherwise("odd").alias("relation"))
    pairs = found(spark, d)
    return A.with_relations(pairs.groupBy("person", "target").agg(F.count("*").alias("units")), pairs, relations, ["person", "target"])


@query(f"""WITH {LINES}
SELECT CAST(year(date) AS INTEGER) AS year, person, target, ['high', 'medium', 'low', 'none'][min(unit % 4) + 1] AS date_confidence FROM x GROUP BY ALL""")
def assoc_year_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The best confidence of each year's dates; an order's number stands for its date's confidence."""
    level = F.element_at(F.array(*map(F.lit, A.CONFIDENCE)), (F.col("unit") % 4 + 1).cast("int"))
    t = lines(spark, d).withColumn("confidence", level)
    yearly = A.by_year(A.evidence(t, t, ["date", "confidence"]), confidence="confidence")
    return yearly.select("year", "person", "target", "date_confidence")


@query(f"""WITH {YEARLY}
SELECT person, target, CAST(sum(meetings) AS BIGINT) AS meetings, CAST(sum(close_meetings) AS BIGINT) AS close_meetings, CAST(sum(present_meetings) AS BIGINT) AS present_meetings,
       min(min_distance) AS min_distance, min(year) AS first_year, max(year) AS last_year
FROM y WHERE year BETWEEN 1993 AND 1997 AND contains(lower(concat_ws(' ', person, target)), 'brand#1') AND close_meetings > 0
GROUP BY person, target ORDER BY meetings DESC, close_meetings DESC, person, target LIMIT 200""")
def assoc_explorer_rollup(spark: SparkSession, d: str) -> DataFrame:
    return A.explorer(A.by_year(found(spark, d)), 1993, 1997, "Brand#1", close_only=True)


@query(f"""WITH {YEARLY}
SELECT year, count(*) AS rows, CAST(sum(meetings) AS BIGINT) AS meetings, CAST(sum(close_meetings) AS BIGINT) AS close_meetings FROM y GROUP BY year""")
def assoc_per_year(spark: SparkSession, d: str) -> DataFrame:
    return A.per_year(A.by_year(found(spark, d)))


@query("""SELECT l_suppkey, string_agg(name || CASE WHEN n > 1 THEN '×' || n ELSE '' END, '; ' ORDER BY n DESC, name) AS relations
FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS name, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def assoc_relations_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("relation"))
    return A.summarize(rows, ["l_suppkey"])


@query("""SELECT l_orderkey AS meeting_id, l_suppkey AS subject_key, array_to_string(list_sort(list(l_shipmode)), ',') AS relations
FROM (SELECT l_orderkey, l_suppkey, l_returnflag AS l_shipmode FROM lineitem) GROUP BY ALL""")
def relation_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("segment_id"), F.col("l_suppkey").cast("string").alias("subject_key"), F.lit("order").alias("object_key"), F.lit("person").alias("subject_type"), F.col("l_returnflag").alias("relation"))
    meetings = table(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_orderkey").alias("meeting_id"))
    out = A.relation_index(rows, meetings)
    return out.select("meeting_id", F.col("subject_key").cast("long").alias("subject_key"), F.array_join(F.array_sort("relations"), ",").alias("relations"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, event_id, CAST(sum(CASE WHEN i = 1 OR event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS BIGINT) AS unit FROM e""")
def meeting_chain(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return A.chain_units(e, ["user_id"], "o", F.col("event_type") == "signup").select("user_id", "event_id", "unit")


@query("""WITH s AS (SELECT user_id AS volume, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
                  event_type = 'signup' OR event_type NOT IN ('view', 'click') AS starts FROM events),
u AS (SELECT *, sum(CASE WHEN i = 1 OR starts THEN 1 ELSE 0 END) OVER (PARTITION BY volume ORDER BY i) AS unit FROM s)
SELECT 'E' || event_id AS segment_id, 'M-E' || first_value(event_id) OVER (PARTITION BY volume, unit ORDER BY i) AS meeting_id,
       CAST(first_value(ts) OVER (PARTITION BY volume, unit ORDER BY i) AS DATE) AS unit_start FROM u""")
def meeting_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("ts")
    source = F.when(F.col("event_type").isin("view", "click"), "continued_meeting").otherwise("running_header")
    heading = F.when(F.col("event_type") == "signup", "A COURT").otherwise("")
    s = table(spark, d, "events").select(F.col("user_id").alias("volume"), F.struct("ts", "event_id").alias("ord"), F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("segment_id"), heading.alias("heading"), source.alias("date_source"), day.alias("date_start"), day.alias("date_end"), F.lit("high").alias("confidence"))
    return A.meeting_units(s).select("segment_id", "meeting_id", "unit_start")


@query("""WITH b AS (SELECT n_name AS place, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS person, max(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS tier,
                  count(DISTINCT l_orderkey) AS units
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT place, year, count(*) AS people, count(*) FILTER (tier >= 3) AS strong, CAST(sum(units) AS BIGINT) AS units FROM b GROUP BY place, year""")
def tier_by_year(spark: SparkSession, d: str) -> DataFrame:
    line, order = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders")
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "n_name")
    t = line.join(order, F.expr("l_orderkey = o_orderkey")).join(places, F.expr("l_suppkey = s_suppkey"))
    return A.tiers(t.withColumn("unit", F.col("l_orderkey")), "n_name", F.year("o_orderdate"), "o_custkey", F.left("o_orderpriority", F.lit(1)).cast("int"))


ERAS = """r AS (SELECT CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 AS INTEGER) AS e, o_orderpriority, o_orderstatus FROM orders)"""


def dated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 90).cast("int")).alias("e"), "o_orderpriority", "o_orderstatus")


@query(f"""WITH {ERAS}, t AS (SELECT *, CASE WHEN e < DATE '1995-03-15' THEN 'before' WHEN s >= DATE '1995-03-15' THEN 'after' ELSE 'undetermined' END AS era FROM r)
SELECT o_orderpriority, count(*) FILTER (era = 'before') AS before, count(*) FILTER (era = 'after') AS after, count(*) FILTER (era = 'undetermined') AS undetermined
FROM t GROUP BY o_orderpriority""")
def before_after_pivot(spark: SparkSession, d: str) -> DataFrame:
    t = dated(spark, d).withColumn("era", M.era(F.col("s"), F.col("e"), F.lit("1995-03-15").cast("date")))
    return M.before_after(t, ["o_orderpriority"])


@query(f"""WITH {ERAS}, t AS (SELECT s + CAST(floor((e - s) / 2) AS INTEGER) AS m, o_orderstatus FROM r)
SELECT year(m) || CASE WHEN month(m) <= 6 THEN 'a' ELSE 'b' END AS bin, count(*) FILTER (o_orderstatus = 'F') AS named, count(*) FILTER (o_orderstatus <> 'F') AS collective
FROM t GROUP BY bin""")
def half_year_bins(spark: SparkSession, d: str) -> DataFrame:
    t = dated(spark, d).withColumn("bin", M.half_year(M.midpoint(F.col("s"), F.col("e"))))
    return t.groupBy("bin").agg(F.count_if(F.col("o_orderstatus") == "F").alias("named"), F.count_if(F.col("o_orderstatus") != "F").alias("collective"))


THEMES = {"licence": "licen[cs]e", "article": "(^|[^a-z])(the|der|die|das|le|la|les|el|los)([^a-z]|$)", "number": "[0-9]{3}"}


@query(f"""SELECT lang, {", ".join(f"count(*) FILTER (regexp_matches(text, '(?i){p}')) AS {n}" for n, p in THEMES.items())} FROM documents GROUP BY lang""")
def theme_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.theme_counts(table(spark, d, "documents"), "text", THEMES, ["lang"])


@query("SELECT source, CAST(sum(len(regexp_extract_all(text, '[A-Za-z]{2,}'))) AS BIGINT) AS words FROM documents GROUP BY source")
def words_volume(spark: SparkSession, d: str) -> DataFrame:
    return M.word_volume(table(spark, d, "documents"), "text", ["source"])


@query("""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS x FROM documents)
SELECT lower(x) AS word, count(*) FILTER (x = lower(x)) AS lower_case, count(*) FILTER (x <> lower(x)) AS capital FROM w GROUP BY ALL HAVING count(*) >= 20""")
def case_counts(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("x"))
    g = w.groupBy(F.lower("x").alias("word")).agg(F.count_if(F.col("x") == F.lower("x")).alias("lower_case"), F.count_if(F.col("x") != F.lower("x")).alias("capital"))
    return g.filter(F.col("lower_case") + F.col("capital") >= 20)


@query("""WITH f AS (SELECT lang, translate(word, 'vj', 'ui') AS key, word, count(*) AS c FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents) GROUP BY ALL),
c AS (SELECT lang, key, sum(c) AS n, arg_min(word, (-c, word)) AS word FROM f GROUP BY lang, key),
t AS (SELECT lang, key, word, CAST(n AS BIGINT) AS n, sum(n) OVER (PARTITION BY key) AS a, sum(n) OVER (PARTITION BY lang) AS s, sum(n) OVER () AS t FROM c),
p AS (SELECT *, CAST(500 AS DOUBLE) * a / t AS p, a - n AS o, t - s AS r FROM t WHERE n >= 3),
z AS (SELECT *, (ln((n + p) / (s + 500 - n - p)) - ln((o + p) / (r + 500 - o - p))) / sqrt(1 / (n + p) + 1 / (o + p)) AS z FROM p)
SELECT lang, word, n, round(z, 1) AS z FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(z, 6) DESC, key) AS i FROM z WHERE z > 1.96) WHERE i <= 12""")
def distinctive_words(spark: SparkSession, d: str) -> DataFrame:
    return M.distinctive_words(M.word_rows(table(spark, d, "documents"), "text", ["lang"]), "lang")


NETWORK = """s AS (SELECT DISTINCT o_custkey % 400 AS node, l_partkey AS unit FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT node, count(*) AS units FROM s GROUP BY node ORDER BY units DESC, node LIMIT 70),
p AS (SELECT a.node AS a, b.node AS b, count(*) AS shared, any_value(ka.units) AS na, any_value(kb.units) AS nb
      FROM s a JOIN s b ON a.unit = b.unit AND a.node < b.node JOIN k ka ON a.node = ka.node JOIN k kb ON b.node = kb.node GROUP BY ALL HAVING count(*) >= 2),
j AS (SELECT a, b, shared, shared / (na + nb - shared) AS jaccard FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY jaccard DESC, a, b) AS i FROM (SELECT *, a AS e FROM j UNION ALL SELECT *, b FROM j))"""


def network(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    return M.network(t.select((F.col("o_custkey") % 400).alias("node"), F.col("l_partkey").alias("unit")), "node", "unit", least_shared=2)


@query(f"WITH {NETWORK} SELECT DISTINCT a, b, shared, jaccard FROM r WHERE i <= 4")
def network_edges_topk(spark: SparkSession, d: str) -> DataFrame:
    return network(spark, d)


@query()
def network_communities(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.operators.graph import communities

    e = network(spark, d).select(F.lit(1).alias("graph"), "a", "b", F.col("jaccard").alias("weight"))
    return communities(e)


@query()
def network_layout(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.operators.graph import layout

    e = network(spark, d).select(F.lit(1).alias("graph"), "a", "b", F.col("jaccard").alias("weight"))
    return layout(e)


BOXES = "('west', 1, -200.0, -1000.0, 3000.0, 20000.0), ('wide', 2, -2000.0, -2000.0, 6000.0, 30000.0), ('east', 3, 3000.0, 0.0, 20000.0, 20000.0)"


@query(f"""WITH b(frame, ord, west, south, east, north) AS (VALUES {BOXES}),
p AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS lon, CAST(c_custkey AS DOUBLE) AS lat FROM customer)
SELECT id, lon, lat, arg_min(frame, ord) AS frame FROM p JOIN b ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY id, lon, lat""")
def place_frames(spark: SparkSession, d: str) -> DataFrame:
    boxes = spark.sql(f"SELECT col1 AS frame, col2 AS ord, CAST(col3 AS DOUBLE) AS west, CAST(col4 AS DOUBLE) AS south, CAST(col5 AS DOUBLE) AS east, CAST(col6 AS DOUBLE) AS north FROM VALUES {BOXES}")
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("lon"), F.col("c_custkey").cast("double").alias("lat"))
    return M.frames(points, boxes)


@query("""SELECT doc_id, source, pick FROM (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('1622-' || doc_id), doc_id) AS INTEGER) AS pick FROM documents)
WHERE pick <= CASE source WHEN 'src0' THEN 15 WHEN 'src1' THEN 10 WHEN 'src2' THEN 5 ELSE 0 END""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return Q.stratified(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", {"src0": 15, "src1": 10, "src2": 5}, 1622)


@query("""WITH s AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('1619-' || doc_id), doc_id) AS INTEGER) AS pick FROM documents WHERE n_chars > 400)
SELECT doc_id, source, pick, CAST(row_number() OVER (ORDER BY pick, source) AS INTEGER) AS review_order FROM s WHERE pick <= 6""")
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("n_chars > 400").select("doc_id", "source")
    return Q.round_robin(Q.stratified(rows, "source", "doc_id", 6, 1619), "source")


@query("""WITH r AS (SELECT lang, toxic = 1 AS g, regexp_matches(text, '(?i)\\b(idiot|moron|scum|worthless)\\b') AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM r GROUP BY lang)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM c""")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return Q.binary_scores(t, F.col("toxic") == 1, F.col("text").rlike(r"(?i)\b(idiot|moron|scum|worthless)\b"), ["lang"])


@query("""WITH r AS (SELECT lang, quality = 1 AS ok FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, count(*) FILTER (ok) AS correct, count(*) FILTER (ok) / count(*) AS precision FROM r GROUP BY ROLLUP (lang)""")
def relation_precision(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return Q.precision(t, "lang", F.col("quality") == 1)


SPANS = """g AS (SELECT l_orderkey AS page, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS INTEGER) % 14 + 1 AS e, l_returnflag AS label, 0 AS i FROM lineitem WHERE l_linenumber % 2 = 0),
p AS (SELECT l_orderkey AS page, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS INTEGER) % 14 + 1 AS e, l_linestatus AS label, row_number() OVER () AS i FROM lineitem WHERE l_linenumber % 2 = 1)"""


@query(f"""WITH {SPANS}, m AS (SELECT p.page, p.i, p.label AS predicted, arg_min(g.label, CASE g.label WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) AS gold
      FROM p LEFT JOIN g ON p.page = g.page AND g.s < p.e AND p.s < g.e GROUP BY p.page, p.i, p.label)
SELECT predicted, coalesce(gold, 'none') AS gold, count(*) AS n FROM m GROUP BY ALL""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("l_linenumber") * 10
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), start.alias("start"), (start + F.col("l_quantity").cast("int") % 14 + 1).alias("end"), "l_returnflag", "l_linestatus", "l_linenumber")
    gold = t.filter("l_linenumber % 2 = 0").withColumnRenamed("l_returnflag", "label")
    return Q.confusion(gold, t.filter("l_linenumber % 2 = 1").withColumnRenamed("l_linestatus", "label"), "page", ["N", "R"])
