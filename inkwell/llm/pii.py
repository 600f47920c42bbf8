"""Personal data by base patterns and bootstrapped contextual extraction (native).

Base patterns find e-mail and IP addresses, card and phone numbers. These seed a
bootstrap, and so do tokens of the shape of a secret: the words before a seed are a
lexical pattern, all tokens with digits or @ and digit groups set apart by spaces are
instances, and patterns and instances score each other in rounds over the
pattern-instance graph of the whole corpus. Identifiers that no base pattern matches,
and secrets, are found where patterns of high confidence agree on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import COUNTERS, hot_keys, join_hot, staged, text_of, tidied

# The patterns equal the plain ones, made linear: a run of the first class is
# entered at its start or where the last match ended, and runs give nothing back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)
#: A token with a digit or @: what the bootstrap may call an identifier.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Digit groups set apart by single spaces, brackets allowed: an identifier may be written so.
SPACED = r"(?<![^\x20\x09-\x0D(])\(?+[0-9][0-9()./-]*+(?:\x20\(?+[0-9][0-9()./-]*+(?![^\x20\x09-\x0D,;:!?\"']))++"
#: A pattern needs so many distinct known instances of a kind, and this share of
#: all its instances; an instance needs this score and so many patterns.
LEAST_SEEDS, LEAST_CONFIDENCE, LEAST_SCORE, LEAST_PATTERNS = 3, 0.6, 0.9, 2
#: The bootstrap goes on until a round finds nothing new; with so many it is given up.
MOST_ROUNDS = 60
#: Kind and shape of seeds that are spans only if patterns confirm them: long hexadecimal or mixed runs.
SECRET = "secret"
SECRET_SHAPE = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_/+=-]{24,})$"
ALL_KINDS = [*KINDS, SECRET]
#: What an identifier of each kind has to look like to be found by its patterns alone.
SHAPES = {
    "email": r"[A-Za-z0-9]@[A-Za-z]",
    "ip": r"^[0-9A-Fa-f]+(?:[.:][0-9A-Fa-f]*){3,}$",
    "card": r"^[^A-Za-z@]*(?:[0-9][^A-Za-z0-9@]*){12,19}$",
    "phone": r"^[^A-Za-z@]*(?:[0-9][^A-Za-z0-9@]*){6,15}$",
    SECRET: r"[A-Za-z0-9_/+=-]{16,}",
}
#: A pattern's words count by their last WORD_END characters, looked for in CONTEXT before the instance.
WORD_END, CONTEXT = 24, 256


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.expr("0") + c.try_cast("int")).otherwise(2 * c.try_cast("int") - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", m.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(kind == "card", F.length(digits).between(14, 19) & luhn(F.when(F.length(digits).between(14, 19), digits).otherwise(F.lit("1"))))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(False)
    )


def matches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """r (row), doc_id and items: all matches of base patterns, tokens and spaced groups, with the length and end of the gap before each."""
    t = docs.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("doc_id"), text_of(text).alias("t"))
    digit = F.col("t").rlike("[0-9]")
    guards = {"email": F.contains("t", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("t", F.lit("+")), "token": F.col("t").rlike("[0-9@]"), "spaced": F.col("t").rlike(r"[0-9()./-]\x20\(?[0-9]")}
    none = F.array().cast("array<string>")
    patterns = BASE | {"token": TOKEN, "spaced": SPACED}
    for kind, p in patterns.items():
        t = t.withColumn(f"m_{kind}", F.when(guards[kind], F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none))

    def items(kind: str, p: str) -> Column:
        m, width = F.col(f"m_{kind}"), 0 if kind in BASE else CONTEXT
        gaps = F.slice(F.when(F.size(m) > 0, F.split("t", p, -1)).otherwise(none), F.lit(1), F.size(m))
        item = lambda e, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), e["m"].alias("m"), F.length(e["g"]).alias("gap"), F.right(e["g"], F.lit(width)).alias("left"))
        return F.transform(F.arrays_zip(m.alias("m"), gaps.alias("g")), item)

    lists = [items(kind, p) for kind, p in patterns.items()]
    return t.select("r", "doc_id", F.concat(*lists).alias("items"))


def masked(m: Column) -> Column:
    """A token as part of a context: addresses are alike, and so are digits."""
    return F.regexp_replace(F.regexp_replace(m, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]", "x@x"), "[0-9]", "0")


def located(rows: DataFrame) -> DataFrame:
    """r, kind, start, end (code points, end exclusive), m and left of each item of ``rows``; left goes on over the item before."""
    flat = rows.select("r", F.inline("items"))
    order = Window.partitionBy("r", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.coalesce(F.lag(F.right("m", F.lit(CONTEXT))).over(order), F.lit(""))
    left = F.when(F.col("kind").isin(KINDS), F.lit("")).when(F.col("gap") >= CONTEXT, F.col("left")).otherwise(F.concat(masked(last), "left"))
    return flat.select("r", "kind", (end - F.length("m")).alias("start"), end.alias("end"), "m", left.alias("left"))


def edges(tokens: DataFrame) -> DataFrame:
    """The corpus' pattern-instance graph: distinct (x, p), x a token or spaced groups without outer punctuation, p one or two words before it."""
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    left = F.lower("left")
    one = F.regexp_extract(left, rf"({word}{{1,{WORD_END}}}){space}+$", 1)
    two = F.regexp_extract(left, rf"({word}{{1,{WORD_END}}}){space}+{word}+{space}+$", 1)
    named = tokens.withColumn("p", F.explode(F.array(one, F.when(two != "", F.concat_ws(" ", two, one)).otherwise(F.lit("")))))
    return named.filter("p <> ''").select("x", "p").distinct()


def shaped(x: Column, kind: Column | None = None) -> Column:
    """Whether ``x`` may be an identifier of the kind, or of any."""
    fits = [(k, x.rlike(p)) for k, p in SHAPES.items()]
    if kind is None:
        return reduce(lambda a, kp: a | kp[1], fits, F.lit(False))
    return reduce(lambda c, kp: c.when(kind == kp[0], kp[1]), fits, F.when(F.lit(False), False))


def bootstrap(tokens: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(x, kind) of unseen identifiers and confirmed secrets, from ``tokens`` (x, left, seed: the kind of a seed, or null).

    Each round, a pattern's confidence in a kind is the share of its distinct
    instances known to be of it; an unknown instance's score is the chance that
    not all patterns that hold it are wrong. Sums are grouped in Spark, and frequent
    patterns and instances are joined on the map side.
    """
    graph = staged(edges(tokens), "graph")
    hot = {c: staged(hot_keys(graph, c, COUNTERS), f"hot_{c}") for c in ("x", "p")}
    known = staged(tokens.filter("seed is not null").groupBy("x").agg(F.min("seed").alias("kind")), "known")
    seeds = known
    sizes = staged(graph.groupBy("p").agg(F.count("*").alias("n")), "patterns")
    shapely = graph.filter(shaped(F.col("x")))

    def scored(known: DataFrame, of: DataFrame, how: str) -> DataFrame:
        """Instances of ``of`` (or, with how left_anti, of none of them) that the patterns of ``known`` agree on."""
        held = join_hot(graph, known, "x", hot=hot["x"]).filter("kind is not null").groupBy("p", "kind").agg(F.count("*").alias("f"))
        # Over half of a pattern's instances are of one kind, so it is good for one at most.
        good = held.filter(F.col("f") >= LEAST_SEEDS).join(sizes, "p").withColumn("c", F.col("f") / F.col("n")).filter(F.col("c") >= LEAST_CONFIDENCE)
        good = staged(good.select("p", "kind", "c"), "good")
        votes = join_hot(shapely, good, "p", hot=hot["p"]).filter(F.col("kind").isNotNull() & shaped(F.col("x"), F.col("kind"))).groupBy("x", "kind")
        votes = votes.agg((1 - F.exp(F.sum(F.log1p(-F.least("c", F.lit(0.99)))))).alias("s"), F.count("*").alias("n"))
        sure = votes.filter((F.col("s") >= LEAST_SCORE) & (F.col("n") >= LEAST_PATTERNS)).join(of.select("x"), "x", how)
        return staged(sure.groupBy("x").agg(F.max_by("kind", F.struct("s", "n", "kind")).alias("kind")), "new")

    for _ in range(most_rounds):
        new = scored(known, known, "left_anti")
        if new.isEmpty():
            found = known.join(seeds.select("x"), "x", "left_anti")
            unsure = seeds.filter(F.col("kind") == SECRET)
            return found.unionByName(scored(known, unsure, "left_semi").filter(F.col("kind") == SECRET))
        known = known.unionByName(new)
    raise RuntimeError(f"the bootstrap has not converged after {most_rounds} rounds")


@tidied
def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, found (all spans: start, rank, kind, end, base; sorted).

    The four counts are of base spans; added ones are of these kinds or ``secret``. Null text is empty; rows that repeat an id are documents of their own. An empty
    table gives no rows. ``rank`` orders kinds that start at one place.
    """
    rows = staged(matches(docs, text, key), "matches")
    is_base = F.col("kind").isin(KINDS)
    spots = staged(located(rows).filter(~is_base | valid(F.col("kind"), F.col("m"))), "spots")
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, ALL_KINDS.index(k)), ALL_KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    base = spots.filter(is_base).select("r", "start", rank.alias("rank"), "kind", "end", F.lit(True).alias("base"))
    # In the order of starts, a token knows the base spans that began before it and the next one.
    line = Window.partitionBy("r").orderBy("start", ~is_base)
    past = F.max(F.when(is_base, F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    here = F.col("start")
    after = F.min(F.when(is_base, F.struct(here.alias("start"), F.col("kind"), F.col("m")))).over(Window.partitionBy("r").orderBy("start").rangeBetween(0, Window.unboundedFollowing))
    lead = F.regexp_extract("m", r"^[^\p{L}\p{N}+]*", 0)
    core = F.regexp_replace("m", r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
    tokens = spots.withColumn("past", past).withColumn("after", after).filter(~is_base)
    tokens = tokens.withColumn("seed", F.when(F.col("after.start") < F.col("end"), F.col("after.kind")))
    # A token that holds a base span is a seed; spaced groups only add what holds none.
    tokens = tokens.filter(((F.col("kind") == "token") & F.col("seed").isNotNull()) | F.col("seed").isNull() & F.coalesce(F.col("past") <= here, F.lit(True)))
    found = F.when(F.col("seed").isNotNull(), F.col("after.m")).otherwise(core)
    tokens = tokens.select("r", (here + F.length(lead)).alias("start"), found.alias("x"), "left", "seed", "kind").filter("x <> ''")
    # One instance a place: a token that may be an identifier, or else the spaced groups it begins.
    first = Window.partitionBy("r", "start").orderBy(((F.col("kind") == "token") & (F.col("seed").isNotNull() | shaped(F.col("x")))).desc(), "kind")
    secret = F.when(F.col("seed").isNull() & F.col("x").rlike(SECRET_SHAPE), SECRET)
    tokens = tokens.withColumn("n", F.row_number().over(first)).filter("n = 1").withColumn("seed", F.coalesce("seed", secret))
    tokens = staged(tokens.drop("n", "kind"), "tokens")
    new = bootstrap(tokens, most_rounds)
    added = tokens.filter(F.coalesce("seed", F.lit(SECRET)) == SECRET).join(new, "x").select("r", "start", rank.alias("rank"), "kind", (F.col("start") + F.length("x")).alias("end"), F.lit(False).alias("base"))
    spans = base.unionByName(added).groupBy("r").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "base"))).alias("found"))
    out = rows.select("r", "doc_id").join(spans.hint("merge"), "r", "left")  # both grow with the documents
    nothing = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean>>")
    out = out.withColumn("found", F.coalesce("found", nothing))
    count = lambda k: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in KINDS), "found")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.sha2(written(F.filter("found", lambda s: s["base"])), 256)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), base.alias("base_sha256"), written(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


SQL: dict[str, str] = {}  # the bootstrap is iterative; tests hold base spans against a plain regex scan
QUERIES = {"op8_pii": op8_pii}
