"""Registered queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.functions import truth as T
from trivium.operators import certain, planning, relation
from trivium.plans import declared, fact_queries, ledger_queries, log_queries, more_queries, pattern_queries, rule_queries, rules, tree_queries  # noqa: F401  (they register their queries)
from trivium.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from trivium.sources import checkpoint_folder, table

TOXIC = "SELECT source, lang, count(*) FILTER (toxic = 1) AS lo, count(*) FILTER (toxic = 1 OR toxic IS NULL) AS hi FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang"


def _toxic(spark: SparkSession, d: str) -> DataFrame:
    """Toxic documents by source and language: certain and possible counts; no label is unknown."""
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang").join(labels, "doc_id", "left").withColumn("t", T.lift(F.col("toxic") == 1))
    return docs.groupBy("source", "lang").agg(T.lower_count(F.col("t")).alias("lo"), T.upper_count(F.col("t")).alias("hi"))


@query(f"""WITH c AS ({TOXIC}) SELECT *, 'Violation' AS verdict FROM c WHERE lo > 0 UNION ALL SELECT *, 'Clean' FROM c WHERE lo = 0 AND hi = lo UNION ALL SELECT *, 'Unresolved' FROM c WHERE hi > lo""")
def pplus_toxic_by_source(spark, d):
    return rules.judge(_toxic(spark, d), "P+")


@query(f"""WITH c AS ({TOXIC}), v AS (SELECT source, lang, lo > 0 AS v, hi > lo AS u FROM c)
SELECT count(*) AS subjects, count(*) FILTER (v) AS violations, count(*) FILTER (u) AS unresolved, CAST(CASE WHEN count(*) FILTER (v) > 0 THEN 0 WHEN count(*) FILTER (u) > 0 OR count(*) = 0 THEN 1 ELSE 2 END AS TINYINT) AS truth, count(*) = 0 AS vacuous, false AS required FROM v""")
def rule_accounting(spark, d):
    return rules.account(pplus_toxic_by_source(spark, d), ["source", "lang"])


@query("SELECT 0::BIGINT AS subjects, 0::BIGINT AS violations, 0::BIGINT AS unresolved, 1::TINYINT AS truth, true AS vacuous, true AS required")
def vacuous_rule(spark, d):
    return rules.account(pplus_toxic_by_source(spark, d).filter("lang = 'none'"), ["source", "lang"], must_measure=True)


@query(f"""WITH c AS ({TOXIC}), r AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) AS i, count(*) OVER (PARTITION BY lang) AS n FROM c WHERE hi > lo)
SELECT lang, max(n) AS n, string_agg(source, ',' ORDER BY source) FILTER (i <= 3) AS names FROM r GROUP BY lang""")
def rollup_unresolved(spark, d):
    return rules.rollup(pplus_toxic_by_source(spark, d), ["lang"], "source")


URGENT = "CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END"


@query(f"""WITH u AS (SELECT o_custkey, count(*) FILTER ({URGENT} = 2) AS lo, count(*) FILTER ({URGENT} >= 1) AS hi FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
c AS (SELECT c_custkey, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM customer LEFT JOIN u ON o_custkey = c_custkey)
SELECT c_custkey, lo, hi, CASE WHEN hi = 0 THEN 'Violation' WHEN lo > 0 THEN 'Clean' ELSE 'Unresolved' END AS verdict FROM c""")
def pminus_customer_urgent_order(spark, d):
    orders = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.expr(f"cast({URGENT} as tinyint)").alias("t"))
    return rules.judge(certain.count_bounds(table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], F.col("t")), "P-")


@query("""WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS lo, count(*) FILTER (l_returnflag IN ('N', 'A')) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, lo, hi, CASE WHEN lo > 3 THEN 'Violation' WHEN hi <= 3 THEN 'Clean' ELSE 'Unresolved' END AS verdict FROM c""")
def pn_lines_per_order_bounds(spark, d):
    t = F.expr("cast(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 0 END as tinyint)")
    lines = table(spark, d, "lineitem").select("l_orderkey", t.alias("t")).groupBy("l_orderkey").agg(T.lower_count(F.col("t")).alias("lo"), T.upper_count(F.col("t")).alias("hi"))
    return rules.judge(lines, "Pn max", 3)


@query("""WITH u AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS t FROM orders GROUP BY 1)
SELECT c_custkey, CAST(2 - coalesce(t, 0) AS TINYINT) AS truth FROM customer LEFT JOIN u ON o_custkey = c_custkey""")
def certain_anti_join(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.expr(f"cast({URGENT} as tinyint)").alias("t"))
    return certain.absent(table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], F.col("t"))


@query("""WITH l AS (SELECT o_orderkey, o_custkey, min(CASE WHEN p_size IS NULL THEN 1 WHEN p_size > 45 THEN 2 WHEN p_size > 40 THEN 1 ELSE 0 END) AS every_large FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
c AS (SELECT o_custkey, max(every_large) AS t FROM l GROUP BY 1)
SELECT c_custkey, CAST(coalesce(t, 0) AS TINYINT) AS truth FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def quantifier_nested(spark, d):
    """Customers with some order all of whose lines have large parts, inside out."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    size = F.when(F.col("p_size").isNull(), T.truth(1)).when(F.col("p_size") > 45, T.truth(2)).when(F.col("p_size") > 40, T.truth(1)).otherwise(T.truth(0))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey", "left").withColumn("t", size)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    per_order = orders.join(lines.groupBy("l_orderkey").agg(T.every(F.col("t")).alias("t")), "l_orderkey")
    return certain.exists(table(spark, d, "customer").select("c_custkey"), per_order, ["c_custkey"], F.col("t"))


EDGES = "SELECT p_partkey AS src, (7 * p_partkey + p_size) % (SELECT count(*) FROM part) AS dst, CASE WHEN p_size % 3 = 1 THEN 1 ELSE 2 END AS truth FROM part"


def _edges(spark, d):
    checkpoint_folder(spark)
    part = table(spark, d, "part").select("p_partkey", "p_size")
    n = part.count()
    return part.select(F.col("p_partkey").alias("src"), ((7 * F.col("p_partkey") + F.col("p_size")) % n).alias("dst"), F.when(F.col("p_size") % 3 == 1, 1).otherwise(2).cast("tinyint").alias("truth"))


REACH = f"""WITH RECURSIVE e AS ({EDGES}), w AS (SELECT src, dst, truth, 1 AS n FROM e UNION SELECT w.src, e.dst, least(w.truth, e.truth), n + 1 FROM w JOIN e ON w.dst = e.src WHERE n < 12)"""


@query(REACH + " SELECT src, dst, CAST(max(truth) AS TINYINT) AS truth FROM w GROUP BY src, dst")
def reaches_within_12(spark, d):
    return relation.reaches(_edges(spark, d), 12)


@query(f"""WITH RECURSIVE e AS ({EDGES}), w AS (SELECT src, dst, truth FROM e UNION SELECT w.src, e.dst, least(w.truth, e.truth) FROM w JOIN e ON w.dst = e.src)
SELECT src AS node, CAST(max(truth) AS TINYINT) AS truth FROM w WHERE src = dst GROUP BY src""")
def pc_part_cycle(spark, d):
    return relation.cycles(_edges(spark, d))


ORDER_PART = "SELECT l_orderkey AS src, l_partkey AS dst, max(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS truth FROM lineitem GROUP BY 1, 2"


@query(f"""WITH a AS (SELECT o_custkey AS src, o_orderkey AS dst, {URGENT} AS truth FROM orders), b AS ({ORDER_PART})
SELECT a.src, b.dst, CAST(max(least(a.truth, b.truth)) AS TINYINT) AS truth FROM a JOIN b ON a.dst = b.src WHERE least(a.truth, b.truth) > 0 GROUP BY 1, 2""")
def compose_relation(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.expr(f"cast({URGENT} as tinyint)").alias("truth"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.expr("cast(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 0 END as tinyint)").alias("truth"))
    return relation.compose(relation.strongest(a), relation.strongest(b))


@query("SELECT user_id, arg_max(event_type, struct_pack(ts, event_id)) AS event_type, arg_max(value, struct_pack(ts, event_id)) FILTER (value IS NOT NULL) AS value FROM events GROUP BY user_id")
def event_fold_state(spark, d):
    return certain.last_write(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("SELECT user_id, event_id, event_type, before FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before = event_type")
def event_fold_conflicts(spark, d):
    """Events that claim a change which the state before already holds."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", "ts", "event_type").withColumn("before", F.lag("event_type").over(w)).filter("before = event_type").drop("ts")


@query("""WITH l AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), e AS (SELECT * FROM l WHERE b IS DISTINCT FROM event_type)
SELECT user_id, arg_max(event_type, struct_pack(ts, event_id)) AS event_type, arg_max(ts, struct_pack(ts, event_id)) AS since FROM e GROUP BY user_id""")
def latest_into_category(spark, d):
    return planning.latest_into(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], "ts")


@query("""WITH c AS (SELECT date_trunc('week', o_orderdate) AS s, count(*) AS points FROM orders GROUP BY 1), l AS (SELECT points FROM c ORDER BY s DESC LIMIT 6)
SELECT count(*) AS n, round(avg(points), 6) AS mean, round(stddev_pop(points), 6) AS deviation, CAST(floor(greatest(0, avg(points) - stddev_pop(points))) AS BIGINT) AS capacity FROM l""")
def velocity_capacity(spark, d):
    week = F.date_trunc("week", F.col("o_orderdate"))
    cycles = table(spark, d, "orders").groupBy(week.alias("start")).agg(F.count(F.lit(1)).alias("points")).withColumn("end", F.col("start"))
    return planning.capacity(cycles, "points", 6, 1.0).withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 6))


@query("""WITH RECURSIVE o AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
f AS (SELECT p_brand, p_partkey, i, p_size <= 200 AS picked, CASE WHEN p_size <= 200 THEN p_size ELSE 0 END AS s FROM o WHERE i = 1
      UNION ALL SELECT o.p_brand, o.p_partkey, o.i, f.s + o.p_size <= 200, CASE WHEN f.s + o.p_size <= 200 THEN f.s + o.p_size ELSE f.s END FROM f JOIN o ON o.p_brand = f.p_brand AND o.i = f.i + 1)
SELECT p_brand, p_partkey AS item, picked FROM f""")
def greedy_fill(spark, d):
    part = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("item"), "p_partkey", "p_size")
    return planning.greedy_fill(part, "p_brand", ["p_partkey"], "p_size", 200)


@query("""SELECT o_orderstatus, o_orderkey, place, greatest(n - 8, 0) AS hidden FROM (SELECT o_orderstatus, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE place <= 8""")
def board_topk_hidden(spark, d):
    cards = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return planning.columns_with_hidden(cards, "o_orderstatus", [F.desc("o_totalprice"), F.col("o_orderkey")], 8).select("o_orderstatus", "o_orderkey", "place", "hidden")


@query("""WITH c AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'expedite' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'active' ELSE 'backlog' END AS lane, o_orderkey, o_totalprice FROM orders),
r AS (SELECT lane, o_orderkey, CAST(row_number() OVER (PARTITION BY lane ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place, count(*) OVER (PARTITION BY lane) AS n FROM c)
SELECT lane, o_orderkey, place, CASE WHEN lane IN ('active', 'expedite') THEN 0 ELSE greatest(n - 8, 0) END AS hidden FROM r WHERE place <= 8 OR lane IN ('active', 'expedite')""")
def board_lanes(spark, d):
    """The board with its expedite lane: neither the lane nor work in progress is cut, as `board_topk_hidden` cuts every column."""
    lane = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F"), "expedite").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "active").otherwise("backlog")
    cards = table(spark, d, "orders").select(lane.alias("lane"), "o_orderkey", "o_totalprice")
    return planning.columns_with_hidden(cards, "lane", [F.desc("o_totalprice"), F.col("o_orderkey")], 8, F.col("lane").isin("active", "expedite")).select("lane", "o_orderkey", "place", "hidden")


@query("""SELECT coalesce(o.p_partkey, n.k) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'Added' WHEN n.k IS NULL THEN 'Deleted' ELSE 'Modified' END AS change
FROM (SELECT p_partkey, p_brand AS v FROM part WHERE p_partkey % 10 <> 0) o FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN 'x' ELSE p_brand END AS v FROM part WHERE p_partkey % 7 <> 0) n ON n.k = o.p_partkey
WHERE o.p_partkey IS NULL OR n.k IS NULL OR o.v IS DISTINCT FROM n.v""")
def keyed_diff(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    new = part.filter("p_partkey % 7 <> 0").withColumn("p_brand", F.when(F.col("p_size") > 40, "x").otherwise(F.col("p_brand")))
    return certain.keyed_diff(part.filter("p_partkey % 10 <> 0"), new, "p_partkey", "p_brand")


@query("""WITH n AS (SELECT p_name FROM part GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey, p_name FROM part JOIN n USING (p_name)""")
def unique_name_edges(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    unique = part.groupBy("p_name").count().filter("count = 1").select("p_name")
    return part.join(unique, "p_name").select("p_partkey", "p_name")


@query("""SELECT page_id, regexp_replace(trim(regexp_replace(url, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '[0-9]+', '#', 'g') AS shape, regexp_matches(url, '^(//|[A-Za-z][A-Za-z0-9+.-]*:)') AS external FROM pages""")
def link_shapes(spark, d):
    return table(spark, d, "pages").select("page_id", X.fingerprint_text(F.col("url")).alias("shape"), X.is_external(F.col("url")).alias("external"))


@query("""WITH c AS (SELECT p_partkey, p_size / 50.0 AS r, (p_partkey % 256) / 255.0 AS g, (p_partkey % 17) / 16.0 AS b FROM part),
l AS (SELECT p_partkey, 0.2126 * CASE WHEN r <= 0.03928 THEN r / 12.92 ELSE pow((r + 0.055) / 1.055, 2.4) END + 0.7152 * CASE WHEN g <= 0.03928 THEN g / 12.92 ELSE pow((g + 0.055) / 1.055, 2.4) END + 0.0722 * CASE WHEN b <= 0.03928 THEN b / 12.92 ELSE pow((b + 0.055) / 1.055, 2.4) END AS l FROM c)
SELECT p_partkey, round(1.05 / (l + 0.05), 6) AS contrast FROM l""")
def colour_contrast(spark, d):
    part = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("r"), ((F.col("p_partkey") % 256) / 255.0).alias("g"), ((F.col("p_partkey") % 17) / 16.0).alias("b"))
    light = X.luminance(*(F.col(c).cast("double") for c in "rgb"))
    return part.select("p_partkey", F.round(X.contrast(F.lit(1.0), light), 6).alias("contrast"))


@query("""SELECT a.doc_id, CASE WHEN a.text IS NULL OR l.quality IS NULL THEN 'Unresolved' WHEN l.quality = 1 THEN 'Clean' ELSE 'Violation' END AS verdict FROM documents a LEFT JOIN labels l USING (doc_id)""")
def p0_equality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), 1).alias("one")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select("doc_id", rules.equality(F.col("quality"), F.col("one")).alias("verdict"))


@query("")
def selector_owner(spark, d):
    """Which pattern owns each document: source and language patterns of different specificity."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item"), "source", "lang", "n_chars")
    pattern = F.explode(
        F.filter(
            F.array(
                F.struct(F.lit("all").alias("entity"), F.lit(1).alias("specificity"), F.lit(True).alias("must"), F.lit(True).alias("hit")),
                F.struct(F.lit("english").alias("entity"), F.lit(2).alias("specificity"), F.lit(True).alias("must"), (F.col("lang") == "en").alias("hit")),
                F.struct(F.lit("first").alias("entity"), F.lit(2).alias("specificity"), F.lit(True).alias("must"), (F.col("source") == "src0").alias("hit")),
                F.struct(F.lit("long").alias("entity"), F.lit(3).alias("specificity"), F.lit(False).alias("must"), (F.col("n_chars") > 4000).alias("hit")),
            ),
            lambda x: x["hit"],
        )
    )
    return certain.owners(docs.select("item", pattern.alias("p")).select("item", "p.entity", "p.specificity", "p.must")).withColumn("owners", F.array_join("owners", ","))


ORACLE_SQL["selector_owner"] = """SELECT doc_id AS item,
CASE WHEN lang = 'en' AND source = 'src0' THEN CASE WHEN n_chars > 4000 THEN 'May' ELSE 'Unknown' END WHEN n_chars > 4000 THEN 'May' ELSE 'Must' END AS status,
CASE WHEN lang = 'en' AND source = 'src0' THEN CASE WHEN n_chars > 4000 THEN 'english,first,long' ELSE 'english,first' END
     WHEN lang = 'en' THEN CASE WHEN n_chars > 4000 THEN 'english,long' ELSE 'english' END
     WHEN source = 'src0' THEN CASE WHEN n_chars > 4000 THEN 'first,long' ELSE 'first' END
     ELSE CASE WHEN n_chars > 4000 THEN 'all,long' ELSE 'all' END END AS owners FROM documents"""
