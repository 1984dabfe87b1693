"""Registered queries of Markdown outlines, assignment plans, lock changes, dangling ends, lookups, days and closing, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.operators import agenda, diffs, ledger, log, planning, selectors, workflow
from trivium.plans.registry import query
from trivium.sources import blocks, checkpoint_folder, table

# Files made of conversations: a line a turn
KIND = "(turn + conv_id) % 5"
LINES = f"SELECT conv_id AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line, CASE {KIND} WHEN 0 THEN '```' WHEN 1 THEN '# ' || role WHEN 2 THEN role || ' says' WHEN 3 THEN '===' ELSE 'see [x](t' || turn || '.md) and `[y](z.md)`' END AS content, {KIND} AS kind FROM conversations"
INSIDE = f"WITH l AS ({LINES}), s AS (SELECT *, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) % 2 = 1 AS code, lead(kind) OVER (PARTITION BY path ORDER BY line) AS under FROM l)"


def _marked(spark, d):
    checkpoint_folder(spark)
    role, turn, kind = F.col("role"), F.col("turn"), (F.col("turn") + F.col("conv_id")) % 5
    content = F.when(kind == 0, "```").when(kind == 1, F.concat(F.lit("# "), role)).when(kind == 2, F.concat(role, F.lit(" says"))).when(kind == 3, "===").otherwise(F.concat(F.lit("see [x](t"), turn, F.lit(".md) and `[y](z.md)`")))
    line = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), line.cast("long").alias("line"), content.alias("content"))
    return blocks.labelled(rows, blocks.MARKDOWN, 3)


@query(f"{INSIDE} SELECT CAST(path AS VARCHAR) AS path, line, 1 AS level, CASE kind WHEN 1 THEN content[3:] ELSE content END AS title FROM s WHERE NOT code AND (kind = 1 OR kind = 2 AND under = 3)")
def markdown_outline(spark, d):
    """Headings of both forms outside of code fences, from files read in chunks of three lines."""
    return blocks.headings(_marked(spark, d)).select("path", "line", "level", "title")


@query(f"{INSIDE} SELECT CAST(path AS VARCHAR) AS path, line, regexp_extract(content, '[(](t[0-9]+[.]md)[)]', 1) AS target FROM s WHERE kind = 4 AND NOT code")
def markdown_links(spark, d):
    return blocks.links(_marked(spark, d)).select("path", "line", "target")


TICKET = "o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'epic' WHEN 1 THEN 'bug' ELSE 'task' END AS type, CASE WHEN o_custkey % 13 > 0 THEN o_custkey % 9 END AS points"
MEMBER = "CASE WHEN o_custkey % 4 = 0 THEN 'c1' WHEN o_custkey % 4 = 1 THEN 'c2' WHEN o_custkey % 4 = 2 THEN 'c3' END AS cycle"


@query(f"""WITH t AS (SELECT {TICKET}, {MEMBER} FROM orders), h AS (SELECT coalesce(sum(points) FILTER (type = 'task'), 0) AS held FROM t WHERE cycle = 'c2' AND id % 50 = 3),
m AS (SELECT t.*, t.cycle = 'c2' AND t.id % 50 = 3 AS here, CASE WHEN cycle = 'c3' OR cycle = 'c2' AND t.id % 50 <> 3 THEN cycle END AS other, held + CASE type WHEN 'task' THEN points ELSE 0 END AS total, held FROM t, h),
o AS (SELECT *, CASE WHEN coalesce(here, false) THEN 'already' WHEN type = 'epic' THEN 'epic' WHEN points IS NULL THEN 'unsized' WHEN total > held + 5 THEN 'over capacity' ELSE 'add' END AS outcome FROM m)
SELECT id, outcome, CASE WHEN outcome = 'add' AND cycle = 'c3' THEN 'c3' END AS moved_from, CASE WHEN outcome = 'add' THEN CAST(total AS BIGINT) END AS committed, false AS over_commit FROM o""")
def assignment_plans(spark, d):
    """What assigning each order to a cycle comes to, and the open cycle that it leaves; closed ones keep theirs."""
    rows = table(spark, d, "orders").selectExpr(*_columns(TICKET), MEMBER)
    members = rows.filter("cycle is not null and (cycle <> 'c2' or id % 50 = 3)")
    cycles = spark.createDataFrame([("c1", 1, "closed"), ("c2", 2, "open"), ("c3", 3, "planned")], "id string, start int, state string")
    held = members.filter("cycle = 'c2' and type = 'task'").agg(F.coalesce(F.sum("points"), F.lit(0)).alias("_limit"))
    tickets = rows.select("id", "type", "points").crossJoin(F.broadcast(held))  # one row
    return workflow.assignment_plan(tickets, "c2", cycles, members, ("task",), F.col("_limit") + 5)


def _columns(text: str) -> list[str]:
    """Columns of a list whose parts hold no comma outside of ``AS``."""
    return [c.strip() for c in text.split(", ")]


FLOWS = "SELECT o_orderkey AS flow, o_custkey AS producer, o_custkey % 7 AS consumer FROM orders"


@query(f"""WITH f AS ({FLOWS}), o AS (SELECT * FROM f WHERE flow % 11 > 0), n AS (SELECT flow, CASE WHEN flow % 17 = 0 THEN producer + 1 ELSE producer END AS producer, consumer FROM f WHERE flow % 13 > 0),
a AS (SELECT p_partkey AS k, p_brand AS body, p_size AS sig FROM part WHERE p_partkey % 5 > 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 'new' ELSE p_brand END AS body, CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE p_size END AS sig FROM part WHERE p_partkey % 7 > 0)
SELECT 'flow' AS what, CAST(coalesce(o.flow, n.flow) AS VARCHAR) AS key, CASE WHEN o.flow IS NULL THEN 'Added' WHEN n.flow IS NULL THEN 'Removed' ELSE 'Changed' END AS change, '' AS facets FROM o FULL JOIN n ON n.flow = o.flow WHERE o.flow IS NULL OR n.flow IS NULL OR o.producer <> n.producer
UNION ALL SELECT 'entry', CAST(coalesce(a.k, b.k) AS VARCHAR), CASE WHEN a.k IS NULL THEN 'Added' WHEN b.k IS NULL THEN 'Removed' ELSE 'Changed' END, CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.sig <> b.sig THEN 'sig' END, CASE WHEN a.body <> b.body THEN 'body' END) END FROM a FULL JOIN b ON b.k = a.k WHERE a.k IS NULL OR b.k IS NULL OR a.sig <> b.sig OR a.body <> b.body""")
def lock_diff_with_flows(spark, d):
    flows = table(spark, d, "orders").selectExpr("o_orderkey AS flow", "o_custkey AS producer", "o_custkey % 7 AS consumer")
    part = table(spark, d, "part")
    old = part.filter("p_partkey % 5 > 0").selectExpr("p_partkey AS k", "p_size AS sig", "p_brand AS body")
    new = part.filter("p_partkey % 7 > 0").selectExpr("p_partkey AS k", "CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE p_size END AS sig", "CASE WHEN p_partkey % 6 = 0 THEN 'new' ELSE p_brand END AS body")
    moved = flows.filter("flow % 13 > 0").withColumn("producer", F.when(F.col("flow") % 17 == 0, F.col("producer") + 1).otherwise(F.col("producer")))
    return diffs.lock_changes(old, new, "k", ["sig", "body"], flows.filter("flow % 11 > 0"), moved).withColumn("facets", F.array_join("facets", ","))


@query("""WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2 + 1 END AS parent FROM customer), l AS (SELECT c_custkey AS src, 'blocks' AS kind, CASE WHEN c_custkey % 4 > 0 THEN c_custkey + c_nationkey * 40 END AS dst FROM customer UNION ALL SELECT id, 'parent', parent FROM t)
SELECT src, kind, dst FROM l WHERE dst IS NOT NULL AND dst NOT IN (SELECT id FROM t)""")
def dangling_ends(spark, d):
    """Links and parents that lead to no ticket."""
    rows = table(spark, d, "customer")
    links = rows.selectExpr("c_custkey AS src", "'blocks' AS kind", "CASE WHEN c_custkey % 4 > 0 THEN c_custkey + c_nationkey * 40 END AS dst")
    return ledger.dangling_ends(links, rows.selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2 + 1 END AS parent"))


@query("SELECT p_brand, string_agg(DISTINCT CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS ids FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 7) GROUP BY p_brand")
def found_by_key(spark, d):
    part = table(spark, d, "part").withColumn("id", F.col("p_partkey").cast("string"))
    return log.find_by_key(part, part.filter("p_size = 7").select("p_brand"), "p_brand").withColumn("ids", F.array_join("ids", ","))


@query("SELECT c_nationkey AS id, c_custkey AS child, c_name AS title, c_mktsegment AS category FROM customer WHERE c_custkey % 5 > 0")
def ticket_children(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS parent", "c_name AS title", "c_mktsegment AS category")
    return log.children(rows)


@query("SELECT event_id, CAST(ts + INTERVAL 1 SECOND * (event_id * 97) AS DATE) AS day, CAST(CAST(ts AS DATE) - CAST(event_id % 400 AS INT) AS DATE) AS before FROM events")
def days_of_instants(spark, d):
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", X.day_of(X.plus_seconds(at, F.col("event_id") * 97)).alias("day"), X.plus_days(X.day_of(at), -(F.col("event_id") % 400)).alias("before"))


@query("SELECT doc_id, regexp_replace(coalesce(text, ''), '(?i)\\b(the and|of|and)\\b', '[private]', 'g') AS text FROM documents WHERE lang = 'en' AND regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F]*')")
def redacted_terms(spark, d):
    """English texts of ASCII alone without three private terms."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").filter((F.col("lang") == "en") & (F.octet_length("text") == F.length("text")))
    return docs.select("doc_id", X.private_terms(F.col("text"), ("and", "the and", "of")).alias("text"))


MEMBERS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'active' ELSE 'open' END AS category, CASE WHEN o_orderkey % 3 = 0 THEN 'bug' ELSE 'task' END AS type, o_custkey % 9 AS points, o_custkey % 50 = 3 AS live, o_custkey % 20 AS g FROM orders"


@query(f"""WITH m AS ({MEMBERS}), f AS (SELECT g, count(*) FILTER (category = 'active' AND live) AS b, count(*) FILTER (category <> 'done') AS c, CAST(coalesce(sum(points) FILTER (type = 'task'), 0) AS BIGINT) AS committed, CAST(coalesce(sum(points) FILTER (type = 'task' AND category = 'done'), 0) AS BIGINT) AS done FROM m GROUP BY g)
SELECT g AS "group", CASE WHEN b > 0 THEN 'live lease' WHEN g = 5 AND c > 0 THEN 'no next cycle' ELSE 'closes' END AS state, c AS carried, committed, done FROM f WHERE g IN (3, 4, 5)""")
def cycle_close_states(spark, d):
    """The three ways that closing a cycle can come out: a member in progress is held, nothing follows, or it closes."""
    members = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'active' ELSE 'open' END AS category", "CASE WHEN o_orderkey % 3 = 0 THEN 'bug' ELSE 'task' END AS type", "o_custkey % 9 AS points", "o_custkey % 50 = 3 AS live", "o_custkey % 20 AS g")
    cycles = spark.createDataFrame([(1, 1, 9, "open"), (2, 10, 19, "planned")], "id int, s int, e int, state string").select("id", F.date_add(F.lit("1995-01-01").cast("date"), F.col("s")).alias("start"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("e")).alias("end"), "state")
    out = None
    for g in (3, 4, 5):
        others = cycles.filter("id = 1") if g == 5 else cycles
        row = agenda.close_plan(cycles.filter("id = 1"), members.filter(F.col("g") == g), others, F.lit("1995-01-05").cast("date"), ("task",))
        row = row.select(F.lit(g).cast("long").alias("group"), "state", "carried", "committed", "done")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT 6 AS n, 40 AS capacity UNION ALL SELECT 6, CAST(floor(greatest(0, avg(p) - stddev_pop(p))) AS BIGINT) FROM (SELECT sum(o_custkey % 9) AS p FROM orders WHERE o_orderkey % 10 < 6 GROUP BY o_orderkey % 10)")
def overridden_capacity(spark, d):
    """Capacity as it is set, and as it comes from the last cycles."""
    cycles = table(spark, d, "orders").filter("o_orderkey % 10 < 6").groupBy((F.col("o_orderkey") % 10).alias("start")).agg(F.sum(F.col("o_custkey") % 9).alias("points")).withColumn("end", F.col("start"))
    rows = planning.capacity(cycles, "points", 6, 1.0, override=40).unionByName(planning.capacity(cycles, "points", 6, 1.0))
    return rows.select(F.col("n").cast("int").alias("n"), "capacity")


LEASES = "CASE p_partkey % 3 WHEN 0 THEN concat('src/d', CAST(p_partkey % 7 AS STRING), '/**') WHEN 1 THEN concat('src/d', CAST(p_partkey % 7 AS STRING)) ELSE concat('src/*/f', CAST(p_partkey % 7 AS STRING), '?.rs') END"
WANTED = "CASE WHEN p_size % 2 = 0 THEN concat('src/d', CAST(p_size % 7 AS STRING), '/x*.rs') ELSE concat('**/f', CAST(p_size % 7 AS STRING), '*') END"


@query("SELECT p_partkey FROM part WHERE CASE WHEN p_partkey % 3 < 2 AND p_size % 2 = 0 THEN p_partkey % 7 = p_size % 7 WHEN p_partkey % 3 < 2 THEN true WHEN p_size % 2 = 0 THEN false ELSE p_partkey % 7 = p_size % 7 END")
def overlapping_leases(spark, d):
    """Pairs of patterns that can take one file."""
    pairs = table(spark, d, "part").selectExpr("p_partkey", f"{LEASES} AS held", f"{WANTED} AS wanted")
    return selectors.overlapping(pairs, "held", "wanted").select("p_partkey")
