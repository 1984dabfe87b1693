"""Registered queries of ticket logs, their index, milestones and cycles over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trivium.operators import agenda, ledger, log, relation, workflow
from trivium.plans.registry import query
from trivium.sources import checkpoint_folder, table

BODY = "CASE WHEN event_id % 50 = 0 THEN substr(props, 1, 3) ELSE props END AS body"


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 50 <> 0 AND props IS NOT NULL")
def parsed_events(spark, d):
    """Fields of readable event bodies."""
    return log.parse_events(table(spark, d, "events").selectExpr("event_id", BODY), "body", "k long")[0].select("event_id", "k")


@query("SELECT event_id FROM events WHERE event_id % 50 = 0 OR props IS NULL")
def unread_events(spark, d):
    return log.parse_events(table(spark, d, "events").selectExpr("event_id", BODY), "body", "k long")[1].select("event_id")


@query("SELECT user_id AS ticket, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 10007, event_id) AS place FROM events")
def events_in_fold_order(spark, d):
    events = table(spark, d, "events").selectExpr("user_id AS ticket", "event_id", "(event_id * 7919) % 10007 AS ms")
    return log.in_fold_order(events, ["ms", "event_id"]).select("ticket", "event_id", "place")


CHANGES = ("user_id AS ticket", "event_type AS field", "event_id", "CASE WHEN event_id % 5 > 0 THEN event_id % 4 END AS new", "CASE WHEN event_id % 3 > 0 THEN (event_id * 3) % 4 END AS old")


@query(f"""WITH c AS (SELECT {', '.join(CHANGES)} FROM events), f AS (SELECT *, lag(new) OVER (PARTITION BY ticket, field ORDER BY event_id) AS found FROM c)
SELECT event_id, field, old, found FROM f WHERE old IS DISTINCT FROM found""")
def field_conflicts(spark, d):
    """Changes that were made to another value than the one that stood there."""
    return log.field_conflicts(table(spark, d, "events").selectExpr(*CHANGES), ["event_id"]).select("event_id", "field", "old", "found")


MOVES = ("user_id AS ticket", "event_id", "event_id AS at", "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'active' ELSE 'backlog' END AS {q}to{q}", "CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'active' ELSE 'backlog' END AS {q}from{q}")
MOVED = f"m AS (SELECT {', '.join(MOVES).format(q=chr(34))} FROM events)"


def moves(spark, d):
    return table(spark, d, "events").selectExpr(*(m.format(q="`") for m in MOVES))


@query(f"""WITH {MOVED}, f AS (SELECT *, coalesce(lag("to") OVER (PARTITION BY ticket ORDER BY event_id), 'backlog') AS found FROM m) SELECT event_id, "from", found FROM f WHERE "from" <> found""")
def transition_conflicts(spark, d):
    return log.transition_conflicts(moves(spark, d), ["event_id"], "backlog").select("event_id", "from", "found")


USERS = "user_id AS id", "CASE user_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'active' ELSE 'backlog' END AS category", "CASE user_id % 5 WHEN 0 THEN 'wontfix' WHEN 1 THEN 'fixed' ELSE 'done' END AS outcome", "CASE user_id % 4 WHEN 0 THEN 'story' WHEN 1 THEN 'epic' ELSE 'task' END AS type", "user_id % 8 AS points"
USER = f"u AS (SELECT {', '.join(USERS)} FROM (SELECT DISTINCT user_id FROM events))"


def users(spark, d):
    return table(spark, d, "events").select("user_id").distinct().selectExpr(*USERS)


@query(f"""WITH {MOVED}, {USER}, l AS (SELECT ticket, max(event_id) AS "at" FROM m WHERE "to" = 'done' GROUP BY ticket)
SELECT id, type, points, "at" FROM u JOIN l ON l.ticket = u.id WHERE category = 'done' AND outcome IN ('fixed', 'done')""")
def done_facts(spark, d):
    return log.done_facts(moves(spark, d), users(spark, d), ["event_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE value > 20 GROUP BY user_id")
def latest_exemption(spark, d):
    """The latest exemption of each user, whatever fields it leaves empty."""
    return log.latest(table(spark, d, "events").filter("value > 20"), ["user_id"], ["event_id"], "event_type", "event_id")


DIGITS = " + ".join(f"(strpos('{log.CROCKFORD}', substr(ulid, {i}, 1)) - 1) * {32 ** (10 - i)}" for i in range(1, 11))


@query(f"""WITH e AS (SELECT event_id, concat('0', upper(substr(md5(CAST(event_id AS VARCHAR)), 1, 25))) AS ulid FROM events)
SELECT event_id, CAST({DIGITS} AS BIGINT) AS ms FROM e""")
def ulid_times(spark, d):
    ulid = F.concat(F.lit("0"), F.upper(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 25)))
    return table(spark, d, "events").select("event_id", log.ulid_ms(ulid).alias("ms"))


@query("SELECT event_id, event_id % 5000 AS skew FROM events WHERE event_id % 5000 > 600")
def skewed_events(spark, d):
    """Events whose identifier is more than ten minutes from the time they state."""
    events = table(spark, d, "events").select("event_id", (F.col("event_id") * 10000 + F.col("event_id") % 5000 * 1000).alias("ms"), F.timestamp_seconds(F.col("event_id") * 10).alias("at"))
    return log.skewed(events, "ms", "at").select("event_id", "skew")


@query("SELECT ticket, arg_min(kind, t) AS kind FROM (SELECT user_id AS ticket, event_id AS t, CASE event_type WHEN 'signup' THEN 'create' ELSE event_type END AS kind FROM events) GROUP BY ticket HAVING arg_min(kind, t) <> 'create'")
def not_created_first(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("ticket"), "event_id", F.when(F.col("event_type") == "signup", "create").otherwise(F.col("event_type")).alias("kind"))
    return log.not_created_first(events, ["event_id"])


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 7 = 0 AND c_nationkey <> 3 THEN 'c_nationkey' END, CASE WHEN c_custkey % 5 = 0 AND c_mktsegment <> 'BUILDING' THEN 'c_mktsegment' END) AS fields FROM customer
WHERE (c_custkey % 7 = 0 AND c_nationkey <> 3) OR (c_custkey % 5 = 0 AND c_mktsegment <> 'BUILDING')""")
def differing_fields(spark, d):
    """Fields of stored customers that are not what their log folds to."""
    stored = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    folded = stored.withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, 3).otherwise(F.col("c_nationkey"))).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "BUILDING").otherwise(F.col("c_mktsegment")))
    return log.differing_fields(stored, folded, "c_custkey", ["c_nationkey", "c_mktsegment"]).withColumn("fields", F.array_join("fields", ","))


@query("SELECT c_custkey AS id, c_nationkey AS nation, 'k1' AS _key FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey * 2, 99, 'k1' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 98, 'k1' FROM customer WHERE c_custkey % 20 = 10")
def index_upsert(spark, d):
    """An index moved from one state to the next: changed tickets replace theirs, new ones come in."""
    index = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation", "'k0' AS _key")
    tens = index.filter("id % 10 = 0")
    changed = tens.selectExpr("id * 2 AS id", "99 AS nation").unionByName(index.filter("id % 20 = 10").selectExpr("id", "98 AS nation"))
    base = index.filter("id % 20 = 10 or id % 10 <> 0")
    return log.apply(base, "k0", "k1", changed)


LABELS = "CASE c_nationkey % 3 WHEN 0 THEN 'ui' WHEN 1 THEN 'db' ELSE 'net' END"


@query(f"SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 4 = 1 AND {LABELS} = 'db'")
def listed_tickets(spark, d):
    tickets = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS category", "CASE c_nationkey % 4 WHEN 1 THEN 'task' ELSE 'story' END AS type", f"array('all', {LABELS}) AS labels", "c_custkey % 2 = 0 AS blocked", "c_nationkey AS parent")
    return log.listed(tickets, category="BUILDING", type="task", label="db").select("id")


@query("""WITH t AS (SELECT upper(md5(CAST(p_partkey AS VARCHAR))) AS id, concat('P-', CAST(p_partkey % 500 AS VARCHAR)) AS alias FROM part),
q AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN concat('~', right(md5(CAST(c_custkey AS VARCHAR)), 2 + c_custkey % 5)) WHEN 1 THEN upper(md5(CAST(c_custkey AS VARCHAR))) ELSE concat('P-', CAST(c_custkey % 700 AS VARCHAR)) END AS asked FROM customer),
f AS (SELECT asked, id FROM q JOIN t ON asked[1] = '~' AND ends_with(id, upper(substr(asked, 2))) UNION SELECT asked, id FROM q JOIN t ON asked = id UNION SELECT asked, id FROM q JOIN t ON asked = alias)
SELECT q.asked, CASE count(id) WHEN 0 THEN 'NotFound' WHEN 1 THEN 'Found' ELSE 'Ambiguous' END AS status, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids FROM q LEFT JOIN f USING (asked) GROUP BY q.asked""")
def resolved_handles(spark, d):
    """What suffixes, identifiers and aliases mean: one ticket, none or several."""
    tickets = table(spark, d, "part").select(F.upper(F.md5(F.col("p_partkey").cast("string").cast("binary"))).alias("id"), F.array(F.concat(F.lit("P-"), (F.col("p_partkey") % 500).cast("string"))).alias("aliases"))
    key, digest = F.col("c_custkey"), F.md5(F.col("c_custkey").cast("string").cast("binary"))
    asked = F.when(key % 3 == 0, F.concat(F.lit("~"), F.right(digest, (2 + key % 5).cast("int")))).when(key % 3 == 1, F.upper(digest)).otherwise(F.concat(F.lit("P-"), (key % 700).cast("string")))
    return log.resolve_handles(table(spark, d, "customer").select(asked.alias("asked")).distinct(), tickets, 2).select("asked", "status", F.array_join("ids", ",").alias("ids"))


LINKED = ("c_custkey AS src", "CASE c_nationkey % 3 WHEN 0 THEN 'blocks' WHEN 1 THEN 'causes' ELSE 'relates' END AS kind", "c_custkey * 3 + c_nationkey AS dst")


@query(f"""WITH l AS (SELECT {', '.join(LINKED)} FROM customer), t AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS category FROM customer),
r AS (SELECT src AS id, 'out' AS direction, kind, dst AS other FROM l UNION SELECT dst, 'in', CASE kind WHEN 'blocks' THEN 'blocked-by' WHEN 'causes' THEN 'caused-by' ELSE kind END, src FROM l)
SELECT r.*, t.title, t.category FROM r LEFT JOIN t ON t.id = r.other WHERE r.id IN (SELECT id FROM t)""")
def ticket_links(spark, d):
    """Links from and to every ticket, dangling ones too."""
    tickets = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS title", "c_mktsegment AS category")
    inverse = {v: k for k, v in ledger.INVERSE.items()}
    return log.linked_view(tickets, table(spark, d, "customer").selectExpr(*LINKED), inverse)


@query("SELECT DISTINCT concat('n', CAST(l_suppkey AS VARCHAR)) AS alias, l_partkey AS id FROM lineitem")
def aliases_once(spark, d):
    return log.aliases_once(table(spark, d, "lineitem").select(F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("alias"), F.col("l_partkey").alias("id")))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_on_base(spark, d):
    return log.missing_on_base(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) FILTER (value IS NOT NULL) AS value, min((event_id * 31) % 9973) AS created, max((event_id * 31) % 9973) AS updated FROM events GROUP BY user_id")
def folded_plans(spark, d):
    """Plans whose times are the least and greatest of their log, whatever order its fields follow."""
    events = table(spark, d, "events").withColumn("at", F.col("event_id") * 31 % 9973)
    return log.fold_plans(events, "user_id", ["event_id"], ["event_type", "value"])


@query("SELECT p_brand, p_size, min(p_partkey) % 2 AS result FROM part WHERE p_size <= 20 GROUP BY 1, 2 UNION ALL SELECT p_brand, p_size, 7 FROM part WHERE p_size > 20 AND p_size % 5 > 0 GROUP BY 1, 2")
def memo_remembered(spark, d):
    """Results put beside those that are there; failed evaluations are not kept."""
    inputs = table(spark, d, "part").groupBy("p_brand", "p_size").agg((F.min("p_partkey") % 2).alias("result"))
    return log.remember(inputs.filter("p_size <= 20"), inputs.withColumn("result", F.lit(7).cast("long")).withColumn("failed", F.col("p_size") % 5 == 0), ["p_brand", "p_size"])


# Cycles and milestones

CYCLES = "n_nationkey AS id, DATE '1995-01-01' + n_nationkey * 60 AS start, DATE '1995-01-01' + n_nationkey * 60 + 59 AS \"end\", CASE WHEN n_nationkey % 4 = 0 THEN DATE '1995-01-01' + n_nationkey * 60 + 30 END AS ended"
COUNTED = ("task", "story")


def calendar(spark, d):
    start = F.date_add(F.lit("1995-01-01").cast("date"), F.col("n_nationkey") * 60)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), start.alias("start"), F.date_add(start, 59).alias("end"), F.when(F.col("n_nationkey") % 4 == 0, F.date_add(start, 30)).alias("ended"), F.when(F.col("n_nationkey") < 3, "closed").otherwise("open").alias("state"))


@query(f"""WITH c AS (SELECT {CYCLES} FROM nation), f AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'task' WHEN 1 THEN 'story' ELSE 'epic' END AS type, o_custkey % 8 AS points, CAST(o_orderdate AS DATE) AS "on" FROM orders)
SELECT c.id AS cycle, CAST(coalesce(sum(points), 0) AS BIGINT) AS points FROM c LEFT JOIN f ON type IN ('task', 'story') AND start <= "on" AND "on" <= coalesce(ended, "end") GROUP BY c.id""")
def delivered_points(spark, d):
    facts = table(spark, d, "orders").selectExpr("CASE o_orderkey % 3 WHEN 0 THEN 'task' WHEN 1 THEN 'story' ELSE 'epic' END AS type", "o_custkey % 8 AS points", "CAST(o_orderdate AS DATE) AS `on`")
    return agenda.delivered(facts, calendar(spark, d), COUNTED)


@query("SELECT o_custkey, CAST(sum(CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 5 > 0 THEN o_orderkey % 8 ELSE 0 END) AS BIGINT) AS committed FROM orders GROUP BY o_custkey")
def committed_points(spark, d):
    members = table(spark, d, "orders").selectExpr("o_custkey", "CASE o_orderkey % 3 WHEN 0 THEN 'task' WHEN 1 THEN 'story' ELSE 'epic' END AS type", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 8 END AS points")
    return agenda.committed(members, "o_custkey", COUNTED)


PARENTED = "t AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN CAST(floor(c_custkey / 3) AS BIGINT) END AS parent, CASE WHEN c_nationkey % 2 = 0 THEN 'done' ELSE 'active' END AS category, CASE WHEN c_custkey % 10 = 0 THEN concat('v', CAST(c_nationkey % 6 AS VARCHAR)) END AS claim FROM customer)"
STONES = "m AS (SELECT n_nationkey AS id, concat('v', CAST(n_nationkey AS VARCHAR)) AS version, CASE n_nationkey % 3 WHEN 0 THEN 'closed' ELSE 'open' END AS state, CASE WHEN n_nationkey % 4 > 0 THEN n_name ELSE ' ' END AS goal, CASE WHEN n_nationkey % 5 > 0 THEN (n_nationkey * 7) % 11 END AS target FROM nation WHERE n_nationkey < 9), e AS (SELECT version, unnest([id * 3 + 1, id + 20]) AS epic FROM m)"
UNDER = f"WITH RECURSIVE {PARENTED}, {STONES}, b AS (SELECT DISTINCT epic, epic AS id FROM e UNION SELECT b.epic, t.id FROM b JOIN t ON t.parent = b.id)"


def parented(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_custkey > 0 THEN CAST(floor(c_custkey / 3) AS BIGINT) END AS parent", "CASE WHEN c_nationkey % 2 = 0 THEN 'done' ELSE 'active' END AS category",
        "CASE WHEN c_custkey % 10 = 0 THEN array('x', concat('milestone:v', CAST(c_nationkey % 6 AS STRING))) ELSE array('x') END AS labels",
    )


def stones(spark, d):
    return table(spark, d, "nation").filter("n_nationkey < 9").selectExpr(
        "n_nationkey AS id", "concat('v', CAST(n_nationkey AS STRING)) AS version", "CASE n_nationkey % 3 WHEN 0 THEN 'closed' ELSE 'open' END AS state", "CASE WHEN n_nationkey % 4 > 0 THEN n_name ELSE ' ' END AS goal",
        "CASE WHEN n_nationkey % 5 > 0 THEN (n_nationkey * 7) % 11 END AS target", "array(CAST(n_nationkey * 3 + 1 AS BIGINT), CAST(n_nationkey + 20 AS BIGINT)) AS epics",
    )


@query(f"{UNDER} SELECT * FROM b")
def under_epics(spark, d):
    checkpoint_folder(spark)
    return agenda.under_epics(parented(spark, d), stones(spark, d).select(F.explode("epics").alias("epic")).distinct())


@query(f"{UNDER} SELECT version, id FROM e JOIN b USING (epic) UNION SELECT claim, id FROM t WHERE claim IN (SELECT version FROM m)")
def milestone_members(spark, d):
    checkpoint_folder(spark)
    return agenda.milestone_members(stones(spark, d), parented(spark, d))


@query(f"{UNDER} SELECT id, claim AS version FROM t WHERE claim IN (SELECT version FROM m) AND (claim, id) NOT IN (SELECT (version, id) FROM e JOIN b USING (epic))")
def pm034_claims_outside(spark, d):
    """Claims on a milestone by tickets below none of its epics."""
    checkpoint_folder(spark)
    return agenda.claims_outside(stones(spark, d), parented(spark, d))


@query(f"WITH {STONES} SELECT id FROM m WHERE state = 'open' AND trim(goal) = ''")
def pm001_without_goal(spark, d):
    return agenda.without_goal(stones(spark, d)).select("id")


@query(f"WITH {PARENTED}, {STONES} SELECT version, count(*) AS epics FROM e JOIN m USING (version) LEFT JOIN t ON t.id = epic WHERE m.state = 'closed' AND t.category IS DISTINCT FROM 'done' GROUP BY version")
def pm002_incomplete_epics(spark, d):
    return agenda.incomplete_epics(stones(spark, d), parented(spark, d))


@query(f"WITH {STONES} SELECT id FROM m WHERE state = 'open' ORDER BY target NULLS LAST, version LIMIT 1")
def next_milestone(spark, d):
    return agenda.next_milestone(stones(spark, d))


LANE = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END"


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {LANE}, {LANE} = 2 AND o_orderkey % 3 <> 0, o_orderkey) AS place FROM orders")
def plan_order(spark, d):
    """Each customer's orders as a plan takes them: the next milestone's first among the plain ones only."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr(LANE).alias("l"))
    keys = agenda.plan_order(F.col("l"), F.col("o_orderkey") % 3 == 0)
    return orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*keys, "o_orderkey")).alias("place"))


@query(f"""WITH {USER}, f AS (SELECT count(*) FILTER (category = 'active' AND id % 7 = 100) AS blocking, count(*) FILTER (category <> 'done') AS carried, CAST(sum(points) FILTER (type IN ('task', 'story')) AS BIGINT) AS committed, CAST(sum(points) FILTER (type IN ('task', 'story') AND category = 'done') AS BIGINT) AS done FROM u)
SELECT 'closes' AS state, DATE '1995-01-01' + 320 AS ended, 6 AS target, carried, committed, done FROM f""")
def cycle_close_plan(spark, d):
    """Closing the sixth cycle early: what is open goes to the next."""
    cycles = calendar(spark, d)
    members = users(spark, d).withColumn("live", F.col("id") % 7 == 100)
    return agenda.close_plan(cycles.filter("id = 5"), members, cycles, F.date_add(F.lit("1995-01-01").cast("date"), 320), COUNTED)


@query("SELECT count(*) AS ready, 1000000 AS least FROM orders WHERE o_orderstatus = 'O' HAVING count(*) < 1000000")
def pm033_ready_queue_low(spark, d):
    return agenda.ready_queue_low(table(spark, d, "orders").filter("o_orderstatus = 'O'"), 1_000_000)


@query("WITH w AS (SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_orderpriority <> '1-URGENT') AS standard, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderpriority = '1-URGENT') AS expedite, count(*) FILTER (o_orderkey % 3 <> 0) AS stale FROM orders WHERE o_orderstatus = 'P') SELECT * FROM w WHERE standard > 3")
def pm013_work_over_limit(spark, d):
    active = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return agenda.over_limit(workflow.in_progress(active, active.filter("o_orderkey % 3 = 0").select("o_orderkey"), "o_orderkey", F.col("o_orderpriority") == "1-URGENT"), 3)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0 AND (o_orderstatus <> 'F' OR DATE '1997-01-01' - CAST(o_orderdate AS DATE) <= 700)")
def shown_on_board(spark, d):
    """Orders on the board: no epics, and of what is done only what is recent."""
    shown = agenda.shown_on_board(F.when(F.col("o_orderkey") % 6 == 0, "epic").otherwise("task"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("active"), F.col("o_orderdate").cast("date"), F.lit("1997-01-01").cast("date"), 700)
    return table(spark, d, "orders").filter(shown).select("o_orderkey")


@query(f"""WITH {MOVED}, {USER}, l AS (SELECT u.id, max(event_id) AS t FROM m JOIN u ON u.id = m.ticket AND m."to" = u.category GROUP BY u.id) SELECT u.id, coalesce(t, -u.id) AS since FROM u LEFT JOIN l USING (id)""")
def card_since(spark, d):
    return agenda.card_since(moves(spark, d), users(spark, d).withColumn("created", -F.col("id")), ["event_id"])


@query("SELECT user_id, arg_max(event_type, struct_pack(value, event_type)) AS event_type, max(value) AS value FROM events GROUP BY user_id")
def slowest_stage(spark, d):
    return agenda.slowest(table(spark, d, "events"), "user_id", "event_type", "value")


FAMILY = ("c_custkey AS src", "c_custkey - c_custkey % 20 + (c_custkey * 7 + c_nationkey) % 20 AS dst")


@query(f"""WITH RECURSIVE g AS (SELECT {', '.join(FAMILY)} FROM customer UNION SELECT c_custkey, c_custkey - c_custkey % 20 + (c_custkey * 3 + 1) % 20 FROM customer WHERE c_custkey % 4 = 0), w AS (SELECT * FROM g UNION SELECT w.src, g.dst FROM w JOIN g ON g.src = w.dst)
SELECT a.src AS node, max(a.dst) AS ring FROM w a JOIN w b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src""")
def strongly_connected(spark, d):
    """Rings of the customers' links: each node on a cycle with the greatest node of its ring."""
    checkpoint_folder(spark)
    customers = table(spark, d, "customer")
    more = customers.filter("c_custkey % 4 = 0").selectExpr("c_custkey AS src", "c_custkey - c_custkey % 20 + (c_custkey * 3 + 1) % 20 AS dst")
    return relation.on_cycles(customers.selectExpr(*FAMILY).unionByName(more))


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS node FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 90 AS name, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 4 END AS qualifier FROM lineitem WHERE l_quantity > 45 AND l_linenumber < 3),
n AS (SELECT p_partkey AS node, p_partkey % 100 AS name, p_size % 4 AS own FROM part), o AS (SELECT DISTINCT name, qualifier FROM c JOIN r ON r.node = c.src),
m AS (SELECT n.node, o.name, o.qualifier, count(*) OVER (PARTITION BY o.name, o.qualifier) AS n FROM o JOIN n ON n.name = o.name AND (o.qualifier IS NULL OR o.qualifier = n.own))
SELECT node, bool_or(qualifier IS NOT NULL AND n = 1) AS pinned FROM m GROUP BY node""")
def poison_map(spark, d):
    """Parts that an unresolved call from a reached supplier may mean."""
    lines = table(spark, d, "lineitem")
    reached = lines.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("node")).distinct()
    calls = lines.filter("l_quantity > 45 and l_linenumber < 3").selectExpr("l_suppkey AS src", "l_partkey % 90 AS name", "CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 4 END AS qualifier")
    named = table(spark, d, "part").selectExpr("p_partkey AS node", "p_partkey % 100 AS name", "p_size % 4 AS qualifier")
    return relation.poisoned(reached, calls, named)
