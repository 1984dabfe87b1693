"""Registered queries of range joins, ticket analytics and differences over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.operators import diffs, ledger, spans
from trivium.plans.registry import query
from trivium.sources import checkpoint_folder, table

#: Microseconds of a zone-less time, whatever the zone of the session.
MICROS = "unix_micros(from_utc_timestamp(cast(ts as timestamp), current_timezone()))"

RANGES = """f AS (SELECT o_orderkey AS finding, o_custkey AS path, o_orderkey % 1000 AS s, o_orderkey % 1000 + 5 AS e FROM orders),
x AS (SELECT p_partkey AS exception, p_partkey % (SELECT count(*) FROM customer) AS path, (p_partkey * 7) % 1000 AS s, (p_partkey * 7) % 1000 + p_size * 9 AS e FROM part)"""


@query(f"""WITH {RANGES}, m AS (SELECT finding, exception, row_number() OVER (PARTITION BY finding ORDER BY x.e - x.s, exception) AS i FROM f JOIN x ON f.path = x.path AND x.s <= f.s AND f.e <= x.e)
SELECT f.finding, m.exception FROM f LEFT JOIN m ON f.finding = m.finding AND i = 1""")
def exception_tightest(spark, d):
    """The narrowest exception around each finding."""
    n = table(spark, d, "customer").count()
    place = F.col("o_orderkey") % 1000
    findings = table(spark, d, "orders").select(F.col("o_orderkey").alias("finding"), F.col("o_custkey").alias("path"), place.alias("start"), (place + 5).alias("end"))
    at = (F.col("p_partkey") * 7) % 1000
    exceptions = table(spark, d, "part").select(F.col("p_partkey").alias("exception"), (F.col("p_partkey") % n).alias("path"), at.alias("from"), (at + F.col("p_size") * 9).alias("to"))
    return spans.tightest(findings, exceptions, ["path"], "finding", "exception").select("finding", "exception")


@query("""WITH t AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 600 + event_id % 100000 AS e FROM events),
p AS (SELECT d.event_id, q.event_id AS symbol, q.s, q.e, d.s AS line FROM t d JOIN t q ON d.user_id = q.user_id AND d.event_type = 'error' AND q.event_type = 'purchase'),
n AS (SELECT event_id, arg_min(symbol, struct_pack(s, w := s - e, symbol)) AS ahead FROM p WHERE s > line AND s <= line + 86400 GROUP BY event_id),
a AS (SELECT event_id, arg_min(symbol, struct_pack(w := e - s, symbol)) AS around FROM p WHERE s <= line AND line <= e GROUP BY event_id)
SELECT t.event_id, coalesce(ahead, around) AS symbol FROM t LEFT JOIN n USING (event_id) LEFT JOIN a USING (event_id) WHERE event_type = 'error'""")
def directive_binding(spark, d):
    """Each error with the purchase it precedes within a day, else the purchase whose span holds it."""
    second = F.floor(F.expr(MICROS) / 1_000_000)
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", second.alias("line"))
    symbols = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("symbol"), F.col("line").alias("from"), (F.col("line") + 600 + F.col("event_id") % 100000).alias("to"))
    return spans.bind(events.filter("event_type = 'error'").select("event_id", "user_id", "line"), symbols, ["user_id"], "event_id", "symbol", 86400).select("event_id", "symbol")


@query("""SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.role = 'assistant' AND c.turn - a.turn BETWEEN 0 AND 1)""")
def unadjoined_turns(spark, d):
    """User turns with no assistant turn on the same or the line above."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return spans.unadjoined(turns.filter("role = 'user'"), turns.filter("role = 'assistant'"), ["conv_id"], "turn").select("conv_id", "turn")


LINKS = "SELECT l_orderkey AS src, CASE l_returnflag WHEN 'A' THEN 'blocks' WHEN 'R' THEN 'blocked-by' ELSE 'relates' END AS kind, l_partkey * 9 AS dst FROM lineitem"
STATE = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'active' ELSE 'backlog' END"


def _links(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS src", "CASE l_returnflag WHEN 'A' THEN 'blocks' WHEN 'R' THEN 'blocked-by' ELSE 'relates' END AS kind", "l_partkey * 9 AS dst")


def _tickets(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", f"{STATE} AS category", "o_orderpriority AS priority", "o_orderdate AS at")


BLOCKED = f"""t AS (SELECT o_orderkey AS id, {STATE} AS category, o_orderpriority, o_orderdate FROM orders), l AS ({LINKS}),
b AS (SELECT dst AS ticket, src AS blocker FROM l WHERE kind = 'blocks' UNION SELECT src, dst FROM l WHERE kind = 'blocked-by'),
k AS (SELECT *, category <> 'done' AND EXISTS (SELECT 1 FROM b JOIN t o ON o.id = b.blocker WHERE b.ticket = t.id AND o.category <> 'done') AS blocked FROM t)"""


@query(f"WITH {BLOCKED} SELECT id, blocked FROM k")
def blocked_derived(spark, d):
    return ledger.with_blocked(_tickets(spark, d), _links(spark, d)).select("id", "blocked")


@query(f"""WITH {BLOCKED} SELECT id, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS lane, CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_orderdate AS DATE) END AS due FROM k WHERE category = 'backlog' AND NOT blocked""")
def doable_lanes(spark, d):
    """What can be started, with its lane and due day, the keys of the order of work."""
    rows = ledger.with_blocked(_tickets(spark, d), _links(spark, d)).filter("category = 'backlog' and not blocked")
    return rows.selectExpr("id", "CASE priority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS lane", "CASE WHEN priority = '2-HIGH' THEN CAST(at AS DATE) END AS due")


@query(f"WITH l AS ({LINKS}) SELECT src, kind, dst FROM l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = dst)")
def dangling_links(spark, d):
    return ledger.dangling(_links(spark, d), _tickets(spark, d)).select("src", "kind", "dst")


@query(f"""WITH l AS (SELECT DISTINCT * FROM ({LINKS})) SELECT 'self' AS problem, kind, src AS node FROM l WHERE src = dst
UNION ALL SELECT 'origins', kind, dst FROM l GROUP BY kind, dst HAVING count(*) > 1""")
def link_topology(spark, d):
    return ledger.topology(_links(spark, d))


#: Families of twenty customers with links of one kind, spelled either way, and parents.
FAMILY = "c_custkey - c_custkey % 20"
KINDS = "['blocks', 'causes', 'discovered-from', 'supersedes', 'splits', 'duplicates', 'enabler-for', 'relates']"
BACK = "['blocked-by', 'caused-by', 'spawned', 'superseded-by', 'split-from', 'duplicated-by', 'enabled-by', 'relates']"
LINKED = f"c_custkey AS one, {FAMILY} + (c_custkey * 7 + c_nationkey) % 20 AS other"
PARENT = f"CASE WHEN c_nationkey % 2 = 0 THEN {FAMILY} + (c_custkey * 3 + c_nationkey) % 20 END"


@query(f"""WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN 'story' ELSE 'task' END AS type, {PARENT} AS parent FROM customer),
l AS (SELECT DISTINCT k AS kind, CASE WHEN k = 'relates' THEN least(one, other) ELSE one END AS src, CASE WHEN k = 'relates' THEN greatest(one, other) ELSE other END AS dst FROM (SELECT {LINKED}, {KINDS}[(c_custkey // 20) % 8 + 1] AS k FROM customer)),
e AS (SELECT * FROM l UNION SELECT 'parent', id, parent FROM t WHERE parent IS NOT NULL), p AS (SELECT * FROM e WHERE src <> dst),
a AS (SELECT * FROM p WHERE kind IN ('blocks', 'causes', 'discovered-from', 'supersedes', 'parent')), w AS (SELECT * FROM a UNION SELECT w.kind, w.src, a.dst FROM w JOIN a ON a.kind = w.kind AND a.src = w.dst)
SELECT 'self' AS problem, kind, src AS node FROM e WHERE src = dst UNION SELECT 'cycle', kind, src FROM w WHERE src = dst
UNION (SELECT 'origins', kind, dst FROM p WHERE kind = 'splits' GROUP BY kind, dst HAVING count(*) > 1)
UNION SELECT 'duplicate', kind, src FROM p WHERE kind = 'duplicates' AND src IN (SELECT dst FROM p WHERE kind = 'duplicates')
UNION SELECT 'target', kind, dst FROM p WHERE kind = 'enabler-for' AND dst NOT IN (SELECT id FROM t WHERE type = 'story')""")
def link_faults(spark, d):
    """Links and parents that break what their kind allows; every third customer writes the link from its other end."""
    checkpoint_folder(spark)
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    tickets = customers.selectExpr("c_custkey AS id", "CASE WHEN c_nationkey % 3 = 0 THEN 'story' ELSE 'task' END AS type", f"{PARENT} AS parent")
    at = "cast(floor(c_custkey / 20) % 8 as int) + 1"
    names = lambda listed: f"element_at(array({listed[1:-1]}), {at})"
    written = customers.selectExpr(LINKED.split(", ", 1)[0], LINKED.split(", ", 1)[1], "c_custkey % 3 = 0 AS turned", f"{names(KINDS)} AS ahead", f"{names(BACK)} AS back")
    links = written.selectExpr("if(turned, other, one) AS src", "if(turned, back, ahead) AS kind", "if(turned, one, other) AS dst")
    return ledger.faults(links, tickets)


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT user_id, arg_max(CASE WHEN event_type = 'view' THEN epoch_us(ts) ELSE 0 END, struct_pack(ts, event_id)) AS until FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id),
c AS (SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 AS mid FROM events) SELECT user_id FROM u LEFT JOIN e USING (user_id), c WHERE until IS NULL OR until <= mid""")
def inbox_snooze(spark, d):
    """Users whose latest triage is not a snooze beyond the middle of the log."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts", F.expr(MICROS).alias("us"))
    low, high = events.agg(F.min("us"), F.max("us")).first()
    triage = events.filter("event_type in ('view', 'click')").withColumn("until", F.when(F.col("event_type") == "view", F.col("us")).otherwise(0))
    return ledger.inbox(events.select("user_id").distinct(), triage, "user_id", ["ts", "event_id"], F.lit((low or 0) + ((high or 0) - (low or 0)) // 2))


@query("""WITH e AS (SELECT user_id, event_type, arg_max(value > 50, struct_pack(ts, event_id)) AS pass FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (pass) AS passing, count(*) FILTER (NOT pass) AS failing FROM e GROUP BY user_id""")
def latest_evidence(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value").filter("value is not null")
    last = ledger.latest_evidence(events.withColumn("pass", F.col("value") > 50), ["user_id", "event_type"], ["ts", "event_id"], "pass")
    return last.groupBy("user_id").agg(F.count_if("pass").alias("passing"), F.count_if(~F.col("pass")).alias("failing"))


@query("""WITH i AS (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS id FROM part), s AS (SELECT p_partkey, n, right(id, n) AS h FROM i, range(2, 33) r(n)), c AS (SELECT h FROM s GROUP BY h HAVING count(*) = 1)
SELECT p_partkey, arg_min(h, n) AS handle FROM s JOIN c USING (h) GROUP BY p_partkey""")
def unique_suffix_handles(spark, d):
    ids = table(spark, d, "part").select("p_partkey", F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("id"))
    return ledger.handles(ids, "id", 2).select("p_partkey", "handle")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), r AS (SELECT l_suppkey AS src, l_partkey AS dst, max(CASE l_returnflag WHEN 'N' THEN 2 ELSE 1 END) AS t FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
SELECT src, dst, CAST(coalesce(t, CASE WHEN p_partkey IS NOT NULL THEN 1 ELSE 0 END) AS TINYINT) AS truth FROM a LEFT JOIN r USING (src, dst) LEFT JOIN part ON p_partkey = dst AND p_size > 40""")
def holds_poisoned(spark, d):
    """Does a supplier certainly deliver a part?  Large parts are poisoned."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_returnflag")
    relation = lines.filter("l_returnflag <> 'R'").groupBy("src", "dst").agg(F.max(F.when(F.col("l_returnflag") == "N", 2).otherwise(1)).alias("truth"))
    # Suppliers are numbered apart from parts: a poisoned part poisons only its own side.
    return ledger.holds(lines.select("src", (-1 - F.col("dst")).alias("dst")).distinct(), relation.withColumn("dst", -1 - F.col("dst")), table(spark, d, "part").filter("p_size > 40").select((-1 - F.col("p_partkey")).alias("node"))).withColumn("dst", -1 - F.col("dst"))


SHIFTED = "SELECT p_partkey + 1 AS p_partkey, p_brand, p_type, p_size FROM part"


@query(f"""WITH n AS ({SHIFTED}), j AS (SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, o.p_partkey AS ok, n.p_partkey AS nk, concat_ws(',', CASE WHEN o.p_brand IS DISTINCT FROM n.p_brand THEN 'p_brand' END, CASE WHEN o.p_type IS DISTINCT FROM n.p_type THEN 'p_type' END, CASE WHEN o.p_size IS DISTINCT FROM n.p_size THEN 'p_size' END) AS f FROM part o FULL JOIN n ON o.p_partkey = n.p_partkey)
SELECT p_partkey, CASE WHEN ok IS NULL THEN 'Added' WHEN nk IS NULL THEN 'Removed' ELSE 'Changed' END AS change, CASE WHEN ok IS NULL OR nk IS NULL THEN '' ELSE f END AS facets FROM j WHERE ok IS NULL OR nk IS NULL OR f <> ''""")
def drift_facets(spark, d):
    """Facets of each part that differ from those of the part before it."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return diffs.facet_changes(part, part.withColumn("p_partkey", F.col("p_partkey") + 1), "p_partkey", ["p_brand", "p_type", "p_size"]).withColumn("facets", F.array_join("facets", ","))


@query("""SELECT a.p_partkey, CASE WHEN a.p_brand = b.p_brand AND a.p_size = b.p_size THEN 'Unchanged' WHEN a.p_brand = b.p_brand THEN 'Modified' WHEN a.p_size = b.p_size THEN 'Renamed' ELSE 'Unrelated' END AS delta FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def identity_delta(spark, d):
    part = table(spark, d, "part")
    a, b = part.select("p_partkey", "p_brand", "p_size"), part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("b_brand"), F.col("p_size").alias("b_size"))
    return a.join(b, "p_partkey").select("p_partkey", diffs.identity_delta(F.col("p_brand"), F.col("p_size"), F.col("b_brand"), F.col("b_size")).alias("delta"))


@query("""SELECT a.p_partkey, CAST(CASE WHEN a.p_size > 45 THEN 1 WHEN b.p_partkey IS NULL OR a.p_brand <> b.p_brand OR a.p_type <> b.p_type THEN 2 ELSE 0 END AS TINYINT) AS truth FROM part a LEFT JOIN part b ON b.p_partkey + 1 = a.p_partkey""")
def touched_symbols(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return diffs.touched(part.withColumn("p_partkey", F.col("p_partkey") + 1), part, "p_partkey", ["p_brand", "p_type"], F.col("p_size") <= 45)


@query("SELECT doc_id FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM documents WHERE lang = 'en')")
def memo_misses(spark, d):
    """Documents whose text no English document has answered already."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return diffs.misses(docs, docs.filter("lang = 'en'"), ["digest"]).select("doc_id")


PATTERNS = ("data/*/src1", "data/{en,de}/**", "data/fr/src?", "**/src[2-4]")


@query("""WITH p AS (SELECT 'data/' || lang || '/' || source AS path FROM documents), g(pattern, re) AS (VALUES ('data/*/src1', '^data/[^/]*/src1$'), ('data/{en,de}/**', '^data/(en|de)/.*$'), ('data/fr/src?', '^data/fr/src[^/]$'), ('**/src[2-4]', '^(.*/)?src[2-4]$'))
SELECT pattern, count(*) AS n FROM p JOIN g ON regexp_matches(path, re) GROUP BY pattern""")
def glob_theta_join(spark, d):
    """Paths under each pattern; the patterns are compiled once and travel in the plan."""
    path = F.concat(F.lit("data/"), "lang", F.lit("/"), "source")
    hits = F.filter(F.array(*(F.when(path.rlike(X.glob_pattern(p)), F.lit(p)) for p in PATTERNS)), lambda x: x.isNotNull())
    return table(spark, d, "documents").select(F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size || 'px' WHEN 1 THEN p_size || '.5rem' WHEN 2 THEN '0' WHEN 3 THEN p_size || '%' WHEN 4 THEN 'auto' ELSE 'x' || p_size END AS v, p_size FROM part)
SELECT p_partkey, CASE p_size % 6 WHEN 3 THEN 'percent' WHEN 4 THEN 'auto' WHEN 2 THEN 'zero' WHEN 0 THEN 'px' WHEN 1 THEN 'rem' ELSE 'other' END AS kind, CASE p_size % 6 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN (p_size + 0.5) * 16.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE END AS px FROM s""")
def css_length(spark, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 6 == 0, F.concat(size, F.lit("px"))).when(F.col("p_size") % 6 == 1, F.concat(size, F.lit(".5rem"))).when(F.col("p_size") % 6 == 2, "0").when(F.col("p_size") % 6 == 3, F.concat(size, F.lit("%"))).when(F.col("p_size") % 6 == 4, "auto").otherwise(F.concat(F.lit("x"), size))
    return table(spark, d, "part").select("p_partkey", X.css_length(text).alias("l")).select("p_partkey", "l.kind", "l.px")


@query("SELECT p_partkey, [p_size // 10, p_size % 10, p_partkey % 7] >= [2, 5, 0] AS new_enough FROM part")
def version_compare(spark, d):
    version = F.concat_ws(".", F.floor(F.col("p_size") / 10), F.col("p_size") % 10, F.col("p_partkey") % 7)
    return table(spark, d, "part").select("p_partkey", (X.version_key(version) >= X.version_key(F.lit("2.5"))).alias("new_enough"))
