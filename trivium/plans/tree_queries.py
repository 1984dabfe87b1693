"""Registered queries of tree and scope operators over nodes made of the parts table, with their SQL.

Expressions that both engines read alike are written once and stand in the
query and in its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivium.operators import scopes, tree
from trivium.plans.registry import query
from trivium.sources import table

#: Trees of 121 parts, three children a node and five levels; part k of a tree has the children 3k+1 to 3k+3.
BASE = "p_partkey AS node_id, CAST(floor(p_partkey / 121) AS BIGINT) AS artifact, p_partkey % 121 AS k, p_size AS size, p_brand AS brand"
DEPTH = "CASE WHEN k < 1 THEN 0 WHEN k < 4 THEN 1 WHEN k < 13 THEN 2 WHEN k < 40 THEN 3 ELSE 4 END"
FIRST = "CASE WHEN k < 1 THEN 0 WHEN k < 4 THEN 1 WHEN k < 13 THEN 4 WHEN k < 40 THEN 13 ELSE 40 END"
WIDTH = "CASE WHEN k < 1 THEN 810 WHEN k < 4 THEN 270 WHEN k < 13 THEN 90 WHEN k < 40 THEN 30 ELSE 10 END"
OP = "CASE WHEN k = 0 THEN 'group' WHEN size % 7 = 0 THEN 'opaque' WHEN size % 5 = 0 THEN 'unit' WHEN size % 5 = 1 THEN 'bind' WHEN k >= 40 AND size % 2 = 0 THEN 'ref' WHEN k >= 40 THEN 'literal' ELSE 'apply' END"
COLUMNS = (
    "artifact", "node_id", "CASE WHEN k > 0 THEN artifact * 121 + CAST(floor((k - 1) / 3) AS BIGINT) END AS parent_id", f"{OP} AS op", "concat('n', CAST(size % 9 AS STRING)) AS name",
    f"(k - ({FIRST})) * ({WIDTH}) AS \"start\"", f"(k - ({FIRST}) + 1) * ({WIDTH}) - 1 AS \"end\"", f"{DEPTH} AS depth", "size", "brand",
)
NODES = f"b AS (SELECT {BASE} FROM part), n AS (SELECT {', '.join(COLUMNS)} FROM b)"
#: Pairs of a node and one above it.
ABOVE = f"{NODES}, a AS (SELECT i.*, o.node_id AS above, o.op AS above_op, o.name AS above_name, o.depth AS above_depth FROM n i JOIN n o ON o.artifact = i.artifact AND o.\"start\" <= i.\"start\" AND i.\"end\" <= o.\"end\" AND o.depth < i.depth)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*BASE.split(", ")).selectExpr(*(c.replace('"', "`") for c in COLUMNS))


@query(f"WITH {NODES} SELECT parent_id AS src, node_id AS dst, CAST(2 AS TINYINT) AS truth FROM n WHERE parent_id IS NOT NULL")
def tree_children(spark, d):
    return tree.children(nodes(spark, d))


@query(f"""WITH {NODES} SELECT node_id, CASE WHEN parent_id IS NOT NULL THEN lag(node_id) OVER w END AS before, CASE WHEN parent_id IS NOT NULL THEN lead(node_id) OVER w END AS after
FROM n WINDOW w AS (PARTITION BY artifact, parent_id ORDER BY "start", node_id)""")
def tree_siblings(spark, d):
    return tree.siblings(nodes(spark, d)).select("node_id", "before", "after")


@query(f"WITH {ABOVE} SELECT above, node_id, depth - above_depth AS distance FROM a")
def tree_descendants(spark, d):
    n = nodes(spark, d)
    return tree.ancestry(n, n).select("above", "node_id", (F.col("depth") - F.col("above_depth")).alias("distance"))


@query(f"WITH {ABOVE}, q AS (SELECT node_id, node_id % 40 AS above FROM n) SELECT q.above, q.node_id, a.above IS NOT NULL AS holds FROM q LEFT JOIN a ON a.above = q.above AND a.node_id = q.node_id")
def tree_is_ancestor(spark, d):
    n = nodes(spark, d)
    return tree.is_ancestor(n.select((F.col("node_id") % 40).alias("above"), "node_id"), n)


@query(f"WITH {ABOVE} SELECT n.node_id, arg_max(a.above, a.above_depth) AS unit FROM n LEFT JOIN a ON a.node_id = n.node_id AND a.above_op = 'unit' GROUP BY n.node_id")
def tree_enclosing_unit(spark, d):
    n = nodes(spark, d)
    return tree.enclosing(n, n.filter("op = 'unit'")).select("node_id", "unit")


POINTS = ("o_orderkey AS point", "CAST(floor(o_custkey / 121) AS BIGINT) AS artifact", "o_orderkey % 900 AS place")


@query(f"WITH {NODES}, q AS (SELECT {', '.join(POINTS)} FROM orders) SELECT point, arg_max(node_id, depth) AS node_id FROM q LEFT JOIN n ON n.artifact = q.artifact AND n.\"start\" <= place AND place <= n.\"end\" GROUP BY point")
def tree_node_at(spark, d):
    """The deepest node at a place, null beyond the last one."""
    points = table(spark, d, "orders").selectExpr(*POINTS)
    return tree.node_at(points, nodes(spark, d), "point", "place").select("point", "node_id")


@query(f"WITH {ABOVE} SELECT n.node_id, coalesce(string_agg(a.above_name, ',' ORDER BY a.above_depth DESC), '') AS binders FROM n LEFT JOIN a ON a.node_id = n.node_id AND a.above_op = 'bind' WHERE n.op = 'ref' GROUP BY n.node_id")
def binders_in_scope(spark, d):
    n = nodes(spark, d)
    return tree.binders_in_scope(n.filter("op = 'ref'"), n.filter("op = 'bind'")).withColumn("binders", F.array_join("binders", ","))


@query(f"""WITH {ABOVE} SELECT DISTINCT u.above AS unit, u.name FROM a u WHERE u.op = 'ref' AND u.above_op = 'unit'
AND NOT EXISTS (SELECT 1 FROM a x WHERE x.node_id = u.node_id AND x.above_op = 'bind' AND x.above_name = u.name AND x.above_depth > u.above_depth)""")
def free_variables(spark, d):
    n = nodes(spark, d)
    return tree.free_variables(n.filter("op = 'unit'"), n.filter("op = 'ref'"), n.filter("op = 'bind'"))


NODE_STATUS = "CASE WHEN size % 13 = 0 THEN 1 WHEN size % 17 = 0 THEN 0 ELSE 2 END"


@query(f"WITH {ABOVE}, s AS (SELECT node_id, {NODE_STATUS} AS s FROM n) SELECT s.node_id, CAST(least(min(s.s), coalesce(min(o.s), 2)) AS TINYINT) AS status FROM s LEFT JOIN a ON a.node_id = s.node_id LEFT JOIN s o ON o.node_id = a.above GROUP BY s.node_id")
def containment_status(spark, d):
    return tree.chain_status(nodes(spark, d).withColumn("status", F.expr(NODE_STATUS)))


@query(f"""WITH {ABOVE} SELECT u.node_id, count(*) FILTER (a.op = 'literal') AS literals, count(*) FILTER (a.op = 'ref') AS uses, count(*) FILTER (a.op = 'opaque') AS opaque FROM n u LEFT JOIN a ON a.above = u.node_id WHERE u.op = 'unit' GROUP BY u.node_id""")
def unit_contents(spark, d):
    """Literals, uses of names and opaque regions under each unit."""
    n = nodes(spark, d)
    kinds = {"literals": F.col("op") == "literal", "uses": F.col("op") == "ref", "opaque": F.col("op") == "opaque"}
    return tree.contents(n.filter("op = 'unit'"), n, kinds).select("node_id", *kinds)


@query(f"WITH {ABOVE} SELECT above AS node_id, string_agg(DISTINCT name, ',' ORDER BY name) AS reasons FROM a WHERE op = 'opaque' AND above_op = 'unit' GROUP BY above")
def unseen_reasons(spark, d):
    n = nodes(spark, d)
    return tree.unseen_reasons(n.filter("op = 'unit'"), n).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {ABOVE}, s AS (SELECT u.node_id AS root, x.node_id, x."start", x.depth, x.depth - u.depth AS rel, x.op, x.name FROM n u JOIN n x ON x.artifact = u.artifact AND u."start" <= x."start" AND x."end" <= u."end" AND (u.depth < x.depth OR u.node_id = x.node_id) WHERE u.op = 'unit'),
f AS (SELECT root, name, min(struct_pack("start", depth, node_id)) AS first FROM s WHERE op = 'bind' GROUP BY root, name), bd AS (SELECT root, name, row_number() OVER (PARTITION BY root ORDER BY first) AS i FROM f)
SELECT s.root AS node_id, sha256(string_agg(s.op || ':' || s.rel || ':' || CASE WHEN i IS NULL THEN s.name ELSE '#' || i END, chr(10) ORDER BY s."start", s.depth, s.node_id)) AS digest FROM s LEFT JOIN bd ON bd.root = s.root AND bd.name = s.name GROUP BY s.root""")
def unit_digests(spark, d):
    """Digests of units that the names of their own binders do not change."""
    n = nodes(spark, d)
    return tree.subtree_digests(n.filter("op = 'unit'"), n)


PARTS = ("brand AS symref", "node_id % 7 AS place", "node_id", "CASE WHEN size % 50 = 0 THEN NULL ELSE concat('d', CAST(size AS STRING)) END AS digest")


@query(f"""WITH {NODES}, p AS (SELECT {', '.join(PARTS)} FROM n WHERE op = 'unit'), w AS (SELECT symref, count(*) AS c, count(*) FILTER (digest IS NULL) AS h, string_agg(digest, '' ORDER BY place, node_id) AS j FROM p GROUP BY symref), q AS (SELECT DISTINCT brand AS symref FROM n UNION SELECT 'nowhere')
SELECT symref, CASE WHEN c IS NULL THEN 'Absent' WHEN h > 0 THEN 'Unknown' ELSE 'Known' END AS kind, CASE WHEN h = 0 THEN CASE WHEN c = 1 THEN j ELSE sha256(j) END END AS digest, CAST(coalesce(c, 0) AS INT) AS parts FROM q LEFT JOIN w USING (symref)""")
def identity_digests(spark, d):
    """Parts of one name as one identity, with its digest."""
    n = nodes(spark, d)
    asked = n.select(F.col("brand").alias("symref")).unionByName(spark.range(1).select(F.lit("nowhere").alias("symref")))
    return tree.identities(n.filter("op = 'unit'").selectExpr(*PARTS), asked)


@query(f"WITH {NODES} SELECT node_id, CAST(CASE WHEN op = 'opaque' THEN 1 WHEN op = 'unit' THEN 2 ELSE 0 END AS TINYINT) AS truth FROM n")
def op_is_unit(spark, d):
    return nodes(spark, d).select("node_id", tree.op_is(F.col("op"), F.col("op") == "unit").alias("truth"))


@query(f"WITH {NODES} SELECT artifact, node_id, row_number() OVER (PARTITION BY artifact ORDER BY \"start\", \"end\" DESC, depth, node_id) AS place FROM n")
def nodes_in_order(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("artifact").orderBy("start", F.desc("end"), "depth", "node_id"))
    return tree.in_order(nodes(spark, d).select("artifact", "node_id", "start", "end", "depth").withColumn("place", place)).select("artifact", "node_id", "place")


#: Scopes are groups, units and binders; a unit is declared in the scope around it, a binder's name in its own; every twentieth edge is only possible.
IS_SCOPE = "op IN ('group', 'unit', 'bind')"
EDGE_STATUS = "CASE WHEN size % 20 = 5 THEN 1 ELSE 2 END"
RESOLVED = f"""{ABOVE}, sc AS (SELECT node_id, artifact, op, name, depth, size FROM n WHERE {IS_SCOPE}),
up AS (SELECT i.node_id, arg_max(i.above, i.above_depth) AS scope FROM a i WHERE i.above_op IN ('group', 'unit', 'bind') GROUP BY i.node_id),
dl AS (SELECT up.scope, n.name, n.node_id AS decl FROM n JOIN up USING (node_id) WHERE n.op = 'unit' UNION ALL SELECT node_id, name, node_id FROM n WHERE op = 'bind'),
ch AS (SELECT r.node_id AS ref, r.name, s.node_id AS scope, s.depth, s.size FROM n r JOIN a ON a.node_id = r.node_id JOIN sc s ON s.node_id = a.above WHERE r.op = 'ref'),
ps AS (SELECT *, coalesce(min({EDGE_STATUS}) OVER (PARTITION BY ref ORDER BY depth DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS path FROM ch),
hit AS (SELECT ps.ref, ps.depth, ps.path, dl.decl FROM ps JOIN dl ON dl.scope = ps.scope AND dl.name = ps.name),
nearest AS (SELECT ref, max(depth) FILTER (path = 2) AS stop FROM hit GROUP BY ref),
hinted AS (SELECT ps.ref, max(ps.depth) AS top, bool_or(ps.size % 3 = 0 AND ps.depth >= coalesce(stop, -1)) AS weak FROM ps LEFT JOIN nearest USING (ref) GROUP BY ps.ref),
res AS (SELECT hit.ref, string_agg(DISTINCT CAST(decl AS VARCHAR), ',' ORDER BY CAST(decl AS VARCHAR)) AS decls, count(DISTINCT decl) AS c, min(path) AS p FROM hit JOIN nearest USING (ref) WHERE hit.depth >= coalesce(stop, -1) GROUP BY hit.ref),
rs AS (SELECT r.node_id AS ref, CASE WHEN c IS NULL THEN 'Unknown' WHEN c = 1 AND p = 2 AND NOT weak THEN 'Must' ELSE 'May' END AS status, coalesce(res.decls, '') AS decls FROM n r LEFT JOIN res ON res.ref = r.node_id LEFT JOIN hinted ON hinted.ref = r.node_id WHERE r.op = 'ref')"""


def resolution(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    inside = n.filter(IS_SCOPE)
    up = tree.enclosing(n, inside, "scope").filter("scope is not null").select("artifact", "node_id", "scope", "op", "name", "size")
    edges = up.filter(IS_SCOPE).select("artifact", F.col("node_id").alias("scope"), F.lit(0).alias("label"), F.col("scope").alias("target"), F.expr(EDGE_STATUS).alias("status"))
    own = lambda rows, scope: rows.select("artifact", F.col(scope).alias("scope"), "name", F.col("node_id").alias("decl"), F.lit(2).alias("status"))
    decls = own(up.filter("op = 'unit'"), "scope").unionByName(own(n.filter("op = 'bind'"), "node_id"))
    hints = inside.filter("size % 3 = 0").select("artifact", F.col("node_id").alias("scope"), F.lit(None).cast("array<string>").alias("names"))
    return scopes.resolve(up.filter("op = 'ref'").select("artifact", F.col("node_id").alias("ref"), "name", "scope"), edges, decls, hints)


@query(f"WITH {RESOLVED} SELECT ref, status, decls FROM rs")
def scope_resolution(spark, d):
    """What each reference means: the nearest certain declaration, or all that are possible."""
    return resolution(spark, d).select("ref", "status", F.array_join(F.array_sort(F.transform("decls", lambda x: x.cast("string"))), ",").alias("decls"))


@query(f"""WITH {RESOLVED}, e AS (SELECT ref, status, unnest(string_split(decls, ',')) AS decl FROM rs WHERE status <> 'Unknown')
SELECT ref AS src, CAST(decl AS BIGINT) AS dst, CAST(CASE status WHEN 'Must' THEN 2 ELSE 1 END AS TINYINT) AS truth FROM e""")
def rel_resolves(spark, d):
    return tree.resolves(resolution(spark, d).withColumnRenamed("ref", "src"))[0]


@query(f"""WITH {RESOLVED}, q AS (SELECT ref AS src, ref % 300 AS dst FROM rs)
SELECT src, dst, CAST(CASE WHEN status = 'Unknown' THEN 1 WHEN NOT list_contains(string_split(decls, ','), CAST(dst AS VARCHAR)) THEN 0 WHEN status = 'Must' THEN 2 ELSE 1 END AS TINYINT) AS truth FROM q JOIN rs ON rs.ref = q.src""")
def resolves_to(spark, d):
    r = resolution(spark, d).withColumnRenamed("ref", "src").persist()
    return tree.resolves_to(r.select("src", (F.col("src") % 300).alias("dst")), r)


@query(f"""WITH {RESOLVED}, h AS (SELECT parent_id, arg_min(node_id, "start") AS head, arg_min(op, "start") AS hop FROM n WHERE parent_id IS NOT NULL GROUP BY parent_id),
u AS (SELECT node_id, arg_max(above, above_depth) AS unit FROM a WHERE above_op = 'unit' GROUP BY node_id),
e AS (SELECT ref, status, CAST(unnest(string_split(decls, ',')) AS BIGINT) AS decl FROM rs WHERE status <> 'Unknown')
SELECT u.unit AS src, e.decl AS dst, CAST(max(CASE status WHEN 'Must' THEN 2 ELSE 1 END) AS TINYINT) AS truth FROM n JOIN h ON h.parent_id = n.node_id AND hop = 'ref' JOIN u ON u.node_id = n.node_id JOIN e ON e.ref = h.head JOIN n t ON t.node_id = e.decl AND t.op = 'unit' WHERE n.op = 'apply' GROUP BY 1, 2""")
def rel_calls(spark, d):
    return tree.calls(nodes(spark, d), resolution(spark, d).withColumnRenamed("ref", "src"))


@query(f"""WITH {ABOVE}, seen AS (SELECT node_id AS scope FROM n WHERE {IS_SCOPE} AND size % 3 = 0 UNION SELECT above FROM a WHERE {IS_SCOPE} AND size % 3 = 0 AND above_op IN ('group', 'unit', 'bind'))
SELECT node_id AS decl, CAST(CASE WHEN node_id IN (SELECT scope FROM seen) THEN 1 ELSE 0 END AS TINYINT) AS truth FROM n WHERE op = 'bind'""")
def read_by_opaque(spark, d):
    inside = nodes(spark, d).filter(IS_SCOPE).withColumn("scope", F.col("node_id"))
    return scopes.read_by_opaque(inside.filter("op = 'bind'").select("artifact", "scope", F.col("node_id").alias("decl")), inside.select("artifact", "scope", "start", "end"), inside.filter("size % 3 = 0").select("artifact", "scope"))
