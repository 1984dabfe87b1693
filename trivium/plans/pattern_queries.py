"""Registered queries of tree patterns, subtree digests, imports, pattern tables, memos, versions and the streaming log, with their SQL.

Expressions that both engines read alike are written once and stand in the query and in its SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivium.operators import certain, exports, facets, globs, memo, snapshots, twigs
from trivium.plans import rule_plans, rulelang
from trivium.plans.registry import query
from trivium.plans.tree_queries import ABOVE, NODES, nodes
from trivium.sources import checkpoint_folder, table
from trivium.streaming import fold

# Digests and patterns over the trees of the parts table

#: Preorder places, the innermost binder of each use, and what stands in each unit's subtree.
PRINTED = f"""{ABOVE}, o AS (SELECT n.*, row_number() OVER (PARTITION BY artifact ORDER BY "start", "end" DESC, depth, node_id) AS pre FROM n),
nb AS (SELECT node_id, arg_max(above, above_depth) AS binder FROM a WHERE op = 'ref' AND above_op = 'bind' AND above_name = name GROUP BY node_id),
s AS (SELECT u.node_id AS root, x.pre, x.op, x.depth - u.depth AS rel, x.name, b.pre - u.pre AS bound, x.pre - b.pre AS far FROM o u JOIN o x ON x.artifact = u.artifact AND u."start" <= x."start" AND x."end" <= u."end" AND (u.depth < x.depth OR u.node_id = x.node_id)
LEFT JOIN nb ON nb.node_id = x.node_id LEFT JOIN o b ON b.node_id = nb.binder),
pr AS (SELECT root, count(*) AS size, string_agg(op || ':' || rel || ':' || CASE WHEN op = 'bind' THEN '' WHEN bound >= 0 THEN '#' || far ELSE '=' || name END, ',' ORDER BY pre) AS text FROM s GROUP BY root)"""


@query(f"WITH {PRINTED} SELECT root AS node_id, size, min(root) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS copies FROM pr")
def alike_subtrees(spark, d):
    """Every subtree with its size, the first that is the same but for names it binds itself, and how many are."""
    rows = facets.digests(nodes(spark, d))
    same = rows.groupBy("digest").agg(F.min("node_id").alias("first"), F.count("*").alias("copies"))
    return rows.join(same, "digest").select("node_id", "size", "first", "copies")


KIDS = f'{NODES}, c AS (SELECT *, row_number() OVER (PARTITION BY artifact, parent_id ORDER BY "start", node_id) AS ix, count(*) OVER (PARTITION BY artifact, parent_id) AS kids FROM n WHERE parent_id IS NOT NULL)'


@query(f"WITH {KIDS} SELECT n.artifact, n.node_id AS root, a.node_id AS \"A\", r.node_id AS \"R\", n.node_id AS \"REST_of\", r.ix + 1 AS \"REST_from\", r.kids AS \"REST_to\" FROM n JOIN c a ON a.parent_id = n.node_id JOIN c r ON r.parent_id = n.node_id AND r.ix > a.ix WHERE n.op = 'apply' AND r.op = 'ref' AND a.op = 'literal'")
def pattern_stretches(spark, d):
    """Applications with a literal and, anywhere behind it, a reference: all ways."""
    return twigs.match(nodes(spark, d), "apply($$$, $A:literal, $$$, $R:ref, $$$REST)")


@query(f"""WITH {PRINTED}, c AS (SELECT *, row_number() OVER (PARTITION BY artifact, parent_id ORDER BY "start", node_id) AS ix, count(*) OVER (PARTITION BY artifact, parent_id) AS kids FROM n WHERE parent_id IS NOT NULL)
SELECT n.artifact, n.node_id AS root, n.node_id AS "F", a.node_id AS "X" FROM n JOIN c a ON a.parent_id = n.node_id AND a.ix = 1 JOIN c b ON b.parent_id = n.node_id AND b.ix = b.kids AND b.kids > 1 JOIN pr p ON p.root = a.node_id JOIN pr q ON q.root = b.node_id WHERE p.text = q.text""")
def pattern_repeats(spark, d):
    """Nodes whose first and last child are the same tree."""
    return twigs.match(nodes(spark, d), "$F($X, $$$, $X)")


@query(f"WITH {ABOVE} SELECT a.artifact, a.above AS root, a.node_id AS \"D\", k.node_id AS \"K\" FROM a JOIN n k ON k.parent_id = a.node_id WHERE a.above_op = 'unit' AND a.op = 'bind' AND k.op = 'ref' AND k.name = 'n3'")
def pattern_below(spark, d):
    """Units with a binder somewhere below that has a reference to n3 right under it."""
    return twigs.match(nodes(spark, d), 'unit(..$D:bind($$$, $K:ref "n3", $$$))')


UNSEEN_KIDS = f"{ABOVE}, h AS (SELECT parent_id AS node_id, bool_or(op = 'ref') AS sure, bool_or(op = 'opaque') AS may FROM n WHERE parent_id IS NOT NULL GROUP BY parent_id)"


@query(f"WITH {UNSEEN_KIDS} SELECT n.artifact, n.node_id, CAST(CASE WHEN n.op = 'opaque' THEN 1 WHEN n.op <> 'apply' THEN 0 WHEN sure THEN 2 WHEN may THEN 1 ELSE 0 END AS TINYINT) AS truth FROM n LEFT JOIN h USING (node_id)")
def pattern_truth(spark, d):
    """Does a node apply something to a reference?  Unknown where an unseen node may be one."""
    return twigs.matches(nodes(spark, d), "apply($$$, ref, $$$)")


RULES = """
rule TRE101 "applied-to-a-name" {
  find c: call
  where c is roles`apply($$$, ref, $$$)`
  report c "applied"
}
rule TRE102 "literal-beside-a-call" {
  find n: literal
  find c: call where n adjoins c
  report n "beside {c.id}"
}
rule TRE103 "call-of-a-literal" {
  find c: `apply($A:literal, $$$)`
  where c.name == "n3"
  report c "{c.A}"
}
"""


def _tree_verdicts(spark: SparkSession, d: str, rule: str) -> DataFrame:
    n = nodes(spark, d)
    of = lambda op: n.filter(F.col("op") == op).select(F.col("node_id").alias("id"), F.col("artifact").alias("file"), "start", "end", F.col("parent_id").alias("parent"), "name", F.floor(F.col("start") / 30).alias("line"))
    catalog = rule_plans.Catalog({"call": of("apply"), "literal": of("literal")}, nodes=n)
    found = next(r for r in rulelang.parse(RULES) if r.id == rule)
    return rule_plans.evaluate(found, catalog).drop("reason")


@query(f"""WITH {UNSEEN_KIDS} SELECT 'TRE101' AS rule, 'warn' AS severity, CAST(node_id AS VARCHAR) AS subject, CASE WHEN sure THEN 'Violation' WHEN may THEN 'Unresolved' ELSE 'Clean' END AS verdict, 'applied' AS message FROM n LEFT JOIN h USING (node_id) WHERE op = 'apply'""")
def grl_snippet_condition(spark, d):
    return _tree_verdicts(spark, d, "TRE101")


@query(f"""WITH {NODES}, p AS (SELECT *, floor("start" / 30) AS line FROM n) SELECT 'TRE102' AS rule, 'warn' AS severity, CAST(a.node_id AS VARCHAR) AS subject, 'Violation' AS verdict, 'beside ' || c.node_id AS message
FROM p a JOIN p c ON c.artifact = a.artifact AND c.line - a.line BETWEEN 0 AND 1 WHERE a.op = 'literal' AND c.op = 'apply'""")
def grl_adjoins_links(spark, d):
    """A binding that nothing but the neighbourhood of two lines links."""
    return _tree_verdicts(spark, d, "TRE102")


@query(f"""WITH {KIDS} SELECT 'TRE103' AS rule, 'warn' AS severity, CAST(n.node_id AS VARCHAR) AS subject, CASE WHEN n.name = 'n3' THEN 'Violation' ELSE 'Clean' END AS verdict, CAST(c.node_id AS VARCHAR) AS message
FROM n JOIN c ON c.parent_id = n.node_id AND c.ix = 1 WHERE n.op = 'apply' AND c.op = 'literal'""")
def grl_snippet_source(spark, d):
    return _tree_verdicts(spark, d, "TRE103")


# Imports: modules of ten entries each with the names n1 to n50, made of the parts table; twenty modules refer to one another

BLOCK = "CAST(floor(p_partkey / 200) AS BIGINT) * 20"

KIND = "CASE p_size % 10 WHEN 5 THEN 'module' WHEN 6 THEN 'module' WHEN 7 THEN 'alias' WHEN 8 THEN 'alias' WHEN 9 THEN 'glob' ELSE 'decl' END"
SEEK = "CASE WHEN p_size % 10 = 9 AND p_partkey % 3 > 0 THEN '' WHEN p_size % 10 IN (7, 9) THEN concat('n', CAST(p_partkey % 50 + 1 AS STRING)) WHEN p_size % 10 = 8 THEN concat('n', CAST(p_partkey % 50 + 1 AS STRING), '/n', CAST(p_partkey % 49 + 1 AS STRING)) END"
ENTRY = (
    "concat('m', CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS STRING)) AS module", "CASE WHEN p_size % 10 <> 9 THEN concat('n', CAST(p_size AS STRING)) END AS name", f"{KIND} AS kind",
    f"CASE WHEN p_size % 10 IN (5, 6) THEN concat('m', CAST({BLOCK} + (p_partkey * 3) % 20 AS STRING)) WHEN p_size % 10 < 5 THEN concat('s', CAST(p_partkey AS STRING)) END AS target",
    f"CASE WHEN p_size % 10 >= 7 THEN concat('m', CAST({BLOCK} + (p_partkey * 7 + 1) % 20 AS STRING)) END AS start", f"{SEEK} AS seek", "p_size % 3 > 0 AS public", "CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 2 END AS status",
)
ASK = ("p_partkey AS ask", f"concat('m', CAST({BLOCK} + (p_partkey * 11) % 20 AS STRING)) AS module", "CASE WHEN p_partkey % 2 = 0 THEN concat('n', CAST(p_size AS STRING)) ELSE concat('n', CAST(p_size AS STRING), '/n', CAST(p_partkey % 50 + 1 AS STRING)) END AS seek")
#: States of all searches; a glob is asked where no entry of the module has the name.
SEARCH = """e AS MATERIALIZED (SELECT module, name, kind, target, start, CASE WHEN seek = '' THEN [] ELSE string_split(seek, '/') END AS path, public, status FROM er), hd AS MATERIALIZED (SELECT DISTINCT module, name FROM e WHERE kind <> 'glob'),
st(ask, writer, module, path, t) AS (SELECT ask, module, module, string_split(seek, '/'), 2 FROM q UNION
SELECT st.ask, CASE e.kind WHEN 'module' THEN st.writer ELSE e.module END, CASE e.kind WHEN 'module' THEN e.target ELSE e.start END,
CASE e.kind WHEN 'module' THEN st.path[2:] WHEN 'alias' THEN list_concat(e.path, st.path[2:]) ELSE list_concat(e.path, st.path) END, least(st.t, e.status)
FROM st JOIN e ON e.module = st.module AND (e.public OR st.writer = e.module) AND len(st.path) > 0
AND (e.kind = 'module' AND e.name = st.path[1] AND len(st.path) > 1 OR e.kind = 'alias' AND e.name = st.path[1] OR e.kind = 'glob' AND (st.module, st.path[1]) NOT IN (SELECT (module, name) FROM hd))
WHERE len(CASE e.kind WHEN 'module' THEN st.path[2:] WHEN 'alias' THEN list_concat(e.path, st.path[2:]) ELSE list_concat(e.path, st.path) END) <= 5),
en AS (SELECT st.ask, e.target, max(least(st.t, e.status)) AS t FROM st JOIN e ON e.module = st.module AND e.name = st.path[1] AND e.kind IN ('decl', 'module') AND (e.public OR st.writer = e.module) WHERE len(st.path) = 1 GROUP BY ALL)"""


def _facts(rows: str) -> str:
    """SQL for the facts of rows ``w, m, path, q, t``: a path to follow, and then the stack of names that ``q`` stands for."""
    rest = lambda i: f"concat_ws('|', 'S', w, m, array_to_string(path, '/'), {i})"
    return f"""SELECT unnest(CASE WHEN len(path) = 0 THEN [{{kind: 'end', state: q, writer: w, module: m, name: '', nx: '', t: t}}]
ELSE list_concat([{{kind: 'name', state: CASE WHEN len(path) > 1 THEN {rest(1)} ELSE q END, writer: w, module: m, name: path[1], nx: '', t: CASE WHEN len(path) > 1 THEN 2 ELSE t END}}],
list_transform(range(1, len(path)), lambda i: {{kind: 'stack', state: {rest("i")}, writer: '', module: '', name: path[i + 1], nx: CASE WHEN i + 1 < len(path) THEN {rest("i + 1")} ELSE q END, t: CASE WHEN i + 1 < len(path) THEN 2 ELSE t END}})) END, recursive := true) FROM ({rows})"""


#: As SEARCH, for paths of any length: a state is a first name and, by name, the stack below it.
MEANT = f"""{SEARCH[: SEARCH.index("st(ask")]}f(kind, state, writer, module, name, nx, t) USING KEY (kind, state, writer, module, name, nx, t) AS ({_facts("SELECT writer AS w, module AS m, string_split(seek, '/') AS path, concat('F', ask) AS q, 2 AS t FROM q")} UNION
({_facts("""SELECT CASE e.kind WHEN 'module' THEN f.writer ELSE e.module END AS w, CASE e.kind WHEN 'module' THEN e.target ELSE e.start END AS m, CASE e.kind WHEN 'module' THEN [] WHEN 'alias' THEN e.path ELSE list_append(e.path, f.name) END AS path, f.state AS q, least(f.t, e.status) AS t
FROM f JOIN e ON f.kind = 'name' AND e.module = f.module AND (e.public OR f.writer = e.module)
AND (e.kind = 'module' AND e.name = f.name AND f.state NOT LIKE 'F%' OR e.kind = 'alias' AND e.name = f.name OR e.kind = 'glob' AND (f.module, f.name) NOT IN (SELECT (module, name) FROM hd))""")}
UNION ALL SELECT 'name', s.nx, a.writer, a.module, s.name, '', least(a.t, s.t) FROM f a JOIN recurring.f s ON s.state = a.state AND a.kind = 'end' AND s.kind = 'stack'
UNION ALL SELECT 'name', s.nx, a.writer, a.module, s.name, '', least(a.t, s.t) FROM f s JOIN recurring.f a ON s.state = a.state AND a.kind = 'end' AND s.kind = 'stack')),
en AS (SELECT CAST(substr(f.state, 2) AS BIGINT) AS ask, e.target, max(least(f.t, e.status)) AS t FROM f JOIN e ON e.module = f.module AND e.name = f.name AND e.kind IN ('decl', 'module') AND (e.public OR f.writer = e.module) WHERE f.kind = 'name' AND f.state LIKE 'F%' GROUP BY ALL)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr(*ENTRY)
    return rows.withColumn("path", F.when(F.col("seek") == "", F.array().cast("array<string>")).otherwise(F.split("seek", "/"))).drop("seek")


@query(f"""WITH RECURSIVE er AS (SELECT {', '.join(ENTRY)} FROM part), q AS (SELECT {', '.join(ASK)} FROM part), {SEARCH},
r AS (SELECT ask, count(*) AS c, min(t) AS t, string_agg(target, ',' ORDER BY target) AS targets FROM en GROUP BY ask)
SELECT ask, CASE WHEN c IS NULL THEN 'Unknown' WHEN c = 1 AND t = 2 THEN 'Must' ELSE 'May' END AS status, coalesce(targets, '') AS targets FROM q LEFT JOIN r USING (ask)""")
def resolve_import(spark, d):
    """What paths of one or two names mean from a module, through modules, renamings and globs."""
    checkpoint_folder(spark)
    asks = table(spark, d, "part").selectExpr(*ASK).select("ask", "module", F.split("seek", "/").alias("path"))
    return exports.resolve_imports(asks, entries(spark, d), 5).withColumn("targets", F.array_join("targets", ","))


@query(f"""WITH RECURSIVE er AS (SELECT {', '.join(ENTRY)} FROM part), pu AS (SELECT row_number() OVER () AS ask, * FROM er WHERE public), q AS (SELECT ask, start AS module, seek, module AS writer FROM pu WHERE kind IN ('alias', 'glob') AND seek <> ''),
{MEANT}, md AS (SELECT DISTINCT target FROM er WHERE kind = 'module'),
nm AS (SELECT module, name, target, status AS t FROM pu WHERE kind IN ('decl', 'module') UNION ALL SELECT pu.module, pu.name, en.target, least(en.t, pu.status) FROM pu JOIN en USING (ask) WHERE kind = 'alias'),
fl AS (SELECT pu.module AS into_, en.target AS module, max(least(en.t, pu.status)) AS t FROM pu JOIN en USING (ask) WHERE kind = 'glob' AND en.target LIKE 'm%' GROUP BY ALL UNION ALL SELECT module, start, max(status) FROM pu WHERE kind = 'glob' AND seek = '' GROUP BY ALL),
al(module, name, target, t) AS (SELECT * FROM nm UNION SELECT fl.into_, al.name, al.target, least(al.t, fl.t) FROM al JOIN fl ON fl.module = al.module WHERE (fl.into_, al.name) NOT IN (SELECT (module, name) FROM hd)),
rc(root, module, t) AS (SELECT DISTINCT module, module, 2 FROM er UNION SELECT rc.root, al.target, least(rc.t, al.t) FROM rc JOIN al ON al.module = rc.module WHERE al.target LIKE 'm%')
SELECT root, al.target, CAST(max(least(rc.t, al.t)) AS TINYINT) AS truth FROM rc JOIN al ON al.module = rc.module GROUP BY ALL""")
def public_api(spark, d):
    """All that each module makes public, taken as a root, by their own names and by what they and their public modules re-export."""
    checkpoint_folder(spark)
    rows = entries(spark, d)
    return exports.public_api(rows, rows.select(F.col("module").alias("root")).distinct())


# Pattern tables

PATH = "concat('data/', coalesce(lang, 'und'), '/', source, '/', CAST(doc_id % 100 AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.md' END)"
GLOB = "CASE p_size % 5 WHEN 0 THEN concat('data/en/src', CAST(p_partkey % 25 AS STRING), '/**') WHEN 1 THEN concat('**/', CAST(p_partkey % 100 AS STRING), '.txt') WHEN 2 THEN concat('data/{en,d{e,a}}/src', CAST(p_partkey % 25 AS STRING), '/*.md') WHEN 3 THEN concat('data/*/src', CAST(p_partkey % 25 AS STRING), '/', CAST(p_partkey % 100 AS STRING), '.*') ELSE concat('data,x/{en,fr}/src', CAST(p_partkey % 25 AS STRING), '/*') END"
RE = "CASE p_size % 5 WHEN 0 THEN '^data/en/src' || p_partkey % 25 || '/.*$' WHEN 1 THEN '^(.*/)?' || p_partkey % 100 || '[.]txt$' WHEN 2 THEN '^data/(en|de|da)/src' || p_partkey % 25 || '/[^/]*[.]md$' WHEN 3 THEN '^data/[^/]*/src' || p_partkey % 25 || '/' || p_partkey % 100 || '[.][^/]*$' ELSE '^data,x/(en|fr)/src' || p_partkey % 25 || '/[^/]*$' END"
HITS = f"p AS (SELECT DISTINCT {PATH} AS path FROM documents), g AS (SELECT p_partkey AS pattern, p_partkey % 40 AS lease, {RE} AS re FROM part), hit AS (SELECT pattern, lease, path FROM p JOIN g ON regexp_matches(path, re))"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(f"{PATH} AS path").distinct()


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey AS pattern", "p_partkey % 40 AS lease", f"{GLOB} AS glob")


@query(f"WITH {HITS} SELECT pattern, path FROM hit")
def pattern_table_join(spark, d):
    """The files of each pattern of a table, by the patterns' literal parts."""
    return globs.matching(_paths(spark, d), _patterns(spark, d)).select("pattern", "path")


SHARED = "'data/fr/**'"


@query(f"WITH {HITS} SELECT path, string_agg(DISTINCT lease, ',' ORDER BY lease) AS leases FROM hit WHERE path NOT LIKE 'data/fr/%' GROUP BY path HAVING count(DISTINCT lease) > 1")
def lease_contention(spark, d):
    """Files that several leases hold by their patterns, those shared left out."""
    shared = spark.range(1).selectExpr(f"{SHARED} AS glob")
    held = globs.contended(_patterns(spark, d), _paths(spark, d), shared)
    return held.withColumn("leases", F.array_join(F.transform("leases", lambda x: x.cast("string")), ","))


@query(f"WITH {HITS}, c AS (SELECT DISTINCT doc_id % 40 AS lease, {PATH} AS path FROM documents) SELECT lease, path FROM c WHERE path NOT LIKE 'data/fr/%' AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.path = c.path AND hit.lease = c.lease)")
def changes_out_of_scope(spark, d):
    """Changed files that neither a pattern of their lease nor a shared one covers."""
    changed = table(spark, d, "documents").selectExpr("doc_id % 40 AS lease", f"{PATH} AS path")
    return globs.out_of_scope(changed, _patterns(spark, d), spark.range(1).selectExpr(f"{SHARED} AS glob"))


SPEC = "CASE p_size % 5 WHEN 0 THEN [1, 3, -1, 0, 0, 0] WHEN 1 THEN [1, 1, -1, 0, 0, 0] ELSE [1, 2, 0, -2, 0, 0] END"


@query(f"""WITH {HITS}, c AS MATERIALIZED (SELECT path AS item, 'e' || p_partkey % 11 AS entity, {SPEC} AS spec, p_size % 4 > 0 AS must FROM hit JOIN part ON p_partkey = pattern),
s AS (SELECT item, max(spec) FILTER (must) AS m, max(spec) AS high FROM c GROUP BY item), t AS (SELECT c.item, count(DISTINCT entity) AS n, max(entity) AS x FROM c JOIN s USING (item) WHERE must AND spec = m GROUP BY c.item), r AS (SELECT c.item, max(spec) AS rival FROM c JOIN t USING (item) WHERE entity <> x GROUP BY c.item),
a AS (SELECT c.item, string_agg(DISTINCT entity, ',' ORDER BY entity) AS "all", string_agg(DISTINCT entity, ',' ORDER BY entity) FILTER (spec = m) AS tied FROM c JOIN s USING (item) GROUP BY c.item),
o AS (SELECT item, string_agg(DISTINCT entity, ',' ORDER BY entity) AS open FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.item = c.item AND d.must AND d.entity <> c.entity AND d.spec > c.spec) GROUP BY item)
SELECT item, CASE WHEN m IS NULL THEN 'May' WHEN n > 1 AND high = m THEN 'Unknown' WHEN n = 1 AND (rival IS NULL OR rival < m) THEN 'Must' ELSE 'May' END AS status,
CASE WHEN m IS NULL THEN "all" WHEN n > 1 AND high = m THEN tied WHEN n = 1 AND (rival IS NULL OR rival < m) THEN x ELSE open END AS owners FROM s LEFT JOIN t USING (item) LEFT JOIN r USING (item) LEFT JOIN a USING (item) LEFT JOIN o USING (item)""")
def owners_by_patterns(spark, d):
    """Who owns each file, from a table of patterns, by their specificity."""
    selectors = table(spark, d, "part").selectExpr("concat('e', CAST(p_partkey % 11 AS STRING)) AS entity", f"{GLOB} AS glob", "p_size % 4 > 0 AS must")
    return certain.owners(globs.owner_candidates(_paths(spark, d), selectors)).withColumn("owners", F.array_join("owners", ","))


NAME = "concat('pkg::src', CAST(p_size % 20 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '::m1' END)"
IMPORTED = "concat('pkg::', source, '::m', CAST(doc_id % 3 AS STRING))"


@query(f"""WITH {HITS}, i AS (SELECT DISTINCT {PATH} AS file, {IMPORTED} AS target FROM documents), b AS (SELECT p_partkey AS ban, {NAME} AS name FROM part)
SELECT file, target, ban FROM i JOIN hit ON path = file JOIN b ON ban = pattern WHERE target = name OR starts_with(target, name || '::')""")
def banned_imports(spark, d):
    """Imports that a table of bans hits: names, and what is below them, from files of a pattern."""
    bans = table(spark, d, "part").selectExpr("p_partkey AS ban", f"{GLOB} AS glob", f"{NAME} AS name")
    return globs.forbidden(table(spark, d, "documents").selectExpr(f"{PATH} AS file", f"{IMPORTED} AS target"), bans)


# Memos and deltas

CHANGED = "CASE WHEN p_partkey % 97 = 0 THEN p_size + 1 ELSE p_size END"


@query(f"""WITH l AS (SELECT l_orderkey AS key, sum({CHANGED}) AS total, bool_or(p_partkey % 97 = 0) AS hit FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT key, total, key % 50 = 7 AS failed, hit OR key % 50 = 7 AS evaluated FROM l""")
def memo_refresh(spark, d):
    """Totals of orders after some parts changed: only the orders of those parts, and those that failed before, are evaluated again."""
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey AS key", "l_partkey AS input")
    state = lambda size: table(spark, d, "part").selectExpr("p_partkey AS input", f"CAST({size} AS LONG) AS size")

    def evaluator(now: DataFrame):
        def evaluate(todo: DataFrame) -> tuple[DataFrame, DataFrame]:
            read = lines.join(todo, "key", "left_semi").join(now, "input")
            found = read.groupBy("key").agg(F.sum("size").alias("total")).withColumn("failed", F.col("key") % 50 == 7)
            return found, read.select("key", "input", F.col("size").cast("string").alias("digest")).distinct()

        return evaluate

    digests_of = lambda now: now.select("input", F.col("size").cast("string").alias("digest"))
    before, after = state("p_size"), state(CHANGED)
    wanted = lines.select("key").distinct()
    results, reads, _ = memo.refresh(spark.createDataFrame([], "key long, total long"), spark.createDataFrame([], "key long, input long, digest string"), digests_of(before), wanted, evaluator(before), ["key"])
    _, _, answer = memo.refresh(results, reads, digests_of(after), wanted, evaluator(after), ["key"])
    return answer.select("key", "total", "failed", "evaluated")


@query("""SELECT CASE WHEN p_partkey % 53 = 0 THEN 'Moved' ELSE p_brand END AS brand, count(*) AS rows, CAST(sum(CAST(l_quantity AS BIGINT) * p_size) AS BIGINT) AS total FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 31 <> 5 GROUP BY 1""")
def delta_view(spark, d):
    """Sums of a join after lines went and parts moved, from the sums before and the changes alone."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("quantity"), "l_orderkey")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"))
    old, new = lines.select("part", "quantity"), parts.withColumn("brand", F.when(F.col("part") % 53 == 0, "Moved").otherwise(F.col("brand")))
    gone = memo.consolidated(lines.filter("l_orderkey % 31 = 5").select("part", "quantity").withColumn(memo.COUNT, F.lit(-1)))
    moved = memo.changes(parts, new)
    sums = {"total": F.col("quantity") * F.col("size")}
    view = memo.sums_of(old.join(parts, "part"), ["brand"], sums)
    return memo.summed(view, memo.joined(old, gone, parts, moved, ["part"]), ["brand"], sums)


# Versions and the stream


def _shared(spark: SparkSession) -> str:
    checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/trivium-{uuid.uuid4().hex}"


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'done' ELSE o_orderstatus END AS status, o_custkey AS owner FROM orders UNION ALL SELECT -1 - c_custkey, 'new', c_custkey FROM customer")
def index_versions(spark, d):
    """An index after a change that was in time; one that came from a stale state left nothing."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    store = snapshots.Snapshots(spark, _shared(spark), ["id"])
    store.rebuild(orders, "first")
    done = orders.filter("id % 7 = 0").withColumn("status", F.lit("done"))
    fresh = table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("id"), F.lit("new").alias("status"), F.col("c_custkey").alias("owner"))
    store.apply(done.unionByName(fresh), "first", "second")
    if store.apply(orders.withColumn("status", F.lit("stale")), "first", "third") is not None:
        raise AssertionError("a stale writer was let in")
    return store.read()


MOVE = ("CAST(user_id AS STRING) AS ticket", "event_type AS field", "CAST(event_id AS STRING) AS id", "CASE WHEN event_id % 6 = 0 THEN 'other' ELSE CAST((event_id - 1) % 5 AS STRING) END AS old", "CAST(event_id % 5 AS STRING) AS new")


@query(f"""WITH m AS (SELECT {', '.join(MOVE)}, floor(epoch_us(ts) / 1000) AS ms, ts FROM events), f AS (SELECT *, lag(new) OVER (PARTITION BY ticket, field ORDER BY ms, ts, id) AS found FROM m)
SELECT ticket, field, id, found FROM f WHERE old IS DISTINCT FROM found""")
def streamed_conflicts(spark, d):
    """Changes that do not start from what their field held, from a stream that keeps each ticket's log in its state."""
    folder = _shared(spark)
    fold.stateful(spark)
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    changes = stream.selectExpr(*MOVE, "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000) AS LONG) AS ms", "CAST(ts AS TIMESTAMP) AS at")
    keep = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")
    fold.fold_log(changes).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return fold.settle(spark.read.parquet(f"{folder}/out"))[1]
