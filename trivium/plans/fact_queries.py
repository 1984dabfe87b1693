"""Registered queries of bindings, rule accounting, files and text functions over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.operators import bindings, certain
from trivium.plans import rules
from trivium.plans.registry import query
from trivium.sources import files, table

# References, acknowledgements, flows


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'missing' WHEN o_orderstatus = 'F' THEN 'terminal' ELSE 'open' END AS standing
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey + l_linenumber * 3 AS ticket FROM lineitem) LEFT JOIN orders ON o_orderkey = ticket""")
def reference_standing(spark, d):
    """What the tickets that lines refer to have come to."""
    refs = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey + l_linenumber * 3 AS ticket").distinct()
    tickets = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS category")
    return bindings.standing(refs, tickets).select("l_orderkey", "l_linenumber", "standing")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def ref001_dangling(spark, d):
    """References to what is not there."""
    return bindings.without_partner(table(spark, d, "lineitem").select("l_orderkey").distinct(), table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey + l_linenumber * 3 WHERE o_orderstatus = 'F'")
def todo002_terminal(spark, d):
    return reference_standing(spark, d).filter("standing = 'terminal'").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40)")
def inv001_without_anchor(spark, d):
    """Invariants (large parts) that no directive anchors."""
    anchors = table(spark, d, "lineitem").filter("l_returnflag = 'A' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return bindings.without_partner(table(spark, d, "part").filter("p_size > 25").select("p_partkey"), anchors, ["p_partkey"])


IMPORT = "concat('src/', lang, '/', source, '.rs')", "concat('pkg::', source, '::m', CAST(doc_id % 3 AS {text}))"


@query(f"""WITH i AS (SELECT DISTINCT {IMPORT[0]} AS file, {IMPORT[1].format(text='VARCHAR')} AS target FROM documents)
SELECT file, target, 0 AS ban FROM i WHERE regexp_matches(file, '^src/en/[^/]*$') AND (target = 'pkg::src1' OR starts_with(target, 'pkg::src1::'))
UNION ALL SELECT file, target, 1 FROM i WHERE regexp_matches(file, '^src/(de|fr)/.*$') AND (target = 'pkg::src2::m1' OR starts_with(target, 'pkg::src2::m1::'))""")
def inv002_forbidden_imports(spark, d):
    imports = table(spark, d, "documents").selectExpr(f"{IMPORT[0]} AS file", f"{IMPORT[1].format(text='STRING')} AS target").distinct()
    return bindings.forbidden_imports(imports, [("src/en/*", "pkg::src1"), ("src/{de,fr}/**", "pkg::src2::m1")])


LOCKED = "p_partkey % 11 > 0"
LIVE = "p_partkey % 13 > 0"


@query(f"""WITH b AS (SELECT DISTINCT l_suppkey AS doc, l_partkey AS symref FROM lineitem), k AS (SELECT p_partkey, p_brand, p_size % 30 AS p_size FROM part WHERE {LOCKED}), s AS (SELECT p_partkey, p_brand, p_size FROM part WHERE {LIVE})
SELECT doc, symref, CASE WHEN s.p_partkey IS NULL THEN 'gone' WHEN k.p_partkey IS NULL THEN 'unacked' ELSE 'changed' END AS problem, CASE WHEN s.p_partkey IS NOT NULL AND k.p_partkey IS NOT NULL THEN 'p_size' ELSE '' END AS facets
FROM b LEFT JOIN k ON k.p_partkey = symref LEFT JOIN s ON s.p_partkey = symref WHERE s.p_partkey IS NULL OR k.p_partkey IS NULL OR k.p_size <> s.p_size""")
def drift001_bindings(spark, d):
    """Documents bound to what is gone, never acknowledged or changed since."""
    part = table(spark, d, "part").selectExpr("p_partkey AS symref", "p_partkey", "p_brand", "p_size")
    bound = table(spark, d, "lineitem").selectExpr("l_suppkey AS doc", "l_partkey AS symref")
    return bindings.drift(bound, part.filter(LOCKED).withColumn("p_size", F.col("p_size") % 30), part.filter(LIVE), ["p_brand", "p_size"]).withColumn("facets", F.array_join("facets", ","))


@query(f"SELECT p_partkey AS symref FROM part WHERE {LOCKED} AND {LIVE} AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def drift003_stale_acks(spark, d):
    part = table(spark, d, "part").selectExpr("p_partkey AS symref", "p_partkey")
    bound = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("symref"))
    return bindings.stale_acks(part.filter(LOCKED), bound, part.filter(LIVE))


@query("SELECT doc_id AS symref, CAST(CASE WHEN lang = 'fr' THEN 1 WHEN coalesce(text, '') <> '' THEN 2 ELSE 0 END AS TINYINT) AS truth FROM documents WHERE doc_id % 3 = 0")
def doc001_undocumented(spark, d):
    """Does each public symbol have a document?  What nothing could read is unknown."""
    symbols = table(spark, d, "documents").selectExpr("doc_id AS symref", "text AS doc", "CASE doc_id % 3 WHEN 0 THEN 'public' ELSE 'private' END AS visibility", "lang <> 'fr' AS read")
    return bindings.undocumented(symbols, F.col("read"))


@query(f"""WITH k AS (SELECT p_partkey AS symref, p_name AS body FROM part WHERE {LOCKED}), l AS (SELECT p_partkey AS symref, p_name AS body FROM part WHERE {LIVE} AND p_partkey % 3 > 0 UNION ALL SELECT p_partkey + 1000000, CASE WHEN p_partkey % 39 = 0 THEN NULL ELSE p_name END FROM part WHERE p_partkey % 3 = 0),
g AS (SELECT * FROM k WHERE symref NOT IN (SELECT symref FROM l)), f AS (SELECT * FROM l WHERE symref NOT IN (SELECT symref FROM k)), c AS (SELECT g.symref, string_agg(DISTINCT CAST(f.symref AS VARCHAR), ',' ORDER BY CAST(f.symref AS VARCHAR)) AS candidates FROM g JOIN f USING (body) GROUP BY g.symref)
SELECT g.symref, CASE WHEN candidates IS NOT NULL THEN 'renamed' ELSE 'undecided' END AS state, coalesce(candidates, '') AS candidates FROM g LEFT JOIN c USING (symref) WHERE candidates IS NOT NULL OR EXISTS (SELECT 1 FROM f WHERE body IS NULL)""")
def sys008_renames(spark, d):
    """Acknowledged parts that vanished and appear again under another key."""
    part = table(spark, d, "part")
    lock = part.filter(LOCKED).selectExpr("CAST(p_partkey AS STRING) AS symref", "p_name AS body")
    moved = part.filter("p_partkey % 3 = 0").selectExpr("CAST(p_partkey + 1000000 AS STRING) AS symref", "CASE WHEN p_partkey % 39 = 0 THEN NULL ELSE p_name END AS body")
    live = part.filter(f"{LIVE} and p_partkey % 3 > 0").selectExpr("CAST(p_partkey AS STRING) AS symref", "p_name AS body").unionByName(moved)
    return bindings.renames(lock, live).select(F.col("symref").cast("long").alias("symref"), "state", F.array_join("candidates", ",").alias("candidates"))


FLOWS = "o_orderkey AS flow", "o_custkey AS producer", "(o_custkey * 7 + o_orderkey) % 1200 AS consumer", "o_custkey % 5 AS producer_contract", "o_orderkey % 5 AS consumer_contract"
ENDS = "c_custkey AS symref", "c_custkey % 5 AS contract", "c_nationkey <> 7 AS exact"


@query(f"""WITH f AS (SELECT {', '.join(FLOWS)} FROM orders), l AS (SELECT {', '.join(ENDS)} FROM customer WHERE c_custkey % 9 > 0)
SELECT flow, CASE WHEN NOT (p.exact AND c.exact) THEN 'unresolved' ELSE 'skew' END AS state FROM f JOIN l p ON p.symref = producer JOIN l c ON c.symref = consumer
WHERE NOT (p.exact AND c.exact) OR p.contract <> c.contract OR p.contract <> producer_contract OR c.contract <> consumer_contract""")
def sys006_flow_skew(spark, d):
    """Flows whose ends no longer agree on their contract."""
    return bindings.flow_skew(table(spark, d, "orders").selectExpr(*FLOWS), table(spark, d, "customer").filter("c_custkey % 9 > 0").selectExpr(*ENDS))


@query(f"""WITH f AS (SELECT {', '.join(FLOWS)} FROM orders), l AS (SELECT c_custkey AS symref FROM customer WHERE c_custkey % 9 > 0)
SELECT flow, CASE WHEN producer IN (SELECT symref FROM l) THEN 'consumer' ELSE 'producer' END AS "end" FROM f WHERE (producer IN (SELECT symref FROM l)) <> (consumer IN (SELECT symref FROM l))""")
def sys009_unbound_ends(spark, d):
    return bindings.unbound_ends(table(spark, d, "orders").selectExpr(*FLOWS), table(spark, d, "customer").filter("c_custkey % 9 > 0").selectExpr(*ENDS))


@query("""WITH q AS (SELECT DISTINCT p_brand AS doc, substr(p_name, 2, 12) AS name FROM part WHERE p_size < 10), n AS (SELECT DISTINCT p_brand AS doc, p_name AS other FROM part WHERE p_size > 40)
SELECT q.doc, q.name, arg_min(other, struct_pack(l := levenshtein(q.name, other), o := other)) AS nearest FROM q LEFT JOIN n ON n.doc = q.doc GROUP BY q.doc, q.name""")
def drift002_nearest_heading(spark, d):
    """For each name that is not there the nearest of its document."""
    part = table(spark, d, "part")
    asked = part.filter("p_size < 10").select(F.col("p_brand").alias("doc"), F.substring("p_name", 2, 12).alias("name")).distinct()
    return bindings.nearest_names(asked, part.filter("p_size > 40").select(F.col("p_brand").alias("doc"), F.col("p_name").alias("name")), ["doc"])


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS item, l_partkey % 7 AS entity FROM lineitem WHERE l_quantity = 50 AND l_suppkey % 2 = 0),
s AS (SELECT item, count(*) AS n, string_agg(CAST(entity AS VARCHAR), ',' ORDER BY entity) AS said, min(entity) AS one FROM c GROUP BY item), o AS (SELECT s_suppkey AS item, s_nationkey % 7 AS entity FROM supplier)
SELECT o.item, CASE WHEN n > 1 THEN 'Unknown' ELSE 'Must' END AS status, coalesce(said, CAST(o.entity AS VARCHAR)) AS owners, CASE WHEN n > 1 THEN 'directive' WHEN n = 1 AND one <> o.entity THEN 'selector' END AS conflict FROM o LEFT JOIN s USING (item)
UNION ALL SELECT item, CASE WHEN n > 1 THEN 'Unknown' ELSE 'Must' END, said, CASE WHEN n > 1 THEN 'directive' END FROM s WHERE item NOT IN (SELECT item FROM o)""")
def merged_owners(spark, d):
    """Owners that selectors found, as directives change them."""
    found = certain.owners(table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), (F.col("s_nationkey") % 7).cast("string").alias("entity"), F.lit(1).alias("specificity"), F.lit(True).alias("must")))
    claims = table(spark, d, "lineitem").filter("l_quantity = 50 and l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("item"), (F.col("l_partkey") % 7).cast("string").alias("entity"))
    return bindings.merge_ranks(found, claims).withColumn("owners", F.array_join("owners", ","))


SOURCES = [f"SELECT DISTINCT l_suppkey % {7 + i} AS entity, CASE l_linenumber % 2 WHEN 0 THEN 'owner' ELSE 'user' END AS role, l_partkey AS identity, {1 + i % 2} AS status FROM lineitem WHERE l_returnflag = '{f}' AND l_quantity > 30" for i, f in enumerate("RAN")]


@query(f"WITH b AS ({' UNION ALL '.join(f'SELECT *, {i} AS rank FROM ({s})' for i, s in enumerate(SOURCES, 1))}) SELECT *, rank > min(rank) OVER (PARTITION BY identity, role) AS overridden FROM b")
def binding_relation(spark, d):
    """Bindings from sources of falling rank, with what a stronger one overrides."""
    lines = table(spark, d, "lineitem").filter("l_quantity > 30")
    source = lambda i, f: lines.filter(F.col("l_returnflag") == f).selectExpr(f"l_suppkey % {7 + i} AS entity", "CASE l_linenumber % 2 WHEN 0 THEN 'owner' ELSE 'user' END AS role", "l_partkey AS identity", f"{1 + i % 2} AS status").distinct()
    return bindings.binding_rows([source(i, f) for i, f in enumerate("RAN")])


@query("""WITH u AS (SELECT p_partkey AS symref, concat(p_brand, '::', 'k', CAST(p_size % 10 AS VARCHAR), '::n', CAST(p_partkey % 40 AS VARCHAR)) AS name FROM part),
q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN concat('k', CAST(p_size % 10 AS VARCHAR), '::n', CAST(p_partkey % 60 AS VARCHAR)) ELSE concat(p_brand, '::k3::n', CAST(p_partkey % 40 AS VARCHAR)) END AS asked FROM part),
m AS (SELECT asked, symref, name = asked AS exact FROM q JOIN u ON name = asked OR ends_with(name, concat('::', asked))), b AS (SELECT *, bool_or(exact) OVER (PARTITION BY asked) AS hit FROM m)
SELECT asked, symref, CAST(CASE WHEN count(*) OVER (PARTITION BY asked) = 1 THEN 2 ELSE 1 END AS TINYINT) AS truth FROM b WHERE exact = hit""")
def literal_units(spark, d):
    """Units that a qualified name means, whole or as a suffix."""
    part = table(spark, d, "part")
    text = lambda c: c.cast("string")
    units = part.select(F.col("p_partkey").alias("symref"), F.array("p_brand", F.concat(F.lit("k"), text(F.col("p_size") % 10)), F.concat(F.lit("n"), text(F.col("p_partkey") % 40))).alias("quals"))
    short = F.array(F.concat(F.lit("k"), text(F.col("p_size") % 10)), F.concat(F.lit("n"), text(F.col("p_partkey") % 60)))
    whole = F.array("p_brand", F.lit("k3"), F.concat(F.lit("n"), text(F.col("p_partkey") % 40)))
    asked = part.select(F.when(F.col("p_partkey") % 2 == 0, short).otherwise(whole).alias("asked"))
    return bindings.literal_units(units, asked).withColumn("asked", F.array_join("asked", "::"))


@query("SELECT l_partkey AS symref, CAST(max(CASE l_returnflag WHEN 'N' THEN 2 ELSE 1 END) AS TINYINT) AS truth FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1 UNION ALL SELECT p_partkey + 1000000, 1 FROM part WHERE p_size = 50")
def best_units(spark, d):
    matches = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symref"), F.expr("CAST(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS TINYINT)").alias("truth"))
    return bindings.best_units(matches, table(spark, d, "part").filter("p_size = 50").select((F.col("p_partkey") + 1000000).alias("symref")))


@query("SELECT doc_id FROM documents WHERE (lang = 'en' OR source = 'src3') AND source NOT IN ('src1', 'src11')")
def scope_files(spark, d):
    """Files of a scope without the shared ones; a pattern that cannot be read matches nothing."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("data/"), "lang", F.lit("/"), "source").alias("path"))
    return bindings.scope_files(rows, "path", ["data/en/**", "**/src3", "data/{broken"], ["**/src1", "**/src11"]).select("doc_id")


@query("SELECT l_partkey, arg_min(l_orderkey, struct_pack(l_suppkey, l_linenumber, l_orderkey)) AS witness FROM lineitem GROUP BY l_partkey")
def first_witness(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_partkey", "l_suppkey AS path", "l_linenumber AS offset", "l_orderkey AS witness")
    return bindings.first_witness(rows, ["l_partkey"], "witness")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR p_type LIKE 'STANDARD%' OR concat('R', CAST(p_partkey AS VARCHAR)) IN ('R7', 'R8')")
def only_rules(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_type").startswith("STANDARD"), "STD").otherwise(F.col("p_brand")).alias("family"), "p_brand")
    chosen = bindings.only(part, ["R7", "R8", "STD", "Brand#11"])
    return chosen.unionByName(part.filter("p_brand = 'Brand#11' and family = 'STD'").filter("false")).select("p_partkey")


STATUS = "CASE WHEN p_size % 4 = 0 THEN 'Examine' WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 4 = 1 THEN 'NotApplicable' WHEN p_size % 5 > 0 AND p_size % 7 > 0 THEN 'Examine' WHEN p_size % 7 = 0 THEN 'NotApplicable' ELSE 'Unresolved' END WHEN p_size % 11 = 0 THEN 'Unresolved' WHEN p_size % 10 < 3 THEN 'Unresolved' ELSE 'Examine' END"


@query(f"SELECT p_partkey, {STATUS} AS status FROM part")
def subject_status(spark, d):
    """May a rule judge a file?  By what it needs and what could be read."""
    s = F.col("p_size")
    need = F.when(s % 4 == 1, "capability").when(s % 4 != 0, "text")
    return table(spark, d, "part").select("p_partkey", bindings.subject_status(s % 3 == 0, need, s % 5 > 0, s % 7 == 0, s % 11 == 0, s % 10, F.lit(3)).alias("status"))


@query("""WITH v AS (SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS names FROM part WHERE p_size = 10 GROUP BY p_brand) SELECT b.p_brand, CASE WHEN names IS NULL THEN 'NotApplicable' ELSE 'Exact' END AS kind, names FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN v USING (p_brand)""")
def callee_vocabulary(spark, d):
    part = table(spark, d, "part").select("p_brand", "p_type", "p_size")
    entries = part.filter("p_size = 10").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("names"))
    return bindings.vocabulary(part.select("p_brand").distinct(), entries, ["p_brand"])


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def mdl001_duplicates(spark, d):
    return bindings.duplicates(table(spark, d, "part"), ["p_brand", "p_size"])


@query("""WITH n AS (SELECT DISTINCT p_partkey % 121 AS scope, p_size AS name FROM part) SELECT i.scope, i.name FROM n i JOIN n o ON o.name = i.name AND o.scope = CAST(floor((i.scope - 1) / 3) AS BIGINT) WHERE i.scope > 0""")
def mdl015_shadowed(spark, d):
    part = table(spark, d, "part").selectExpr("p_partkey % 121 AS scope", "p_size AS name")
    return bindings.shadowed(part, part.filter("scope > 0").selectExpr("scope", "CAST(floor((scope - 1) / 3) AS BIGINT) AS outer"))


@query("SELECT p_brand FROM part WHERE p_size < 4 GROUP BY p_brand HAVING count(DISTINCT p_size) > 1")
def rel002_versions(spark, d):
    return bindings.mismatched_versions(table(spark, d, "part").filter("p_size < 4").select("p_brand", F.col("p_size").alias("version")), "p_brand")


# Accounting of rules

OBSERVED = "p_partkey AS subject", "CASE WHEN p_size % 10 = 9 THEN 1 ELSE 2 END AS selected", "CASE WHEN p_size % 10 = 8 THEN 'macro' END AS unseen", "CASE WHEN p_size % 10 = 7 THEN 'NotApplicable' WHEN p_size % 10 = 6 THEN 'Exact' WHEN p_size % 10 < 3 THEN 'Exact' ELSE 'Bounds' END AS kind", "CASE WHEN p_size % 10 < 3 THEN CAST(p_size % 2 AS BIGINT) ELSE 0 END AS lo", "CASE WHEN p_size % 10 < 3 THEN CAST(p_size % 2 AS BIGINT) ELSE CAST(p_size % 3 AS BIGINT) END AS hi", "p_size % 10 = 6 AS poisoned", "CASE WHEN p_size % 2 = 0 THEN 'call' END AS reason"
JUDGED = """j AS (SELECT *, CASE WHEN selected < 2 OR unseen IS NOT NULL THEN ['Unresolved'] WHEN kind = 'NotApplicable' THEN ['NotApplicable'] WHEN poisoned AND kind = 'Exact' THEN ['Unresolved'] ELSE list_filter([CASE WHEN lo > 0 THEN 'Violation' END, CASE WHEN lo = 0 AND hi = lo THEN 'Clean' END, CASE WHEN hi > lo THEN 'Unresolved' END], lambda x: x IS NOT NULL) END AS l FROM o),
x AS (SELECT subject, unnest(l) AS verdict, selected, unseen, reason, selected = 2 AND unseen IS NULL AND kind <> 'NotApplicable' AS examined FROM j),
e AS (SELECT subject, verdict, CASE WHEN verdict = 'Unresolved' THEN CASE WHEN selected < 2 THEN 'unknown' ELSE coalesce(unseen, reason, 'unknown') END END AS reason, examined FROM x)"""


@query(f"WITH o AS (SELECT {', '.join(OBSERVED)} FROM part), {JUDGED} SELECT * FROM e")
def rule_examined(spark, d):
    """Every subject of a rule with its verdicts: what could not be examined is unresolved, never clean."""
    return rules.examine(table(spark, d, "part").selectExpr(*OBSERVED), "P+")


@query(f"""WITH o AS (SELECT {', '.join(OBSERVED)} FROM part), {JUDGED}, s AS (SELECT subject, bool_or(verdict = 'Violation') AS v, bool_or(verdict = 'Unresolved') AS u, bool_or(verdict = 'NotApplicable') AS na, bool_or(examined) AS ex FROM e GROUP BY subject)
SELECT count(*) FILTER (NOT na) AS subjects, count(*) FILTER (ex) AS examined, count(*) FILTER (v) AS violations, count(*) FILTER (u) AS unresolved, false AS vacuous, false AS required, CAST(0 AS TINYINT) AS truth FROM s""")
def rule_concluded(spark, d):
    return rules.conclude(rules.examine(table(spark, d, "part").selectExpr(*OBSERVED), "P+"), must_measure=True)


@query("SELECT 0::BIGINT AS subjects, 0::BIGINT AS examined, 0::BIGINT AS violations, 0::BIGINT AS unresolved, true AS vacuous, true AS required, CAST(1 AS TINYINT) AS truth")
def rule_vacuous(spark, d):
    """A rule that must measure and finds nothing to judge is required, not clean."""
    return rules.conclude(rules.examine(table(spark, d, "part").filter("p_size < 0").selectExpr(*OBSERVED), "P-"), must_measure=True)


@query(f"WITH o AS (SELECT {', '.join(OBSERVED)} FROM part) SELECT subject, CASE WHEN poisoned AND kind = 'Exact' THEN 'Unknown' ELSE kind END AS kind FROM o")
def tainted_observations(spark, d):
    return table(spark, d, "part").selectExpr(*OBSERVED).select("subject", rules.taint(F.col("kind"), F.col("poisoned")).alias("kind"))


for _polarity in ("P0", "Pc"):

    def _judge(spark, d, polarity=_polarity):
        """Customers by whether a wrong (certain) or open (possible) order stands against them."""
        orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("lo"), F.count_if(F.col("o_orderstatus").isin("P", "O")).alias("hi"))
        return rules.judge(orders, polarity).select("o_custkey", "verdict")

    _judge.__name__ = f"{_polarity.lower()}_verdicts"
    query("""WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS lo, count(*) FILTER (o_orderstatus IN ('P', 'O')) AS hi FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN lo > 0 THEN 'Violation' WHEN hi > 0 THEN 'Unresolved' ELSE 'Clean' END AS verdict FROM c""")(_judge)


# Files and texts

PATH = "concat(CASE doc_id % 5 WHEN 0 THEN 'tickets/' WHEN 1 THEN 'my-tickets/' ELSE 'src/' END, source, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.PY' WHEN 2 THEN '.xyz' ELSE '' END)"


def doc_files(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{PATH} AS path", "text")


@query(f"""WITH f AS (SELECT doc_id, {PATH} AS path, text FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' END AS lang, CASE WHEN doc_id % 5 = 0 THEN 'ledger' ELSE 'source' END AS role, sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest FROM f""")
def described_files(spark, d):
    """Language, role and digest of files as a repository stores them."""
    return files.described(doc_files(spark, d)).select("doc_id", "lang", "role", "digest")


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-3])>', 1)) AS level FROM pages) SELECT page_id, CAST(level AS INT) AS level, count(*) AS n FROM h GROUP BY 1, 2""")
def heading_levels(spark, d):
    """Headings of pages written as Markdown, by level."""
    md = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<h1>", "\n# x\n"), "<h2>", "\n## x\n"), "<h3>", "\n### x\n")
    rows = table(spark, d, "pages").select(F.col("page_id").alias("path"), md.alias("text"))
    return files.headings(rows).filter("title = 'x'").groupBy(F.col("path").alias("page_id"), "level").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, CAST(i - 1 AS INT) AS place, l[i] AS target FROM (SELECT page_id, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: regexp_matches(x, '^[^)\\s]+$')) AS l FROM pages), range(1, 400) r(i) WHERE i <= len(l)""")
def markdown_links(spark, d):
    """Targets of links written as Markdown, in their order."""
    md = F.array_join(F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), lambda x: F.concat(F.lit("see [here]("), x, F.lit(")"))), "\n")
    found = files.links(table(spark, d, "pages").select(F.col("page_id").alias("path"), md.alias("text")))
    place = (F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1).alias("place")
    return found.select(F.col("path").alias("page_id"), place, "target")


@query("""SELECT event_id, 'k' || (event_id % 4) AS key, CAST((event_id % 3) * 2 AS INT) AS depth FROM events""")
def yaml_keys(spark, d):
    text = F.concat(F.repeat(F.lit(" "), (F.col("event_id") % 3 * 2).cast("int")), F.lit("k"), (F.col("event_id") % 4).cast("string"), F.lit(": 1\r\n# k9: no\n- x"))
    return files.keys(table(spark, d, "events").select(F.col("event_id").alias("path"), text.alias("text"))).select(F.col("path").alias("event_id"), "key", "depth")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'anchor' WHEN 1 THEN 'owns' ELSE 'odd' END AS verb, concat('x', CAST(user_id AS VARCHAR), ',', event_type) AS args, CAST(1 AS INT) AS line FROM events WHERE event_id % 7 > 0")
def directive_scan(spark, d):
    """Directives in comments, with their verb and arguments."""
    verb = F.when(F.col("event_id") % 3 == 0, "anchor").when(F.col("event_id") % 3 == 1, "owns").otherwise("odd")
    sign = F.when(F.col("event_id") % 2 == 0, "// ").otherwise("# ")
    text = F.concat(F.lit("code();\n"), F.when(F.col("event_id") % 7 > 0, F.concat(sign, F.lit("note:"))).otherwise("note:"), verb, F.lit(" x"), F.col("user_id").cast("string"), F.lit("  "), "event_type")
    found = files.directives(table(spark, d, "events").select(F.col("event_id").alias("path"), text.alias("text")))
    return found.select(F.col("path").alias("event_id"), "verb", F.array_join("args", ",").alias("args"), "line")


@query("SELECT event_id FROM events WHERE event_id % 7 > 0 AND event_id % 3 = 2")
def dsl001_unknown_verbs(spark, d):
    return files.unknown_verbs(directive_scan(spark, d), ("anchor", "owns")).select("event_id")


@query("SELECT o_custkey AS file, CASE o_orderpriority WHEN '1-URGENT' THEN 'CI001' ELSE 'CI003' END AS rule, o_orderkey AS line FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def tool_findings(spark, d):
    """Findings of another tool's reports under our rules."""
    entry = F.struct(F.col("o_orderpriority").alias("ident"), F.struct(F.col("o_orderkey").alias("row")).alias("at"))
    reports = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.to_json(F.struct(F.collect_list(entry).alias("items"))).alias("report"))
    found, _ = files.tool_findings(reports, "report", ".items", "items array<struct<ident string, at struct<row bigint>>>", {"rule": F.col("f.ident"), "line": F.col("f.at.row")}, {"1-URGENT": "CI001", "2-HIGH": "CI003"})
    return found.select("file", "rule", "line")


@query("SELECT o_custkey AS file, o_orderkey AS line FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def tool002_unmapped(spark, d):
    entry = F.struct(F.col("o_orderpriority").alias("ident"), F.col("o_orderkey").alias("row"))
    reports = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.to_json(F.collect_list(entry)).alias("report"))
    return files.tool_findings(reports, "report", "", "array<struct<ident string, row bigint>>", {"rule": F.col("f.ident"), "line": F.col("f.row")}, {"1-URGENT": "CI001", "2-HIGH": "CI003"})[1].select("file", "line")


@query("SELECT CAST(row_number() OVER (ORDER BY CASE WHEN p_size % 9 > 0 THEN p_brand END NULLS LAST, CASE WHEN p_size % 9 > 0 THEN p_size END NULLS LAST, p_type, p_partkey) AS INT) AS place, p_partkey FROM part")
def findings_in_order(spark, d):
    """Findings as they are reported: by place, those without one last."""
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 9 > 0, F.col("p_brand")).alias("path"), F.when(F.col("p_size") % 9 > 0, F.col("p_size")).alias("offset"), F.col("p_type").alias("rule"), F.lpad(F.col("p_partkey").cast("string"), 20, "0").alias("message"))
    order = Window.orderBy(F.col("path").asc_nulls_last(), F.col("offset").asc_nulls_last(), "rule", "message")  # a report is one list
    return files.in_report_order(rows).select(F.row_number().over(order).alias("place"), "p_partkey")


LEASED = "concat('{\"ticket\": \"t', CAST(user_id AS STRING), '\", \"actor\": \"a\", \"scope\": [\"src/**\"], \"ttl_secs\": ', CAST(event_id % 900 AS STRING), CASE WHEN event_id % 10 = 0 THEN '' ELSE '}' END)"


@query("SELECT event_id % 900 AS ttl_secs, concat('t', CAST(user_id AS VARCHAR)) AS ticket FROM events WHERE event_id % 10 > 0")
def leases_read(spark, d):
    """Leases that can be read."""
    return files.leases(table(spark, d, "events").selectExpr(f"{LEASED} AS raw"), "raw")[0].select("ttl_secs", "ticket")


@query("SELECT event_id FROM events WHERE event_id % 10 = 0")
def leases_corrupt(spark, d):
    return files.leases(table(spark, d, "events").selectExpr("event_id", f"{LEASED} AS raw"), "raw")[1].select("event_id")


@query("""SELECT doc_id, CAST(len(b) - len(replace(b, chr(10), '')) AS INT) AS line, CAST(strlen(string_split(b, chr(10))[-1]) AS INT) AS col FROM (SELECT doc_id, substr(text, 1, 300) AS b FROM documents WHERE length(text) >= 300)""")
def line_index(spark, d):
    """Line and column of the place after a text's first 300 characters."""
    at = F.octet_length(F.substring("text", 1, 300))
    return table(spark, d, "documents").filter("length(text) >= 300").select("doc_id", X.line_at(F.col("text"), at).alias("p")).select("doc_id", "p.line", "p.col")


@query("SELECT p_partkey, p_size % 20 <= p_partkey % 30 AND p_partkey % 30 + 5 <= p_size % 20 + 15 AS holds, least(p_size % 20, p_partkey % 30) AS lo, CASE WHEN greatest(p_size % 20, p_partkey % 30) <= least(p_size % 20 + 15, p_partkey % 30 + 5) THEN greatest(p_size % 20, p_partkey % 30) END AS meet FROM part")
def range_algebra(spark, d):
    a, b = F.col("p_size") % 20, F.col("p_partkey") % 30
    part = table(spark, d, "part")
    return part.select("p_partkey", X.range_contains(a, a + 15, b, b + 5).alias("holds"), X.range_cover(a, a + 15, b, b + 5)["start"].alias("lo"), X.range_meet(a, a + 15, b, b + 5)["start"].alias("meet"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'TODO' WHEN p_size % 3 = 1 THEN '' ELSE 'FIXME' END AS markers FROM part")
def bare_markers(spark, d):
    """Work markers that name no owner."""
    line = F.when(F.col("p_size") % 3 == 0, "x TODO: later, TODOS").when(F.col("p_size") % 3 == 1, "# TODO(ann): later").otherwise("// FIXME, XXX(t-1)")
    return table(spark, d, "part").select("p_partkey", F.array_join(X.bare_markers(line), ",").alias("markers"))


@query("SELECT p_partkey, concat('p-', p_size) AS name, 'sm,[a:b]' AS variants, p_size % 2 = 0 AS important FROM part")
def class_candidates(spark, d):
    word = F.concat(F.lit("  sm:[a:b]:"), F.when(F.col("p_size") % 2 == 0, "!").otherwise(""), F.lit("p-"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.explode(X.class_candidates(word)).alias("c")).select("p_partkey", "c.name", F.array_join("c.variants", ",").alias("variants"), "c.important")


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS step FROM part")
def step_names(spark, d):
    return table(spark, d, "part").select("p_partkey", X.step_name(F.col("p_size") + F.col("p_partkey") % 4 / 4).alias("step"))


@query("SELECT p_partkey, (p_size % 5) * 51 AS r, (p_size % 4) * 60 AS g, 0 AS b FROM part")
def rgb_colours(spark, d):
    text = F.format_string("rgb(%d, %d, 0)", F.col("p_size") % 5 * 51, F.col("p_size") % 4 * 60)
    c = X.rgb_colour(text)
    byte = lambda x: F.round(x * 255).cast("int")
    return table(spark, d, "part").select("p_partkey", byte(c["r"]).alias("r"), byte(c["g"]).alias("g"), byte(c["b"]).alias("b"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '#ff0000' WHEN 1 THEN '#00ff00' WHEN 2 THEN '#0000ff' ELSE '#808080' END AS hex FROM part")
def hsl_colours(spark, d):
    text = F.when(F.col("p_size") % 4 == 0, "hsl(0, 100%, 50%)").when(F.col("p_size") % 4 == 1, "hsl(120deg, 100%, 50%)").when(F.col("p_size") % 4 == 2, "HSL(240, 100%, 50%)").otherwise("hsl(7, 0%, 50%)")
    c = X.hsl_colour(text)
    return table(spark, d, "part").select("p_partkey", X.to_hex(c["r"], c["g"], c["b"]).alias("hex"))
