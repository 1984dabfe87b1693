"""Declared rules over the driver tables as one program, and the queries of their verdicts, accounts and gate.

Each rule stands beside the SQL of its observations ``rule, subject, lo, hi,
known``; one SQL text interprets them all by polarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivium.operators import globs
from trivium.plans import fact_queries
from trivium.plans.pattern_queries import GLOB, PATH, RE
from trivium.plans.program import Facts, Observation, Program, hits
from trivium.plans.registry import query
from trivium.sources import table

PROGRAM = Program()
SQL: dict[str, str] = {}
#: Polarity of each rule for the SQL; Pn has its threshold.
POLARITY: dict[str, tuple[str, int]] = {}


def declared(id: str, slug: str, severity: str, polarity: str, kind: str, sql: str, threshold: int | None = None, must_measure: bool = False):
    SQL[id], POLARITY[id] = sql, (polarity, threshold or 0)
    return PROGRAM.rule(id, slug, severity, polarity, kind, must_measure, threshold)


# What a rule looks for on its subject alone: rules of one kind share a scan.

HOME = "(/home/|/Users/)[A-Za-z0-9_.-]+"


@declared("TICK004", "absolute-home-path", "error", "P+", "document", f"SELECT doc_id AS subject, CAST(regexp_matches(coalesce(text, ''), '{HOME}') AS INT) AS lo, lo AS hi, true AS known FROM documents")
def _(facts, rows):
    return Observation(F.coalesce("text", F.lit("")).rlike(HOME))


@declared("DOC001", "undocumented-public-item", "warn", "P-", "document", "SELECT doc_id, CAST(coalesce(text, '') <> '' AS INT), CAST(coalesce(text, '') <> '' AS INT), lang <> 'fr' FROM documents")
def _(facts, rows):
    """What nothing could read (French here) is unknown."""
    return Observation(F.coalesce("text", F.lit("")) != "", kind=F.when(F.col("lang") == "fr", "Unknown").otherwise("Exact"), reason=F.lit("no_adapter"))


@declared("READ001", "unreadable-file", "warn", "P+", "document", "SELECT doc_id, CAST(n_chars > 20000 AS INT), CAST(n_chars > 20000 AS INT), true FROM documents")
def _(facts, rows):
    return Observation(F.col("n_chars") > 20000)


@declared("PM001", "milestone-without-goal", "warn", "P+", "customer", "SELECT c_custkey, CAST(c_acctbal < 0 AS INT), CAST(c_acctbal < 0 OR c_nationkey = 7 AS INT), true FROM customer")
def _(facts, rows):
    return Observation(F.col("c_acctbal") < 0, (F.col("c_acctbal") < 0) | (F.col("c_nationkey") == 7))


@declared("PM033", "ready-queue-low", "advisory", "Pn min", "customer", "SELECT c_custkey, c_custkey % 9, c_custkey % 9 + c_nationkey % 2, true FROM customer", threshold=3)
def _(facts, rows):
    ready = F.col("c_custkey") % 9
    return Observation(ready, ready + F.col("c_nationkey") % 2)


@declared("DRIFT004", "reattest-required", "warn", "P0", "part", "SELECT p_partkey, CAST(p_size % 10 = 3 AS INT), CAST(p_size % 10 IN (3, 4) AS INT), true FROM part")
def _(facts, rows):
    return Observation(F.col("p_size") % 10 == 3, (F.col("p_size") % 10).isin(3, 4))


# What a rule finds elsewhere: joined to its subjects.


@declared("REF001", "dangling-ticket-ref", "error", "P+", "reference", "SELECT l_orderkey, CAST(bool_or(o.k IS NULL) AS INT), CAST(bool_or(o.k IS NULL) AS INT), true FROM lineitem LEFT JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') o ON o.k = l_orderkey GROUP BY 1")
def _(facts, rows):
    return hits(facts.relations["dangling"], "l_orderkey")


@declared("TODO002", "todo-ticket-terminal", "warn", "P+", "reference", "SELECT l_orderkey, count(*) FILTER (o.o_orderstatus = 'F'), count(*) FILTER (o.o_orderstatus IN ('F', 'P')), true FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) LEFT JOIN orders o ON o.o_orderkey = l_orderkey + l_linenumber * 3 GROUP BY 1")
def _(facts, rows):
    """A ticket whose state is in doubt may be over."""
    refs = facts.kinds["line"].selectExpr("l_orderkey", "l_orderkey + l_linenumber * 3 AS o_orderkey")
    over = facts.kinds["order"].filter("o_orderstatus in ('F', 'P')").select("o_orderkey", "o_orderstatus")
    return hits(refs.join(over, "o_orderkey"), "l_orderkey", F.col("o_orderstatus") == "P")


@declared("INV001", "invariant-without-anchor", "warn", "P-", "invariant", "SELECT p_partkey, count(l_partkey), count(l_partkey), true FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'A' AND l_quantity > 40 WHERE p_size > 25 GROUP BY 1", must_measure=True)
def _(facts, rows):
    return hits(facts.kinds["line_all"].filter("l_returnflag = 'A' and l_quantity > 40"), "l_partkey")


@declared("TICK003", "dangling-link", "error", "P+", "supplier", "SELECT s.s_suppkey, CAST(t.s_suppkey IS NULL AS INT), CAST(t.s_suppkey IS NULL AS INT), true FROM supplier s LEFT JOIN supplier t ON t.s_suppkey = s.s_suppkey + s.s_nationkey")
def _(facts, rows):
    links = rows.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + F.col("s_nationkey")).alias("dst"))
    return hits(links.join(rows.select(F.col("s_suppkey").alias("dst")), "dst", "left_anti"), "src")


@declared("COV003", "tests-names-missing-test", "error", "P-", "supplier", "SELECT s_suppkey, count(*) FILTER (l_returnflag = 'N'), count(l_suppkey), true FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity = 50 AND l_linenumber > 4 AND l_returnflag <> 'R' GROUP BY 1")
def _(facts, rows):
    tests = facts.kinds["line_all"].filter("l_quantity = 50 and l_linenumber > 4 and l_returnflag <> 'R'")
    return hits(tests, "l_suppkey", F.col("l_returnflag") == "A")


@declared("MDL001", "mdl-duplicate-entity", "error", "Pn max", "name", "SELECT p_name, count(*), count(*), true FROM part GROUP BY 1", threshold=1)
def _(facts, rows):
    return hits(facts.kinds["part"], "p_name")


@declared("REL002", "lockstep-version-mismatch", "error", "Pn max", "brand", "SELECT p_brand, count(DISTINCT p_size // 8), count(DISTINCT p_size // 8), true FROM part GROUP BY 1", threshold=1)
def _(facts, rows):
    return hits(facts.kinds["part"].selectExpr("p_brand", "floor(p_size / 8) AS version").distinct(), "p_brand")


HIT = f"(SELECT path, pattern FROM (SELECT DISTINCT {PATH} AS path FROM documents) JOIN (SELECT p_partkey AS pattern, {RE} AS re FROM part WHERE p_partkey % 3 = 0) ON regexp_matches(path, re))"


@declared("SYS001", "sys-unowned", "warn", "P-", "file", f"SELECT p.path, count(pattern), count(pattern), true FROM (SELECT DISTINCT {PATH} AS path FROM documents) p LEFT JOIN {HIT} h ON h.path = p.path GROUP BY 1")
def _(facts, rows):
    patterns = facts.kinds["pattern"].groupBy("glob").agg(F.count("*").alias("n"))
    counts = facts.relations["owned"].join(patterns, "glob").groupBy(F.col("path").alias("subject")).agg(F.sum("n").alias("lo"))
    return counts.withColumn("hi", F.col("lo"))


@declared("SYS002", "sys-ambiguous-owner", "error", "Pn max", "file", f"SELECT p.path, count(DISTINCT pattern % 5), count(DISTINCT pattern % 5), true FROM (SELECT DISTINCT {PATH} AS path FROM documents) p LEFT JOIN {HIT} h ON h.path = p.path GROUP BY 1", threshold=1)
def _(facts, rows):
    owners = facts.kinds["pattern"].select("glob", (F.col("id") % 5).alias("owner")).distinct()
    return hits(facts.relations["owned"].join(owners, "glob").select("path", "owner").distinct(), "path")


@declared("MDL005", "mdl-selector-no-file", "warn", "P-", "pattern", f"SELECT p_partkey, count(path), count(path), true FROM part LEFT JOIN {HIT} h ON h.pattern = p_partkey WHERE p_partkey % 3 = 0 GROUP BY 1")
def _(facts, rows):
    paths = facts.relations["owned"].groupBy("glob").agg(F.count("*").alias("lo"))
    return rows.join(paths, "glob").select(F.col("id").alias("subject"), "lo", F.col("lo").alias("hi"))


def facts(spark: SparkSession, d: str) -> Facts:
    part, lines, orders = table(spark, d, "part"), table(spark, d, "lineitem"), table(spark, d, "orders")
    with_id = lambda rows, id: rows.withColumn("id", F.col(id))
    files = table(spark, d, "documents").selectExpr(f"{PATH} AS path").distinct()
    patterns = part.filter("p_partkey % 3 = 0").selectExpr("p_partkey AS id", f"{GLOB} AS glob")
    owned = globs.matching(files, patterns.select("glob"))  # many patterns have one glob: what is counted is counted by glob
    return Facts(
        {
            "document": with_id(table(spark, d, "documents"), "doc_id"), "customer": with_id(table(spark, d, "customer"), "c_custkey"), "part": with_id(part, "p_partkey"), "supplier": with_id(table(spark, d, "supplier"), "s_suppkey"),
            "reference": lines.select(F.col("l_orderkey").alias("id")).distinct(), "line": lines.select("l_orderkey", "l_linenumber").distinct(), "line_all": lines, "order": orders, "invariant": with_id(part.filter("p_size > 25"), "p_partkey").select("id"),
            "name": part.select(F.col("p_name").alias("id")).distinct(), "brand": part.select(F.col("p_brand").alias("id")).distinct(), "file": files.select(F.col("path").alias("id")), "pattern": patterns,
        },
        {"dangling": fact_queries.ref001_dangling(spark, d), "owned": owned},
    )


def _case(of: str) -> str:
    """SQL of the verdicts on an observation, as a list."""
    by = {
        "P+": "CASE WHEN lo > 0 AND hi > lo THEN ['Violation', 'Unresolved'] WHEN lo > 0 THEN ['Violation'] WHEN hi > 0 THEN ['Unresolved'] ELSE ['Clean'] END",
        "P-": "CASE WHEN hi = 0 THEN ['Violation'] WHEN lo > 0 THEN ['Clean'] ELSE ['Unresolved'] END",
        "P0": "CASE WHEN lo > 0 THEN ['Violation'] WHEN hi > 0 THEN ['Unresolved'] ELSE ['Clean'] END",
        "Pn max": "CASE WHEN lo > threshold THEN ['Violation'] WHEN hi <= threshold THEN ['Clean'] ELSE ['Unresolved'] END",
        "Pn min": "CASE WHEN hi < threshold THEN ['Violation'] WHEN lo >= threshold THEN ['Clean'] ELSE ['Unresolved'] END",
    }
    return f"CASE WHEN NOT known THEN ['Unresolved'] {' '.join(f"WHEN {of} = '{p}' THEN {sql}" for p, sql in by.items())} END"


SEEN = "WITH o AS (" + " UNION ALL ".join(f"SELECT '{id}' AS rule, '{POLARITY[id][0]}' AS polarity, {POLARITY[id][1]} AS threshold, CAST(x.subject AS VARCHAR) AS subject, x.lo, x.hi, x.known FROM ({sql}) x(subject, lo, hi, known)" for id, sql in SQL.items()) + f"), v AS (SELECT rule, subject, unnest({_case('polarity')}) AS verdict, CASE WHEN known THEN 'unknown' ELSE 'no_adapter' END AS reason FROM o)"
RULES = "r(rule, severity, must) AS (VALUES " + ", ".join(f"('{r.id}', '{r.severity}', {str(r.must_measure).lower()})" for r in PROGRAM.rules.values()) + ")"


@query(f"{SEEN} SELECT rule, subject, verdict, CASE WHEN verdict = 'Unresolved' THEN reason END AS reason FROM v WHERE verdict <> 'Clean'")
def program_verdicts(spark, d):
    """What the program's rules say of every subject that is not clean."""
    return PROGRAM.judge(facts(spark, d)).filter("verdict <> 'Clean'").select("rule", "subject", "verdict", "reason")


@query(f"""{SEEN}, {RULES}, e AS (SELECT rule, subject, bool_or(verdict = 'Violation') AS v, bool_or(verdict = 'Unresolved') AS u FROM v GROUP BY ALL), a AS (SELECT rule, count(*) AS subjects, count(*) FILTER (v) AS violations, count(*) FILTER (u) AS unresolved FROM e GROUP BY rule)
SELECT rule, severity, coalesce(subjects, 0) AS subjects, coalesce(subjects, 0) AS examined, coalesce(violations, 0) AS violations, coalesce(unresolved, 0) AS unresolved, subjects IS NULL AS vacuous, subjects IS NULL AND must AS required, CAST(CASE WHEN violations > 0 THEN 0 WHEN unresolved > 0 OR subjects IS NULL THEN 1 ELSE 2 END AS TINYINT) AS truth FROM r LEFT JOIN a USING (rule)""")
def program_accounts(spark, d):
    return PROGRAM.account(PROGRAM.judge(facts(spark, d)))


@query(f"""{SEEN}, {RULES}, w AS (SELECT rule, reason, subject, row_number() OVER (PARTITION BY rule, reason ORDER BY subject) AS i FROM (SELECT DISTINCT rule, reason, subject FROM v WHERE verdict = 'Unresolved'))
SELECT rule, severity, count(*) AS n, NULL AS reason, NULL AS names FROM v JOIN r USING (rule) WHERE verdict = 'Violation' GROUP BY rule, severity
UNION ALL SELECT rule, 'unresolved', max(i), reason, string_agg(subject, ', ' ORDER BY subject) FILTER (i <= 3) FROM w GROUP BY rule, reason""")
def program_findings(spark, d):
    """Violations by rule, and doubts by rule and reason with the first three subjects."""
    rows = PROGRAM.rolled(PROGRAM.judge(facts(spark, d)))
    names = F.when(F.col("severity") == "unresolved", F.col("message"))
    return rows.select("rule", "severity", "reason", names.alias("names"), "n")


def gated(only: str) -> str:
    """SQL: does a rule of the family find an error?"""
    return f"{SEEN}, {RULES} SELECT coalesce(bool_or(verdict = 'Violation' AND severity = 'error'), false) AS failed FROM v JOIN r USING (rule) WHERE rule LIKE '{only}%'"


@query(gated("MDL"))
def program_gate(spark, d):
    """Whether the rules of one family let a change pass."""
    return PROGRAM.gate(facts(spark, d), "error", ("MDL",))
