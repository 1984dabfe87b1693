"""Registered queries of the rule language, selectors and work decisions over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.operators import links, planning, relation, selectors, workflow
from trivium.plans import rule_plans, rulelang, rules
from trivium.plans.registry import query
from trivium.sources import checkpoint_folder, table

RULES = r'''
rule DOC101 "toxic-english" {
  lang [en]  polarity P+  severity error
  find d: document
  where d is toxic
  report d "{d.source}: toxic"
}
rule CUS101 "no-urgent-order" {
  lang *  polarity P-  scope repo  must_measure
  def served(x) = some o: order where o.customer == x.id and o is urgent
  find c: customer
  where served(c)
  report c "customer {c.id} has no urgent order"
}
rule ORD101 "too-many-lines" {
  lang *  polarity Pn
  knob most: int = 3 "certain lines an order may have"
  find o: order
  where count(l: line where l.order == o.id and l is certain) > knob.most
  report o "order {o.id}"
}
rule SUP101 "doubtful-large-part" {
  lang *  severity advisory
  find s: supplier
  where some p: part where s references p and p.size in 46..50
  report s "certainly" when some q: part where s certainly references q and q.size in 46..50
  report s "perhaps"
}
rule DOC102 "too-long-for-its-folder" {
  lang *  needs config
  find row: config.limits
  find d: document where d.path matches row.pattern and d.length > row.most
  report d "over {row.most}"
  unresolved when row.pattern == "data/fr/**" because "the limit is under review"
}
rule ERR101 "error-within-purchase" {
  lang *
  find e: failure
  where e inside sale
  report e "inside"
}
rule LIN101 "mostly-returned" {
  lang *
  find o: order
  where count(l: line where l.order == o.id and l is certain) >= 2 * count(m: line where m.order == o.id and not m is certain)
  report o "order {o.id}"
}
'''


def _rule(name):
    return next(r for r in rulelang.parse(RULES) if r.id == name)


def _catalog(spark, d):
    t = lambda name: table(spark, d, name)
    toxic = t("labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    docs = t("documents").select("doc_id", "lang", "source", "n_chars").join(toxic, "doc_id", "left")
    second = F.floor(F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp_ntz").cast("timestamp"), "UTC")) / 1_000_000)
    events = t("events").select("event_id", "event_type", F.col("user_id").alias("file"), second.alias("start"))
    kinds = {
        "document": docs.select(F.col("doc_id").alias("id"), "lang", "source", F.col("n_chars").alias("length"), F.concat(F.lit("data/"), "lang", F.lit("/"), "source").alias("path"), "toxic"),
        "customer": t("customer").select(F.col("c_custkey").alias("id")),
        "order": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.when(F.col("o_orderpriority") != "1-URGENT", False).when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("urgent")),
        "line": t("lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("order"), F.when(F.col("l_returnflag") == "N", True).when(F.col("l_returnflag") == "R", False).alias("certain")),
        "supplier": t("supplier").select(F.col("s_suppkey").alias("id")),
        "part": t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")),
        "failure": events.filter("event_type = 'error'").select(F.col("event_id").alias("id"), "file", "start", F.col("start").alias("end")),
        "sale": events.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "file", "start", (F.col("start") + 600 + F.col("event_id") % 100000).alias("end")),
    }
    references = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.expr("cast(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 0 END as tinyint)").alias("truth"))
    limits = spark.createDataFrame([("data/en/**", 3000), ("data/{de,es}/src?", 2000), ("data/fr/**", 1000)], "pattern string, most int")
    return rule_plans.Catalog(kinds, {"references": references}, {"config.limits": limits})


def _verdicts(spark, d, name):
    return rule_plans.evaluate(_rule(name), _catalog(spark, d)).select("rule", "severity", "subject", "verdict", "message")


VERDICT = "CASE t WHEN 2 THEN 'Violation' WHEN 1 THEN 'Unresolved' ELSE 'Clean' END AS verdict"
TOXIC_EN = f"SELECT 'DOC101' AS rule, 'error' AS severity, CAST(doc_id AS VARCHAR) AS subject, {VERDICT}, source || ': toxic' AS message FROM (SELECT doc_id, source, CASE WHEN toxic IS NULL THEN 1 WHEN toxic = 1 THEN 2 ELSE 0 END AS t FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en')"


@query(TOXIC_EN)
def grl_toxic_english(spark, d):
    return _verdicts(spark, d, "DOC101")


@query(f"""WITH u AS (SELECT o_custkey, max(CASE WHEN o_orderpriority <> '1-URGENT' THEN 0 WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END) AS t FROM orders GROUP BY 1)
SELECT 'CUS101' AS rule, 'warn' AS severity, CAST(c_custkey AS VARCHAR) AS subject, {VERDICT}, 'customer ' || c_custkey || ' has no urgent order' AS message FROM (SELECT c_custkey, 2 - coalesce(t, 0) AS t FROM customer LEFT JOIN u ON o_custkey = c_custkey)""")
def grl_no_urgent_order(spark, d):
    return _verdicts(spark, d, "CUS101")


BOUNDS = "c AS (SELECT o_orderkey, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag IN ('N', 'A')) AS na, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag IN ('R', 'A')) AS ra FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"


@query(f"WITH {BOUNDS} SELECT 'ORD101' AS rule, 'warn' AS severity, CAST(o_orderkey AS VARCHAR) AS subject, {VERDICT}, 'order ' || o_orderkey AS message FROM (SELECT o_orderkey, CASE WHEN n > 3 THEN 2 WHEN na > 3 THEN 1 ELSE 0 END AS t FROM c)")
def grl_too_many_lines(spark, d):
    return _verdicts(spark, d, "ORD101")


@query(f"WITH {BOUNDS} SELECT 'LIN101' AS rule, 'warn' AS severity, CAST(o_orderkey AS VARCHAR) AS subject, {VERDICT}, 'order ' || o_orderkey AS message FROM (SELECT o_orderkey, CASE WHEN n >= 2 * ra THEN 2 WHEN na < 2 * r THEN 0 ELSE 1 END AS t FROM c)")
def grl_count_ratio(spark, d):
    return _verdicts(spark, d, "LIN101")


@query("""WITH r AS (SELECT l_suppkey AS s, max(CASE l_returnflag WHEN 'N' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS t FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size BETWEEN 46 AND 50 GROUP BY 1), c AS (SELECT s_suppkey, coalesce(t, 0) AS t FROM supplier LEFT JOIN r ON s = s_suppkey)
SELECT 'SUP101' AS rule, 'advisory' AS severity, CAST(s_suppkey AS VARCHAR) AS subject, CASE t WHEN 2 THEN 'Violation' WHEN 1 THEN 'Unresolved' ELSE 'Clean' END AS verdict, CASE t WHEN 1 THEN 'perhaps' ELSE 'certainly' END AS message FROM c""")
def grl_certainly_references(spark, d):
    return _verdicts(spark, d, "SUP101")


@query(r"""WITH g(re, most, doubt) AS (VALUES ('^data/en/.*$', 3000, false), ('^data/(de|es)/src[^/]$', 2000, false), ('^data/fr/.*$', 1000, true)), m AS (SELECT doc_id, most, doubt FROM documents JOIN g ON regexp_matches('data/' || lang || '/' || source, re) AND n_chars > most)
SELECT 'DOC102' AS rule, 'warn' AS severity, CAST(doc_id AS VARCHAR) AS subject, CASE WHEN doubt THEN 'Unresolved' ELSE 'Violation' END AS verdict, 'over ' || most AS message FROM m""")
def grl_side_table_globs(spark, d):
    return _verdicts(spark, d, "DOC102")


@query("""WITH t AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT 'ERR101' AS rule, 'warn' AS severity, CAST(event_id AS VARCHAR) AS subject, CASE WHEN EXISTS (SELECT 1 FROM t q WHERE q.user_id = t.user_id AND q.event_type = 'purchase' AND q.s <= t.s AND t.s <= q.s + 600 + q.event_id % 100000) THEN 'Violation' ELSE 'Clean' END AS verdict, 'inside' AS message FROM t WHERE event_type = 'error'""")
def grl_inside_range(spark, d):
    return _verdicts(spark, d, "ERR101")


@query(f"""WITH v AS ({TOXIC_EN}) SELECT count(*) FILTER (verdict = 'Violation') AS error, 0::BIGINT AS warn, 0::BIGINT AS advisory, count(*) FILTER (verdict = 'Unresolved') AS unresolved, count(*) FILTER (verdict = 'Violation') > 0 AS failed FROM v""")
def severity_gate(spark, d):
    found = rule_plans.findings(rule_plans.evaluate(_rule("DOC101"), _catalog(spark, d)))
    return rules.tally(found).crossJoin(rules.gate(found, "error"))  # one row each


@query("""SELECT doc_id AS id, CAST(CASE WHEN source = 'src0' OR (lang = 'en' AND n_chars <= 4000) OR (n_chars > 4000 AND lang <> 'en') THEN 2 ELSE 0 END AS TINYINT) AS truth,
CASE WHEN source = 'src0' THEN '1,2,0,-1,0,0' WHEN lang = 'en' AND n_chars <= 4000 THEN '1,2,-1,0,0,1' WHEN n_chars > 4000 AND lang <> 'en' THEN '0,0,0,0,0,1' ELSE '' END AS spec FROM documents""")
def selector_match(spark, d):
    """A selector over documents: how specifically it matches, dominated matches left out."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "lang", F.concat(F.lit("data/"), "lang", F.lit("/"), "source").alias("path"), F.when(F.col("n_chars") > 4000, "long").otherwise("short").alias("kind"), F.create_map(F.lit("size"), F.col("n_chars").cast("string")).alias("attrs"), F.lit(True).alias("attrs_provided")
    )
    rows = docs.withColumn("m", selectors.matches('"data/en/**" & attr(size <= 4000) | "data/*/src0" | kind(long) & !lang(en)'))
    return rows.select("id", selectors.truth_of(F.col("m")).alias("truth"), F.coalesce(F.array_join(F.array_max(F.transform("m", lambda r: r["spec"])), ","), F.lit("")).alias("spec"))


@query("SELECT doc_id AS id FROM documents WHERE NOT (lang IN ('en', 'de') OR source LIKE 'src1%' AND length(source) = 5)")
def outside_scope(spark, d):
    """Paths that neither a lease nor the shared patterns allow."""
    paths = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("data/"), "lang", F.lit("/"), "source").alias("path"))
    allowed = F.col("path").rlike(X.glob_pattern("data/{en,de}/**")) | F.col("path").rlike(X.glob_pattern("**/src1?"))
    return workflow.outside(paths, "path", allowed).select("id")


EDGES = "SELECT p_partkey AS src, (7 * p_partkey + p_size) % (SELECT count(*) FROM part) AS dst, CASE WHEN p_size % 3 = 1 THEN 1 ELSE 2 END AS truth FROM part"


def _edges(spark, d):
    checkpoint_folder(spark)
    part = table(spark, d, "part").select("p_partkey", "p_size")
    n = part.count()
    return part.select(F.col("p_partkey").alias("src"), ((7 * F.col("p_partkey") + F.col("p_size")) % n).alias("dst"), F.when(F.col("p_size") % 3 == 1, 1).otherwise(2).cast("tinyint").alias("truth"))


@query(f"""WITH RECURSIVE e AS ({EDGES}), s AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 50 = 0),
m AS (SELECT node FROM s UNION SELECT dst FROM m JOIN e ON src = node AND truth = 2), a AS (SELECT node FROM s UNION SELECT dst FROM a JOIN e ON src = node)
SELECT p_partkey AS node, CASE WHEN a.node IS NULL THEN 'Violation' WHEN m.node IS NOT NULL THEN 'Clean' ELSE 'Unresolved' END AS verdict FROM part LEFT JOIN a ON a.node = p_partkey LEFT JOIN m ON m.node = p_partkey""")
def untested_parts(spark, d):
    """Parts that no seed reaches: a violation if none may, unresolved if only doubtful edges lead there."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return rules.judge(relation.covered_by(part, part.filter("node % 50 = 0"), _edges(spark, d)), "P-").select("node", "verdict")


@query(f"""WITH RECURSIVE e AS ({EDGES}), w AS (SELECT src, dst, 1 AS n FROM e UNION SELECT w.src, e.dst, n + 1 FROM w JOIN e ON w.dst = e.src WHERE n < 3), p AS (SELECT DISTINCT src, dst FROM w WHERE src <> dst),
x AS (SELECT p.dst AS node, p.src AS dependent, row_number() OVER (PARTITION BY p.dst ORDER BY p.src) AS i, count(*) OVER (PARTITION BY p.dst) AS n FROM p JOIN part o ON o.p_partkey = p.dst AND o.p_size % 10 = 0 JOIN part q ON q.p_partkey = p.src WHERE NOT q.p_size > o.p_size)
SELECT node, string_agg(CAST(dependent AS VARCHAR), ',' ORDER BY dependent) FILTER (i <= 5) AS first, max(greatest(n - 5, 0)) AS more FROM x GROUP BY node""")
def affects_not_acked(spark, d):
    """What depends on a changed part within three steps and was not acknowledged after it: the first five, and how many more."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    changed = part.filter("p_size % 10 = 0").select(F.col("p_partkey").alias("dst"), F.col("p_size").alias("own"))
    acked = part.select(F.col("p_partkey").alias("src"), F.col("p_size").alias("dep"))
    stale = relation.reaches(_edges(spark, d), 3).filter("src <> dst").join(changed, "dst").join(acked, "src").filter("not dep > own").select(F.col("dst").alias("node"), "src")
    counts = stale.groupBy("node").agg(F.greatest(F.count(F.lit(1)) - 5, F.lit(0)).alias("more"))
    return counts.join(planning.first_names(stale, ["node"], "src", 5), "node").select("node", F.array_join(F.col("first").cast("array<string>"), ",").alias("first"), "more")


@query("""WITH h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages), k AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, target FROM h WHERE NOT regexp_matches(target, '^(//|[A-Za-z][A-Za-z0-9+.-]*:)') AND target LIKE '/%' AND NOT regexp_matches(target, '[.#?]|//') AND length(target) > 1 AND NOT EXISTS (SELECT 1 FROM k WHERE path = target)""")
def broken_links(spark, d):
    """Plain links from the root whose target is no page; :func:`broken_link_anchor` judges every internal link."""
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target")).distinct()
    inner = links.filter(~X.is_external(F.col("target")) & F.col("target").startswith("/") & ~F.col("target").rlike("[.#?]|//") & (F.length("target") > 1))
    resolved = inner.withColumn("path", F.concat(F.lit("/"), X.resolve_path(F.col("target"), F.lit(""))))
    known = pages.select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path")).distinct()
    return resolved.join(known, "path", "left_anti").select("page_id", "target")


RESOLVED = "list_reduce(list_filter(string_split({}, '/'), lambda v: v NOT IN ('', '.')), lambda a, v: CASE WHEN v <> '..' THEN a || '/' || v WHEN a <> '' THEN regexp_replace(a, '/[^/]*$', '') END, '')"


@query(rf"""WITH p AS (SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages), k AS (SELECT page_id, html, {RESOLVED.format("path")} AS path, regexp_replace(path, '[^/]*$', '') AS folder FROM p),
h AS (SELECT DISTINCT page_id, path, folder, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM k),
s AS (SELECT *, split_part(split_part(target, '?', 1), '#', 1) AS name, regexp_extract(split_part(target, '?', 1), '#(.*)$', 1) AS anchor FROM h WHERE NOT regexp_matches(target, '^(//|[A-Za-z][A-Za-z0-9+.-]*:)')),
w AS (SELECT *, CASE WHEN name LIKE '/%' THEN name ELSE folder || '/' || name END AS whole FROM s), r AS (SELECT *, CASE WHEN name = '' THEN path ELSE {RESOLVED.format("whole")} END AS resolved, replace(regexp_replace(trim(lower(anchor)), '[^\pL\pN _-]', '', 'g'), ' ', '-') AS slug FROM w),
a AS (SELECT DISTINCT path, replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_replace(unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)), '<[^>]*>', '', 'g'), '&[A-Za-z0-9#]+;', '&', 'g')), '\s+', ' ', 'g')), '[^\pL\pN _-]', '', 'g'), ' ', '-') AS slug FROM k),
j AS (SELECT page_id, target, CASE WHEN resolved IS NULL THEN 'leaves' WHEN name <> '' AND resolved <> '' AND resolved NOT IN (SELECT path FROM k) THEN 'missing'
WHEN anchor <> '' AND resolved IN (SELECT path FROM k) AND NOT EXISTS (SELECT 1 FROM a WHERE a.path = resolved AND a.slug = r.slug) THEN 'anchor' END AS problem FROM r) SELECT * FROM j WHERE problem IS NOT NULL""")
def broken_link_anchor(spark, d):
    """Internal links that leave the site, whose target is no page, or whose anchor is no heading of it; entities in headings stand for no letter."""
    url_path = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    pages = table(spark, d, "pages").select("page_id", "html", X.resolve_path(url_path, F.lit("")).alias("path"), F.regexp_replace(url_path, "[^/]*$", "").alias("folder"))
    hrefs = pages.select("page_id", "path", "folder", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target")).distinct()
    headings = F.regexp_extract_all("html", F.lit("(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), 1)
    slugs = F.transform(headings, lambda h: X.slug(X.collapse_space(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", ""), "&[A-Za-z0-9#]+;", "&"))))
    return links.broken(hrefs, pages.select("path", slugs.alias("slugs"))).select("page_id", "target", "problem")


WORDS = r"SELECT doc_id, trim(text) AS x, list_filter(regexp_split_to_array(lower(trim(text)), '[^\pL\pN]+'), lambda v: v <> '') AS w FROM documents"


@query(rf"""WITH w AS ({WORDS}) SELECT doc_id, CASE WHEN length(x) < 20 THEN 'short' WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' the ') THEN 'banned'
WHEN len(list_filter(w, lambda v: regexp_matches(v, '^[a-z]{{2,6}}[0-9]{{3}}$'))) > 0 AND len(list_filter(w, lambda v: NOT (regexp_matches(v, '^[a-z]{{2,6}}[0-9]{{3}}$') OR v IN ('does', 'do', 'not', 'no', 'apply', 'applies', 'to', 'this', 'here', 'is', 'ok', 'okay', 'fine', 'the', 'a', 'rule', 'ignore', 'ignored', 'skip', 'skipped', 'disabled')))) = 0 THEN 'restates'
WHEN len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 0 THEN 'repeats' END AS fault FROM w""")
def reason_faults(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", X.reason_fault(F.col("text"), 20, ("the",)).alias("fault"))


@query("""WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part), b AS (SELECT p_partkey, v // 65536 AS r, (v // 256) % 256 AS g, v % 256 AS b FROM c)
SELECT p_partkey, '#' || lpad(lower(hex(r * 65536 + g * 256 + b)), 6, '0') AS hex, round(sqrt((2.0 + r / 2.0 / 256.0) * r * r + 4.0 * g * g + (2.0 + (255.0 - r / 2.0) / 256.0) * b * b), 6) AS distance FROM b""")
def colour_distance(spark, d):
    text = F.concat(F.lit("#"), F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0"))
    part = table(spark, d, "part").select("p_partkey", X.hex_colour(text).alias("c"), X.hex_colour(F.lit("#000")).alias("black"))
    return part.select("p_partkey", X.to_hex(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("hex"), F.round(X.redmean(F.col("c"), F.col("black")), 6).alias("distance"))


@query("""WITH c AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS committed, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1)
SELECT CAST(m AS DATE) AS cycle, committed, done, round(done / committed::DOUBLE, 6) AS ratio, CASE WHEN year(m) < 1995 THEN 'closed' WHEN m > TIMESTAMP '1996-01-15' THEN 'planned' ELSE 'active' END AS state FROM c""")
def cycle_commitment(spark, d):
    orders = table(spark, d, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("cycle"), "o_orderstatus", F.lit(1).alias("points"))
    folded = F.when(F.year("cycle") < 1995, "closed").otherwise("open")
    out = workflow.commitment(orders, "cycle", "points", F.col("o_orderstatus") == "F").withColumn("ratio", F.round("ratio", 6))
    return out.withColumn("state", workflow.cycle_state(folded, F.col("cycle"), F.lit("1996-01-15").cast("date")))


@query("""SELECT count(*) FILTER (o_custkey % 3 <> 0 AND o_orderpriority <> '1-URGENT') AS standard, count(*) FILTER (o_custkey % 3 <> 0 AND o_orderpriority = '1-URGENT') AS expedite, count(*) FILTER (o_custkey % 3 = 0) AS stale FROM orders WHERE o_orderstatus = 'P'""")
def work_in_progress(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return workflow.in_progress(orders.filter("o_orderstatus = 'P'"), orders.filter("o_custkey % 3 <> 0").select("o_orderkey"), "o_orderkey", F.col("o_orderpriority") == "1-URGENT")


@query("""WITH h AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS i FROM h)
SELECT l_partkey, count(*) AS holders, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) FILTER (i <= 5) AS first FROM r GROUP BY l_partkey HAVING count(*) > 1""")
def lease_contention(spark, d):
    held = table(spark, d, "lineitem").filter("l_returnflag = 'N'").select("l_partkey", "l_suppkey")
    return workflow.contention(held, "l_partkey", "l_suppkey").withColumn("first", F.array_join(F.col("first").cast("array<string>"), ","))


@query("""WITH n AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 40 THEN 'x' ELSE p_type END AS p_type FROM part WHERE p_partkey % 7 <> 0), o AS (SELECT * FROM part WHERE p_partkey % 10 <> 0)
SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, CASE WHEN n.p_partkey IS NULL THEN 'kept' WHEN o.p_partkey IS NULL THEN 'acked' WHEN n.p_brand IS NOT DISTINCT FROM o.p_brand AND n.p_type IS NOT DISTINCT FROM o.p_type THEN 'same' ELSE 'acked' END AS step FROM n FULL JOIN o ON n.p_partkey = o.p_partkey""")
def ack_plan(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    now = part.filter("p_partkey % 7 <> 0").withColumn("p_type", F.when(F.col("p_size") > 40, "x").otherwise(F.col("p_type")))
    return workflow.ack_plan(now, part.filter("p_partkey % 10 <> 0"), "p_partkey", ["p_brand", "p_type"])


@query("SELECT lang, count(*) AS files, count(*) FILTER (toxic IS NOT NULL) AS examined, count(*) FILTER (n_chars > 4000) AS partial, max(quality) AS best FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def fidelity_by_language(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return workflow.fidelity(docs, "lang", F.col("toxic").isNotNull(), F.col("n_chars") > 4000, "quality")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'already' WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority = '5-LOW' THEN 'epic' WHEN o_custkey % 13 = 0 THEN 'unsized' WHEN 8 + CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_custkey % 9 ELSE 0 END > 12 THEN 'over capacity' ELSE 'add' END AS outcome FROM orders""")
def assign_outcomes(spark, d):
    c = F.col("o_custkey")
    points = F.when(c % 13 != 0, c % 9)
    outcome = workflow.assignment(c % 11 == 0, F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "5-LOW", points, F.col("o_orderpriority") != "4-NOT SPECIFIED", F.lit(8), F.lit(12))
    return table(spark, d, "orders").select("o_orderkey", outcome.alias("outcome"))
