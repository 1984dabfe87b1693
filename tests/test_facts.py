"""Small cases of trees, scopes, logs, agendas, bindings, files and rule accounting, and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.operators import agenda, bindings, log, relation, scopes, tree
from trivium.plans import codec, rule_plans, rulelang, rules
from trivium.sources import checkpoint_folder, files
from trivium.streaming import fold_stream


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_search_of_scopes():
    lexical = {3: [(0, 2, 2)], 2: [(0, 1, 2)]}
    assert scopes.search(3, "x", lexical, {1: [("x", 10, 2)], 2: [("x", 20, 2)]}, {}) == ("Must", [20])
    assert scopes.search(3, "x", lexical, {1: [("x", 10, 2)], 2: [("x", 20, 1)]}, {}) == ("May", [10, 20])
    assert scopes.search(3, "x", lexical, {1: [("x", 10, 2)]}, {2: [None]}) == ("May", [10])
    assert scopes.search(3, "x", lexical, {1: [("x", 10, 2)]}, {2: [["y"]]}) == ("Must", [10])
    assert scopes.search(3, "x", lexical, {1: [("x", 10, 0)]}, {}) == ("Unknown", [])
    assert scopes.search(3, "z", lexical, {1: [("x", 10, 2)]}, {}) == ("Unknown", [])
    # By label, then target: the first certain declaration ends the search; rings end too.
    assert scopes.search(1, "x", {1: [(1, 2, 2), (0, 3, 2)], 3: [(0, 1, 2)]}, {2: [("x", 20, 2)], 3: [("x", 30, 2)]}, {}) == ("Must", [30])


def test_digests_do_not_see_the_names_of_binders(spark):
    def unit(name):
        rows = [(1, 0, None, "unit", "u", 0, 9, 0), (1, 1, 0, "bind", name, 0, 9, 1), (1, 2, 1, "ref", name, 3, 4, 2), (1, 3, 1, "ref", "free", 5, 6, 2)]
        n = spark.createDataFrame(rows, "artifact long, node_id long, parent_id long, op string, name string, start long, end long, depth int")
        return tree.subtree_digests(n.filter("op = 'unit'"), n).first().digest, [tuple(r) for r in tree.free_variables(n.filter("op = 'unit'"), n.filter("op = 'ref'"), n.filter("op = 'bind'")).collect()]

    assert unit("a") == unit("b") and unit("a")[0] != unit("free")[0]
    assert unit("a")[1] == [(0, "free")]


def test_rings_equal_mutual_reach(spark):
    checkpoint_folder(spark)
    rng = random.Random(5)
    for n, m in ((6, 4), (9, 13)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {(a, b) for a, b in edges}
        while True:
            more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
            if not more:
                break
            reach |= more
        want = {a: max(b for b in range(n) if (a, b) in reach and (b, a) in reach) for a in range(n) if (a, a) in reach}
        got = relation.on_cycles(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()
        assert {r.node: r.ring for r in got} == want and len(got) == len(want)
    assert relation.on_cycles(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_the_first_doubt_is_handed_on(spark):
    checkpoint_folder(spark)
    edges = spark.createDataFrame([("t", "a", 2, 1), ("a", "b", 1, 2), ("t", "b", 1, 3), ("b", "c", 2, 4), ("c", "d", 1, 5), ("x", "y", 1, 6)], "src string, dst string, truth tinyint, site int")
    sure = relation.reach_from(spark.createDataFrame([("t",)], "node string"), edges.filter("truth = 2"))
    assert {r.node: r.site for r in relation.first_doubt(sure, edges).collect()} == {"b": 2, "c": 2, "d": 2}


def test_strata(spark):
    checkpoint_folder(spark)
    base = {"calls": spark.createDataFrame([("a", "b", 2), ("b", "c", 1)], "src string, dst string, truth tinyint")}
    known = relation.strata([("far", lambda r: relation.compose(r["calls"], r["calls"])), ("all", lambda r: relation.union(r["calls"], r["far"]))], base)
    assert {(r.src, r.dst, r.truth) for r in known["all"].collect()} == {("a", "b", 2), ("b", "c", 1), ("a", "c", 1)}
    with pytest.raises(ValueError):
        relation.strata([("calls", lambda r: r["calls"])], base)


def test_ulid_and_skew(spark):
    assert value(spark, log.ulid_ms(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) == 1469922850259
    assert value(spark, log.ulid_ms(F.lit("81ARZ3NDEKTSV4RRFFQ69G5FAV"))) is None and value(spark, log.ulid_ms(F.lit("x"))) is None


def test_index_moves_only_from_the_state_it_shows(spark, tmp_path):
    tickets = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    log.rebuild(tickets, "k0", str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    changed = spark.createDataFrame([("b", 3), ("c", 4)], "id string, n int")
    assert log.apply(index, "stale", "k1", changed) is None
    assert {(r.id, r.n, r._key) for r in log.apply(index, "k0", "k1", changed).collect()} == {("a", 1, "k1"), ("b", 3, "k1"), ("c", 4, "k1")}
    assert log.index_key(index.filter("false")) is None


def test_handles_mean_one_several_or_none(spark):
    tickets = spark.createDataFrame([("01AB", ["old"]), ("02AB", ["old", "new"]), ("03CD", None)], "id string, aliases array<string>")
    asked = spark.createDataFrame([("~ab",), ("~1AB",), ("03CD",), ("old",), ("new",), ("~",), ("nope",), (" ~cd ",)], "asked string")
    got = {r.asked: (r.status, r.ids) for r in log.resolve_handles(asked, tickets).collect()}
    assert got == {"~ab": ("Ambiguous", ["01AB", "02AB"]), "~1AB": ("Found", ["01AB"]), "03CD": ("Found", ["03CD"]), "old": ("Ambiguous", ["01AB", "02AB"]), "new": ("Found", ["02AB"]), "~": ("NotFound", []), "nope": ("NotFound", []), " ~cd ": ("Found", ["03CD"])}


@pytest.mark.parametrize("live,open_,later,want", [(True, True, True, "live lease"), (False, True, False, "no next cycle"), (False, True, True, "closes"), (False, False, False, "closes")])
def test_closing_a_cycle(spark, live, open_, later, want):
    day = lambda n: f"date'2026-01-{n:02}'"
    cycle = spark.sql(f"SELECT 1 AS id, {day(1)} AS start, {day(14)} AS end, 'open' AS state")
    others = cycle.unionByName(spark.sql(f"SELECT 2 AS id, {day(15)} AS start, {day(28)} AS end, '{'open' if later else 'closed'}' AS state"))
    members = spark.createDataFrame([("active" if open_ else "done", "task", 3, live), ("done", "story", 5, False), ("done", "epic", 8, False)], "category string, type string, points int, live boolean")
    row = agenda.close_plan(cycle, members, others, F.expr(day(10)), ("task", "story")).first()
    assert (row.state, row.committed) == (want, 8)
    assert (str(row.ended), row.target) == (("2026-01-10", 2 if open_ else None) if want == "closes" else ("None", None))


def test_epics_above_rings_of_parents(spark):
    checkpoint_folder(spark)
    tickets = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "id long, parent long")
    got = agenda.under_epics(tickets, spark.createDataFrame([(1,), (4,)], "epic long"))
    assert {(r.epic, r.id) for r in got.collect()} == {(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)}


def test_renames_are_undecided_where_a_body_is_unknown(spark):
    lock = spark.createDataFrame([("old", "x"), ("lost", "y"), ("here", "z")], "symref string, body string")
    live = spark.createDataFrame([("new", "x"), ("dark", None), ("here", "z")], "symref string, body string")
    assert {r.symref: (r.state, r.candidates) for r in bindings.renames(lock, live).collect()} == {"old": ("renamed", ["new"]), "lost": ("undecided", [])}
    assert {r.symref for r in bindings.renames(lock, live.filter("body is not null")).collect()} == {"old"}


def test_a_ban_that_cannot_be_read_is_not_silent(spark):
    imports = spark.createDataFrame([("a/b.rs", "x::y"), ("a/b.rs", "x::yz")], "file string, target string")
    assert [(r.target, r.ban) for r in bindings.forbidden_imports(imports, [("a/*", "x::y")]).collect()] == [("x::y", 0)]
    assert {(r.target, r.ban) for r in bindings.forbidden_imports(imports, [("a/{", "x::y")]).collect()} == {("x::y", None), ("x::yz", None)}


def test_walk_describes_files_and_tells_the_large_ones(spark, tmp_path):
    (tmp_path / "tickets").mkdir()
    (tmp_path / "tickets" / "a.md").write_bytes(b"# A\r\ntext [b](b.md#x \"t\")\r\n## B c\r\nend")
    (tmp_path / "b.yaml").write_text("k: 1\n  - j:\n")
    (tmp_path / "big.py").write_text("x" * 100)
    (tmp_path / "skip.log").write_text("x")
    found, over = files.walk(spark, str(tmp_path), ("**/*.log",), cap=60)
    got = {r.path: (r.lang, r.role) for r in found.collect()}
    assert got == {"tickets/a.md": ("markdown", "ledger"), "b.yaml": ("yaml", "source")}
    assert [(r.path, r.size) for r in over.collect()] == [("big.py", 100)]
    assert [(r.line, r.level, r.slug) for r in files.headings(found).orderBy("line").collect()] == [(0, 1, "a"), (2, 2, "b-c")]
    assert [(r.line, r.target) for r in files.links(found).collect()] == [(1, "b.md#x")]
    assert [(r.line, r.depth, r.key) for r in files.keys(found.filter("lang = 'yaml'")).orderBy("line").collect()] == [(0, 0, "k"), (1, 2, "j")]
    symbols, unread = files.symbols(found)
    assert [(r.name, r.start, r.end) for r in symbols.orderBy("start").collect()] == [("A", 0, 3), ("B c", 2, 3)]
    assert [r.path for r in unread.collect()] == ["b.yaml"]

    def broken(path, text):
        raise RuntimeError(path)

    symbols, unread = files.symbols(found, {"markdown": broken})
    assert symbols.count() == 0 and unread.count() == 2
    with pytest.raises(ValueError):
        files.adapter("markdown")(broken)


def test_calls_of_names_that_one_symbol_bears(spark):
    rows = [("a", "f", "g(1); h(2)"), ("b", "g", ""), ("b", "h", ""), ("c", "h", "f()")]
    found = spark.createDataFrame(rows, "path string, name string, body string")
    assert {(r.src, r.dst) for r in files.unique_calls(found).collect()} == {("a::f", "b::g"), ("c::h", "a::f")}


def test_lock_files_read_back(spark):
    entries = [{"symref": "b", "sig": 'a "quoted"\\ \n\t\x01', "reason": "é"}, {"symref": "a", "body": "1"}]
    got = files.read_lock(spark, files.write_lock(entries)).collect()
    assert [(r.symref, r.sig, r.body, r.reason) for r in got] == [("a", None, "1", None), ("b", entries[0]["sig"], None, "é")]
    assert files.read_lock(spark, "").count() == 0


def test_lines_and_columns(spark):
    text = F.lit("aé\n\U0001f600b\n")
    got = [value(spark, X.line_at(text, F.lit(i))) for i in (0, 3, 4, 8, 9, 10, 11)]
    assert [g and tuple(g) for g in got] == [(0, 0, 0), (0, 3, 2), (1, 0, 0), (1, 4, 2), (1, 5, 3), (2, 0, 0), None]


def test_reasons_and_colours(spark):
    assert value(spark, X.reason_fault(F.lit("a reason, long"))) == "short" and value(spark, X.reason_fault(F.lit("a reason, longer"))) is None
    assert value(spark, X.reason_fault(F.lit("this is N/A for all files"))) == "banned"
    assert value(spark, X.to_hex(*(X.hsl_colour(F.lit("hsl(30, 100%, 50%)"))[c] for c in "rgb"))) == "#ff8000"
    assert value(spark, X.hsl_colour(F.lit("hsl(x)"))) is None and value(spark, X.rgb_colour(F.lit("rgb(1,2)"))) is None


def observed(spark, *rows):
    schema = "subject int, selected int, unseen string, kind string, lo long, hi long, poisoned boolean, reason string"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def test_what_a_rule_could_not_examine_is_not_clean(spark):
    rows = observed(spark, (2, None, "Exact", 0, 0, False, None), (1, None, "Exact", 0, 0, False, None), (2, "hole", "Exact", 0, 0, False, None), (2, None, "Exact", 0, 0, True, "call"), (2, None, "Bounds", 1, 2, True, "call"), (2, None, "NotApplicable", 0, 0, False, None))
    got = sorted((r.subject, r.verdict, r.reason, r.examined) for r in rules.examine(rows, "P+").collect())
    assert got == [(0, "Clean", None, True), (1, "Unresolved", "unknown", False), (2, "Unresolved", "hole", False), (3, "Unresolved", "call", True), (4, "Unresolved", "call", True), (4, "Violation", None, True), (5, "NotApplicable", None, False)]
    total = rules.conclude(rules.examine(rows, "P+")).first()
    assert (total.subjects, total.examined, total.violations, total.unresolved, total.vacuous, total.truth) == (5, 3, 1, 4, False, 0)
    silent = rules.conclude(rules.examine(rows.filter("kind = 'NotApplicable'"), "P-"), True).first()
    assert (silent.subjects, silent.vacuous, silent.required, silent.truth) == (0, False, False, 1)


RULE = r'''
rule EMP001 "nothing-to-judge" {
  lang *  must_measure  needs config
  find d: document
  where d is toxic
  report d "toxic"
}
'''


def test_a_rule_over_nothing_is_vacuous(spark):
    rule = rulelang.parse(RULE)[0]
    docs = spark.createDataFrame([], "id int, toxic boolean")
    with pytest.raises(rulelang.RuleError):
        rule_plans.report(rule, rule_plans.Catalog({"document": docs}))
    catalog = rule_plans.Catalog({"document": docs}, sides={"config.x": docs})
    assert [(r.reason, r.required, r.n) for r in rule_plans.report(rule, catalog).collect()] == [("vacuous", True, 0)]
    full = rule_plans.Catalog({"document": spark.createDataFrame([(1, True), (2, None), (3, False), (4, None)], "id int, toxic boolean")}, sides={"config.x": docs})
    got = sorted((r.severity, r.subject, r.message, r.reason, r.n) for r in rule_plans.report(rule, full).collect())
    assert [(s, n) for s, *_, n in got] == [("unresolved", 2), ("warn", 1)] and got[0][2] == "2, 4"
    assert codec.decode(codec.encode(rule)) == rule
    with pytest.raises(rulelang.RuleError):
        codec.decode(codec.encode(rule) + b" ")


def test_the_streaming_fold_does_not_mind_the_order_of_arrival(spark, tmp_path):
    schema = "ticket string, ms long, title string, state string"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 3, None, "done"), ("a", 1, "first", "open")], schema).write.json(str(tmp_path / "in" / "1"))
    spark.createDataFrame([("a", 2, "second", "active"), ("b", 5, "b", None)], schema).write.json(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").json(str(tmp_path / "in"))
    run = fold_stream(stream, "ticket", ["ms"], ["title", "state"]).writeStream.outputMode("complete").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("folded").collect()} == {("a", "second", "done"), ("b", "b", None)}


def test_a_scan_reads_tickets_and_tells_what_it_cannot(spark):
    from trivium.operators import log

    tree = spark.createDataFrame([("tickets/b/ticket.json", '{"title": "two", "parent": "a"}'), ("tickets/a/ticket.json", '{"title": "one"}'), ("tickets/c/ticket.json", "{no"), ("tickets/a/events/1.json", "{}"), ("src/tickets/d/ticket.json", "{}")], "path string, text string")
    found, unread = log.scan_at(tree, "text", "title string, parent string")
    assert [(r.id, r.title, r.parent) for r in found.collect()] == [("a", "one", None), ("b", "two", "a")]
    assert [r.path for r in unread.collect()] == ["tickets/c/ticket.json"]
    more = found.withColumns({"category": F.lit("open"), "type": F.lit("task")})
    assert [tuple(r) for r in log.summaries(more, spark.createDataFrame([("b",), ("x",)], "id string")).collect()] == [("b", "two", "open", "task")]
    assert [tuple(r) for r in log.children(more).collect()] == [("a", "b", "two", "open")]


@pytest.mark.parametrize("glob,want", [("a/**", True), ("", False), ("{a,{b}}", True), ("{a", False), ("a}", False), ("[x", False), ("[]x]", True), ("a/../b", False), ("..a", True), (None, None)])
def test_globs_that_can_be_read(spark, glob, want):
    from trivium.functions import text as X

    assert spark.range(1).select(X.valid_glob(F.lit(glob).cast("string")).alias("v")).first().v is want


def test_days_and_private_terms(spark):
    from trivium.functions import text as X

    row = spark.range(1).select(X.day_of(X.instant(F.lit(-1))).cast("string").alias("a"), X.plus_days(F.lit("2024-02-28").cast("date"), 2).cast("string").alias("b"), X.plus_days(F.lit("9999-12-31").cast("date"), 1).alias("c"), X.private_terms(F.lit("Acme's ACME+ acmes (Ann Lee) Ann"), ("acme", "acme+", "ann", "ann lee"), "$1").alias("d")).first()
    assert tuple(row) == ("1969-12-31", "2024-03-01", None, "$1's $1 acmes ($1) $1")
