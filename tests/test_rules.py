"""The rule language, selectors, and decisions over work, on small tables."""

import pytest
from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.operators import planning, relation, selectors, workflow
from trivium.plans import rule_plans, rulelang, rules
from trivium.sources import checkpoint_folder


@pytest.fixture(scope="module")
def catalog(spark):
    checkpoint_folder(spark)
    functions = spark.createDataFrame(
        [("f1", "main", True, "a", 0, 100, 1, None), ("f2", "helper", None, "a", 10, 50, 3, "f1"), ("f3", "late", False, "b", 0, 9, 1, None), ("f4", None, True, "b", 20, 30, 5, None)],
        "id string, name string, public boolean, file string, start int, end int, line int, parent string",
    )
    tests = spark.createDataFrame([("t1", "check_main"), ("t2", "late")], "id string, name string")
    comments = spark.createDataFrame([("c1", "a", 12, 15, 2, "TODO x"), ("c2", "b", 40, 45, 9, "done")], "id string, file string, start int, end int, line int, text string")
    calls = spark.createDataFrame([("t1", "f1", 2), ("f1", "f2", 1), ("f2", "f3", 2)], "src string, dst string, truth tinyint")
    rows = spark.createDataFrame([("ma*",), ("{late,x}",)], "pattern string")
    return rule_plans.Catalog({"function": functions, "test": tests, "comment": comments}, {"calls": calls}, {"config.names": rows})


def verdicts(catalog, body, header="", **knobs):
    rule = rulelang.parse(f'rule T001 "t" {{ {header}\n{body} }}')[0]
    return {r.subject: r.verdict for r in rule_plans.evaluate(rule, catalog, knobs).collect()}


CASES = [
    ("flag", "find f: function\nwhere f is public\nreport f \"x\"", "", dict(f1="Violation", f2="Unresolved", f3="Clean", f4="Violation")),
    ("not", "find f: function\nwhere not f is public\nreport f \"x\"", "", dict(f1="Clean", f2="Unresolved", f3="Violation", f4="Clean")),
    ("null name is unknown", "find f: function\nwhere f.name == \"main\"\nreport f \"x\"", "", dict(f1="Violation", f2="Clean", f3="Clean", f4="Unresolved")),
    ("regex", "find f: function where exists f.name\nwhere f.name ~ /^MA|er$/i\nreport f \"x\"", "", dict(f1="Violation", f2="Violation", f3="Clean")),
    ("equality, unknown side", "find f: function\nwhere some t: test where t.name == f.name\nreport f \"x\"", "", dict(f1="Clean", f2="Clean", f3="Violation", f4="Unresolved")),
    ("edge", "find f: function\nwhere some t: test where t calls f\nreport f \"x\"", "polarity P-", dict(f1="Clean", f2="Violation", f3="Violation", f4="Violation")),
    ("reach", "find f: function\nwhere some t: test where t reaches f via calls within 3\nreport f \"x\"", "polarity P-", dict(f1="Clean", f2="Unresolved", f3="Unresolved", f4="Violation")),
    ("reach too short", "find f: function\nwhere no t: test where t reaches f via calls within knob.n\nreport f \"x\"", 'knob n: int = 2 "steps"', dict(f1="Clean", f2="Unresolved", f3="Violation", f4="Violation")),
    ("strength", "find f: function\nwhere f possibly calls function\nreport f \"x\"", "", dict(f1="Violation", f2="Violation", f3="Clean", f4="Clean")),
    ("sure", "find f: function\nwhere f certainly calls function\nreport f \"x\"", "", dict(f1="Clean", f2="Violation", f3="Clean", f4="Clean")),
    ("inside a shape", "find c: comment\nwhere c inside function(name = \"helper\")\nreport c \"x\"", "", dict(c1="Violation", c2="Clean")),
    ("has", "find f: function\nwhere f has comment\nreport f \"x\"", "", dict(f1="Violation", f2="Violation", f3="Clean", f4="Clean")),
    ("directly", "find f: function\nwhere some g: function where f directly inside g\nreport f \"x\"", "", dict(f1="Clean", f2="Violation", f3="Clean", f4="Clean")),
    ("count", "find f: function\nwhere count(c: comment where c.file == f.file) + 1 >= 2\nreport f \"x\"", "", dict(f1="Violation", f2="Violation", f3="Violation", f4="Violation")),
    ("side table", "find row: config.names\nfind f: function where f.name matches row.pattern\nreport f \"x\"", "", dict(f1="Violation", f3="Violation", f4="Unresolved")),
    ("reports in order", "find f: function\nreport f \"public\" when f is public\nreport f \"main\" when f.name == \"main\"", "", dict(f1="Violation", f2="Unresolved", f3="Clean", f4="Violation")),
    ("doubt", "find f: function\nwhere f is public\nreport f \"x\"\nunresolved when f.file == \"b\" because \"odd\"", "", dict(f1="Violation", f2="Unresolved", f3="Unresolved", f4="Unresolved")),
    ("macro", "def deep(x) = x.start > 5 and x.end in 40..60\nfind f: function\nwhere deep(f)\nreport f \"x\"", "", dict(f1="Clean", f2="Violation", f3="Clean", f4="Clean")),
    ("any", "find f: function\nwhere any { f.line in [1, 5], f is public }\nreport f \"x\"", "", dict(f1="Violation", f2="Unresolved", f3="Violation", f4="Violation")),
]


@pytest.mark.parametrize("name,body,header,want", CASES, ids=[c[0] for c in CASES])
def test_rule(catalog, name, body, header, want):
    assert verdicts(catalog, body, header) == want


def test_knobs_and_messages(catalog):
    rule = rulelang.parse('rule T002 "t" { knob most: int = 60 "m"\nfind f: function\nwhere f.end > knob.most\nreport f "{f.name} in {f.file}" }')[0]
    assert {r.message for r in rule_plans.findings(rule_plans.evaluate(rule, catalog)).collect()} == {"main in a"}
    assert rule_plans.findings(rule_plans.evaluate(rule, catalog, {"most": 20})).count() == 3
    with pytest.raises(rulelang.RuleError):
        rule_plans.evaluate(rule, catalog, {"least": 1})


@pytest.mark.parametrize(
    "body,fault",
    [
        ("find f: functon\nreport f \"x\"", "did you mean function"), ("find f: function\nwhere f.nam == \"x\"\nreport f \"x\"", "did you mean f.name"),
        ("find f: function\nwhere some t: test where t.name != f.name\nreport f \"x\"", "links t"), ("find f: function\nfind t: test\nreport f \"x\"", "links t"),
        ("find f: function\nwhere f reaches f via calls within 2000\nreport f \"x\"", "1 to 1024"), ("find f: function\nwhere f.name ~ /a(?=b)/\nreport f \"x\"", "look-around"),
        ("find f: function\nwhere g(f)\nreport f \"x\"", "definition g"), ("find f: function where some f: test\nreport f \"x\"", "bound twice"),
        ("find f: function", "reports"), ("def a() = b()\nfind f: function\nreport f \"x\"", "not defined before"), ("find f: rust`x`\nreport f \"x\"", "no adapter"), ("find f: `x`\nreport f \"x\"", "no nodes"),
    ],
)
def test_refused(catalog, body, fault):
    with pytest.raises(rulelang.RuleError, match=fault):
        verdicts(catalog, body)


def test_gate_and_tally(spark):
    found = spark.createDataFrame([("A", "warn", None), ("A", "unresolved", "must"), ("B", "error", None)], "rule string, severity string, required string")
    assert {r.rule: (r.error, r.warn, r.unresolved) for r in rules.tally(found, "rule").collect()} == {"A": (0, 1, 1), "B": (1, 0, 0)}
    a = found.filter("rule = 'A'")
    assert [rules.gate(*x).first().failed for x in ((found, "error"), (a, "error"), (a, "warn"), (a, "error", True), (a.limit(0), "warn"))] == [True, False, True, True, False]
    assert [r.rule for r in rules.unmeasured(spark.createDataFrame([("A",), ("C",)], "rule string"), found).collect()] == ["C"]


def test_selectors(spark):
    items = spark.createDataFrame(
        [("src/a.rs", "rust", "fn", {"size": "12 KiB"}, True), ("src/x/b.py", "python", "fn", {}, True), ("docs/c.md", "markdown", "doc", {}, False)], "path string, lang string, kind string, attrs map<string,string>, attrs_provided boolean"
    )
    def truths(text):
        return [r.t for r in items.select(selectors.truth_of(selectors.matches(text)).alias("t")).collect()]

    assert truths('"src/**"') == [2, 2, 0]
    assert truths('"src/**" & !lang(python)') == [2, 0, 0]
    assert truths("attr(size <= 20 KiB)") == [2, 0, 1]
    assert truths("attr(size <= 20 MiB)") == [1, 0, 1]
    assert truths('attr(size = "12 KiB") | kind(doc)') == [2, 0, 2]
    assert truths('("docs/" | lang(rust)) & attr(size ~ 1*)') == [2, 0, 1]
    rows = items.select(selectors.matches('"src/*" | "src/a.rs" | lang(rust)').alias("m")).first().m
    assert [(r.spec, r.truth) for r in rows] == [([2, 2, 0, 0, 0, 0], 2)]
    # Of both the larger pattern part, the predicates added; here and below beside the overlap of patterns, which has steps of its own.
    rows = items.select(selectors.matches('"src/**" & lang(rust) & kind(fn)').alias("m")).first().m
    assert [(r.spec, r.truth) for r in rows] == [([1, 1, -1, 0, 0, 2], 2)]
    for bad in ('"src', "lang(rust) &", '("a"', "lang(a) lang(b)"):
        with pytest.raises(ValueError):
            selectors.matches(bad)


@pytest.mark.parametrize(
    "a,b,want",
    [("src", "src/a.rs", True), ("src/a.rs", "src/b.rs", False), ("src/**", "src/a/b.rs", True), ("src/*.rs", "src/*.py", False), ("a/**/z", "a/b/*", True), ("a/*", "b/**", False), ("a/[xy]", "b/*", True), ("**/x", "a/b/x", True), ("src", "src/*", True), ("a/b", "a/b", True)],
)
def test_globs_overlap(a, b, want):
    assert selectors.globs_overlap(a, b) is want is selectors.globs_overlap(b, a)


def test_globs_overlap_where_a_short_path_matches_both(spark):
    import itertools
    import re

    some = ["a", "a/b", "*", "?", "a*", "*b", "??", "**", "**/b", "a/**", "a/**/b", "*/b", "a**", "a/b*", "*/?", "b", "ab"]
    paths = ["".join(x) for n in range(1, 6) for x in itertools.product("ab/", repeat=n)]
    paths = [p for p in paths if not p.startswith("/") and not p.endswith("/") and "//" not in p]
    takes = {g: {p for p in paths if re.match(X.glob_pattern(g).replace(r"\z", r"\Z"), p) or not re.search("[*?]", g) and p.startswith(g + "/")} for g in some}
    pairs = [(a, b) for a in some for b in some]
    assert {(a, b): selectors.globs_overlap(a, b) for a, b in pairs} == {(a, b): bool(takes[a] & takes[b]) for a, b in pairs}
    frame = spark.createDataFrame([*pairs, ("a", None)], "a string, b string")
    assert {tuple(r) for r in selectors.overlapping(frame, "a", "b").collect()} == {p for p in pairs if takes[p[0]] & takes[p[1]]}


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(X.called_names(F.lit("fn go() { double(triple (1)); println!(x); }\ndef f(x): go(x)"))) == ["double", "triple", "go"]
    assert [one(X.is_ulid(F.lit(t))) for t in ("01M3Z713RETBN30XBC6CK11FBF", "81M3Z713RETBN30XBC6CK11FBF", "01M3Z713RETBN30XBC6CK11FBU")] == [True, False, False]
    assert one(X.redact_homes(F.lit("/home/ann/x C:\\Users\\bob\\y"))) == "/home/<user>/x C:\\Users\\<user>\\y"
    faults = [one(X.reason_fault(F.lit(t))) for t in ("too short", "a temporary workaround for parsers", "this rule ABC123 does not apply here", "the the parser output is generated", "generated parser output, see ADR-0007")]
    assert faults == ["short", "banned", "restates", "repeats", None]
    assert tuple(one(X.hex_colour(F.lit("#F008")))) == (1.0, 0.0, 0.0, 136 / 255)
    assert one(X.hex_colour(F.lit("#12345"))) is None
    assert one(X.to_hex(F.lit(2.5 / 255), F.lit(3.5 / 255), F.lit(2.0))) == "#0204ff"
    assert one(X.identifier(F.lit(" Große  Farbe / 2 "))) == "große-farbe-2"
    for glob, path, want in (("src/**", "src/a/b", True), ("**/x", "x", True), ("a/*.{rs,py}", "a/b.py", True), ("a/?", "a/bc", False), ("a.b", "acb", False)):
        assert one(F.rlike(F.lit(path), X.glob_pattern_column(F.lit(glob)))) is want is one(F.lit(path).rlike(X.glob_pattern(glob)))


def test_positions_move(spark):
    edits = spark.createDataFrame([("t", 1, [1, 2, 3]), ("t", 2, [2, 0, 1]), ("t", 3, [1, 3]), ("u", 5, None)], "id string, at int, moved array<int>")
    asked = spark.createDataFrame([("t", 1, 1), ("t", 1, 2), ("t", 1, 3), ("t", 3, 2), ("u", 1, 1), ("v", 0, 4)], "id string, since int, position int")
    got = {(r.id, r.since, r.position): r.now for r in workflow.remap_positions(edits, asked, "id", "at").collect()}
    assert got == {("t", 1, 1): 3, ("t", 1, 2): None, ("t", 1, 3): 1, ("t", 3, 2): 2, ("u", 1, 1): None, ("v", 0, 4): 4}


def test_work(spark):
    cycles = spark.createDataFrame([(1, 1, 9, None, "closed"), (2, 10, 19, 12, None), (3, 20, 29, None, None)], "id int, start int, end int, ended int, state string")
    assert [[r.id for r in workflow.default_cycle(cycles, F.lit(day)).collect()] for day in (11, 15, 40)] == [[2], [3], []]
    parts = spark.createDataFrame([("2", "core", "fix", "b"), ("1", "core", "fix", "a"), ("3", "core", "odd", "c"), ("4", "app", "add", "d")], "id string, product string, kind string, text string")
    got = [(r.product, r.kind, r.entries) for r in workflow.sections(parts, ["core", "app"], ["add", "fix"]).orderBy("place").collect()]
    assert got == [("core", "fix", ["a", "b"]), ("app", "add", ["d"])]
    names = spark.createDataFrame([(1, c) for c in "dcbaabcd"] + [(2, None)], "g int, n string")
    assert [(r.g, r.first) for r in planning.first_names(names, ["g"], "n", 3).collect()] == [(1, ["a", "b", "c"])]
    guard = workflow.close_guards(F.col("b"), F.lit(False), F.lit(True), F.col("c"), F.lit(0))
    rows = spark.createDataFrame([([True, None], 1), ([], 0), ([True], 0)], "b array<boolean>, c int").select(guard.alias("g"))
    assert [r.g for r in rows.collect()] == [["unbound criteria", "open children"], ["no criteria"], []]
    lock = spark.createDataFrame([(1, "x"), (2, "y")], "k int, f string")
    now = spark.createDataFrame([(1, "x"), (3, "z")], "k int, f string")
    assert {r.k: r.step for r in workflow.ack_plan(now, lock, "k", ["f"]).collect()} == {1: "same", 2: "kept", 3: "acked"}
    assert {r.k: r.step for r in workflow.ack_plan(now, lock, "k", ["f"], True, True, "new format").collect()} == {1: "reattested", 2: "dropped", 3: "acked"}
    with pytest.raises(ValueError):
        workflow.ack_plan(now, lock, "k", ["f"], True)


def test_reach_from(spark):
    checkpoint_folder(spark)
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("c", "a", 2), ("x", "y", 2)], "src string, dst string, truth tinyint")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("y",)], "node string")
    got = {r.node: (r.lo, r.hi) for r in relation.covered_by(nodes, nodes.filter("node = 'a'"), edges).collect()}
    assert got == {"a": (1, 1), "b": (1, 1), "c": (0, 1), "y": (0, 0)}
    assert {r.node for r in relation.reach_from(nodes.filter("node = 'a'"), edges, 1).collect()} == {"a", "b"}


def test_snippets_and_neighbours_drive_bindings(spark):
    """Patterns with holes as sources and conditions; ``adjoins``, ranges and patterns as the only links."""
    nodes = spark.createDataFrame(
        [("a", "n1", None, "unit", "main", 0, 99, 0), ("a", "n2", "n1", "apply", None, 1, 20, 1), ("a", "n3", "n2", "ref", "peer", 2, 5, 2), ("a", "n4", "n2", "literal", "1", 6, 9, 2), ("a", "n5", "n1", "apply", None, 30, 50, 1), ("a", "n6", "n5", "opaque", None, 31, 40, 2), ("a", "n7", "n5", "literal", "2", 41, 44, 2)],
        "artifact string, node_id string, parent_id string, op string, name string, start long, end long, depth int",
    )
    calls = nodes.filter("op = 'apply'").selectExpr("node_id AS id", "artifact AS file", "start", "end", "parent_id AS parent", "cast(start / 10 AS int) AS line")
    notes = spark.createDataFrame([("c1", "a", 0, 4, 0), ("c2", "a", 70, 80, 7), ("c3", "b", 0, 4, 0)], "id string, file string, start long, end long, line int")
    paths = spark.createDataFrame([("g1", "{a,x}"), ("g2", "?/**")], "id string, glob string")
    catalog = rule_plans.Catalog({"call": calls, "note": notes, "owner": paths}, nodes=nodes)
    assert verdicts(catalog, 'find c: roles`apply($F:ref "peer", $$$A)`\nreport c "x"') == {"n2": "Violation"}
    rule = rulelang.parse('rule T003 "t" { find c: `apply($F:ref, $X)`\nreport c "{c.F} of {c.X} in {c.file}" }')[0]
    assert [r.message for r in rule_plans.evaluate(rule, catalog).collect()] == ["n3 of n4 in a"]
    assert verdicts(catalog, 'find c: call\nwhere c is `apply(ref, $$$)` as roles\nreport c "x"') == {"n2": "Violation", "n5": "Unresolved"}
    assert verdicts(catalog, 'find c: call\nwhere c has `literal "2"`\nreport c "x"') == {"n2": "Clean", "n5": "Violation"}
    assert verdicts(catalog, 'find n: note\nfind c: call where n adjoins c\nreport n "x"') == {"c1": "Violation"}
    assert verdicts(catalog, 'find n: note\nwhere some c: call where n after c\nreport n "x"') == {"c1": "Clean", "c2": "Violation", "c3": "Clean"}
    assert verdicts(catalog, 'find u: `unit`\nfind c: call where c inside u\nreport c "x"') == {"n2": "Violation", "n5": "Violation"}
    assert verdicts(catalog, 'find n: note\nfind o: owner where n.file matches o.glob\nreport n "x"') == {"c1": "Violation", "c2": "Violation"}
