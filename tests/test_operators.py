"""Truth tables and small cases of the operators."""

import pytest
from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.functions import truth as T
from trivium.operators import certain, diffs, ledger, links, planning, relation, spans
from trivium.plans import rules
from trivium.sources import checkpoint_folder


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_kleene(spark):
    y, u, n = (T.truth(i) for i in (2, 1, 0))
    assert [value(spark, c) for c in (T.both(y, u), T.both(n, u), T.either(y, u), T.either(n, u), T.negate(u), T.lift(F.lit(None).cast("boolean")))] == [1, 0, 2, 1, 1, 1]
    rows = spark.createDataFrame([(2,), (1,), (0,)], "t tinyint")
    assert tuple(rows.agg(T.every(F.col("t")), T.some(F.col("t"))).first()) == (0, 2)
    assert tuple(rows.filter("t < 2").agg(T.some(F.col("t")), T.none(F.col("t"))).first()) == (1, 1)
    assert tuple(rows.filter("false").agg(T.every(F.col("t")), T.some(F.col("t")), T.none(F.col("t"))).first()) == (2, 0, 2)


def test_closure(spark):
    checkpoint_folder(spark)
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("c", "a", 2)], "src string, dst string, truth tinyint")
    got = {(r.src, r.dst): r.truth for r in relation.reaches(edges).collect()}
    assert (got["a", "b"], got["a", "c"], got["a", "a"], got["c", "b"], got["b", "b"]) == (2, 1, 1, 2, 1)
    assert {(r.src, r.dst): r.truth for r in relation.compose(edges, edges).collect()}["a", "c"] == 1
    assert {(r.src, r.dst) for r in relation.reaches(edges, 1).collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    with pytest.raises(ValueError):
        relation.reaches(edges, 0)


@pytest.mark.parametrize(
    "polarity,threshold,lo,hi,want",
    [
        ("P+", None, 1, 1, ["Violation"]), ("P+", None, 1, 2, ["Unresolved", "Violation"]), ("P+", None, 0, 0, ["Clean"]), ("P+", None, 0, 1, ["Unresolved"]),
        ("P-", None, 0, 0, ["Violation"]), ("P-", None, 1, 1, ["Clean"]), ("P-", None, 0, 1, ["Unresolved"]),
        ("Pn max", 2, 3, 3, ["Violation"]), ("Pn max", 2, 1, 2, ["Clean"]), ("Pn max", 2, 2, 3, ["Unresolved"]),
        ("Pn min", 2, 0, 1, ["Violation"]), ("Pn min", 2, 2, 5, ["Clean"]), ("Pn min", 2, 1, 2, ["Unresolved"]),
    ],
)
def test_polarity(spark, polarity, threshold, lo, hi, want):
    got = rules.judge(spark.createDataFrame([("s", lo, hi)], "s string, lo long, hi long"), polarity, threshold).collect()
    assert sorted(r.verdict for r in got) == want


def test_threshold_is_required(spark):
    with pytest.raises(ValueError):
        rules.verdicts("Pn max", F.lit(1), F.lit(1))


def test_owners(spark):
    def owner(*candidates):
        rows = spark.createDataFrame([(1, *c) for c in candidates], "item int, entity string, specificity int, must boolean")
        r = certain.owners(rows).first()
        return r.status, r.owners

    assert owner(("broad", 1, True), ("narrow", 2, True)) == ("Must", ["narrow"])
    assert owner(("a", 2, True), ("b", 2, True), ("c", 1, True)) == ("Unknown", ["a", "b"])
    assert owner(("a", 2, True), ("b", 2, True), ("c", 3, False)) == ("May", ["a", "b", "c"])
    assert owner(("a", 1, False), ("b", 2, False)) == ("May", ["a", "b"])
    assert owner(("a", 2, True), ("b", 3, False), ("c", 1, True)) == ("May", ["a", "b"])


def test_paths_and_slugs(spark):
    path = lambda p, f: value(spark, X.resolve_path(F.lit(p), F.lit(f)))
    assert (path("../a/./b.md", "docs"), path("../../x", "docs"), path("/top.md", "docs")) == ("a/b.md", None, "top.md")
    assert value(spark, X.slug(F.lit("A [link](x) & More_words"))) == "a-link--more_words"
    assert tuple(value(spark, X.quantity(F.lit("12 KiB")))) == (12.0, "KiB")
    assert [value(spark, X.age(F.lit(s))) for s in (59, 7200, 90000)] == ["0m", "2h", "1d"]


def test_greedy_fill_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("g", i, i, s) for i, s in enumerate([5, 8, 3, 2])], "g string, item int, rank int, size int")
    got = {r.item: r.picked for r in planning.greedy_fill(rows, "g", ["rank"], "size", 10).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}


def test_anti_join_keeps_uncertainty(spark):
    outer = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    inner = spark.createDataFrame([(1, 2), (2, 1), (2, 0)], "k int, t tinyint")
    assert {r.k: r.truth for r in certain.absent(outer, inner, ["k"], F.col("t")).collect()} == {1: 0, 2: 1, 3: 2}


def test_glob_patterns():
    import re

    hit = lambda g, p: re.match(X.glob_pattern(g).replace(r"\z", r"\Z"), p) is not None
    assert hit("a/*/c", "a/b/c") and not hit("a/*/c", "a/b/b/c") and hit("a/**/c", "a/c") and hit("a/**", "a/b/c.d")
    assert hit("x.{rs,t{o,i}ml}", "x.toml") and not hit("x.rs", "xars") and hit("f[!a]", "fb") and not hit("f[!a]", "f/") and not hit("f?", "f/")
    with pytest.raises(ValueError):
        X.glob_pattern("{a")


def test_lengths_and_versions(spark):
    length = lambda t: tuple(value(spark, X.css_length(F.lit(t))))
    assert [length(t) for t in ("12px", "1.5rem", "0", "50%", "auto", "calc(1px)", "7", "px")] == [("px", 12.0), ("rem", 24.0), ("zero", 0.0), ("percent", None), ("auto", None), ("calc", None), ("other", None), ("other", None)]
    assert value(spark, X.version_key(F.lit("1.10")) > X.version_key(F.lit("1.9.3")))


def test_ranges_against_brute_force(spark):
    import random

    rng = random.Random(2)
    outer = [(rng.randrange(3), i, a := rng.randrange(10**rng.randint(1, 6)), a + rng.randrange(10**rng.randint(1, 6))) for i in range(150)] + [(0, 150, None, 5)]
    inner = [(rng.randrange(3), i, a := rng.randrange(10**rng.randint(1, 6)), a + rng.randrange(40)) for i in range(150)]
    o = spark.createDataFrame(outer, "p int, x int, from long, to long")
    got = {r.k: r.x for r in spans.tightest(spark.createDataFrame(inner, "p int, k int, start long, end long"), o, ["p"], "k", "x").collect()}
    around = lambda p, s, e: min(((t - f, x) for q, x, f, t in outer if q == p and f is not None and f <= s and e <= t), default=(0, None))[1]
    assert got == {k: around(p, s, e) for p, k, s, e in inner}
    bound = {r.k: r.x for r in spans.bind(spark.createDataFrame([(p, k, s) for p, k, s, _ in inner], "p int, k int, line long"), o, ["p"], "k", "x", 50).collect()}
    ahead = lambda p, s: min(((f, f - t, x) for q, x, f, t in outer if q == p and f is not None and s < f <= s + 50), default=(0, 0, None))[2]
    assert bound == {k: around(p, s, s) if ahead(p, s) is None else ahead(p, s) for p, k, s, _ in inner}


def test_blocked_and_merged(spark):
    tickets = spark.createDataFrame([(1, "todo"), (2, "done"), (3, "todo"), (4, "done")], "id int, category string")
    links = spark.createDataFrame([(1, "blocked-by", 3), (2, "blocks", 3), (9, "blocks", 3), (3, "blocks", 4), (3, "relates", None)], "src int, kind string, dst int")
    assert {r.id: r.blocked for r in ledger.with_blocked(tickets, links).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert ledger.dangling(links, tickets).count() == 0
    log = lambda *r: spark.createDataFrame(list(r), "id int, v string")
    assert {tuple(r) for r in diffs.merge_events(log((1, "a")), log((1, "b"), (2, "c"))).collect()} == {(1, "a"), (2, "c")}
    same = diffs.identity_delta(F.lit("a"), F.lit(None).cast("string"), F.lit("a"), F.lit(None).cast("string"))
    assert value(spark, same) == "Modified"


def test_broken_links_of_every_form(spark):
    pages = spark.createDataFrame([("en/a", ["top", "two-words"]), ("en/b.html", []), ("unread", None)], "path string, slugs array<string>")
    fine = ["b.html", "/en/a#top", "#Two words", "?page=2", "../en/a?q#x", "a?q=1#zz", "/unread#any", "b.html#", "/", "https://x.y/z", "//x/y", "./a#top?q"]
    bad = {"no.": "missing", "/et.": "missing", "x": "missing", "../x?q=1": "missing", "../../x": "leaves", "#none": "anchor", "b.html#top": "anchor", "/en/a?q=1#top": None, "/en/a#none": "anchor", "c#top": "missing"}
    rows = spark.createDataFrame([("en/a", "/en/", t) for t in [*fine, *bad]], "path string, folder string, target string")
    got = {r.target: r.problem for r in links.broken(rows, pages).collect()}
    assert got == {t: p for t, p in bad.items() if p}


def test_broken_link_anchor_judges_all_internal_links(spark, tmp_path):
    import __spark_entry__ as entry

    html = '<h1>A <b>big</b> &amp; title</h1><a href="/et."><a href="x"><a href="../../.."><a href="#a-big--title"><a href="#no"><a href="2.html?p=1">'
    spark.createDataFrame([(1, "http://h/en/1?q=1", html), (2, "http://h/en/2.html#top", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.target, r.problem) for r in entry.queries()["broken_link_anchor"](spark, str(tmp_path)).collect()}
    assert got == {("/et.", "missing"), ("x", "missing"), ("../../..", "leaves"), ("#no", "anchor")}


def test_cards_that_are_never_cut(spark):
    cards = spark.createDataFrame([(c, i) for c in ("active", "todo", "expedite") for i in range(5)] + [("done", 9)], "lane string, card int")
    got = planning.columns_with_hidden(cards, "lane", ["card"], 2, F.col("lane").isin("active", "expedite")).collect()
    shown = {}
    for r in got:
        shown.setdefault((r.lane, r.hidden), []).append(r.card)
    assert {k: sorted(v) for k, v in shown.items()} == {("active", 0): [0, 1, 2, 3, 4], ("expedite", 0): [0, 1, 2, 3, 4], ("todo", 3): [0, 1], ("done", 0): [9]}


def test_faults_of_links_and_parents(spark):
    checkpoint_folder(spark)
    links = [(1, "blocks", 2), (3, "blocked-by", 2), (3, "blocks", 1), (4, "blocks", 2), (5, "relates", 6), (6, "relates", 5), (7, "causes", 7), (1, "causes", 2), (2, "blocks", None)]
    links += [(1, "splits", 9), (9, "split-from", 1), (8, "splits", 9), (9, "splits", 8), (1, "duplicates", 2), (2, "duplicates", 3), (5, "duplicated-by", 6), (1, "enabler-for", 10), (11, "enabled-by", 1), (1, "enabler-for", 99), (8, "superseded-by", 9), (8, "supersedes", 9)]
    tickets = spark.createDataFrame([(1, "task", 2), (2, "task", 3), (3, "task", 1), (4, "task", 1), (5, "task", 5), (10, "story", None), (11, None, None)], "id int, type string, parent int")
    got = {tuple(r) for r in ledger.faults(spark.createDataFrame(links, "src int, kind string, dst int"), tickets).collect()}
    want = {("cycle", "blocks", i) for i in (1, 2, 3)} | {("cycle", "parent", i) for i in (1, 2, 3)} | {("cycle", "supersedes", i) for i in (8, 9)}
    assert got == want | {("self", "causes", 7), ("self", "parent", 5), ("origins", "splits", 9), ("duplicate", "duplicates", 2), ("target", "enabler-for", 11), ("target", "enabler-for", 99)}


def test_versions_of_any_length(spark):
    key = lambda v: X.version_key(F.lit(v))
    assert value(spark, F.array(key("1.2.3.4.6") > key("1.2.3.4.5"), key("1.2") == key("1.2.0.0.0.0"), key("1.2.0.0.0.1") > key("1.2"), key("0.0") == key("0"), key("2") > key("1.9.9.9.9"))) == [True] * 5


def test_range_joins_send_no_side_whole_to_every_executor(spark):
    from trivium.operators import tree

    nodes = spark.range(20).selectExpr("0L AS artifact", "id AS node_id", "'unit' AS op", "'n' AS name", "id AS start", "40 - id AS end", "cast(id AS int) AS depth", "2 AS status")
    found = tree.chain_status(nodes)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20


def test_rounds_find_an_unknown_end_once(spark):
    from trivium.operators import relation

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", None), ("b", None)], "src string, dst string")
    rows = relation.reach_pairs(spark.createDataFrame([("a", "a")], "seed string, node string"), edges).collect()
    assert sorted((r.node for r in rows), key=repr) == ["a", "b", "c", None]


def test_long_rings_take_few_rounds(spark):
    from trivium.operators import relation

    n = 300
    ring = [(i, (i + 1) % n) for i in range(n)]
    tail = [(n + i, n + i + 1) for i in range(n)] + [(2 * n, 0)]
    # A ring whose one long way round passes a node with two edges out.
    wide = [(1000 + i, 1000 + (i + 1) % n) for i in range(n)] + [(1007, 1100), (1007, 5000), (5000, 5001)]
    spark.sparkContext.setJobGroup("rings", "rings")
    got = relation.on_cycles(spark.createDataFrame(ring + tail + wide, "src long, dst long")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rings"))
    spark.sparkContext._jsc.clearJobGroup()
    assert {r.node: r.ring for r in got} == {i: n - 1 for i in range(n)} | {1000 + i: 1000 + n - 1 for i in range(n)}
    assert jobs < n, jobs


@pytest.mark.parametrize("most", [4, 30, 200_000])
def test_rings_are_settled_within_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(relation, "ONE_TASK", most)
    blocks = [(20 * k + i, 20 * k + (7 * i + k) % 20) for k in range(30) for i in range(20)]
    wide = [(19 + 20 * k, 20 * (k + 1)) for k in range(10)] + [(205, 3), (3, 599)] + [(599, 20 * k + 2) for k in range(30)]  # across ranges, and one node with many edges
    edges = sorted({(a, b) for a, b in blocks + wide})
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {}
    for a in range(600):
        reach[a], open_ = set(), list(after.get(a, ()))
        while open_:
            if (b := open_.pop()) not in reach[a]:
                reach[a].add(b)
                open_ += after.get(b, ())
    got = relation.on_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert sorted((r.node, r.ring) for r in got) == [(a, max(b for b in reach[a] if a in reach[b])) for a in range(600) if a in reach[a]]


def test_guesses_of_sizes_do_not_grow_with_rounds(spark):
    # Spark multiplies them at joins: with rounds that join rows with themselves their digits doubled each round.
    chain = spark.createDataFrame([(i, (i + 1) % 200) for i in range(200)], "node long, to long")
    for rows in relation._pure_rings(chain):
        guess = str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        assert len(guess) < 60, len(guess)


def test_small_graphs_take_few_jobs_to_find_rings(spark):
    # Each job's plan and figures stay with the driver: with hundreds of them its memory grew by 10 MB a second.
    edges = [(20 * k + i, 20 * k + (7 * i + k) % 20) for k in range(30) for i in range(20)]
    spark.sparkContext.setJobGroup("few", "few")
    relation.on_cycles(spark.createDataFrame(edges, "src long, dst long")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs <= 30, jobs


def test_candidates_of_a_body_are_listed_once(spark):
    from trivium.operators import bindings

    lock = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "symref string, body string")
    live = spark.createDataFrame([("n", "x"), ("m", "x"), ("u", None)], "symref string, body string")
    found = bindings.renames(lock, live)
    assert {(r.symref, r.state, tuple(r.candidates)) for r in found.collect()} == {("a", "renamed", ("m", "n")), ("b", "renamed", ("m", "n")), ("c", "undecided", ()), ("d", "undecided", ())}
    lists = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_set" in x]
    assert lists and all("Aggregate [body" in x for x in lists), lists


def test_equal_patterns_meet_the_paths_once(spark):
    from trivium.operators import globs

    paths = spark.createDataFrame([("d/a.txt", 1), ("d/a.txt", 2), ("d/b.md", 1)], "path string, at int")
    patterns = spark.createDataFrame([(1, "d/*.txt"), (2, "d/*.txt"), (2, "d/*.txt"), (3, "{d,e}/b.md"), (4, None)], "pattern int, glob string")
    found = globs.matching(paths, patterns)
    assert sorted(map(tuple, found.select("at", "path", "pattern").collect())) == [(1, "d/a.txt", 1), (1, "d/a.txt", 2), (1, "d/b.md", 3), (2, "d/a.txt", 1), (2, "d/a.txt", 2)]
    taken = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ArrowEvalPython" in x]
    assert taken and all("pattern" not in x for x in taken), taken


def test_each_shard_of_the_index_has_its_own_file(spark, monkeypatch):
    import glob
    import os

    from pyspark.sql import functions as F

    from trivium.llm import common, lexical

    monkeypatch.setattr(lexical, "SHARD_TERMS", 4)
    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text")).coalesce(1)
    with common.scratch(spark):
        index, documents, length = lexical.build_index(docs)
        rows = [spark.read.parquet(f).count() for f in glob.glob(os.path.join(index._trivium_folder, "index", "*.parquet"))]
        assert (documents, length, index.count()) == (8, 16, 4)
        assert sorted(rows) == [1, 1, 1, 1]


def test_few_groups_make_few_files(spark):
    from trivium.llm import exact

    docs = spark.createDataFrame([(i, f"Text {i % 7}") for i in range(50)], "doc_id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = exact.exact_groups(docs)
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert {(r.doc_id, r.keep_id) for r in found.collect()} == {(i, max(j for j in range(50) if j % 7 == i % 7)) for i in range(50)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
