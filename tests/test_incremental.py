"""Pattern tables, memos, versions, the streaming log, imports: against brute force and full evaluation."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from trivium.functions import text as X
from trivium.operators import exports, globs, log, memo, snapshots
from trivium.streaming import fold

# Pattern tables


def test_alternatives_nest_and_commas_outside_are_commas():
    assert globs.alternatives("a,b/{c,d}") == ["a,b/c", "a,b/d"]
    assert sorted(globs.alternatives("x{a,{b,c}d}{,y}")) == sorted(["xa", "xbd", "xcd", "xay", "xbdy", "xcdy"])
    assert globs.alternatives("{a") == ["{a"] and globs.alternatives("a}") == ["a}"]


GLOBS = ["src/**", "src/*.rs", "**/mod.rs", "**/*.tar.gz", "**", "*", "docs/{a,b}/*.md", "a,b/{c,d}", "src/{x,{y,z}w}/main.rs", "lib/[a-c]?.rs", "src/x/main.rs", "**/x/**", "{a", "n/[!a]*", None]
PATHS = ["src/x/main.rs", "src/zw/main.rs", "src/y/main.rs", "src/a.rs", "mod.rs", "a/mod.rs", "dist/p.tar.gz", "p.gz", "docs/a/r.md", "docs/c/r.md", "a", "a,b/c", "b/c", "lib/bq.rs", "lib/dq.rs", "q/x/r", "{a", "n/b", "n/a", "top", ".rs"]


def by_regex(path, glob):
    import re

    return any(re.match(X.glob_pattern(a.replace("{", "[{]").replace("}", "[}]")).replace(r"\z", r"\Z"), path) for a in globs.alternatives(glob))


def test_pattern_tables_match_as_each_pattern_does(spark):
    patterns = spark.createDataFrame(list(enumerate(GLOBS)), "pattern int, glob string")
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    got = {(r.path, r.glob) for r in globs.matching(paths, patterns).collect()}
    assert got == {(p, g) for p in PATHS for g in GLOBS if g is not None and by_regex(p, g)}
    assert ("a", "a,b/{c,d}") not in got and ("src/zw/main.rs", "src/{x,{y,z}w}/main.rs") in got
    some = patterns.filter("glob like 'src%'")
    assert {r.path for r in globs.unmatched(paths, some).collect()} == {p for p in PATHS if not any(by_regex(p, g) for g in GLOBS if g and g.startswith("src"))}


def test_patterns_that_are_data_are_read_like_those_that_are_not(spark):
    rows = [(p, g) for p in PATHS for g in GLOBS if g is not None]
    got = spark.createDataFrame(rows, "path string, glob string").select("path", "glob", F.rlike("path", X.glob_pattern_column(F.col("glob"))).alias("hit")).collect()
    assert {(r.path, r.glob) for r in got if r.hit} == {(p, g) for p, g in rows if by_regex(p, g)}


def test_many_patterns_are_joined_by_their_literal_parts(spark):
    patterns = spark.range(100_000).selectExpr("id AS pattern", "concat('src/d', id, '/**/*.{rs,py}') AS glob")
    paths = spark.range(2_000).selectExpr("concat('src/d', id % 500, '/a/f', id, '.', if(id % 2 = 0, 'rs', 'py')) AS path").unionByName(spark.range(500).selectExpr("concat('src/d', id, '/a.md') AS path"))
    pairs = globs.matching(paths, patterns)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs.count() == 2_000


def test_leases_are_resolved_to_files(spark):
    leases = spark.createDataFrame([("L1", "src/**"), ("L2", "src/a/*"), ("L3", "docs/*"), ("L1", "src/a/x")], "lease string, glob string")
    files = spark.createDataFrame([(p,) for p in ("src/a/x", "src/b", "docs/i", "src/Cargo.lock", "z")], "path string")
    shared = spark.createDataFrame([("**/Cargo.lock",)], "glob string")
    assert {tuple(r) for r in globs.resolved_scopes(leases, files, shared).collect()} == {("L1", "src/a/x"), ("L1", "src/b"), ("L2", "src/a/x"), ("L3", "docs/i")}
    assert [(r.path, r.leases) for r in globs.contended(leases, files, shared).collect()] == [("src/a/x", ["L1", "L2"])]
    changed = spark.createDataFrame([("L2", "src/a/x"), ("L2", "src/b"), ("L3", "src/Cargo.lock")], "lease string, path string")
    assert [tuple(r) for r in globs.out_of_scope(changed, leases, shared).collect()] == [("L2", "src/b")]


# Memos and deltas


def test_a_refresh_evaluates_only_what_changed(spark):
    r = random.Random(0)
    reads_of = {k: r.sample(range(40), 3) for k in range(60)}
    value = {i: i * 10 for i in range(35)}  # five inputs are not there
    seen = []

    def evaluator(now):
        def evaluate(todo):
            keys = [x.key for x in todo.collect()]
            seen.append(set(keys))
            fresh = [(k, sum(now.get(i, 0) for i in reads_of[k]), k % 17 == 3) for k in keys]
            return spark.createDataFrame(fresh, "key long, total long, failed boolean"), spark.createDataFrame([(k, i, str(now[i]) if i in now else None) for k in keys for i in reads_of[k]], "key long, input long, digest string")

        return evaluate

    inputs = lambda now: spark.createDataFrame([(i, str(v)) for i, v in now.items()], "input long, digest string")
    wanted = spark.createDataFrame([(k,) for k in range(60)], "key long")
    results, reads = spark.createDataFrame([], "key long, total long"), spark.createDataFrame([], "key long, input long, digest string")
    state = dict(value)
    for change in ({}, {}, {3: 7, 38: 5}, {4: None}, {3: 7}):
        for i, v in change.items():
            state.pop(i, None) if v is None else state.update({i: v})
        results, reads, answer = (x.persist() for x in memo.refresh(results, reads, inputs(state), wanted, evaluator(dict(state)), ["key"]))
        assert {x.key: x.total for x in answer.collect()} == {k: sum(state.get(i, 0) for i in reads_of[k]) for k in range(60)}
        results.count(), reads.count()
    failing = {k for k in range(60) if k % 17 == 3}
    uses = lambda *inputs: {k for k in range(60) if set(inputs) & set(reads_of[k])}
    assert seen == [set(range(60)), failing, failing | uses(3, 38), failing | uses(4), failing]


def test_views_follow_deltas(spark):
    r = random.Random(1)
    rows = lambda n: [(r.randint(0, 8), r.randint(0, 5)) for _ in range(n)]
    left, right = rows(60), rows(40)
    frame = lambda x, v: spark.createDataFrame(x, f"k long, {v} long")
    sums = {"total": F.col("a") * F.col("b")}
    view = memo.sums_of(frame(left, "a").join(frame(right, "b"), "k"), ["k"], sums)
    for _ in range(3):
        new_left, new_right = left[r.randint(0, 9) :] + rows(4), right[r.randint(0, 9) :] + rows(3)
        d_left, d_right = memo.changes(frame(left, "a"), frame(new_left, "a")), memo.changes(frame(right, "b"), frame(new_right, "b"))
        delta = memo.joined(frame(left, "a"), d_left, frame(right, "b"), d_right, ["k"])
        view = memo.summed(view, delta, ["k"], sums)
        view = spark.createDataFrame(view.collect(), view.schema)
        left, right = new_left, new_right
        full = memo.sums_of(frame(left, "a").join(frame(right, "b"), "k"), ["k"], sums)
        assert sorted(map(tuple, view.collect())) == sorted(map(tuple, full.collect()))


# Versions


def rows_at(store, version=None):
    return sorted(map(tuple, store.read(version).collect()))


def test_versions_are_compared_and_set(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "index"), ["id"])
    assert store.version() is None
    tickets = lambda *x: spark.createDataFrame(list(x), "id string, title string")
    first = store.rebuild(tickets(("a", "one"), ("b", "two")), "k1")
    second = store.apply(tickets(("b", "2"), ("c", "three")), "k1", "k2")
    assert rows_at(store) == [("a", "one"), ("b", "2"), ("c", "three")] and rows_at(store, first) == [("a", "one"), ("b", "two")]
    assert store.apply(tickets(("d", "four")), "k1", "k3") is None and store.version() == second
    version, rebuilt = store.refresh(tickets(("d", "four")), "k1", "k3", lambda: tickets(("d", "all")))
    assert rebuilt and version.key == "k3" and rows_at(store) == [("d", "all")]
    for i in range(12):
        assert store.apply(tickets(("d", str(i)), (f"n{i}", "new")), f"k{i + 3}", f"k{i + 4}")
    assert len(store.version().parts) <= snapshots.MOST_PARTS and len(rows_at(store)) == 13
    assert [r.title for r in store.get(tickets(("d", ""), ("zz", ""))).collect()] == ["11"]
    assert store.vacuum(1) and len(rows_at(store)) == 13


def test_of_two_writers_one_wins(spark, tmp_path):
    folder = str(tmp_path / "index")
    snapshots.Snapshots(spark, folder, ["id"]).rebuild(spark.createDataFrame([("a", "0")], "id string, title string"), "k0")
    done, gate = {}, threading.Barrier(4)

    def write(name):
        store = snapshots.Snapshots(spark, folder, ["id"])
        changed = spark.createDataFrame([(name, "x")], "id string, title string")
        held, commit = store.version(), store._commit
        store.version = lambda: held
        store._commit = lambda *x: (gate.wait(60), commit(*x))[1]  # all have read the version before any commits
        done[name] = store.apply(changed, "k0", f"by {name}")

    threads = [threading.Thread(target=write, args=(n,)) for n in "pqrs"]
    [t.start() for t in threads], [t.join() for t in threads]
    won = [n for n, v in done.items() if v]
    store = snapshots.Snapshots(spark, folder, ["id"])
    assert len(done) == 4 and len(won) == 1 and store.version().key == f"by {won[0]}" and rows_at(store) == sorted([("a", "0"), (won[0], "x")])


# The streaming log


@pytest.mark.parametrize("chunk", [2, 256])
def test_a_log_out_of_order_folds_as_the_whole(spark, tmp_path, chunk):
    r = random.Random(chunk)
    changes, value = [], {}
    for i in range(240):
        ticket, name = f"t{r.randint(0, 5)}", r.choice(["title", "category"])
        old = value.get((ticket, name), "new" if name == "category" else None)
        old = r.choice([old, old, old, "other"])
        value[ticket, name] = str(r.randint(0, 9))
        changes.append((ticket, name, i // 3, i, f"e{i:03}", old, value[ticket, name]))
    sent = changes + r.sample(changes, 40)  # some arrive twice
    r.shuffle(sent)
    schema = "ticket string, field string, ms long, at long, id string, old string, new string"
    folder, out = tmp_path / "in", str(tmp_path / "out")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    fold.stateful(spark)
    try:
        for part in range(2):  # the stream stops and is taken up again
            for i, batch in enumerate((sent[:140], sent[140:])[part][at : at + 35] for at in range(0, 140, 35)):
                spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder / f"f{part}{i}"))
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
            rows = fold.fold_log(stream.withColumn("at", F.timestamp_micros("at")), {"category": "new"}, chunk)
            keep = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
            rows.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    fields, conflicts = fold.settle(spark.read.parquet(out))
    whole = spark.createDataFrame(changes, schema)
    want = log.field_conflicts(whole.withColumn("first", F.when(F.col("field") == "category", "new")), ["ms", "at", "id"])
    want = {(x.ticket, x.field, x.id) for x in want.collect() if x.old != (x.found if x.found is not None else x.first)}
    assert {(x.ticket, x.field): x.value for x in fields.collect()} == value
    assert {(x.ticket, x.field, x.id) for x in conflicts.collect()} == want and want


# Imports

ENTRIES = "module string, name string, kind string, target string, start string, path array<string>, public boolean, status int"


def meaning(asks, entries, most=exports.MOST_NAMES):
    held = {(e[0], e[1]) for e in entries if e[2] != "glob"}
    out = {}
    for ask, writer, module, path in asks:
        found, seen, work = {}, set(), [(writer, module, tuple(path), 2)]
        while work:
            state = work.pop()
            if state in seen or not state[2] or len(state[2]) > most:
                continue
            seen.add(state)
            writer_, module_, (name, *rest), t = state
            for m, n, kind, target, start, p, public, status in entries:
                if m != module_ or not (public or writer_ == m or writer_.startswith(m + "::")):
                    continue
                u = min(t, status)
                if kind == "glob":
                    if (m, name) not in held:
                        work.append((m, start, (*p, name, *rest), u))
                elif n == name:
                    if kind == "alias":
                        work.append((m, start, (*p, *rest), u))
                    elif not rest:
                        found[target] = max(u, found.get(target, 0))
                    elif kind == "module":
                        work.append((writer_, target, tuple(rest), u))
        out[ask] = found
    return out


def random_entries(seed):
    r = random.Random(seed)
    modules = [f"m{i}" for i in range(6)] + ["m0::in", "m1::in"]
    names = "abcde"
    out = []
    for i in range(40):
        kind = r.choice(["decl", "decl", "module", "alias", "alias", "glob"])
        target = f"s{i}" if kind == "decl" else r.choice(modules) if kind == "module" else None
        path = [r.choice(names) for _ in range(r.randint(1, 3) if kind == "alias" else r.randint(0, 1))] if kind in ("alias", "glob") else None
        out.append((r.choice(modules), None if kind == "glob" else r.choice(names), kind, target, r.choice(modules) if path is not None else None, path, r.random() < 0.8, r.choice([2, 2, 1])))
    return modules, names, out


@pytest.mark.parametrize("seed", range(3))
def test_paths_mean_what_a_search_finds(spark, seed):
    modules, names, entries = random_entries(seed)
    r = random.Random(seed)
    asks = [(i, m, m, [r.choice(names) for _ in range(r.randint(1, 2))]) for i, m in enumerate(modules * 4)]
    want = meaning(asks, entries, 8)
    before, exports.MOST_NAMES = exports.MOST_NAMES, 8
    try:
        got = exports.resolve_imports(spark.createDataFrame([(a, m, p) for a, _, m, p in asks], "ask long, module string, path array<string>"), spark.createDataFrame(entries, ENTRIES)).collect()
    finally:
        exports.MOST_NAMES = before
    for x in got:
        found = want[x.ask]
        assert x.targets == sorted(found)
        assert x.status == ("Unknown" if not found else "Must" if len(found) == 1 and min(found.values()) == 2 else "May")
    assert len(got) == len(asks) and {x.status for x in got} > {"Unknown"}


def test_a_root_makes_public_what_can_be_reached_through_public_names(spark):
    entries = [
        ("root", "api", "module", "root::api", None, None, True, 2), ("root", "secret", "module", "root::secret", None, None, False, 2),
        ("root::api", "f", "decl", "F", None, None, True, 2), ("root::api", "hidden", "decl", "H", None, None, False, 2),
        ("root::secret", "g", "decl", "G", None, None, True, 2), ("root::secret", "h", "decl", "H2", None, None, True, 2), ("root::secret", "p", "decl", "P", None, None, False, 2),
        ("root", "g2", "alias", None, "root", ["secret", "g"], True, 2), ("root::api", None, "glob", None, "root::secret", [], True, 1),
        ("root::api", "h", "decl", "own h", None, None, True, 2), ("root", "loop", "alias", None, "root", ["loop"], True, 2),
    ]
    got = exports.public_api(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame([("root",)], "root string")).collect()
    assert {(x.target, x.truth) for x in got} == {("root::api", 2), ("F", 2), ("G", 2), ("own h", 2)}


def test_public_names_take_paths_of_any_length(spark):
    deep = [(f"m{i}", "n", "module", f"m{i + 1}", None, None, True, 1 if i == 9 else 2) for i in range(20)]
    entries = [
        *deep, ("m20", "far", "decl", "FAR", None, None, True, 2), ("root", "x", "alias", None, "m0", ["n"] * 20 + ["far"], True, 2),
        ("root", "more", "alias", None, "root", ["more", "more"], True, 2), ("root", None, "glob", None, "root", ["z"], True, 2), ("root", "y", "alias", None, "root", ["more", "far"], True, 2),
    ]
    rows = spark.createDataFrame(entries, ENTRIES)
    names = {(x.name, x.target, x.truth) for x in exports.public_names(rows).filter("module = 'root'").collect()}
    assert names == {("x", "FAR", 1)}
    assert not exports.public_names(rows, 12).filter("module = 'root'").collect()


@pytest.mark.parametrize("seed", range(2))
def test_paths_of_any_length_mean_what_a_search_finds(spark, seed):
    modules, names, entries = random_entries(seed)
    r = random.Random(seed)
    asks = [(str(i), m, m, [r.choice(names) for _ in range(r.randint(1, 2))]) for i, m in enumerate(modules * 3)]
    got = exports.meant(spark.createDataFrame(asks, "ask string, writer string, module string, path array<string>"), spark.createDataFrame(entries, ENTRIES)).collect()
    want = {(a, target, t) for a, found in meaning(asks, entries, 12).items() for target, t in found.items()}
    assert {(x.ask, x.target, x.truth) for x in got} == want


def test_every_module_is_a_root_of_the_public_api(spark, tmp_path):
    from trivium.plans import pattern_queries

    spark.range(400).selectExpr("id AS p_partkey", "CAST(id * 7 % 50 + 1 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    own = {x.module for x in pattern_queries.entries(spark, str(tmp_path)).filter("public and kind in ('decl', 'module')").collect()}
    assert len(own) > 30 and own <= {x.root for x in pattern_queries.public_api(spark, str(tmp_path)).collect()}
