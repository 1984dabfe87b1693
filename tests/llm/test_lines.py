"""Operator 12 against brute force, and its runs on their own."""

import random
from collections import Counter

import pytest
from conftest import SCHEMA, make_documents

from trivium.llm import line_dedup

SPACES = b" \t\n\x0b\x0c\r"


def key(line):
    return line.encode().strip(SPACES).lower()


def without_repeats(texts, documents, least=1):
    held = Counter()
    for t in texts:
        held.update({key(x) for x in (t or "").split("\n")})
    gone = {k for k, n in held.items() if n >= documents and len(k.decode()) >= least}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lines_of_documents(seed, n):
    r = random.Random(seed)
    common = ["Menu", "  Über uns \t", "ALL RIGHTS RESERVED\r", "x", " ", "ÄÖ"]
    rows = []
    for i, row in enumerate(make_documents(seed, n)):
        lines = (row[1] or "").split(" ")[:20]
        for _ in range(r.randint(0, 6)):
            line = r.choice(common)
            lines.insert(r.randint(0, len(lines)), r.choice([line, line.upper(), f" {line}", line]))
        rows.append((row[0] if i % 9 else None, "\n".join(lines) if i % 7 else row[1], *row[2:]))
    return rows


@pytest.mark.parametrize("seed,documents,least,batches,fan", [(0, 10, 1, 8, 4), (1, 3, 2, 5, 2), (2, 1, 1, 3, 2), (3, 4, 1, 16, 2)])
def test_lines_equal_brute_force(spark, seed, documents, least, batches, fan):
    rows = lines_of_documents(seed, 80)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = line_dedup.drop_repeated_lines(docs, documents, least, batches, fan).collect()
    want = [(r[0], *w) for r, w in zip(rows, without_repeats([r[1] for r in rows], documents, least))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(w[2] for w in want)


def test_batches_leave_settled_keys_out_and_levels_are_compacted(spark):
    with line_dedup.LineRuns(spark, documents=3, fan=2) as runs:
        for batch in ([(1, 1)] * 3 + [(2, 2)], [(1, 1), (2, 2), (3, 3)], [(2, 2), (1, 1)], [(3, 3)], [(4, 4)]):
            runs.add(spark.createDataFrame(batch, "a long, b long"))
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        held = {r.a: r.documents for run in runs.runs() for r in run.collect()}
        assert held == {1: 3, 2: 3, 3: 2, 4: 1}  # what came of 1 after it had settled was not added
        assert {(r.a, r.b) for r in runs.settled().collect()} == {(1, 1), (2, 2)}
        names = [t for level in runs.levels for t in level]
    assert not any(spark.catalog.tableExists(t) for t in names)


def test_runs_are_merged_without_a_shuffle_or_sort_of_theirs(spark):
    with line_dedup.LineRuns(spark, documents=1) as runs:
        runs.add(spark.range(1000).selectExpr("id AS a", "id AS b"))
        plan = runs.unsettled(spark.range(10).selectExpr("id AS a", "id AS b", "1L AS documents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "SortMergeJoin" in plan


def test_line_dedup_edge_cases(no_documents, odd_documents):
    assert line_dedup.drop_repeated_lines(no_documents).collect() == []
    got = line_dedup.drop_repeated_lines(odd_documents, 3).collect()
    assert sorted((r.n_lines, r.n_dropped, r.kept) for r in got) == [(1, 0, "")] * 2 + [(1, 1, "")] * 3


def test_a_text_of_very_many_lines(spark):
    lines = [f"line {i % 40_000}" if i % 3 else "Again" for i in range(120_000)]
    rows = [(1, "\n".join(lines)), (2, "again"), (3, "other\n AGAIN ")]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert (got[1].n_lines, got[1].n_dropped) == (120_000, 40_000)
    assert got[1].kept == "\n".join(x for x in lines if x != "Again") and got[3].kept == "other"
