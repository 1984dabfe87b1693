"""Operators 2, 6, 9 and 10 against brute force and edge cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import SCHEMA, make_documents

from trivium.llm import ann, mixing, neardup, suffix
from trivium.llm.common import words
from trivium.llm.suffix_sort import common_prefixes, suffix_array


def closure(links, nodes):
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed,k", [(0, 4), (1, 5), (2, 2)])
def test_near_groups_equal_all_pairs(spark, seed, k):
    rows = make_documents(seed, 90)
    sets = {}
    for d, t, *_ in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(links, sets)
    got = neardup.near_groups(spark.createDataFrame(rows, SCHEMA), k=k).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets[r.doc_id]) for r in got)


def test_near_groups_where_the_centre_is_not_linked(spark):
    """A hub whose variants are linked with it but not with one another, and chains of drifting texts."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(25):
        w = list(base)
        for i in rng.choice(200, 5, replace=False):
            w[i] = f"x{rng.integers(1e6)}"
        texts.append(w)
    drift = list(base)
    for step in range(20):
        drift = list(drift)
        for i in rng.choice(200, 3, replace=False):
            drift[i] = f"y{step}{i}"
        texts.append(drift)
    texts.insert(13, base)
    rows = [(i, " ".join(w), "en", "s", 1, 1, "k") for i, w in enumerate(texts)]
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in neardup.near_groups(spark.createDataFrame(rows, SCHEMA), k=4).collect()}
    assert got == closure(links, sets)


def test_components_of_random_links(spark):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    root = list(range(200))
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.component for x in neardup.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root[x] for a, b in links if a != b for x in (a, b)}


def test_components_of_a_path_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (32, 30), (40, 40)]
    got = {r.node: r.component for r in neardup.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 30 for i in (30, 31, 32)}


def variants(spark):
    """Texts w and v that nothing links, a text near to w and one near to v."""
    w, v = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    return " ".join(w), " ".join(v), " ".join([*w, "x"]), " ".join([*v, "x"])


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 3, 2), (3, 2, 1, 0)])
def test_rows_of_one_identifier_are_one_node(spark, order):
    w, v, wx, vx = variants(spark)
    rows = [(5, w), (5, v), (3, wx), (9, vx)]
    docs = spark.createDataFrame([(*rows[i], 1, 2) for i in order], "doc_id long, text string, _row long, id long").repartition(1)
    assert {(r.doc_id, r.component_id) for r in neardup.near_groups(docs, k=4).collect()} == {(5, 3), (3, 3), (9, 3)}


def test_near_copies_go_by_rows_where_identifiers_repeat(spark):
    w, z, wx, _ = variants(spark)
    rows = [(5, w), (5, z), (3, wx), (None, z), (None, "alone"), (None, ""), (4, None), (4, None)]
    docs = spark.createDataFrame([(d, t, i, "k") for i, (d, t) in enumerate(rows)], "doc_id long, text string, _row long, key string").repartition(2)
    got = neardup.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted([(5, z), (3, wx), (-1, "alone"), (-1, ""), (4, ""), (4, "")])


def test_near_groups_edge_cases(no_documents, odd_documents):
    assert neardup.near_groups(no_documents).count() == 0
    got = neardup.near_groups(odd_documents).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert neardup.drop_near_copies(odd_documents).columns == odd_documents.columns


def test_suffix_array_with_queues_on_disk():
    rng = np.random.default_rng(0)
    for trial in range(150):
        text = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)), 0).astype(np.int32)
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        order = suffix_array(text, budget=64 if trial % 2 else 1 << 20)
        assert order.tolist() == want
        lcp = common_prefixes(text, order, 5)
        for i in range(1, len(order)):
            a, b = text[order[i - 1] :].tolist(), text[order[i] :].tolist()
            n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[i] == min(n, 5)


def removed(rows, length):
    least = {}
    data = {d: (t or "").encode() for d, t, *_ in rows}
    for d in sorted(data):
        for i in range(len(data[d]) - length + 1):
            least.setdefault(data[d][i : i + length], d)
    out = {}
    for d, text in data.items():
        cover = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if least[text[i : i + length]] < d:
                cover[i : i + length] = b"\1" * length
        out[d] = (len(text), sum(cover), len([x for x in bytes(cover).split(b"\0") if x]), hashlib.sha256(bytes(c for c, x in zip(text, cover) if not x)).hexdigest())
    return out


@pytest.mark.parametrize("seed,length,gram", [(0, 50, 24), (1, 50, 24), (2, 20, 12)])
def test_repeated_spans_equal_brute_force(spark, seed, length, gram):
    rows = make_documents(seed, 70)
    got = suffix.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(3), length, gram, with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(rows, length)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_anchors_are_dealt_evenly_to_buckets(spark):
    rng = random.Random(5)
    texts = [(d, "".join(rng.choice("abcdefgh ") for _ in range(5000)), d % 4) for d in range(40)]
    sent = suffix.sent_anchors(spark.createDataFrame(texts, "doc_id long, text string, chunk long"), 24, 50, 24).collect()
    sizes = [0] * 24
    for r in sent:
        sizes[r.bucket] += len(r.keys)
    assert max(sizes) < 1.5 * sum(sizes) / 24 and min(sizes) > 0.5 * sum(sizes) / 24


def test_repeated_spans_edge_cases(no_documents, odd_documents):
    assert suffix.repeated_spans(no_documents).count() == 0
    got = suffix.repeated_spans(odd_documents).collect()
    assert len(got) == 5 and all(r.n_removed == 0 for r in got)


def brute_neighbours(ids, x, every, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = unit @ unit[i]
        order = sorted((-round(float(v), 12), int(j)) for v, j in zip(s, ids) if j != ids[i])
        out[int(ids[i])] = [j for _, j in order[:k]]
    return out


def test_nearest_recall_and_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 64))
    x = (centres[rng.integers(8, size=1500)] * 0.6 + rng.normal(size=(1500, 64))).astype(np.float32)
    x[700:] = np.where(rng.random((800, 1)) < 0.4, x[:800], x[700:])  # many identical vectors
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = defaultdict(list)
    for r in sorted(ann.nearest(df).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
        a, b = x[r.query_id].astype(float), x[r.vec_id].astype(float)
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    want = brute_neighbours(ids, x.astype(float), 50, 5)
    assert set(got) == set(want)
    assert all(len(v) == 5 and len(set(v)) == 5 and q not in v for q, v in got.items())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


def test_repeated_vectors_of_a_group_take_one_place():
    import pyarrow as pa

    a, b = np.array([1.0, 0.0]).tobytes(), np.array([1.0, 1.0]).tobytes()
    base = pa.table({"vector": [a, a, a, b], "ids": [[1, 2, 3], [1, 2, 3], [1, 2, 3], [4]], "code": [7, 8, 9, 8], "part": [0, 0, 0, 0]})
    asked = pa.table({"query": [a, a, a], "code": [7, 8, 9], "part": [0, 0, 0]})
    assert ann.meet(base, asked, 6).column("ids").to_pylist() == [[1, 2, 3, 4]]

def test_nearest_edge_cases(spark):
    schema = "vec_id long, embedding array<double>, code long"
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (None, [1.0, 0.5], 1), (6, [None, 1.0], 1), (50, [1.0], 1), (7, [-1.0, 0.0], 1), (7, [-1.0, 0.0], 1)]
    got = ann.nearest(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got] == [(0, 1, 2, 0.707107), (0, 2, 1, 0.0), (0, 3, 7, -1.0)]
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0


def test_perturbations_come_in_order_of_cost():
    rng = np.random.default_rng(2)
    place = rng.random(4)
    d = np.concatenate([place, 1 - place])
    sets = [s for n in range(1, 5) for s in __import__("itertools").combinations(range(8), n) if len({i % 4 for i in s}) == n]
    want = sorted(sum(d[i] ** 2 for i in s) for s in sets)[:20]
    assert np.allclose([sum(d[i] ** 2 for i in s) for s in ann.perturbations(d, 20)], want)


def test_targets_share_and_stop_at_three_times():
    t = mixing.targets({"a": 100, "b": 10, None: 90})
    assert sum(t.values()) == pytest.approx(200)
    assert all(t[s] <= 3 * n + 1e-9 for s, n in {"a": 100, "b": 10, None: 90}.items())
    assert t["b"] == 30 and t["a"] / t[None] == pytest.approx(5 / 1)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_flow_shares_overlapping_sources_at_least_repetition():
    given = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 12, "b": 10}, 3)
    assert given == {("a",): 10, ("a", "b"): 10, ("b",): 2}
    given = mixing.route({("a",): 10, ("b",): 5}, {"a": 4, "b": 15}, 3)
    assert given == {("a",): 4, ("b",): 15}


def test_mix_meets_targets(documents, rows):
    got = mixing.mix(documents).collect()
    assert len(got) == len(rows)
    size_of, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for d, t, _, s, *_ in rows:
        size_of[s] += len(words(t))
    want = mixing.targets(dict(size_of))
    source = {d: s for d, _, _, s, *_ in rows}
    text = {d: t for d, t, *_ in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(words(text[r.doc_id])) and r.source_size == size_of[s] and r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[s])
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    again = mixing.mix(documents.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * (i % 7 + 1), "s", [["a"], ["a", "b"], ["b", None]][i % 3]) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, of array<string>"), members="of").collect()
    assert len(got) == 300 and all(0 <= r.taken <= 3 * r.size for r in got)


def test_mix_edge_cases(no_documents, odd_documents):
    assert mixing.mix(no_documents).count() == 0
    assert mixing.mix(odd_documents).count() == 5
    assert mixing.apply_mix(odd_documents).columns == odd_documents.columns


def test_apply_mix_decides_rows_without_identifiers_one_by_one(spark):
    rows = [(None, f"{s}{i} " * 10, None, s, 1, 2, "k") for s, n in (("a", 40), ("b", 40), ("c", 240)) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {r.source: r.target for r in mixing.mix(docs, keep=("source",)).select("source", "target").distinct().collect()}
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns
    words_of = {r.source: r.n * 10 for r in got.groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert {s: abs(words_of.get(s, 0) - w) <= 10 for s, w in want.items()} == dict.fromkeys("abc", True)
    again = mixing.apply_mix(docs.repartition(2))
    assert sorted(r.text for r in got.collect()) == sorted(r.text for r in again.collect())


def test_apply_mix_takes_what_mix_says_where_identifiers_and_column_names_repeat(spark):
    rows = [(i % 7, f"w{i} " * (i % 9 + 1), "abc"[i % 3], 5, "x", 1, 2, 3) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long, _row string, size long, taken long, target long").repartition(2)
    said = mixing.mix(docs).agg({"taken": "sum"}).first()[0]
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns
    assert sum(len(r.text.split()) for r in got.collect()) == said
