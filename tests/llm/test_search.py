"""Operator 11 against brute force, its blocks against every way to cut, and its skipping."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from conftest import SCHEMA

from trivium.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    documents, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, query in wanted.items():
        w = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in query if df[t]}
        found = []
        for d, c in counts:
            m = 100 - 90 + 90 * c.total() * documents // length
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in w if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß7") for _ in range(r.randint(1, 4))) for _ in range(120)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = ["".join(r.choice([w, w.upper()]) + r.choice([" ", "-", "\x7f", "_", ". "]) for w in r.choices(vocabulary, weights, k=r.randint(0, 60))) for _ in range(n)]
    docs = [(None if i % 29 == 0 else i if i % 7 else 3, None if i % 31 == 0 else texts[i // 2 if i % 3 == 0 else i]) for i in range(n)]
    items = [(i if i % 9 else None, " ".join(r.choices(vocabulary, k=r.randint(1, 12))) + " unseen") for i in range(40)] + [(5, "more a b"), (90, None), (91, "..."), (92, "unseen")]
    return docs, items


@pytest.mark.parametrize("seed,cost,longest,k", [(0, lexical.BLOCK_COST, 256, 10), (1, 50_000, 4, 3), (2, 0, 8, 10), (3, 10**9, 16, 1)])
def test_search_equals_brute_force(spark, monkeypatch, seed, cost, longest, k):
    docs, items = corpus(seed)
    if seed == 2:
        monkeypatch.setattr(lexical, "QUERY_BYTES", 200)  # several blocks of queries
    frame = spark.createDataFrame([(d, t, None, None, 1, 2, "k") for d, t in docs], SCHEMA).repartition(4)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int").repartition(2)
    got = lexical.search(frame, asked, k, cost, longest)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute(docs, items, k)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_are_the_cheapest_cut(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 11, 12)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    parts = rng.integers(1, 100, starts[-1]).astype(np.int32)
    cost, longest = int(rng.integers(0, 120)), 4
    ends = lexical.choose_blocks(parts, starts, cost, longest)

    def price(cuts):
        return sum(cost + (b - a) * int(parts[a:b].max()) - int(parts[a:b].sum()) for a, b in zip(cuts, cuts[1:]))

    for a, b in zip(starts, starts[1:]):
        ways = [[a, *c, b] for n in range(b - a) for c in combinations(range(a + 1, b), n)]
        allowed = [w for w in ways if all(y - x in (1, 2, 4) for x, y in zip(w, w[1:]))]
        assert price([a, *ends[(ends > a) & (ends <= b)]]) == min(map(price, allowed))


def shard(n, seed=0):
    rng = np.random.default_rng(seed)
    texts = [[b"t%d" % t for t in rng.zipf(1.3, rng.integers(5, 60)) % 50] for _ in range(n)]
    return lexical.Shard.build(list(range(n)), texts, n, sum(map(len, texts))), texts


def test_a_shard_survives_its_row_and_finds_the_best(monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", 16)
    built, texts = shard(2000)
    row = built.row(7)
    held = lexical.Shard.of_row(row[2], **dict(zip(lexical.ARRAYS, row[3:])))
    assert held.terms == built.terms and (held.blocks == built.blocks).all()
    rng = np.random.default_rng(1)
    for _ in range(30):
        lists = np.unique(rng.integers(0, len(held.terms), 6))
        weights = rng.integers(1, 9000, len(lists))
        score = np.zeros(len(texts), np.int64)
        for t, w in zip(lists, weights):
            at = slice(held.starts[t], held.starts[t + 1])
            score[held.docs[at]] += w * held.parts[at]
        docs, found = held.best(lists, weights, 10)
        assert (score[docs] == found).all()
        assert sorted(found)[-10:] == sorted(score)[-10:]
        floor = int(np.sort(score)[-3])
        docs, found = held.best(lists, weights, 10, floor)
        assert sorted(docs) == sorted(np.flatnonzero(score >= max(1, floor)))


def test_blocks_below_the_threshold_are_not_read(monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", 16)
    n = 4000
    texts = [[b"common"] * (1 + i % 3) + [b"filler"] * 20 for i in range(n)]
    for i in range(100, 112):
        texts[i] = [b"common"] * 40 + [b"rare"] * 5
    held = lexical.Shard.build(list(range(n)), texts, n, sum(map(len, texts)), cost=100_000)
    seen = []

    class Watched:
        def __init__(self, parts):
            self.parts = parts

        def __getitem__(self, at):
            seen.append(len(at))
            return self.parts[at]

    lists = np.array([held.terms.index(b"common"), held.terms.index(b"rare")])
    held.parts = Watched(held.parts)
    docs, _ = held.best(lists, np.array([10, 5000]), 10)
    assert set(docs) <= set(range(100, 112)) and sum(seen) < n / 4


def test_search_edge_cases(spark, no_documents, odd_documents):
    asked = spark.createDataFrame([(1, "the same text"), (2, None)], "item_id long, text string")
    assert lexical.search(no_documents, asked).collect() == []
    assert lexical.search(odd_documents, asked.limit(0)).collect() == []
    got = lexical.search(odd_documents, asked, k=2).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in got) == [(1, 1, 1), (1, 2, 1)]


def test_a_very_long_text_of_one_word_and_of_many(spark):
    docs = spark.createDataFrame([(1, "z" * 3_000_000), (2, "tip top " * 300_000), (3, "tip")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "tip"), (2, "z" * 3_000_000)], "item_id long, text string")
    assert {(r.item_id, r["rank"], r.doc_id) for r in lexical.search(docs, asked).collect()} == {(1, 1, 2), (1, 2, 3), (2, 1, 1)}
