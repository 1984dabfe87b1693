"""Operator 13 against brute force: phrases, their owners, and the ways of words and pivots that do not fit."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SCHEMA
from pyspark.sql import functions as F

from trivium.llm import collocations as c


def pieces(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", lower)]


def brute(rows, max_words, least, percent, top):
    out = []
    by_lang = {}
    for lang, text in rows:
        by_lang.setdefault("und" if lang is None else lang, []).extend(pieces(text))
    for lang, all_pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in all_pieces for k in range(1, max_words + 1) for i in range(len(p) - k + 1))
        found = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        inside = Counter()
        for g, n in found.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], n)
        listed = []
        for g, a in found.items():
            if g in inside and 100 * inside[g] >= percent * a:
                continue
            score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            listed.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        n = sum(map(len, all_pieces))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(listed)[:top], 1)]
    return sorted(out)


def texts(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß|") for _ in range(r.randint(1, 5))) for _ in range(60)] + ["x" * 60]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out = []
    for i in range(n):
        words = r.choices(vocabulary, weights, k=r.randint(0, 60))
        joined = "".join(w.upper() * (r.random() < 0.2) or w for w in [x for w in words for x in (w, r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b!", "\r\n"]))])
        out.append((r.choice(["en", "en", "en", "de", None]), joined if i % 13 else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, 1, "k") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed,max_words,least,percent,top,table", [(0, 3, 10, 50, 2000, 1 << 20), (1, 4, 3, 50, 40, 1 << 20), (2, 5, 2, 80, 2000, 10), (3, 2, 1, 50, 2000, 0)])
def test_phrases_equal_brute_force(spark, monkeypatch, seed, max_words, least, percent, top, table):
    if seed != 1:
        # Small partitions and flushes, which the workers would not learn of: the functions are called here.
        monkeypatch.setattr(c, "FRAGMENTS_A_BUCKET", 200)
    rows = texts(seed)
    got = c.collocations(frame(spark, rows), max_words, least, percent, top, table)
    want = brute(rows, max_words, least, percent, top)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == want
    assert len(want) > 5


@pytest.mark.parametrize("hot,context,wide", [(0, 2, False), (5, 2, False), (30, 3, True), (10**6, 1, False)])
def test_each_occurrence_has_one_owner(hot, context, wide):
    """Whatever the routing, the partitions together count each phrase in exactly one place."""
    rng = np.random.default_rng(hot)
    x = rng.zipf(1.4, 4000) % 40 - 1
    if wide:
        x[x == 7] = c.HASHED + 5
    texts = [x[:2500], x[2500:]]
    found, places = Counter(), Counter()
    parts = {}
    for t in texts:
        for bucket, n, is_wide, blob in c.packed_fragments(t, context, hot, 16):
            parts.setdefault(bucket, []).append(c.unpacked_rows(n, is_wide, blob, 2 * context + 1))
    for got in parts.values():
        rows, before, weights = (np.concatenate(y) for y in zip(*got))
        for ids, f in c.mined(rows, before, weights, context + 1, 1):
            for g, n in zip(map(tuple, ids.tolist()), f.tolist()):
                found[g] += n
                places[g] += 1
    want = Counter()
    for t in texts:
        for k in range(2, context + 2):
            for i in range(len(t) - k + 1):
                if (t[i : i + k] >= 0).all():
                    want[tuple(t[i : i + k].tolist())] += 1
    assert found == want and set(places.values()) == {1}


def test_numbers_of_words_outside_the_table_are_those_of_spark(spark):
    words = [("en", "a"), ("de", "a"), ("", "é" * 50), ("en", "x" * 100)]
    got = spark.createDataFrame(words, "lang string, word string").select(c.hashed_number(F.col("lang"), F.col("word")).alias("n")).collect()
    assert [r.n for r in got] == [c.hash_of(lang.encode(), w.encode()) for lang, w in words]


def test_collocations_edge_cases(no_documents, odd_documents):
    assert c.collocations(no_documents).collect() == []
    got = c.collocations(odd_documents, least=2).collect()
    assert {(r.lang, r.n) for r in got} == {("und", 30)} and all(r.a == 2 for r in got)


def test_a_very_long_word_and_a_very_long_piece(spark):
    long = "y" * 2_000_000
    docs = spark.createDataFrame([(1, f"{long} end " * 2 + "p q " * 300_000, "en")] * 2, "doc_id long, text string, lang string")
    got = {r.phrase: r.a for r in c.collocations(docs, max_words=2, least=2).collect()}
    assert got["p q"] == 600_000 and got[f"{long} end"] == 4 and len(got) == 5
