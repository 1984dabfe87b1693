"""Operators 3 and 5: held-out accuracy, identities and edge cases; the pipeline stage by stage."""

import random
import zlib

import numpy as np
import pytest
from conftest import SCHEMA

from trivium.llm import exact, neardup, packing, quality, toxicity
from trivium.llm.features import WordIds


def labelled(n=600, seed=4):
    rng = random.Random(seed)
    syllables = ["ba", "do", "ki", "lu", "ne", "so", "ta", "ri"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 80))]
        bad, toxic = rng.random() < 0.3, False
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 2 else [w[0]] * len(w)
        elif rng.random() < 0.25:
            toxic = True
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grolk", "snarf", "wupp"])
        docs.append((i, " ".join(w), "en", "s", None, 1, "k"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = labelled()
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {x[0]: x[1:] for x in labels}


def auc(pairs):
    positive, negative = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in positive for b in negative])


def test_quality_on_held_out_rows(data):
    docs, labels, truth = data
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert auc([(r.score, truth[r.doc_id][0]) for r in got if r.held_out]) > 0.97


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    size = quality.WORDS + quality.N_DENSE
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)), None, None)
    ids, x = np.array([3, 9, 12, 700, 5]), rng.normal(size=5)
    pairs = sum(m.factors[ids[i]] @ m.factors[ids[j]] * x[i] * x[j] for i in range(5) for j in range(i))
    assert m.margins(ids, x, np.array([0]))[0] == pytest.approx(0.3 + m.weights[ids] @ x + pairs)


def test_toxicity_on_rows_not_learned_from(spark, data):
    docs, labels, truth = data
    chain = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    got = [r for r in toxicity.score(docs, chain).collect() if r.doc_id % 3 == 0]
    assert np.mean([r.toxic == bool(truth[r.doc_id][1]) for r in got]) > 0.95
    assert auc([(r.p_low_quality, not truth[r.doc_id][0]) for r in got]) > 0.97


def test_later_models_learn_from_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    ids, row = rng.integers(0, 2**32, 4000, dtype=np.uint64).astype(np.uint32), np.repeat(np.arange(400), 10)
    dense = rng.normal(size=(400, toxicity.N_DENSE))
    y = np.column_stack([rng.integers(0, 2, 400), rng.integers(0, 2, 400)])
    y[:, 1] = y[:, 0]  # noise decides the first category, the first decides the second
    chain = toxicity.fit_chain(ids, row, dense, y)
    earlier = chain.models[1].weights[-1]
    assert len(chain.models[1].weights) == len(chain.models[1].words) + toxicity.N_DENSE + 1
    assert earlier < 1  # in-sample probabilities of noise would seem to predict it


def test_models_edge_cases(spark, data, no_documents, odd_documents):
    docs, labels, _ = data
    none = labels.filter("false")
    machine, chain = quality.train(docs, labels), toxicity.train(docs, labels)
    assert quality.score(no_documents, machine).count() == 0 and toxicity.score(no_documents, chain).count() == 0
    assert quality.score(odd_documents, machine).count() == 5 and toxicity.score(odd_documents, chain).count() == 5
    assert {r.score for r in quality.score(odd_documents, quality.train(docs, none)).collect()} == {0.5}
    assert not any(r.toxic for r in toxicity.score(odd_documents, toxicity.train(docs, none)).collect())
    nulls = spark.createDataFrame([(None, None, None), (1, None, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.score(odd_documents, quality.train(docs, nulls)).count() == 5
    assert toxicity.predict(chain, [], WordIds()).shape == (0, 2)


def test_pipeline_stages_are_the_operators(spark, tmp_path, data):
    import corpus_pipeline

    docs, labels, truth = data
    extra = [(1000 + i, r.text.upper() if i % 2 else r.text, "en", "t", 1, 1, "k") for i, r in enumerate(docs.filter("doc_id < 40").collect())]
    docs.unionByName(spark.createDataFrame(extra, SCHEMA)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, str(tmp_path))
        if name == "toxicity":
            left = {r.doc_id for r in now.collect()}
            clean, bad = {d for d in truth if not truth[d][1]}, {d for d in truth if truth[d][1]}
            assert len(left & clean) > 0.98 * len(clean) and len(left & bad) < 0.05 * len(bad)
        elif name == "exact_dedup":
            assert {r.doc_id for r in now.collect()} == {r.doc_id for r in exact.exact_groups(before).collect() if r.kept}
        elif name == "minhash_near_dedup":
            assert {r.doc_id for r in now.collect()} == {r.doc_id for r in neardup.near_groups(before).collect() if r.kept}
        if name != "packing":
            assert now.columns == columns
    assert now.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert packing.SCHEMA.startswith("doc_id")


def test_training_rows_are_bounded_and_do_not_depend_on_arrival(spark):
    from trivium.llm.features import training_rows

    rows = [(i % 7, f"text {i}", i) for i in range(300)] + [(9, None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(9, 1), (3, 0)], "doc_id long, quality int")
    got = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, n_chars long").repartition(3)
        got.append(sorted(map(tuple, training_rows(docs, labels, ["quality"], 5).collect())))
    assert got[0] == got[1] and len({r[0] for r in got[0]}) == len(got[0]) <= 5
