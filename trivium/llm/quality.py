"""Operator 3: quality classification by a factorisation machine.

Inputs of a score are hashed words, structure statistics of the whole text and
the metadata column ``n_chars``.  The pairwise interactions of all inputs have
rank ``FACTORS``; they are scored in linear time by the identity

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

The machine is fitted on the driver on at most ``MAX_TRAINING`` labelled
documents (a stated bound; features are computed on the executors and only
they travel); every document is scored, in one narrow map.

Edge cases: null and empty texts are scored from their (zero) statistics; a
null n_chars counts as the length of the text; repeated rows are scored each;
without any label the score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fold_column, fold_of, release_memory
from .features import STATISTICS, WordIds, statistics, training_rows

WORDS = 1 << 14
FACTORS = 8
MAX_TRAINING = 20_000
N_DENSE = len(STATISTICS) + 1
THRESHOLD = 0.3


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # (WORDS + N_DENSE,)
    factors: np.ndarray  # (WORDS + N_DENSE, FACTORS)
    mean: np.ndarray
    scale: np.ndarray

    def margins(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic function of rows in compressed sparse form; no row may be empty."""
        xv = self.factors[ids] * values[:, None]
        linear = np.add.reduceat(self.weights[ids] * values, starts)
        sums = np.add.reduceat(xv, starts, axis=0)
        squares = np.add.reduceat((xv * xv).sum(axis=1), starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)


def sparse_rows(texts: list, n_chars: list, ids: WordIds) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Word ids and values (normalised square roots of counts) and dense inputs of each text."""
    found, values, dense = [], [], []
    for text, n in zip(texts, n_chars):
        stats, _, counts = statistics(text)
        dense.append([*stats, float(np.log1p(max(0, len(text or "") if n is None else n)))])
        found.append(np.fromiter(map(ids.__getitem__, counts), np.int32, len(counts)))
        v = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
        values.append(v / max(1e-9, float(np.sqrt((v * v).sum()))))
    return found, values, np.array(dense, np.float32).reshape(-1, N_DENSE)


def assemble(found, values, dense, mean, scale):
    """Compressed sparse rows: the words of a text, then its dense inputs, standardised and cut at 5."""
    standard = np.clip((dense - mean) / scale, -5, 5).astype(np.float32)
    tail = np.arange(WORDS, WORDS + N_DENSE, dtype=np.int32)
    ids = np.concatenate([x for row in found for x in (row, tail)])
    vals = np.concatenate([x for row, d in zip(values, standard) for x in (row, d)])
    sizes = np.array([len(row) + N_DENSE for row in found])
    return ids, vals, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def fit(found, values, dense, labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> Machine:
    """Mini-batch AdaGrad on the logistic loss; deterministic for given rows."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    size = WORDS + N_DENSE
    if not n:
        return Machine(0.0, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32), np.zeros(N_DENSE, np.float32), np.ones(N_DENSE, np.float32))
    mean, scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3)
    rate_of = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    m = Machine(float(np.log(rate_of / (1 - rate_of))), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32), mean, scale)
    seen_w, seen_v, seen_b = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            ids, vals, starts = assemble([found[i] for i in rows], [values[i] for i in rows], dense[rows], mean, scale)
            lengths = np.diff(np.append(starts, len(ids)))
            error = 1 / (1 + np.exp(-np.clip(m.margins(ids, vals, starts), -30, 30))) - labels[rows]
            each = np.repeat(error, lengths) / len(rows)
            xv = m.factors[ids] * vals[:, None]
            sums = np.repeat(np.add.reduceat(xv, starts, axis=0), lengths, axis=0)
            touched, inverse = np.unique(ids, return_inverse=True)
            gw = np.bincount(inverse, each * vals, len(touched)).astype(np.float32) + decay * m.weights[touched]
            part = (each * vals)[:, None] * (sums - xv)
            gv = np.stack([np.bincount(inverse, part[:, f], len(touched)) for f in range(FACTORS)], axis=1).astype(np.float32) + decay * m.factors[touched]
            seen_w[touched] += gw * gw
            seen_v[touched] += gv * gv
            m.weights[touched] -= rate * gw / np.sqrt(seen_w[touched])
            m.factors[touched] -= rate * gv / np.sqrt(seen_v[touched])
            gb = float(error.mean())
            seen_b += gb * gb
            m.bias -= rate * gb / seen_b**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, modulus: int = 5) -> Machine:
    """Fit on labelled rows outside the held-out fold (crc32 of doc_id as text, modulo 5, is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(WORDS)
        for batch in batches:
            if not batch.num_rows:
                continue
            found, values, dense = sparse_rows(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([x.tobytes() for x in values], pa.binary()), pa.array([x.tobytes() for x in dense], pa.binary()), batch.column("quality").cast(pa.int32())],
                names=["doc_id", "ids", "vals", "dense", "quality"],
            )
        release_memory()

    learn = labels.filter(fold_column(labels["doc_id"], modulus) != 0)
    rows = training_rows(docs.select("doc_id", "text", "n_chars"), learn, ["quality"], most)
    rows = rows.mapInArrow(run, "doc_id long, ids binary, vals binary, dense binary, quality int").toArrow().sort_by("doc_id")
    take = lambda name, kind: [np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]
    dense = np.array(take("dense", np.float32), np.float32).reshape(-1, N_DENSE)
    ids, vals, marks = take("ids", np.int32), take("vals", np.float32), rows.column("quality").to_numpy().astype(np.float32)
    del rows
    release_memory()
    machine = fit(ids, vals, dense, marks)
    del ids, vals
    release_memory()
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, modulus: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # fixed size: (WORDS + N_DENSE) * (FACTORS + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids = held.value, WordIds(WORDS)
        for batch in batches:
            margin = []
            for at in range(0, batch.num_rows, 256):
                texts, n_chars = (batch.column(c).slice(at, 256).to_pylist() for c in ("text", "n_chars"))
                margin.append(m.margins(*assemble(*sparse_rows(texts, n_chars, ids), m.mean, m.scale)))
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(margin), -30, 30))) if margin else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([fold_of(i, modulus) == 0 for i in batch.column("doc_id").to_pylist()], pa.bool_()), pa.array(p.astype(np.float64)), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )
        release_memory()

    return docs.select("doc_id", "text", "n_chars").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
