"""Operator 5: toxicity by a classifier chain.

Categories are predicted one after another.  Each is a linear (logistic) model
over the presence of words and the structure statistics of the whole text and
over the probabilities of the earlier categories.  While fitting, those
probabilities are out of fold: each comes from a model that has not seen the
row, so a later model meets in training what it will meet in use.

Words enter a model by a test of association with its category (a z-score on
document counts), so that its size is bounded by the vocabulary of markers and
long clean texts do not gather noise.  Words are told apart by their crc32.

The chain is fitted on at most ``MAX_TRAINING`` labelled documents (a stated
bound; their word hashes go to one task, the model to the driver), and scores
every document in one narrow map.

Edge cases: null and empty texts are scored from their (zero) statistics;
repeated rows are scored each; without labels of a category its probability
is 0; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, rows_of, small_batches
from .features import STATISTICS, WordIds, statistics, training_rows

MAX_TRAINING = 20_000
CATEGORIES = ("low_quality", "toxic")
FOLDS = 5
MIN_Z = 3.5
N_DENSE = len(STATISTICS)


@dataclass
class Linear:
    words: np.ndarray  # sorted crc32 values
    weights: np.ndarray  # of words, dense statistics, earlier categories
    bias: float

    def margins(self, index: np.ndarray, row: np.ndarray, dense: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """``index``: places in ``words``; ``row``: the row of each."""
        n = len(self.words)
        out = self.bias + np.bincount(row, self.weights[index], len(dense)) + dense @ self.weights[n : n + N_DENSE]
        return out + (earlier @ self.weights[n + N_DENSE :] if earlier.shape[1] else 0.0)


@dataclass
class Chain:
    categories: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    models: list[Linear] = field(default_factory=list)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def places(model_words: np.ndarray, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``model_words`` of those ids that it holds, and their rows."""
    if not len(model_words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(model_words, ids), len(model_words) - 1)
    hit = model_words[at] == ids
    return at[hit], row[hit]


PART = 256  # texts that are scored at once
BLOCK = 1 << 20  # entries that are looked up at once while fitting


@dataclass
class Entries:
    """Which words occur in which rows, told by codes: places in the sorted ``words``."""

    words: np.ndarray
    codes: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, row: np.ndarray) -> Entries:
        words = np.unique(ids)
        codes = np.empty(len(ids), np.int32)
        for at in range(0, len(ids), BLOCK):
            codes[at : at + BLOCK] = np.searchsorted(words, ids[at : at + BLOCK])
        return cls(words, codes, row.astype(np.int32))

    def sums(self, of_row: np.ndarray) -> np.ndarray:
        """For each word the sum of ``of_row`` over the rows that hold it."""
        out = np.zeros(len(self.words))
        for at in range(0, len(self.codes), BLOCK):
            out += np.bincount(self.codes[at : at + BLOCK], of_row[self.row[at : at + BLOCK]], len(out))
        return out

    def select(self, known: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``known`` (codes) and rows, counted among those ``inside``, of the entries that both hold."""
        place = np.full(len(self.words), -1, np.int64)
        place[known] = np.arange(len(known))
        number = np.where(inside, np.cumsum(inside) - 1, -1)
        index, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(self.codes), BLOCK):
            i, r = place[self.codes[at : at + BLOCK]], number[self.row[at : at + BLOCK]]
            hit = (i >= 0) & (r >= 0)
            index.append(i[hit])
            row.append(r[hit])
        return np.concatenate(index), np.concatenate(row)


def markers(entries: Entries, inside: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Codes of words whose counts of documents ``inside`` differ between the classes by at least ``MIN_Z`` standard deviations."""
    n, positive = entries.sums(inside.astype(float)), entries.sums(np.where(inside, y, 0.0))
    rate = y[inside].mean() if inside.any() else 0.0
    z = (positive - n * rate) / np.sqrt(np.maximum(n * rate * (1 - rate), 1e-9))
    return np.flatnonzero((n >= 2) & (np.abs(z) >= MIN_Z))


def fit_linear(entries: Entries, inside: np.ndarray, dense, earlier, y, steps: int = 300, ridge: float = 1e-4) -> tuple[Linear, np.ndarray]:
    """Full-batch Adam on the logistic loss over the marker words of the rows ``inside``; the model and the codes of its words."""
    known = markers(entries, inside, y)
    words = entries.words[known]
    index, at = entries.select(known, inside)
    dense, earlier, y = dense[inside], earlier[inside], y[inside]
    n, size = len(known), len(known) + N_DENSE + earlier.shape[1]
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    w, b = np.zeros(size), float(np.log(rate / (1 - rate)))
    if not len(y) or rate <= 1e-6 or rate >= 1 - 1e-6:
        return Linear(words, w, b if len(y) else -30.0), known
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        model = Linear(words, w, b)
        error = (_sigmoid(model.margins(index, at, dense, earlier)) - y) / len(y)
        g = np.concatenate([np.bincount(index, error[at], n), dense.T @ error, earlier.T @ error, [error.sum()]])
        g[:-1] += ridge * w / max(1, np.sqrt(len(y)))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Linear(words, w, float(b)), known


def fit_chain(ids: np.ndarray, row: np.ndarray, dense: np.ndarray, labels: np.ndarray, categories=CATEGORIES, folds: int = FOLDS) -> Chain:
    """``labels``: one column a category, in the order of the chain; rows are dealt to folds in their order.

    Memory: eight bytes for each word of a training row besides ``ids``, and what the markers among them take.
    """
    mean, scale = (dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3)) if len(dense) else (np.zeros(N_DENSE), np.ones(N_DENSE))
    x = np.clip((dense - mean) / scale, -5, 5)
    chain = Chain(tuple(categories), mean, scale)
    earlier = np.zeros((len(x), 0))
    fold = np.arange(len(x)) % folds
    entries = Entries.of(ids, row)
    for j in range(len(categories)):
        y = labels[:, j].astype(float)
        chain.models.append(fit_linear(entries, np.ones(len(x), bool), x, earlier, y)[0])
        if j + 1 == len(categories):
            break
        out = np.zeros(len(x))
        for f in range(folds):
            outside = fold == f
            model, known = fit_linear(entries, ~outside, x, earlier, y)
            index, at = entries.select(known, outside)
            out[outside] = _sigmoid(model.margins(index, at, x[outside], earlier[outside]))
        earlier = np.column_stack([earlier, _logit(out)])
    return chain


def _inputs(texts: list, ids: WordIds):
    dense, found, row = [], [], []
    for i, text in enumerate(texts):
        stats, _, counts = statistics(text)
        dense.append(stats)
        found.append(np.fromiter(map(ids.__getitem__, {w.strip(b".,;:!?\"'()") for w in counts}), np.uint32))
        row.append(np.full(len(found[-1]), i))
    empty = np.zeros(0, np.uint32)
    return np.concatenate([empty, *found]), np.concatenate([np.zeros(0, np.int64), *row]), np.array(dense, float).reshape(-1, N_DENSE)


def predict(chain: Chain, texts: list, ids: WordIds) -> np.ndarray:
    """Probabilities, one column a category."""
    words, row, dense = _inputs(texts, ids)
    x = np.clip((dense - chain.mean) / chain.scale, -5, 5)
    earlier, out = np.zeros((len(texts), 0)), []
    for model in chain.models:
        index, at = places(model.words, words, row)
        p = _sigmoid(model.margins(index, at, x, earlier))
        out.append(p)
        earlier = np.column_stack([earlier, _logit(p)])
    return np.column_stack(out) if out else np.zeros((len(texts), 0))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> Chain:
    """Fit the chain: first ``low_quality`` (labels.quality is 0), then ``toxic``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            blobs, dense = [], []
            for (text,) in rows_of([batch], ("text",)):
                words, _, stats = _inputs([text], ids)
                blobs.append(words.tobytes())
                dense.append(stats.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary()), pa.array(dense, pa.binary()), batch.column("low_quality").cast(pa.int32()), batch.column("toxic").cast(pa.int32())], names=["doc_id", "ids", "dense", "low_quality", "toxic"])
        release_memory()

    small_batches(docs.sparkSession)
    marks = labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    rows = training_rows(docs.select("doc_id", "text"), marks, list(CATEGORIES), most)
    rows = rows.mapInArrow(run, "doc_id long, ids binary, dense binary, low_quality int, toxic int")

    def fit(table: pa.Table) -> pa.Table:
        chain = pickle.dumps(fit_rows(table.sort_by([("doc_id", "ascending"), ("ids", "ascending"), ("dense", "ascending")])))
        release_memory()
        return pa.table({"chain": pa.array([chain], pa.binary())})

    # One task fits the whole sample, which MAX_TRAINING bounds: the driver sees the model alone.
    fitted = rows.withColumn("whole", F.lit(0)).groupBy("whole").applyInArrow(fit, "chain binary").first()
    return pickle.loads(fitted["chain"]) if fitted else fit_chain(np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros((0, N_DENSE)), np.zeros((0, len(CATEGORIES))))


def fit_rows(rows: pa.Table) -> Chain:
    """The chain of a sample: word hashes, statistics and labels of each row."""
    blobs = rows.column("ids").to_pylist()
    row = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(x) // 4 for x in blobs])
    ids = np.frombuffer(b"".join(blobs), np.uint32)
    dense = np.array([np.frombuffer(x) for x in rows.column("dense").to_pylist()], float).reshape(-1, N_DENSE)
    y = np.column_stack([rows.column(c).to_numpy() for c in CATEGORIES])
    return fit_chain(ids, row, dense, y)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` each, ``score`` (the last), ``predicted`` and ``toxic`` for every row."""
    held = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by the markers among MAX_TRAINING rows
    names = [f"p_{c}" for c in chain.categories]
    schema = ", ".join(["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} double" for c in names), "score double, predicted int, toxic boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids = held.value, WordIds()
        for batch in batches:
            parts = [predict(model, batch.column("text").slice(at, PART).to_pylist(), ids) for at in range(0, batch.num_rows, PART)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(batch.column(c) for c in keep), *(pa.array(c) for c in p.T), pa.array(p[:, -1]), pa.array((p[:, -1] >= threshold).astype(np.int32)), pa.array(p[:, -1] >= threshold)],
                names=["doc_id", *keep, *names, "score", "predicted", "toxic"],
            )
        release_memory()

    columns = dict.fromkeys(("doc_id", "text", *keep))
    return docs.select(*columns).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with their columns; a narrow map."""
    chain = train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids = held.value, WordIds()
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                yield part.filter(pa.array(predict(model, part.column("text").to_pylist(), ids)[:, -1] < threshold))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
