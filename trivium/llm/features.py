"""Text features and training rows shared by the document classifiers."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "upper", "digit", "space", "punctuation", "high_byte", "bang", "bar_star_hash",
    "mean_word", "distinct_words", "top_word", "repeated_neighbour", "symbol_words", "caps_words", "distinct_lines", "short_lines",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "|*#$%&@=~^_<>{}[]\\"]] = True

BROADCAST_ROWS = 200_000


def statistics(text: str | None) -> tuple[list[float], list[bytes], Counter]:
    """Structure statistics of a whole text, its lower-cased words and their counts."""
    raw = text_bytes(text)
    tokens = raw.lower().split()
    counts = Counter(tokens)
    n, w = len(raw), len(tokens)
    if not w:
        return [np.log1p(n), *[0.0] * (len(STATISTICS) - 1)], tokens, counts
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = raw.split(b"\n")
    upper = int(bytes_[_UPPER].sum())
    letters = n - int(bytes_[_SPACE].sum()) - int(bytes_[_DIGIT].sum()) - int(bytes_[_PUNCTUATION].sum())
    original = raw.split()
    repeated = sum(map(bytes.__eq__, tokens[1:], tokens[:-1]))
    marked = sum(not t[-1:].isalnum() and t[-1] < 128 and t[-1] not in b".,;:!?" for t in counts)
    caps = sum(map(bytes.isupper, original))
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(np.log1p(len(lines))), upper / max(1, letters), int(bytes_[_DIGIT].sum()) / n,
        int(bytes_[_SPACE].sum()) / n, int(bytes_[_PUNCTUATION].sum()) / n, int(bytes_[128:].sum()) / n, int(bytes_[33]) / w, int(bytes_[_MARKS].sum()) / w,
        float(np.log1p(n / w)), len(counts) / w, max(counts.values()) / w, repeated / w, marked / len(counts), caps / w,
        len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines),
    ], tokens, counts


class WordIds(dict):
    """crc32 of words, modulo ``size``, computed once a task for most words."""

    def __init__(self, size: int = 1 << 32):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = zlib.crc32(word) % self.size
        self[word] = value
        return value


def training_rows(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Labelled documents to learn from: at most ``most``, one a labelled doc_id, those whose hashed doc_id is least.

    The bound is stated; which doc_ids fall under it depends on them alone.  Of
    rows that share a doc_id the one whose content has the least hash is taken,
    so neither their number nor the order of arrival matters.
    """
    wanted = labels.filter("doc_id is not null").filter(" and ".join(f"{c} is not null" for c in columns)).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    wanted = wanted.withColumnRenamed("doc_id", "_labelled")
    if most <= BROADCAST_ROWS:  # the limit above bounds what is sent; texts are then not shuffled
        wanted = F.broadcast(wanted)
    rows = docs.join(wanted, F.col("doc_id") == F.col("_labelled")).drop("_labelled")
    rest = [c for c in rows.columns if c != "doc_id"]
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct(F.xxhash64(*rest), *(c for c in rest if c != "text"))).alias("_row"))
    return one.select(*(F.col(c) if c == "doc_id" else F.col(f"_row.{c}").alias(c) for c in rows.columns))
