"""Operator 1: token counts by trie-shared unigram dynamic programming.

The distinct pre-tokens of a task are inserted in one trie.  For the best
segmentation of a pre-token into vocabulary pieces, the state after a prefix
depends on that prefix alone, so each trie node holds the best forward score
and the piece count of its prefix and is computed once, however many
pre-tokens share it.  Terminal nodes hold the answer; the count of a document
is the sum over its pre-tokens.  The operator is one narrow map: no shuffle.

The public vocabulary files carry ranks, not probabilities, so piece scores
follow Zipf's law over the file's order: score(rank) = -log(rank + 2), in
integer millionths so that ties are exact.  Among equal scores the
segmentation with fewer pieces wins.  Every single byte is a piece, so every
text can be segmented.

Edge cases: null and empty texts have 0 tokens; a null doc_id is kept;
repeated rows yield repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_bytes

SCHEMA = "doc_id long, n_tokens long, n_pretokens long, n_bytes long"
MAX_NODES = 2_000_000  # a full trie is emptied and refilled, which changes memory only


def load_scores(path: str) -> dict[bytes, int]:
    """Pieces of a rank file with their integer Zipf scores."""
    scores = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                piece, rank = line.split()
                scores[base64.b64decode(piece)] = -round(1e6 * math.log(int(rank) + 2))
    return scores


class UnigramTrie:
    """Trie of pre-tokens; a node holds (score, pieces) of the best segmentation of its prefix."""

    def __init__(self, scores: dict[bytes, int], max_nodes: int = MAX_NODES):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.max_nodes = max_nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score = [0]
        self.pieces = [0]

    def insert(self, word: bytes) -> int:
        """Extend the trie by ``word`` and return the piece count at its terminal."""
        if len(self.score) > self.max_nodes:
            self.clear()
        child, score, pieces, known, longest = self.child, self.score, self.pieces, self.scores, self.longest
        path = [0]
        node = 0
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            below = child.get(key)
            if below is None:
                best = None
                for start in range(max(0, end - longest), end):
                    piece = known.get(word[start:end])
                    if piece is not None:
                        at = path[start]
                        found = (score[at] + piece, -pieces[at] - 1)
                        if best is None or found > best:
                            best = found
                below = len(score)
                child[key] = below
                score.append(best[0])
                pieces.append(-best[1])
            node = below
            path.append(node)
        return pieces[node]


class _Terminals(dict):
    """Terminal counts by pre-token, filled from the trie on first use."""

    def __init__(self, trie: UnigramTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        count = self.trie.insert(word.encode("utf-8", "replace"))
        self[word] = count
        return count


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Rows ``doc_id, n_tokens, n_pretokens, n_bytes`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminals = _Terminals(UnigramTrie(load_scores(ranks_path)))
        split = regex.compile(pattern).findall
        for batch in batches:
            tokens, pretokens, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                found = split(text) if text else []
                tokens.append(sum(map(terminals.__getitem__, found)))
                pretokens.append(len(found))
                sizes.append(len(text_bytes(text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (tokens, pretokens, sizes))],
                names=["doc_id", "n_tokens", "n_pretokens", "n_bytes"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
