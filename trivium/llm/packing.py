"""Operator 7: packing token sequences by minimum bin slack.

A document longer than a window yields full windows directly; what remains of
each document (its tail, shorter than a window) goes to a multiset of
remaining lengths.  Windows are then filled one by one: the largest tail
starts the window, a bitset subset-sum dynamic program over the remaining
lengths finds the sum closest to the capacity, and backtracking through the
bitsets yields how many tails of each length are taken.  Where the best sum
still leaves slack, a tail is cut to fill it; the end of a stream of tails is
cut at powers of two, which need no padding.

Packing is local to a partition: one narrow map, no shuffle.  Tails are held
as token arrays (shorter than a window each) and at most ``MAX_TAILS`` at a
time, so memory is bounded whatever the partition holds.

Edge cases: a null or empty text has one token, the end token, and one piece;
repeated rows are packed once each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import rows_of, small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
MAX_TAILS = 32_768
END_ID = 0


def fill_window(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """Lengths and how often to take each so that the sum is the largest possible within ``capacity``.

    ``counts`` maps a length to its multiplicity.  Lengths are added from the
    largest down, multiplicities by binary splitting; bit s of ``reach`` says
    that sum s can be reached.  It stops as soon as the capacity is reached.
    """
    mask = (1 << capacity + 1) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # reachable sums before the step, length, multiple
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((reach, length, take))
            reach |= reach << length * take & mask
            left -= take
            part *= 2
        if reach >> capacity:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            taken[length] += take
    return list(taken.items())


class Tails:
    """The multiset of remaining tails: stacks of items by length."""

    def __init__(self) -> None:
        self.stacks: dict[int, list] = defaultdict(list)
        self.n = self.total = 0

    def put(self, length: int, item) -> None:
        self.stacks[length].append(item)
        self.n += 1
        self.total += length

    def take(self, length: int):
        stack = self.stacks[length]
        item = stack.pop()
        if not stack:
            del self.stacks[length]
        self.n -= 1
        self.total -= length
        return item

    def windows(self, capacity: int, keep: int) -> Iterator[list[tuple[int, object]]]:
        """Fill windows until at most ``keep`` tails are left; items are (length, (doc, start)).

        Unless ``keep`` is 0, a window that the tails cannot fill waits for more.
        """
        while self.n > keep and (self.total >= capacity or not keep):
            first = max(self.stacks)
            window = [(first, self.take(first))]
            room = capacity - first
            if room:
                counts = {k: len(v) for k, v in self.stacks.items() if k <= room}
                for length, times in fill_window(counts, room):
                    window += [(length, self.take(length)) for _ in range(times)]
                    room -= length * times
            if room and self.n:
                longest = max(self.stacks)  # all that are left are longer than the slack
                doc, start = self.take(longest)
                window.append((room, (doc, start)))
                self.put(longest - room, (doc, start + room))
                room = 0
            yield window


def powers_of_two(window: list[tuple[int, tuple]]) -> Iterator[list[tuple[int, tuple]]]:
    """Cut an incomplete window into sequences whose lengths are powers of two, so that none is padded."""
    total = sum(length for length, _ in window)
    pieces = list(window)[::-1]
    for bit in reversed(range(total.bit_length())):
        room = total & 1 << bit
        out = []
        while room:
            length, (doc, start) = pieces.pop()
            used = min(room, length)
            out.append((used, (doc, start)))
            room -= used
            if used < length:
                pieces.append((length - used, (doc, start + used)))
        if out:
            yield out


def rank_encoder(ranks_path: str, pattern: str, special: dict[str, int] | None = None) -> Callable[[str], list[int]]:
    """Byte-level BPE over a rank file; with the added tokens ``special`` it gives the ids of the same vocabulary's tokenizer file."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = special or {}
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(t in text for t in special):
            return coder.encode(text, allowed_special="all", disallowed_special=())
        return coder.encode_ordinary(text)

    return encode


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], capacity: int = 1024, max_tails: int = MAX_TAILS) -> DataFrame:
    """Pieces of every document with their place in sequences of at most ``capacity`` tokens.

    ``encoder`` builds, on the executor, the function from a text to its ids;
    an end id is added to each document.  ``sequence_id`` is unique over all
    partitions, ``offset`` is gapless from 0 within a sequence.
    """
    small_batches(docs.sparkSession)
    if capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        tails = Tails()
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def place(window) -> None:
            nonlocal sequence
            offset = 0
            for length, (doc, start) in window:
                doc_id, first, ids, total = doc
                crc = zlib.crc32(ids[start - first : start - first + length])
                rows.append((doc_id, start, length, crc, total, sequence, offset))
                offset += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in rows_of([batch], ("doc_id", "text")):
                ids = np.array([*(encode(text) if text else ()), END_ID], dtype="<u4")
                total = len(ids)
                full = total - total % capacity
                for start in range(0, full, capacity):
                    place([(capacity, ((doc_id, start, ids[start : start + capacity], total), start))])
                if full < total:
                    tails.put(total - full, ((doc_id, full, ids[full:].copy(), total), full))
                if tails.n >= max_tails:
                    for window in tails.windows(capacity, max_tails // 2):
                        place(window)
                if len(rows) >= 20_000:
                    yield flush()
            if rows:
                yield flush()
        for window in tails.windows(capacity, 0):
            if sum(length for length, _ in window) == capacity:
                place(window)
            else:
                for part in powers_of_two(window):
                    place(part)
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
