"""Operators 1, 4, 7 and 8 against brute force, round trips and edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trivium.llm import exact, lm, packing, token_counts
from trivium.llm.common import pack_sorted, unpack_sorted, words
from trivium.llm.queries import encoder, split_pattern, tokenizer_file

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_sorted_blobs_round_trip():
    x = np.sort(np.random.default_rng(0).integers(0, 2**64, 500, dtype=np.uint64))
    assert (unpack_sorted(pack_sorted(x)) == x).all()
    assert len(unpack_sorted(pack_sorted(x[:0]))) == 0


def test_words_split_at_ascii_space_only():
    assert words("A b\x0bC \x1c É") == ["a b".encode(), b"c", "\x1c É".encode()]
    assert words(None) == []


def viterbi(word: bytes, scores) -> int:
    best = [(0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = scores.get(word[start:end])
            if piece is not None:
                found = (best[start][0] + piece, best[start][1] - 1)
                if best[end] is None or found > best[end]:
                    best[end] = found
    return -best[-1][1]


def test_token_counts_equal_a_segmentation_of_each_word(documents, rows):
    import regex

    scores = token_counts.load_scores(tokenizer_file())
    got = {r.doc_id: r for r in token_counts.count_tokens(documents, tokenizer_file(), split_pattern()).collect()}
    for doc_id, text, *_ in rows:
        found = regex.findall(split_pattern(), text or "")
        assert got[doc_id].n_pretokens == len(found)
        assert got[doc_id].n_bytes == len((text or "").encode())
        if len(text or "") < 1500:
            assert got[doc_id].n_tokens == sum(viterbi(w.encode(), scores) for w in found)


def test_trie_shares_prefixes_and_may_be_emptied():
    scores = {bytes([b]): -10 for b in range(256)} | {b"ab": -11, b"abc": -12, b"bc": -5}
    trie = token_counts.UnigramTrie(scores)
    assert trie.insert(b"abc") == 1 and len(trie.score) == 4
    assert trie.insert(b"abd") == 2 and len(trie.score) == 5
    small = token_counts.UnigramTrie(scores, max_nodes=2)
    assert [small.insert(w) for w in (b"abc", b"abd", b"abc")] == [1, 2, 1]


def test_token_counts_edge_cases(no_documents, odd_documents):
    assert token_counts.count_tokens(no_documents, tokenizer_file(), split_pattern()).count() == 0
    assert token_counts.count_tokens(odd_documents, tokenizer_file(), split_pattern()).count() == 5


def language_model(rows, modulus=7, left_out=2):
    texts = {d: [*words(t), b""] for d, t, *_ in rows}
    train = [t for d, t in texts.items() if zlib.crc32(str(d).encode()) % modulus != left_out]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([b"", *t], t))
    n, once = sum(c.values()), sum(x == 1 for x in c.values())
    u = (once + 1) / (n + once + 2)
    p = lambda w: (1 - u) * c[w] / n if c[w] else u
    q = lambda h, w: lm.BIGRAM * pairs[h, w] / c[h] + (1 - lm.BIGRAM) * p(w) if c[h] else p(w)
    return texts, c, n, q


def test_language_model_equals_brute_force(documents, rows):
    texts, c, n, q = language_model(rows)
    got = {r.doc_id: r for r in lm.score(documents).collect()}
    assert len(got) == len(rows)
    for d, t in texts.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(q(h, w)) for h, w in zip([b"", *t], t)))


def test_language_model_is_a_distribution(rows):
    _, c, n, q = language_model(rows)
    for h in [b"", next(iter(c)), b"never seen"]:
        assert sum(q(h, w) for w in c) + q(h, b"not a word") == pytest.approx(1)


def test_automaton_walks_failure_arcs():
    a = lm.BackoffAutomaton([-1.0, -2.0], {0 * 2 + 1: -0.5}, [-0.1, -0.2], 0)
    assert a.walk([1, 1, 0]) == pytest.approx(-0.5 + (-0.2 - 2.0) + (-0.2 - 1.0))


def test_language_model_edge_cases(spark, no_documents, odd_documents):
    assert lm.score(no_documents).count() == 0
    got = lm.score(odd_documents).collect()
    assert len(got) == 5 and all(math.isfinite(r.score) for r in got)
    untrained = lm.score(odd_documents, modulus=1, left_out=0).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in untrained)


def test_window_filling_is_the_best_subset_sum():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, rng.integers(1, 6))}
        capacity = int(rng.integers(1, 60))
        reach = {0}
        for k, n in counts.items():
            reach = {s + k * i for s in reach for i in range(n + 1)}
        picked = packing.fill_window(counts, capacity)
        assert sum(k * n for k, n in picked) == max(s for s in reach if s <= capacity)
        assert all(0 < n <= counts[k] for k, n in picked)


def check_packing(rows, pieces, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {d: [*t.encode(text or "", add_special_tokens=False).ids, 0] for d, text, *_ in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert set(by_doc) == set(ids)
    for d, found in by_doc.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[d])
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & at - 1 == 0  # full or a power of two: nothing is padded


def test_packing_round_trip(documents, rows):
    for capacity in (1024, 64):
        check_packing(rows, packing.pack(documents, encoder(), capacity).collect(), capacity)


def test_packing_of_texts_with_the_added_token(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"see {mark} here", mark, mark * 3, f"a  {mark}  b\n{mark}\n", f"x{mark}y", "<|endoftext|", f"  {mark} {mark[:-1]}", None]
    pieces = {r.doc_id: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), encoder()).filter("start = 0").collect()}
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert encoder()()(text or "") == ids[:-1]
        assert pieces[i].doc_tokens == len(ids)
        assert pieces[i].ids_crc32 == zlib.crc32(np.array(ids[: pieces[i].length], "<u4").tobytes())

def test_packing_with_few_tails_in_memory(documents, rows):
    check_packing(rows, packing.pack(documents, encoder(), 1024, max_tails=4).collect(), 1024)


def test_packing_edge_cases(no_documents, odd_documents):
    assert packing.pack(no_documents, encoder()).count() == 0
    pieces = packing.pack(odd_documents, encoder()).collect()
    assert sum(r.length for r in pieces if r.start == 0) >= 5
    with pytest.raises(ValueError):
        packing.pack(odd_documents, encoder(), 1000)


@pytest.mark.parametrize("largest", [True, False])
def test_exact_groups(documents, rows, largest):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").encode().lower()].append(d)
    got = exact.exact_groups(documents, largest, fan_bits=4).collect()
    assert len(got) == len(rows)
    of = {d: (g, t) for t, g in groups.items() for d in g}
    for r in got:
        g, t = of[r.doc_id]
        keep = max(g) if largest else min(g)
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(g), r.doc_id == keep, hashlib.sha256(t).hexdigest())


def record_key(digest: bytes, size: int, check: int) -> bytes:
    return digest.ljust(32, b"\0") + size.to_bytes(8, "big") + check.to_bytes(8, "big", signed=True)


def test_merge_runs_keeps_one_verified_record():
    run = np.zeros(3, exact.RECORD)
    run["key"] = [record_key(b"a", 0, 1), record_key(b"a", 0, 2), record_key(b"b", 0, 1)]
    run["id"], run["has_id"], run["rows"] = [5, 6, 7], 1, 1
    merged = exact.merge_runs([run, run], largest=False)
    assert merged["rows"].tolist() == [2, 2, 2]  # equal digests with unequal checks stay apart


@pytest.mark.parametrize("largest", [False, True])
def test_merge_of_sorted_runs_equals_one_sort(largest):
    rng = np.random.default_rng(4)
    for n_runs in range(1, 8):
        rows = np.zeros(400, exact.RECORD)
        rows["key"] = [record_key(bytes([d, 0, d]), 3, -c) for d, c in zip(rng.integers(0, 40, 400).tolist(), rng.integers(0, 3, 400).tolist())]
        rows["id"], rows["has_id"], rows["row"], rows["rows"] = rng.integers(-5, 5, 400), rng.integers(0, 2, 400), rng.permutation(400), 1
        rows["id"] *= rows["has_id"]
        runs = [exact.sorted_run(p, largest) for p in np.array_split(rows, n_runs)]
        assert exact.merge_runs(runs, largest).tolist() == exact.sorted_run(rows, largest).tolist()
    assert len(exact.merge_runs([], largest)) == 0


def test_exact_copies_go_by_rows_where_identifiers_repeat(spark):
    texts = [(5, "A"), (5, "b"), (5, "a"), (7, "a"), (None, "b"), (None, "c"), (None, "C"), (9, None), (9, "")]
    schema = "doc_id long, text string, row long, _row long, digest string, keep_row long, size long"
    docs = spark.createDataFrame([(d, t, 1, i, "x", 2, 3) for i, (d, t) in enumerate(texts)], schema).repartition(3)
    got = exact.drop_exact_copies(docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id or -1, (r.text or "").lower()) for r in got.collect())
    assert kept == [(-1, "c"), (5, "b"), (7, "a"), (9, "")]


def test_exact_dedup_edge_cases(no_documents, odd_documents):
    assert exact.exact_groups(no_documents).count() == 0
    got = exact.exact_groups(odd_documents).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == [(0, 1, 3, False), (0, 2, 2, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 2, True)]
    assert exact.drop_exact_copies(odd_documents).columns == odd_documents.columns
