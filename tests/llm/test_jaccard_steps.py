"""The n-gram join's steps that make it fit larger tables: words by block, sums by range, and a tree that far sets aren't walked in."""

import random

import numpy as np
import pyarrow as pa
import pytest

from provenia.llm import blocks, jaccard

TEXTS = [" A b\tc\x0bd\x0ce\r\nf ", "x", "", None, "\x1c\x85 É éa  É", "ab", "cd", "cd ", " ", "\x00 \x00\x00 Z", "ab cd"]


@pytest.mark.parametrize("texts", [TEXTS, [], [None], [""], [" "], ["a"], ["a", "a"], TEXTS * 40])
def test_words_of_a_block_are_those_of_its_texts(texts):
    for cut in range(min(3, len(texts) + 1)):
        held = pa.array(texts, pa.string()).slice(cut)
        want = [blocks.hashed_words(t, blocks.WordHashes()).tolist() for t in texts[cut:]]
        at, vocab, sizes = blocks.coded_words([held.slice(0, 2), held.slice(2)])
        assert sizes.tolist() == [len(w) for w in want] and vocab[at].tolist() == [h for w in want for h in w]
        assert vocab.tolist() == sorted(set(vocab.tolist()))


def test_a_word_is_hashed_once_in_a_block(monkeypatch):
    seen = []
    hashed = blocks.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(blocks.xxhash, "xxh3_64_intdigest", lambda w: seen.append(w) or hashed(w))
    blocks.coded_words([pa.array(["One two", "one TWO three " * 500])])
    assert sorted(seen) == [b"one", b"three", b"two"]


def test_orders_of_keys_are_sorted():
    rng = np.random.default_rng(2)
    close = (rng.integers(0, 99, 40_000).astype(np.uint64) << np.uint64(57)) | rng.integers(0, 9, 40_000).astype(np.uint64)  # the bits cut off tell them apart
    for keys in (close, rng.integers(0, 2**64, 40_000, np.uint64), np.array([2**64 - 1, 0, 2**64 - 1, 3], np.uint64), np.array([7], np.uint64), np.array([], np.uint64)):
        order = blocks.sorted_order(keys)
        assert sorted(order.tolist()) == list(range(len(keys))) and keys[order].tolist() == sorted(keys.tolist())


def test_sums_of_a_range():
    r = random.Random(4)
    sent = [{r.randrange(300): r.choice([1, 3, 200, 70_000, 2**31]) for _ in range(r.randrange(1, 90))} for _ in range(9)]
    sent = [dict(sorted(x.items())) for x in sent]
    total: dict = {}
    for x in sent:
        for k, v in x.items():
            total[k] = total.get(k, 0) + v
    pack = lambda a: blocks.pack(np.array(list(a), np.uint64))
    table = pa.table([[f"b{i}" for i in range(9)], [0] * 9, [pack(x) for x in sent], [blocks.pack(blocks.narrow(np.array(list(x.values())))) for x in sent], pa.nulls(9, pa.binary())], ["block", "range", "keys", "numbers", "groups"])
    got = blocks.summed(1)(table)
    assert [blocks.together([0], [x]).tolist() for x in got["numbers"].to_pylist()] == [[total[k] for k in x] for x in sent]
    assert got["total"].to_pylist() == [sum(total.values())] * 9 and got["kinds"].to_pylist() == [len(total)] * 9


def group(sets):
    return pa.table([[b"%04d" % i for i in range(len(sets))], [len(s) for s in sets], [blocks.pack(np.array(sorted(s), np.uint64)) for s in sets], pa.array([0] * len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], ["node", "n", "tokens", "side", "label"])


def parts(pairs, n):
    at = list(range(n))
    for a, b in pairs:
        x, y = at[a], at[b]
        at = [x if k == y else k for k in at]
    return {frozenset(i for i in range(n) if at[i] == k) for k in at}


def test_sets_too_far_to_link_are_not_walked_to(monkeypatch):
    """Copies of one text with edits: each shares much with each other, few are near enough."""
    r = random.Random(6)
    base, rare = range(100), iter(range(10**6, 10**7))
    sets = []
    for _ in range(150):
        changed = set(r.sample(base, 22))
        sets.append({next(rare) if k in changed else k for k in base})
    sets += [set(s) | {k} for s, k in zip(sets[:30], r.sample(base, 30), strict=True)]
    walked = []

    class Counted(jaccard.Tree):
        def __init__(self, *a):
            super().__init__(*a)
            numbers = self.numbers
            self.numbers = type("Numbers", (), {"__getitem__": lambda _, k: walked.append(k) or numbers[k]})()

    monkeypatch.setattr(jaccard, "Tree", Counted)
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    got = jaccard.tree_links(group(sets))
    assert parts([(int(a), int(b)) for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)], len(sets)) == parts(near, len(sets))
    assert near and len(walked) < len(sets) ** 2 / 10
