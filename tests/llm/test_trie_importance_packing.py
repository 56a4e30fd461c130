"""Prefix trie, importance resampling and packing against brute-force versions of their own."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("provenia.llm")
from provenia.llm import importance, packing, prefix_trie  # noqa: E402
from provenia.llm.importance import features, resampled, words  # noqa: E402
from provenia.llm.packing import LENGTH, Encoder, capacities, cost, pack, packed_documents, windows  # noqa: E402
from provenia.llm.prefix_trie import TURN, lcp, merged, sorted_run  # noqa: E402

VOCABULARY = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary files here")
DOCS = "doc_id long, text string, ids string, TUPLES int, start string, rank int"
TURNS = "conv_id long, turn long, role string, text string, key string, CHARS int, seq string"


# --- prefix trie


def unit(n: int) -> bytes:
    return n.to_bytes(TURN, "big")


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.lists(st.integers(0, 2), max_size=5), max_size=12), max_size=9))
def test_loser_tree_merges_with_shared_turns(runs):
    keys = [[b"".join(map(unit, s)) for s in run] for run in runs]
    made = [sorted_run(k, list(range(len(k)))) for k in keys]
    out = list(merged(made))
    assert [k for _, k, _ in out] == sorted(itertools.chain(*keys))
    assert [h for h, _, _ in out] == [lcp(a, b) for a, b in zip([b"", *(k for _, k, _ in out)], [k for _, k, _ in out], strict=False)]


def test_loser_tree_compares_no_shared_turn_again(monkeypatch):
    looked = []

    def counted(a, b, known=0):
        found = lcp(a, b, known)
        looked.append(found - known + 1)
        return found

    shared = b"".join(map(unit, range(50)))
    runs = [sorted_run([shared + unit(100 + 8 * i + r) for i in range(20)], list(range(20))) for r in range(8)]
    monkeypatch.setattr(prefix_trie, "lcp", counted)
    assert len(list(merged(runs))) == 160
    # the first 50 turns are compared when the tree is built, and then never again
    assert sum(looked) < 8 * 51 + 160 * 3 * 2


def talks() -> list[tuple]:
    r = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 225), 300, 399, 1000]:
        for t in range(r.choice([0, 1, 1, 2, 3, 5, 7, 9])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["", "a", "bb", None, "hello there"])))
    for c in range(400, 460):  # copies, many of one conversation
        rows += [(c, 0, "system", "be brief"), (c, 1, "user", "hi")]
    rows += [(500, None, "user", "without a turn"), (500, 3, "user", "x"), (500, 3, "user", "x"), (500, 3, "assistant", "x")]  # null turn, repeated row, tie
    rows += [(None, 0, "user", "no id"), (None, 1, "user", "no id")]
    rows += [(600, 0, "user", "x" * 100_000)] + [(700, t, "user", str(t)) for t in range(300)]  # a long text, many turns
    return rows


def trie_by_hand(rows: list[tuple]) -> Counter:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:TURN], role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    told = lambda c: "" if c is None else str(c)
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(told(c).encode()) % 6
        lent = own.get(c - c % 100, []) if c is not None else []
        convs[c] = tuple(lent[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    least = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(told(c) for c in sorted((c for c in members[p] if convs[c] == p), key=lambda c: (c is not None, c or 0))).encode()).hexdigest()
    return Counter((least[p], len(p), least[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


@pytest.mark.parametrize("range_turns", [prefix_trie.RANGE_TURNS, 40])
def test_prefix_trie(spark, monkeypatch, range_turns):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", range_turns)
    rows = talks()
    df = spark.createDataFrame([(*x, "k", 1, "s") for x in rows], TURNS)
    out = prefix_trie.prefix_trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, out.collect())) == trie_by_hand(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == []


# --- importance resampling


def test_words_and_features():
    assert [w.decode() for w in words("A-Z, é1 x\x00y İ_z\xa0w")] == ["a", "z", "é1", "x", "y", "İ", "z\xa0w"] and words(None) == []
    texts = [["a", "b", "a", "b"], [], ["b"], ["c", "a"]]
    for order in (1, 2, 3, 6):
        sizes, owners, hashed = features([[w.encode() for w in t] for t in texts], order, 997)
        want = [[" ".join(t[i : i + n]) for n in range(1, order + 1) for i in range(len(t) - n + 1)] for t in texts]
        assert sizes == [len(w) for w in want]
        assert Counter(zip(owners.tolist(), hashed.tolist(), strict=True)) == Counter((i, zlib.crc32(f.encode()) % 997) for i, w in enumerate(want) for f in w)


def test_each_distinct_tuple_is_hashed_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(importance.zlib, "crc32", lambda x: hashed.append(x) or 7)
    features([[b"a", b"b"] * 50, [b"a", b"b"]], 2)
    assert sorted(hashed) == [b"a", b"a b", b"b", b"b a"]


def documents() -> list[tuple]:
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "日本", "x\x00y"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 19, 20, 40, 90])))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " ,;- "), (903, "w1 " * 30_000), (904, "z" * 200_000), (None, "w1 W2 " * 15), (7, rows[7][1]), (8, "w3 " * 25)]
    return rows


def drawn_by_hand(rows: list[tuple], target: list[str | None], order: int, buckets: int, percent: int) -> list[tuple]:
    split = lambda t: [w for w in re.split("[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    feats = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]
    own = [(i, split(t)) for i, t in rows]
    s, t = Counter(b for _, w in own for b in feats(w)), Counter(b for x in target for b in feats(split(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, w in own:
        f = feats(w)
        weight = math.floor(sum(map(gain, f)) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[5] = k + 1
    return [tuple(x) for x in out]


@pytest.mark.parametrize(("order", "buckets", "percent"), [(1, 10_000, 10), (3, 500, 35)])
def test_resampled(spark, order, buckets, percent):
    rows, target = documents(), ["w1 w2 w3 W4", None, "", "Straße w5 w5 unknown"]
    df = spark.createDataFrame([(*x, "i", 1, "s", 2) for x in rows], DOCS)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    out = resampled(df, wanted, order=order, buckets=buckets, percent=percent)
    assert Counter(map(tuple, out.collect())) == Counter(drawn_by_hand(rows, target, order, buckets, percent))


def test_resampled_empty(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "w " * 30, None, None, None, None)], DOCS)
    text = spark.createDataFrame([], "text string")
    assert resampled(none, text).collect() == []
    (row,) = resampled(some, text, percent=100).collect()
    assert row["n_features"] == 30 and row["weight"] == drawn_by_hand([(1, "w " * 30)], [], 1, 10_000, 100)[0][3] and row["rank"] == 1


# --- packing


def test_capacities():
    assert capacities(2048 * 2 + 21, 2048, True) == [2048, 2048, 16, 4, 1]
    assert capacities(2048 * 2 + 21, 2048, False) == [2048, 2048]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 15), max_size=40), st.integers(1, 60))
def test_windows_fill_sequences(sizes, window):
    parts = [p for part in windows(enumerate(sizes), length=8, window=window) for p in part]
    docs, sequences = defaultdict(list), defaultdict(list)
    for d, start, n, s, offset in parts:
        assert n > 0
        docs[d].append((start, n))
        sequences[s].append((offset, n))
    gapless = lambda x: sorted(x) == [(sum(n for _, n in sorted(x)[:i]), n) for i, (_, n) in enumerate(sorted(x))]
    assert all(gapless(x) for x in [*docs.values(), *sequences.values()])
    assert {d: sum(n for _, n in x) for d, x in docs.items()} == dict(enumerate(sizes))
    assert set(sequences) == set(range(len(sequences)))
    filled = Counter(sum(n for _, n in x) for x in sequences.values())
    assert set(filled) <= {1, 2, 4, 8} and all(filled[k] <= 1 for k in (1, 2, 4))


def test_longest_first_to_the_cheapest():
    out = pack([(0, 0, 6), (1, 0, 4), (2, 0, 3), (3, 0, 3)], [8, 8])
    assert out[:3] == [(0, 0, 6, 0, 0), (1, 0, 4, 1, 0), (2, 0, 3, 1, 4)]
    assert sorted(out[3:]) == [(3, 0, 2, 0, 6), (3, 2, 1, 1, 7)]
    r = random.Random(1)
    sizes = [r.randint(1, 1500) for _ in range(4000)]
    spent = defaultdict(int)
    for part in windows(enumerate(sizes)):
        for _, _, n, s, _ in part:
            spent[s] += cost(n)
    full = sorted(spent.values())[11:]  # without the powers of two at the end
    assert full[-1] / full[0] < 1.45
    in_turn = [cost(n) for n in sizes]
    assert sum(full) < sum(in_turn)


@needs_vocabulary
def test_encoder_as_the_library():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    encoder = Encoder(Path(VOCABULARY).read_text())
    same = lambda t: np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    for base in range(0, 0x110000, 256):
        for form in ("a{}b ", " {}!{}", "1{}  {}'s"):
            assert same("|".join(form.replace("{}", chr(c)) for c in range(base, base + 256) if not 0xD800 <= c < 0xE000)), hex(base)
    for t in ("", " ", "  a\n\n b \t", "it's  we'LL", "<|endoftext|> x<|endoftext|>", "<|endoftext", " " * 50_000, "a" * 50_000, "\x1c\x85\xa0 x", "日本語" * 9_000):
        assert same(t), t[:20]


@needs_vocabulary
def test_packed_documents(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    rows = documents()
    df = spark.createDataFrame([(*x, "i", 1, "s", 2) for x in rows], DOCS).repartition(3)
    out = packed_documents(df, VOCABULARY, window=6000)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for p in out.collect():
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and len(p["ids"]) == p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        if rows.count((p["doc_id"], next(t for i, t in rows if i == p["doc_id"]))) == 1 and sum(i == p["doc_id"] for i, _ in rows) == 1:
            pieces[p["doc_id"]][p["start"]] = p
    for i, parts in pieces.items():
        want = library.encode(next(t for j, t in rows if j == i) or "", add_special_tokens=False).ids + [1]
        assert list(itertools.chain(*(parts[s]["ids"] for s in sorted(parts)))) == want and {p["doc_tokens"] for p in parts.values()} == {len(want)}
        assert sorted(parts) == [sum(parts[s]["length"] for s in sorted(parts)[:k]) for k in range(len(parts))]
    for x in sequences.values():
        assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))]
        total = sum(n for _, n in x)
        assert total == LENGTH or total & (total - 1) == 0
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(n for x in sequences.values() for _, n in x) == total
    assert packed_documents(df.limit(0), VOCABULARY).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        packed_documents(df, VOCABULARY, length=1000)
    assert packing.END == 1
