"""Each operator against a brute-force version of its own, on texts with nulls, ties, repeats, empty and long ones."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("provenia.llm")
from provenia.llm import fingerprint, jaccard, mixing, quality, substring_dedup  # noqa: E402
from provenia.llm.bpe import Bpe, bpe_round_trip  # noqa: E402
from provenia.llm.chat import format_chats  # noqa: E402
from provenia.llm.components import components  # noqa: E402
from provenia.llm.exact_dedup import DigestIndex, by_id, drop_exact_copies, exact_dedup, exact_dedup_in_batches, fresh_index  # noqa: E402
from provenia.llm.lm import score_texts  # noqa: E402
from provenia.llm.secrets import scanned  # noqa: E402

VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary files here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, DIGEST string, row string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(5)
    base = [" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(6)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(10 + i, base[0]) for i in range(4)]  # copies
    out += [(20 + i, base[1].replace(" ", "\n\t", i + 1)) for i in range(3)]  # equal but for white space
    for i in range(8):  # near copies, some of them linked only by way of others
        w = base[2].split()
        for k in range(i):
            w[(k * 7) % len(w)] = f"new{k}"
        out.append((30 + i, " ".join(w)))
    out += [(40, None), (41, ""), (42, " \n "), (43, "one two"), (44, "One TWO"), (45, "İstanbul ΣΑΣ ſ K"), (50, "x" * 5000), (51, " ".join(f"w{i % 700}" for i in range(9000)))]
    out += [(None, base[0]), (None, "no id"), (3, base[3]), (3, "another text for id three")]  # null and repeated ids, a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else None, f"s{(d or 0) % 3}" if d != 5 else None, None, 1, "x", "y") for d, t in texts()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def same(df, want, *columns):
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == sorted(want, key=key)


# --- 1 BPE


@needs_vocabulary
def test_bpe_as_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    want = []
    for d, x in texts():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids)))
    got = bpe_round_trip(docs, VOCABULARY)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got.collect()), key=lambda x: key(x[:3])) == sorted(want, key=lambda x: key(x[:3]))
    assert bpe_round_trip(empty, VOCABULARY).count() == 0


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", "<|", "'s", "don't", " ", "\x1c", " ", "é", "é", "ß", "Σ", "12", "!!", "the"]), max_size=8).map("".join))
def test_bpe_of_any_text(text):
    from tokenizers import Tokenizer

    t = _cached("t", lambda: Tokenizer.from_file(VOCABULARY))
    b = _cached("b", lambda: Bpe(Path(VOCABULARY).read_text()))
    ids = t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b.encode(text), "<u4").tolist() == ids
    assert b.decode(b.encode(text)) == t.decode(ids, skip_special_tokens=False)


@needs_vocabulary
def test_bpe_of_every_code_point():
    """Each code point after a letter, a digit and a mark: its class and its lower case are the tokenizer's, whatever Unicode version Python and regex have."""
    from tokenizers import Tokenizer

    t = _cached("t", lambda: Tokenizer.from_file(VOCABULARY))
    b = _cached("b", lambda: Bpe(Path(VOCABULARY).read_text()))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(f"a{c} 1{c}: {c}" for c in points[i : i + 4000]) for i in range(0, len(points), 4000)]
    for block, e in zip(blocks, t.encode_batch(blocks, add_special_tokens=False), strict=True):
        assert np.frombuffer(b.encode(block), "<u4").tolist() == e.ids


_kept: dict = {}


def _cached(k, make):
    if k not in _kept:
        _kept[k] = make()
    return _kept[k]


# --- 2 Jaccard


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))


def shingle_sets(rows):
    out = []
    for _, x in rows:
        w = words(x)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def classes(rows):
    sets, parent = shingle_sets(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= 75 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    best: dict = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        best[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in best.items()}
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def test_jaccard_classes(docs, empty):
    same(jaccard.jaccard_classes(docs), classes(texts()), "doc_id", "n_shingles", "component_id")
    assert jaccard.jaccard_classes(empty).count() == 0


def test_jaccard_in_chunks(spark, monkeypatch):
    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):  # a group larger than a chunk, with links of all strengths
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w[: r.choice([120, 100, 80])])))
    monkeypatch.setattr(jaccard, "CHUNK", 700)
    same(jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")), classes(rows), "doc_id", "n_shingles", "component_id")


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# --- 3 language model


class PlainModel:
    """The same model by recursion over counts: three orders, a pair being a state from two occurrences on."""

    def __init__(self, texts):
        self.c = [Counter(), Counter(), Counter()]  # of n-grams of 1, 2 and 3 tokens; 0 is the start
        for t in texts:
            t = [0, *t]
            for i in range(1, len(t)):
                for n in range(min(3, i + 1)):
                    self.c[n][tuple(t[i - n : i + 1])] += 1
        self.starts, self.n, self.v = len(texts), sum(self.c[0].values()), len(self.c[0])
        self.w = []
        for n in (1, 2):
            once, every = Counter(), Counter()
            for gram, k in self.c[n].items():
                if self.is_state(gram[:-1]):
                    g = self.group(gram[:-1])
                    every[g] += k
                    once[g] += k == 1
            self.w.append(lambda g, once=once, every=every: (once[g] + 0.5) / (every[g] + 1))

    def count(self, history):
        return self.starts if history == (0,) else self.c[len(history) - 1][history]

    def is_state(self, history):
        return self.count(history) >= len(history) and history[-1] is not None

    def group(self, history):
        return 48 if history == (0,) else int(math.log2(self.count(history)))

    def p(self, x, history):
        if not history:
            return (self.c[0][x,] + 1) / (self.n + self.v + 1)
        lower = self.p(x, history[1:])
        if not self.is_state(history):
            return lower
        w = self.w[len(history) - 1](self.group(history))
        return (1 - w) * self.c[len(history)][*history, x] / self.count(history) + w * lower

    def score(self, t):
        t = [0, *t]
        return sum(math.log10(self.p(t[i], tuple(t[max(0, i - 2) : i]))) for i in range(1, len(t)))


def test_lm_scores(docs, empty, monkeypatch):
    from provenia.llm import blocks, lm

    rows = texts()
    tok = [[*words(x), None] for _, x in rows]
    held = [zlib.crc32(("null" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    model = PlainModel([t for t, h in zip(tok, held, strict=True) if not h])
    want = [(d, h, len(t), sum(model.c[0][x,] > 0 for x in t), model.n, sum(math.log10(model.p(x, ())) for x in t), model.score(t)) for (d, _), h, t in zip(rows, held, tok, strict=True)]
    want.sort(key=lambda r: (key(r[:5]), r[5]))
    monkeypatch.setattr(lm, "WALKED", 100)  # many parts of a block; and more ranges than partitions
    monkeypatch.setattr(blocks, "RANGE_TOKENS", 2500)
    got = sorted((tuple(r) for r in score_texts(docs).collect()), key=lambda r: (key(r[:5]), r[5]))
    assert [g[:5] for g in got] == [x[:5] for x in want]
    assert np.allclose([g[5:] for g in got], [x[5:] for x in want], rtol=1e-9)
    assert score_texts(empty).count() == 0
    untrained = score_texts(docs.filter("doc_id = 2 or doc_id = 44"), folds=1, held_fold=0).collect()  # all held out
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in untrained] == [(0, 0, 0, 0)] * 2


def test_automaton_sums_to_one():
    """From each state: over all words, and one that is unknown."""
    from provenia.llm.lm import END, Automaton, Block

    r = random.Random(4)
    texts_of = [[r.randrange(1, 6) for _ in range(r.randrange(1, 9))] for _ in range(40)]
    every = [[a, b, c] for a in (1, 2, 5, 8) for b in (1, 3, 8) for c in range(1, 9)]  # 6 to 8 are unknown
    model = PlainModel([[*t, None] for t in texts_of])
    vocab = np.sort(np.append(np.arange(1, 9, dtype=np.uint64), END))
    place = {None: int(np.searchsorted(vocab, END)), **{i: int(np.searchsorted(vocab, np.uint64(i))) for i in range(1, 9)}}
    read = [[*t, None] for t in every] + [[a, b, None] for a in (1, 2, 5, 8) for b in (1, 3, 8)]
    block = Block(vocab, np.array([place[x] for t in read for x in t]), np.array([len(t) for t in read]))
    grams = [{}, {}]
    for t in read:
        for i in range(1, len(t)):
            grams[0][t[i - 1], t[i]] = grams[1][tuple(t[max(0, i - 2) : i + 1])] = 0
    name = {v: k for k, v in place.items()} | {len(vocab): 0}
    c1 = np.array([model.c[0][name[i],] for i in range(len(vocab))])
    c2 = np.zeros(len(block.pairs), np.int64)
    for b, x, k in zip(block.before, block.at, block.pair, strict=True):
        c2[k] = model.c[1][name[b], name[x]]
    block.add_triples(c2)
    c3 = np.zeros(len(block.triples), np.int64)
    for i in np.flatnonzero(block.triple >= 0):
        c3[block.triple[i]] = model.c[2][name[block.before[i - 1]], name[block.at[i - 1]], name[block.at[i]]]
    weights = tuple(np.array([w(g) for g in range(49)]) for w in model.w)
    walk = Automaton(block, slice(0, len(block.at)), (c1, c2, c3), model.n, model.v, model.starts, weights).walk
    p = defaultdict(dict)
    for t, begin in zip(read, block.begins.tolist(), strict=True):
        assert abs(walk(begin, begin + len(t)) - model.score(t)) < 1e-9
        for n in range(1, len(t)):
            p[tuple(t[:n])][t[n]] = 10 ** (walk(begin, begin + n + 1) - walk(begin, begin + n))
    for h, of in p.items():
        if len(h) == 2:
            assert abs(sum(of[x] for x in (1, 2, 3, 4, 5, 6, None)) - 1) < 1e-9 and of[6] == of[7] == of[8]


# --- 4 chats


def test_chats_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "[/INST]", " [/INST] ", "\\", "\\b \\l \\\\r", "a\\\\", "[ROLE x] y [/ROLE]", "", None, "<s> x </s>", "plain", "ends [/INST", "] [ < \\", "é́\n\n", "\\ [/INST]"]
    roles = ["user", "assistant", "system", None, "", "to]ol <x> \\", "User"]
    rows = [(c, t, roles[(c + t) % len(roles)], nasty[(c * 3 + t) % len(nasty)]) for c in range(12) for t in range(c + 1)]
    rows += [(None, 0, "user", "hi"), (99, None, "user", "b"), (99, None, "user", "a"), (99, 0, "assistant", "z"), (99, 0, "assistant", "z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    want = defaultdict(list)
    for r in sorted(rows, key=lambda r: key((r[0] if r[0] is not None else -1, *[(x is not None, x if x is not None else 0) for x in (r[1], r[2], r[3] or "")]))):
        want[r[0]].append((r[2], r[3] or ""))
    got = format_chats(df).collect()
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        assert r.identical
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss_text == "".join(x for role, x in want[r.conv_id] if role == "assistant")
    assert format_chats(df.limit(0)).count() == 0


# --- 5 quality


def test_quality_on_held_out_rows(spark):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choice("abcdefghiou") for _ in range(r.randrange(2, 8))) for _ in range(60)) + "."
    bad = lambda i: [" ".join(w + "%%%" for w in good().split()), " ".join(x for w in good().split()[:6] for x in [w] * 8), good().upper()][i % 3]
    rows = [(i, bad(i) if i % 4 == 0 else good()) for i in range(480)]
    docs = spark.createDataFrame([*[(i, t, "l", "s", 0.1) for i, t in rows], (None, None, None, None, None), (1000, "", "l", "s", None)], "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([*[(i, int(i % 4 > 0), 0) for i, _ in rows], (None, 1, 0), (7, 1 - int(7 % 4 > 0), 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    df = quality.quality_scores(docs, quality.fit_quality(docs, labels))
    assert df.columns == [*docs.columns, "_score", "predicted", "held_out"]  # a column of that name keeps it
    out = df.collect()
    assert len(out) == 482 and all(0 <= x._score <= 1 and x.predicted == int(x._score >= 0.5) and x.score in (0.1, None) for x in out)
    held = [x for x in out if x.held_out and x.doc_id is not None and x.doc_id < 480]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in out if x.doc_id is not None)
    assert sum(x.predicted == int(x.doc_id % 4 > 0) for x in held) / len(held) > 0.9
    assert {x._score for x in quality.quality_scores(docs, quality.fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), None).count() == 0


def slow_score(net, text):
    """The network by its definition, chunk by chunk, over the whole text at once."""
    p = net.p
    padded = text + bytes(quality.WIDTH)
    a = [np.maximum(sum(p["taps"][k][padded[i + k]] for k in range(quality.WIDTH)) + p["bias"], 0) for i in range(len(text))]
    best = np.zeros(quality.UNITS)
    for s in range(0, max(len(text), 1), quality.HALF):
        chunk = np.array(a[s : s + 2 * quality.HALF]).reshape(-1, quality.FILTERS)
        x = np.concatenate([chunk.max(axis=0), chunk.mean(axis=0)]) if len(chunk) else np.zeros(2 * quality.FILTERS)
        best = np.maximum(best, np.maximum(x @ p["up"] + p["level"], 0))
    return 1 / (1 + np.exp(-(best @ p["out"] + p["base"][0])))


def test_network_scores_whole_texts(monkeypatch):
    """Of any length, in pieces or not, alone or together with others."""
    net, r = quality.Network(3), random.Random(8)
    net.p["bias"] += 0.05
    texts_of = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 31, 32, 33, 63, 64, 65, 200, 1000, 1057)]
    want = [slow_score(net, t) for t in texts_of]
    assert np.allclose(net.scores(texts_of), want, atol=1e-5)
    monkeypatch.setattr(quality, "PIECE", 128)
    monkeypatch.setattr(quality, "TOGETHER", 300)
    assert np.allclose(net.scores(texts_of), want, atol=1e-5)
    assert np.allclose([net.scores([t])[0] for t in texts_of], want, atol=1e-5)


def test_network_gradients():
    net = quality.Network(3)
    many = [bytes(range(200)) * 2, b"abc", b"some other text, " * 9]
    d = np.array([1.0, -0.5, 0.7], np.float32)
    g = net.gradients(net.units(net.chunks(many)), d)
    value = lambda: float(d @ (net.units(net.chunks(many))["pooled"] @ net.p["out"] + net.p["base"][0]))
    for k, at in (("out", 3), ("base", 0), ("bias", 2), ("level", 1), ("up", (2, 3)), ("up", (20, 3)), ("taps", (1, 101, 2)), ("taps", (0, 98, 5))):
        old = net.p[k][at]
        net.p[k][at] = old + 2e-3
        up = value()
        net.p[k][at] = old - 2e-3
        down = value()
        net.p[k][at] = old
        assert abs((up - down) / 4e-3 - g[k][at]) < 2e-2 * max(1, abs(g[k][at])), k


def test_quality_sample_is_one_text_an_id_and_has_long_ones(spark):
    rows = [(i, f"{'good' if i % 2 else 'bad'} text {i} " * 5) for i in range(40)]
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.fit_quality(df(rows), labels)
    again = quality.fit_quality(df(rows + [r for r in rows if r[0] < 9] * 7), labels)
    assert all((model.p[k] == again.p[k]).all() for k in model.p)  # a repeated id counts once
    long = quality.fit_quality(df([(i, t * 6000 if i % 2 else t) for i, t in rows]), labels)
    assert long is not None and quality.fit_quality(df([r for r in rows if r[0] % 2]), labels) is None


# --- 6 fingerprints


def signed(x, bits=64):
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def xx(*parts):
    """Spark's xxhash64: each part's hash is the next one's seed."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(p.encode() if isinstance(p, str) else struct.pack("<q" if isinstance(p, np.int64) else "<i", int(p)), seed=seed).intdigest()
    return seed


def murmur(*longs):
    """Spark's hash of longs."""
    rot, m = lambda v, r: (v << r | v >> (32 - r)) & 0xFFFFFFFF, 0xFFFFFFFF
    h = 42
    for x in longs:
        for k in (x & m, x >> 32 & m):
            h ^= rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
            h = (rot(h, 13) * 5 + 0xE6546B64) & m
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        h ^= h >> 16
    return h


def order_min_hash(text):
    unspaced = "\u0e00-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
    w = re.findall(f"[{unspaced}]|[^\x20\x09-\x0d{unspaced}]{{1,8}}", text) or [""]
    seen, grams = Counter(), []
    for i in range(len(w)):
        h = signed(xx(*w[i : i + fingerprint.K])) >> 24
        if seen[h]:
            grams.append((i, signed(xx(np.int64(h), seen[h])) >> 24))
        else:
            grams.append((i, h))
        seen[h] += 1
    out = []
    picked = []
    for i in range(fingerprint.MINIMA // 2):
        for half in (lambda h: h >> 32, lambda h: h & 0xFFFFFFFF):
            picked.append(min((half(xx(i, np.int64(g))), at) for at, g in grams))
    for one, two in zip(picked, [*picked[1:], picked[0]], strict=True):
        a, b = (one, two) if one[1] <= two[1] else (two, one)
        out.append(murmur(a[0], b[0]))
    return out


def test_fingerprints(spark, docs, empty):
    """Fingerprints and both likenesses by brute force; null and repeated ids have rows too."""
    rows = sorted(set(texts()) - {(None, "no id"), (3, "another text for id three")}, key=lambda r: -(r[0] if r[0] is not None else -1))
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs.filter("text is distinct from 'another text for id three' and text is distinct from 'no id'")).collect()}
    as_hex = lambda f: "".join(f"{x:08x}" for x in f)
    prints = [order_min_hash(x or "") for _, x in rows]
    like = lambda f, g: math.sqrt(sum(a == b for a, b in zip(f, g, strict=True)) / len(f))
    assert len(got) == len(rows)
    for i, (d, x) in enumerate(rows):
        j = (i + 1) % len(rows)
        x, y = x or "", rows[j][1] or ""
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        r, other = got[d], order_min_hash(edited)
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (as_hex(prints[i]), as_hex(other))
        assert (r.near_edited, r.near_next) == (like(prints[i], other), like(prints[i], prints[j]))
    every = Counter((r.doc_id, r.n_chars) for r in fingerprint.fingerprints(docs).collect())
    assert every == Counter((d, len(x or "")) for d, x in texts())
    assert fingerprint.fingerprints(empty).count() == 0


def test_fingerprint_follows_order_and_occurrence(spark):
    w = [f"t{i}" for i in range(200)]
    versions = {"same": " ".join(w), "swapped": " ".join(w[100:] + w[:100]), "shuffled": " ".join(random.Random(2).sample(w, 200)), "edited": " ".join(w[:190] + ["z"] * 10), "twice": " ".join(w + w), "long": " ".join(w * 100)}
    df = spark.createDataFrame([(k, v) for k, v in versions.items()], "k string, text string")
    fp = {r.k: r.f for r in fingerprint.with_fingerprint(df, "text", "f", ["k"]).collect()}
    like = {k: sum(a == b for a, b in zip(fp["same"], f, strict=True)) / len(f) for k, f in fp.items()}
    assert like["same"] == 1 and like["edited"] > 0.6 and like["shuffled"] < 0.2 and 0.2 < like["swapped"] < 0.8 and like["long"] < like["twice"] < 1


def test_half_of_a_text_is_seen_in_any_script(spark):
    """Also without spaces; texts of their own have next to nothing in common."""
    r = random.Random(9)
    scripts = {"han": lambda: chr(r.randint(0x4E00, 0x9FFF)), "thai": lambda: chr(r.randint(0xE01, 0xE3A)), "kana": lambda: chr(r.randint(0x3041, 0x3096)), "unbroken": lambda: r.choice("abcdefghijklmnop"), "words": lambda: r.choice("abcdefgh   ") + r.choice("aeiou")}
    rows = [(100 * i + k, "".join(draw() for _ in range(r.choice([250, 2000])))) for i, draw in enumerate(scripts.values()) for k in range(8)]
    out = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = sorted(x["near_edited"] for x in out)
    assert near[0] > 0 and near[len(near) // 2] > 0.25
    assert sorted(x["near_next"] for x in out)[len(out) // 2] < 0.15


# --- 7 mixing


def test_schedule_keeps_each_source_within_a_block():
    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 100, "b": 1}, {"x": 1}):
        q = mixing.quotas({k: float(v) for k, v in weights.items()}, 1000)
        assert sum(q.values()) == 1000
        done = Counter()
        for s, k, slot, release, deadline in mixing.schedule(q, 1000):
            assert release <= slot < deadline and k == done[s]
            done[s] += 1
            assert all(abs(done[x] - (slot + 1) * q[x] / 1000) < 1 for x in q)


def test_mix_order(docs, empty):
    n = len(texts())
    out = mixing.mix_order(docs, block=2).collect()
    assert sorted(r.position for r in out) == list(range(n)) and Counter(r.doc_id for r in out) == Counter(d for d, _ in texts())
    for r in out:
        assert r.release <= r.slot < r.deadline
    by = sorted(out, key=lambda r: r.position)
    assert [r.slot for r in by] == sorted(r.slot for r in by)
    for s in {r.source for r in out}:
        own = [r.doc_id for r in by if r.source == s]
        assert own == sorted(own, key=lambda d: (d is None, d or 0))
    assert mixing.mix_order(empty).count() == 0
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, docs.collect()))


def test_mix_keeps_to_the_weights_over_many_periods(spark):
    """After each slot, each source that isn't used up is less than a block from its weight's own share, however long the data."""
    for weights, sizes in ((None, {"a": 3001, "b": 3001, "c": 3001}), ({"a": 1, "b": 0.0001}, {"a": 12_000, "b": 2}), ({"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 1400, "b": 10, "c": 200}), ({"a": 0.123456789012, "b": 98765.4321}, {"a": 1, "b": 3000})):
        df = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
        out = sorted(mixing.mix_order(df, weights, block=1).collect(), key=lambda r: r.slot)
        assert Counter(r.source for r in out) == Counter(sizes) and [r.position for r in out] == list(range(len(out))) and len({r.slot for r in out}) == len(out)
        told = {s: Fraction(str((weights or {}).get(s, 1))) for s in sizes}
        done, total = Counter(), sum(told.values())
        for r in out:
            assert r.release <= r.slot < r.deadline and r.block == done[r.source]
            for at in (r.slot, r.slot + 1):  # slots before and after this one; those between two rows are empty
                assert all(abs(done[s] - at * told[s] / total) < 1 for s in told if done[s] < sizes[s])
                done[r.source] += at == r.slot


def test_mix_is_the_earliest_deadline_first(spark):
    """Slot by slot: of the blocks that are released and not yet run the one with the earliest deadline; each period as the first, without the blocks that aren't there."""
    weights, sizes, block = {"a": 3, "b": 0.5, "c": "1/3"}, {"a": 90, "b": 31, "c": 3, "d": 40, None: 7}, 2
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    got = mixing.mix_order(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=block).collect()
    told = {s: Fraction(str(weights.get(s, 1))) for s in sizes}
    total = sum(told.values())
    period = math.lcm(*((w / total).denominator for w in told.values()))
    have = {s: -(-n // block) for s, n in sizes.items()}
    quota = {s: min(int(told[s] / total * period), have[s]) for s in sizes}
    plan, done = {}, Counter()
    for slot in range(period):
        released = []
        for s in sizes:
            step = total / told[s]
            if done[s] < quota[s] and math.floor(done[s] * step) <= slot:
                released.append((math.ceil((done[s] + 1) * step), math.floor(done[s] * step), s or "\x00", s))
        if released:  # of equal deadlines the first source by name
            s = min(released, key=lambda r: (r[0], r[2]))[3]
            plan[s, done[s]] = slot
            done[s] += 1
    want = sorted((b // quota[s] * period + plan[s, b % quota[s]], i, s) for s, n in sizes.items() for i in range(n) for b in [i // block])
    assert [(r.slot, r.doc_id, r.source) for r in sorted(got, key=lambda r: r.position)] == want


# --- 8 exact dedup


def test_exact_dedup(spark, docs, empty):
    rows = texts()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", x or "") for _, x in rows]
    groups = defaultdict(list)
    for (d, _), x in zip(rows, norm, strict=True):
        groups[x].append(d)
    least = {x: min((d for d in v if d is not None), default=None) for x, v in groups.items()}
    out = exact_dedup(docs, fresh_index(spark, "t1")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == Counter((d, least[x], len(groups[x]), hashlib.sha256(x.encode()).hexdigest()) for (d, _), x in zip(rows, norm, strict=True))
    assert sum(r.kept for r in out) == len(groups) and all(r.doc_id == r.keep_id for r in out if r.kept)
    kept = drop_exact_copies(docs, fresh_index(spark, "t2")).collect()
    assert Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept) == Counter(list(groups))
    assert exact_dedup(empty, fresh_index(spark, "t3")).count() == 0


def test_digest_index_outlives_its_session(spark, docs):
    index = fresh_index(spark, "t4")
    first, second = docs.filter("doc_id < 20"), docs.filter("doc_id >= 20")
    a = [r.doc_id for r in exact_dedup(first, index).collect() if r.kept]  # an id may stay twice, with different texts
    path, buckets = index.path, index.buckets
    spark.sql(f"DROP TABLE {index.table}")  # the catalog forgets, the files stay
    again = DigestIndex(spark, path, buckets)
    assert again.read().count() == len(a)
    b = {r.doc_id: r for r in exact_dedup(second, again).collect()}
    assert 20 not in {d for d, r in b.items() if r.kept} and b[20].keep_id == 1 and 43 in {d for d, r in b.items() if r.kept}
    assert again.read().count() == len(a) + sum(r.kept for r in b.values())
    assert not [r for r in exact_dedup(second, again).collect() if r.kept]


def test_a_batch_that_runs_again_keeps_its_rows(spark, docs, monkeypatch):
    """Its first run may have died after its digests were appended; other batches still meet them."""
    from provenia.llm import exact_dedup as module

    monkeypatch.setattr(module, "COMPACT_AT", 0)
    index, kept = fresh_index(spark, "t5"), lambda rows: Counter((r.doc_id, r.keep_id) for r in rows.collect() if r.kept)
    first = kept(exact_dedup(docs, index, batch="one"))
    size = index.read().count()
    assert sum(first.values()) == size and kept(exact_dedup(docs, index, batch="one")) == first
    assert not kept(exact_dedup(docs, index, batch="two")) and index.read().count() == size
    assert index.version > 0 and len(index.read().inputFiles()) <= index.buckets and DigestIndex(spark, index.path, index.buckets).version == index.version
    index.forget("one")
    assert index.read().count() == 0 and kept(exact_dedup(docs, index, batch="two")) == first
    assert fresh_index(spark, "t5").path != index.path and len({DigestIndex(spark, index.path + x, 8).table for x in ("/a-b", "/a_b")}) == 2


def test_copies_of_rows_with_equal_ids(spark):
    """Columns with any name stay as they are, and of rows with the same id and equal text the first stays whole."""
    rows = [(1, "a  b", "m1", "x"), (1, "a b", "m2", "y"), (1, "c", "m3", "z"), (None, "c", "m4", "w"), (None, None, "m5", "v"), (None, "", "m6", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _sha string, _id string").coalesce(1)
    assert sorted(r._sha for r in drop_exact_copies(df, fresh_index(spark, "t6")).collect()) == ["m1", "m3", "m5"]
    assert drop_exact_copies(df.limit(0), fresh_index(spark, "t7")).count() == 0


def test_batches_meet_in_the_index(spark, docs, empty):
    """Two or more batches by id give what one gives, but the second is decided by an anti-join with the index, which is read where it lies."""
    one = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, fresh_index(spark, "t8")).collect())
    for n in (2, 5):
        index = fresh_index(spark, "t9")
        parts = by_id(docs, batches=n)
        assert len(parts) == n and sum(p.count() for p in parts) == docs.count()
        out = exact_dedup_in_batches(parts, index)
        assert index.read().groupBy("digest").count().filter("count > 1").isEmpty() and index.read().select("batch").distinct().count() > 1
        table, plan = index.table, index.unseen(docs.select(F.unhex(F.sha2("text", 256)).alias("digest")).distinct())._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert plan.count("Exchange hashpartitioning(digest") == 1  # that of the batch
        index.drop()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()) == one and not spark.catalog.tableExists(table)
    assert exact_dedup_in_batches(by_id(empty), fresh_index(spark, "t10")).count() == 0
    assert exact_dedup_in_batches(by_id(docs.filter("doc_id is null")), fresh_index(spark, "t11")).count() == 2


def test_nothing_stays_in_the_catalog(spark, tmp_path, docs):
    from provenia.llm.queries import QUERIES

    before = {t.name for t in spark.catalog.listTables()}
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op2_jaccard", "op3_lm", "op8_exact_dedup"):
        QUERIES[name](spark, str(tmp_path)).count()
    assert {t.name for t in spark.catalog.listTables()} <= before


# --- 9 substring dedup


def later_units(rows, by, least):
    """(doc_id, unit, start, stop, n_words, kept_doc_id, kept_start, run_words), by ids, nulls last."""
    seen, want = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        marks, at = [], 0
        pieces = []
        for line in (t or "").split("\n"):
            cut, here = [], 0
            for m in re.finditer(r"[.!?](?=[\x20\x09-\x0D])", line) if by == "sentence" else ():
                cut.append(line[here : m.end()])
                here = m.end()
            for piece in [*cut, line[here:]]:
                pieces.append((at, piece))
                at += len(piece)
            at += 1
        for start, piece in pieces:
            w = words(piece)
            if w:
                marks.append((start, start + len(piece), len(w), seen.get(tuple(w))))
                seen.setdefault(tuple(w), (d, start))
        i = 0
        while i < len(marks):
            j = i
            while j < len(marks) and marks[j][3]:
                j += 1
            run = sum(m[2] for m in marks[i:j])
            if run >= least:
                want += [(d, i + k, *m[:3], *m[3], run) for k, m in enumerate(marks[i:j])]
            i = max(j, i + 1)
    return want


UNIT_COLUMNS = ("doc_id", "unit", "start", "stop", "n_words", "kept_doc_id", "kept_start", "run_words")


def test_repeated_units(spark):
    long = ". ".join(" ".join(f"p{i}x{j}" for i in range(11)) for j in range(5))
    rows = [(2, f"own two\n{long}.\nend"), (1, f"own one {long}.\nend"), (3, f"{long.upper()}.  \n\nend\n{long}.  rest? Yes! no"), (4, "end"), (5, None), (6, ""), (None, f"x\n{long}."), (7, "a b\n" * 15), (8, f"mid {long}. é yes! no")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, unit int")
    for by, least in (("sentence", 25), ("sentence", 1), ("line", 25), ("line", 1)):
        same(substring_dedup.repeated_units(df, least_words=least, by=by), later_units(rows, by, least), *UNIT_COLUMNS)
    # a passage inside other lines is found from its second sentence on
    assert {r.doc_id for r in substring_dedup.repeated_units(df, by="sentence").collect()} == {2, 3, None, 7, 8}
    assert substring_dedup.repeated_units(df.limit(0)).count() == 0


def test_texts_without_repeated_units(spark):
    """Null and repeated ids, and columns with the names of the operator's own."""
    long = ". ".join(" ".join(f"p{i}x{j}" for i in range(11)) for j in range(5))
    rows = [(1, f"own one. {long}.\nend", "a"), (1, f"own two.\n{long}.\nend", "b"), (None, f"é {long}. Rest. More", "c"), (None, None, "d"), (2, "", "e"), (2, "x", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    out = substring_dedup.deduplicated(df, by="sentence")
    assert out.columns == ["doc_id", "text", "removed", "_removed"]
    got = {r.removed: r for r in out.collect()}
    assert got["a"].text == rows[0][1] and got["b"].text == "own two.\n\n" and got["d"].text is None and got["e"].text == "" and got["f"].text == "x"
    assert got["c"].text == f"é {long.split('. ')[0]}. Rest. More"
    for r in rows:
        kept, at = "", 0
        for s in got[r[2]]._removed:
            kept, at = kept + r[1][at : s.start], s.stop
        assert kept + (r[1] or "")[at:] == (got[r[2]].text or "")
    assert substring_dedup.deduplicated(df.limit(0)).count() == 0


def later_clauses(rows, least):
    """What repeated_units finds by clause: words whose hash is the least of the two before and after begin one; three in a row are compared."""
    seen, want = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        found = [(m.start(), m.end(), m.group().encode().lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        h = [int(hashlib.md5(w).hexdigest()[:8], 16) for _, _, w in found]
        at = [i for i in range(len(h)) if i == 0 or all(h[i] < x for x in h[max(0, i - 2) : i]) and all(h[i] <= x for x in h[i + 1 : i + 3])]
        parts = [found[a:b] for a, b in zip(at, [*at[1:], len(h)][: len(at)], strict=True)]
        starts = [p[0][0] for p in parts]
        kept = {}
        for k in range(max(1, len(parts) - 2) if parts else 0):
            key = tuple(tuple(w for *_, w in p) for p in parts[k : k + 3])
            if key in seen:
                for u in range(k, min(k + 3, len(parts))):
                    kept.setdefault(u, seen[key])
            else:
                seen[key] = (d, starts[k])
        for _, group in itertools.groupby(enumerate(sorted(kept)), lambda x: x[1] - x[0]):
            run = [u for _, u in group]
            total = sum(len(parts[u]) for u in run)
            if total >= least:
                want += [(d, u, starts[u], starts[u + 1] if u + 1 < len(parts) else parts[u][-1][1], len(parts[u]), *kept[u], total) for u in run]
    return want


def test_repeated_clauses(spark):
    r = random.Random(6)
    text = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randint(0, 400)}" for _ in range(n))
    passages = [text(55) for _ in range(4)]
    rows = [(i, f"{text(r.randint(0, 90))}\n{passages[i % 4]} é日 {text(r.randint(0, 90))}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "one two"), (104, "one  TWO"), (105, "w " * 300), (106, passages[0]), (None, passages[1].upper()), (107, text(30_000)), (108, "x" * 200_000), (108, "y " + rows[7][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, unit int")
    for least in (1, 25):
        same(substring_dedup.repeated_units(df, least_words=least), later_clauses(rows, least), *UNIT_COLUMNS)
    # but for a few words at its edges each later copy of a passage goes
    removed = Counter()
    for x in later_clauses(rows, 25):
        removed[x[0]] += x[4]
    assert min(removed[i] for i in range(4, 40)) >= 40 and removed[103] == 0 and set(removed) <= {*range(4, 40), 106, None, 105, 108}
    out = {x["doc_id"]: x for x in substring_dedup.deduplicated(df.filter("doc_id < 108 or doc_id is null")).collect()}
    for d, t in rows:
        if d != 108:
            kept, at = "", 0
            for s in out[d]["removed"]:
                kept, at = kept + t[at : s["start"]], s["stop"]
            assert out[d]["text"] == (None if t is None else kept + t[at:])
    with pytest.raises(ValueError, match="no unit"):
        substring_dedup.repeated_units(df, by="page")


def test_every_later_unit_is_found(spark, tmp_path):
    from provenia.llm.queries import QUERIES

    rows = [(2, "own two\nAll rights  reserved.\nmore"), (1, "all rights reserved.\nown one"), (3, "more\n\nall rights reserved. all rights reserved."), (None, "own one"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for by, n in (("line", 3), ("sentence", 5)):
        got = QUERIES["op9_repeated_lines" if by == "line" else "op9_repeated_units"](spark, str(tmp_path))
        same(got, later_units(rows, by, 1), *UNIT_COLUMNS)
        assert got.count() == n
    assert QUERIES["op9_substring_dedup"](spark, str(tmp_path)).count() == 0


# --- 10 secrets


def test_secrets(spark):
    token = "Ab3dEf6hIj9lMn2pQr5t"
    rows = [(1, f"password: token=abcdef secret={token}", "s1"), (2, "AKIA" + "Z" * 16 + " AKIAshort AKIA" + "Q" * 15, "s2"), (3, "password=token: abcdefgh", "s3"), (4, "é" * 3 + "0123456789abcdef01234567 x", "s4"), (5, None, "s5"), (6, "", None), (7, f"bare {token} here", "s1")]
    rows += [(10 + i, 'API_KEY = "same-value-for-all"', f"o{i}") for i in range(4)] + [(7, f"bare {token} here", "s1"), (None, "secret=x1y2z3q9w8", "s9")]
    df = spark.createDataFrame([(d, t, s, None, 0) for d, t, s in rows], "doc_id long, text string, source string, lang string, n_hex int")
    pattern = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = []
    for d, t, _ in rows:
        t = t or ""
        s = sorted([(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[1]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s)
        want.append((d, *[sum(x[1] == k for x in s) for k in range(3)], hashlib.sha256(base.encode()).hexdigest()))
    out = scanned(df)
    same(out, want, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    by = {r.doc_id: r for r in out.collect()}
    assert by[7].spans == "bare:5:25" and by[7].n_live == 1  # the value of another document's assignment
    assert all(by[10 + i].n_example == 1 and by[10 + i].n_live == 0 for i in range(4))
    assert by[5].spans == "" and scanned(df.limit(0)).count() == 0
