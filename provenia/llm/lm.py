"""Language-model scores: a weighted backoff automaton over smoothed n-grams of one to three tokens, walked from left to right."""

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.blocks import RETURNED, SENT, WordHashes, blocks_of, hashed_words, mix, pack, ranges_for, sent, summed, together, unpack
from provenia.llm.common import parallelism, stage, stage_by, unstage, workers_find_package

#: The end of a text, a token; and the state before the first one, which is no token.
END, START = np.uint64(0x45F3_11AC_D0C6_29B7), np.uint64(0x1D3B_7E90_55A4_C8F1)
#: Histories are grouped by the power of two of their count; each group has its own failure weight. Texts' starts are one more group.
GROUPS = 48
#: Training occurrences from which a pair of tokens is a state of its own; the history of a rarer one is its last token.
LEAST_HISTORY = 2
#: Tokens of the texts for which a part of the automaton is in memory at a time.
WALKED = 300_000


def tokens_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    return np.append(hashed_words(text, hashes), END)


def group_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), GROUPS - 1)


class Block:
    """Texts as places `at` in a sorted vocabulary, with the pairs and triples of tokens that they hold."""

    def __init__(self, vocab: np.ndarray, at: np.ndarray, sizes: np.ndarray):
        self.vocab, self.at = vocab, at.astype(np.int64)
        self.begins = np.cumsum(sizes) - sizes
        self.before = np.concatenate([[0], self.at[:-1]])
        self.before[self.begins] = len(vocab)  # the start's place
        pairs = mix(np.append(vocab, START)[self.before], vocab[self.at])
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)

    def add_triples(self, pair_counts: np.ndarray) -> None:
        """triple: of each token with the pair before it, if that is a state; -1 where not. A text's first token has no pair before it."""
        self.history = np.concatenate([[0], self.pair[:-1]])  # the pair before each token
        known = pair_counts[self.history] >= LEAST_HISTORY
        known[self.begins] = False
        self.triples, found = np.unique(mix(self.pairs[self.history[known]], self.vocab[self.at[known]]), return_inverse=True)
        self.triple = np.full(len(self.at), -1, np.int64)
        self.triple[known] = found


#: Of no arc; a logarithm of a probability is never above 0.
NO_ARC = 1.0


class Automaton:
    """The part of the model that some texts can reach: states, arcs by token, and a failure arc for each state but the root.

    States are the root, each token seen as a history (the start too), and each pair of tokens seen LEAST_HISTORY times. A state's arcs are the tokens
    seen after it; any other token takes the failure arc, which costs the state's failure weight, to the state of the history without its first
    token, and tries there. The root has an arc for each word and for unknown ones. An arc leads to the longest state that ends with its token.

    With N training tokens, V words and w the failure weight of a history's group: the root's P(x) = (c(x) + 1) / (N + V + 1), an arc's
    P(x | h) = (1 - w) c(hx) / c(h) + w P(x | shorter h), and by failure w P(x | shorter h); so the probabilities of each state sum to 1.

    A state that a walk can be in before a token of these texts is named by its order, the number of tokens before that one that it ends with. So what the
    walk needs is laid out by token: the arcs from the states of order 2, 1 and 0, failure weights of the first two, and the order of the state after it.
    """

    def __init__(self, block: Block, part: slice, counts: tuple[np.ndarray, np.ndarray, np.ndarray], total: int, words: int, starts: int, weights: tuple[np.ndarray, np.ndarray]):
        ones, twos, threes = (c.astype(np.float64) for c in counts)
        held = np.append(ones, starts)  # by history of one token, the start the last
        fail = np.where(held > 0, weights[0][group_of(held)], 1.0)
        fail[-1] = weights[0][GROUPS]
        x, v, pair, triple, history = (a[part] for a in (block.at, block.before, block.pair, block.triple, block.history))
        p1 = (ones[x] + 1.0) / (total + words + 1)
        c2 = twos[pair]
        p2 = (1 - fail[v]) * c2 / np.maximum(held[v], 1) + fail[v] * p1
        c3 = np.where(triple >= 0, np.append(threes, 0)[triple], 0)
        own = weights[1][group_of(twos[history])]
        p3 = (1 - own) * c3 / np.maximum(twos[history], 1) + own * p2
        arcs = (np.where(c3 > 0, np.log10(p3), NO_ARC), np.log10(own), np.where(c2 > 0, np.log10(p2), NO_ARC), np.log10(fail[v]), np.log10(p1))
        longest = np.where(block.vocab[x] == END, 0, np.where(c2 >= LEAST_HISTORY, 2, (ones[x] > 0).astype(np.int64)))
        self.rows = [a.tolist() for a in (*arcs, longest)]
        self.first, self.begin = part.start, 1 if starts else 0

    def walk(self, begin: int, end: int) -> float:
        """log10 probability of a block's tokens from a text's first one on: each takes the arc of the state that is carried along, after as many failure arcs as it takes to find one."""
        state, out = self.begin, 0.0
        for arc2, failure2, arc1, failure1, arc0, longest in zip(*(a[begin - self.first : end - self.first] for a in self.rows), strict=True):
            if state == 2:
                if arc2 != NO_ARC:
                    out += arc2
                    state = longest
                    continue
                out += failure2
                state = 1
            if state == 1:
                if arc1 != NO_ARC:
                    out += arc1
                    state = longest
                    continue
                out += failure1
            out += arc0
            state = longest
        return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id as text, modulo folds, is held_fold are held out and train nothing; a null id counts as the text "null".
    Null text is empty text: its one token is the end. Repeated rows count each time. With no training rows every
    token is unknown to a model of no words. Other columns are not read; no rows give no rows.

    Texts are read once, in blocks of hashed words that are kept in a table in the shared folder, bucketed by block; blocks exchange
    sorted keys for corpus counts with ranges of the key space (see `blocks`): words, then pairs, then triples whose history is a state. A failure
    weight is the share of n-grams seen once among all training tokens after its group of histories, the chance that the next one is new.
    Counts grow with the corpus and stay spread over ranges and blocks; only a number for each group of histories, N and V come to the driver.
    """
    spark = docs.sparkSession
    workers_find_package(spark)

    def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for block in blocks_of(batches, 1):
            ids, sizes, held, words = [], [], [], []
            for b in block:
                for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    own = tokens_of(text.as_py(), hashes)
                    ids.append(i)
                    sizes.append(len(own))
                    held.append(zlib.crc32(("null" if i is None else str(i)).encode()) % folds == held_fold)
                    words.append(own)
            vocab, at = np.unique(np.concatenate(words), return_inverse=True)
            counts = np.bincount(at[np.repeat(~np.array(held), sizes)], minlength=len(vocab)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([len(at)]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([held], pa.list_(pa.bool_())), pa.array([pack(at.astype(np.uint32))]), pa.array([pack(vocab)]), pa.array([pack(counts)])], ["block", "tokens", "ids", "sizes", "held", "words", "vocab", "counts"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    columns = "block string, tokens long, ids array<long>, sizes array<int>, held array<boolean>, words binary, vocab binary, counts binary"
    blocks = stage_by(base.mapInArrow(read_blocks, columns), "block", "lm-blocks")
    ranges = ranges_for(blocks.agg(F.sum("tokens")).first()[0] or 0, parallelism(spark))

    def word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, vocab, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                yield sent(block, unpack(vocab), unpack(counts), None, ranges)

    def loaded(left: pa.Table, right: pa.Table) -> tuple[dict, Block, dict[str, np.ndarray]]:
        """A block and what it was told so far, by kind."""
        row, parts = left.to_pylist()[0], {}
        for kind in ("words", "pairs", "triples"):
            own = right.filter(pc.equal(right["kind"], kind))
            parts[kind] = together(own["range"].to_pylist(), own["numbers"].to_pylist())
        return row, Block(unpack(row["vocab"]), unpack(row["words"]), np.array(row["sizes"])), parts

    def pair_keys(left: pa.Table, right: pa.Table) -> pa.Table:
        row, block, told = loaded(left, right)
        train = np.repeat(~np.array(row["held"]), row["sizes"])
        own = np.bincount(block.pair[train], minlength=len(block.pairs)).astype(np.uint32)
        group = np.zeros(len(block.pairs), np.uint8)
        group[block.pair] = np.append(group_of(told["words"]), GROUPS)[block.before]
        return pa.Table.from_batches([sent(row["block"], block.pairs, own, group, ranges)])

    def triple_keys(left: pa.Table, right: pa.Table) -> pa.Table:
        row, block, told = loaded(left, right)
        block.add_triples(told["pairs"])
        known = block.triple >= 0
        train = known & np.repeat(~np.array(row["held"]), row["sizes"])
        own = np.bincount(block.triple[train], minlength=len(block.triples)).astype(np.uint32)
        group = np.zeros(len(block.triples), np.uint8)
        group[block.triple[known]] = group_of(told["pairs"])[block.history[known]]
        return pa.Table.from_batches([sent(row["block"], block.triples, own, group, ranges)])

    def counted(keys: DataFrame, kind: str) -> DataFrame:
        """What ranges return, staged; an n-gram's group is that of its history."""
        return stage(keys.groupBy("range").applyInArrow(summed(GROUPS + 1), RETURNED).withColumn("kind", F.lit(kind)), f"lm-{kind}")

    def with_counts(*told: DataFrame):
        numbers = None
        for x in told:
            x = x.select("block", "kind", "range", "numbers")
            numbers = x if numbers is None else numbers.unionByName(x)
        return blocks.drop("counts").groupBy("block").cogroup(numbers.groupBy("block"))

    def once_and_all(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """By group: n-grams seen once, and all their occurrences."""
        of_range = told.groupBy("range").agg(F.first("once").alias("once"), F.first("all").alias("all"))
        rows = of_range.select(F.posexplode(F.arrays_zip("once", "all"))).groupBy("pos").agg(F.sum("col.once").alias("once"), F.sum("col.all").alias("all")).collect()
        by = {r["pos"]: (r["once"], r["all"]) for r in rows}
        return tuple(np.array([by.get(g, (0, 0))[k] for g in range(GROUPS + 1)], np.float64) for k in (0, 1))

    words = counted(blocks.select("block", "vocab", "counts").mapInArrow(word_keys, SENT), "words")
    told = words.groupBy("range").agg(F.first("total").alias("total"), F.first("kinds").alias("kinds")).agg(F.sum("total").alias("n"), F.sum("kinds").alias("v")).first()
    total, kinds = int(told["n"] or 0), int(told["v"] or 0)
    pairs = counted(with_counts(words).applyInArrow(pair_keys, SENT), "pairs")
    triples = counted(with_counts(pairs).applyInArrow(triple_keys, SENT), "triples")
    seen = [once_and_all(pairs), once_and_all(triples)]
    weights = tuple((once + 0.5) / (every + 1.0) for once, every in seen)
    starts = int(seen[0][1][GROUPS])

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        row, block, told = loaded(left, right)
        block.add_triples(told["pairs"])
        counts = (told["words"], told["pairs"], told["triples"])
        log_root = np.log10((counts[0] + 1.0) / (total + kinds + 1))
        sizes = np.array(row["sizes"])
        ends = np.cumsum(sizes)
        base = np.add.reduceat(log_root[block.at], block.begins)
        known = np.add.reduceat((counts[0] > 0)[block.at].astype(np.int64), block.begins)
        score, i = [], 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(ends, block.begins[i] + WALKED, "right")))
            part = slice(int(block.begins[i]), int(ends[j - 1]))
            model = Automaton(block, part, counts, total, kinds, starts, weights)
            score += [model.walk(a, b) for a, b in zip(block.begins[i:j].tolist(), ends[i:j].tolist(), strict=True)]
            i = j
        columns = [pa.array(row["ids"], pa.int64()), pa.array(row["held"]), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array([total] * len(sizes), pa.int64()), pa.array(base), pa.array(score, pa.float64())]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_counts(words, pairs, triples).applyInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


__all__ = ["Automaton", "Block", "score_texts", "unstage"]
