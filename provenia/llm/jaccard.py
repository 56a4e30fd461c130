"""N-gram Jaccard join: rare-first prefixes find who may link, a prefix tree over each such group finds who does."""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.blocks import RETURNED, SENT, blocks_of, coded_words, mix, narrow, pack, ranges_for, sent, sorted_order, summed, together, unpack
from provenia.llm.common import parallelism, stage, stage_by, unstage, workers_find_package
from provenia.llm.components import components

#: Words in a shingle; two sets link when PART * intersection >= SHARE * union.
WORDS, SHARE, PART = 5, 75, 100
#: Shingles of the sets that one tree holds; larger groups are cut into chunks.
CHUNK = 400_000
#: Sets of a tree, and numbers in each on average, from which on sketches tell which subtrees a query needn't enter.
MANY, LONG = 48, 64
#: Corpus counts tell shingles apart by the upper 48 bits of their hash. Two that fall together only count higher, which loses no link.
COUNTED = ~np.uint64(0xFFFF)


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text's hashed words, sorted hashes; of fewer words than WORDS one of them all; none of no words."""
    if not len(words):
        return words
    k = min(WORDS, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h, words[i : len(words) - k + 1 + i])
    return np.unique(h)


def shingle_sets(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `shingles` gives for each of the texts whose hashed words stand one after another, in one array; and the sizes of these sets."""
    sizes = np.asarray(sizes, np.int64)
    whole = sizes >= WORDS
    long = words if whole.all() else words[np.repeat(whole, sizes)]
    n = len(long) - WORDS + 1
    h = np.full(max(n, 0), WORDS, np.uint64)
    for i in range(WORDS if n > 0 else 0):
        h = mix(h, long[i : i + n])
    # a shingle that begins in one text and ends in the next is none; short texts are made one by one
    first = np.cumsum(np.where(whole, sizes, 0)) - np.where(whole, sizes, 0)
    start = np.cumsum(sizes) - sizes
    parts = []
    for a, b, m, ok in zip(first.tolist(), start.tolist(), sizes.tolist(), whole.tolist(), strict=True):
        if ok:
            part = h[a : a + m - WORDS + 1]
            part.sort()
        else:
            part = shingles(words[b : b + m])
        parts.append(part)
    flat = np.concatenate(parts) if parts else h
    held = np.array([len(x) for x in parts], np.int64)
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    begins = (np.cumsum(held) - held)[held > 0]
    new[begins] = True
    made = np.zeros(len(held), np.int64)
    if len(begins):
        made[held > 0] = np.add.reduceat(new, begins, dtype=np.int64)
    return flat[new], made


def key_places(flat: np.ndarray) -> np.ndarray:
    """Of each shingle, the place of its COUNTED key among the distinct ones, sorted: of one sort, as a search for each is slow beyond the cache."""
    keys = flat & COUNTED
    order = sorted_order(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return at


def least_common(n: int) -> int:
    """Shingles that any partner of a set of n shares with it."""
    return -(-SHARE * n // PART)


class Tree:
    """A prefix tree over sets as sorted sequences of numbers, most frequent first, each run without a branch in one node.

    Arrays by node: the sequences [lo, hi) below it, the depths [start, stop) its numbers come from, its children; and over the
    sequences below it the longest rest, the least and the greatest size.
    """

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        self.sequences, self.sizes = sequences, sizes
        self.lo, self.hi, self.start, self.stop, self.children, self.numbers = [], [], [], [], [], []
        n = len(sequences)
        shared = np.zeros(n, np.int64)  # with the sequence before
        for i in range(1, n):
            a, b = sequences[i - 1], sequences[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[i] = differ[0] if len(differ) else m
        self.root = self._build(0, n, shared)
        lengths = np.array([len(s) for s in sequences])
        self.rest = [int(lengths[i:j].max()) - d for i, j, d in zip(self.lo, self.hi, self.stop, strict=True)]
        self.least = [int(sizes[i:j].min()) for i, j in zip(self.lo, self.hi, strict=True)]
        self.most = [int(sizes[i:j].max()) for i, j in zip(self.lo, self.hi, strict=True)]
        self.lo_at, self.last_at = np.array(self.lo), np.array(self.hi) - 1

    def _node(self, lo: int, hi: int, start: int, stop: int) -> int:
        self.lo.append(lo)
        self.hi.append(hi)
        self.start.append(start)
        self.stop.append(stop)
        self.children.append([])
        self.numbers.append(self.sequences[lo][start:stop])
        return len(self.lo) - 1

    def _build(self, lo: int, hi: int, shared: np.ndarray) -> int:
        def depth(i: int, j: int) -> int:
            return int(shared[i + 1 : j].min()) if j - i > 1 else len(self.sequences[i])

        root = self._node(lo, hi, 0, depth(lo, hi))
        todo = [root]
        while todo:
            at = todo.pop()
            i, j, d = self.lo[at], self.hi[at], self.stop[at]
            if j - i == 1:
                continue
            edges = [i, *(i + 1 + np.flatnonzero(shared[i + 1 : j] == d)).tolist(), j]
            for a, b in zip(edges, edges[1:], strict=False):
                child = self._node(a, b, d, depth(a, b))
                self.children[at].append(child)
                todo.append(child)
        return root


def sketches(sequences: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set of numbers, in words: eight times as many bits as numbers on average or more; each number sets one."""
    sizes = np.array([len(x) for x in sequences])
    width = 64 << max(0, int(8 * sizes.mean()) // 64).bit_length()
    bits = np.zeros((len(sequences), width), bool)
    bits[np.repeat(np.arange(len(sizes)), sizes), np.concatenate(sequences) % width] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def tree_links(table: pa.Table) -> pa.Table:
    """Links (a, b) that connect what is linked within a group of sets: node, n, tokens, side, label.

    side 0 is query and data, 1 query only, 2 data only; sets of equal label are connected already. Sets become sequences in one global order,
    most frequent shingle first; a query walks the tree with the overlap so far, which all sets below a node share, and leaves a
    subtree when the overlap with the shorter rest can't reach what the least size there needs, when no size there is within the
    threshold, when by their sketches too many of the query's numbers are missing in each set there, or when all its sets are connected with the query. Each link joins two components, so there are fewer than sets.
    """
    nodes, n = table["node"].to_pylist(), table["n"].to_numpy()
    side, label = table["side"].to_numpy(), table["label"].to_pylist()
    tokens = [unpack(x.as_py()) for x in table["tokens"]]
    flat = np.concatenate(tokens)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.empty(len(count), np.int64)
    order[np.argsort(-count, kind="stable")] = np.arange(len(count))
    keep = int((count > 1).sum())
    sequences = []
    for part in np.split(order[at], np.cumsum([len(t) for t in tokens])[:-1]):
        part = np.sort(part)
        sequences.append(part[: np.searchsorted(part, keep)])  # what no other set has links nothing
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict = {}
    for i, x in enumerate(label):
        parent[i] = find(first.setdefault(x, i)) if x is not None else i
    data = [i for i in range(len(nodes)) if side[i] != 1]
    data.sort(key=lambda i: (sequences[i].astype(">i8").tobytes(), i))
    links: list[tuple[int, int]] = []
    if data and keep:
        tree = Tree([sequences[i] for i in data], n[data])
        place = {i: k for k, i in enumerate(data)}
        marks = np.zeros(keep, np.int64)
        queries = [i for i in (data if not (side == 1).any() else range(len(nodes))) if side[i] != 2]
        roots, changes, fresh = None, None, 0
        sketch = sketches(sequences) if len(data) >= MANY and len(flat) >= LONG * len(nodes) else None
        of_data, n_data = (sketch[data], n[data]) if sketch is not None else (None, None)
        for done, q in enumerate(queries):
            if done >= fresh:  # which subtrees are connected as a whole is found anew at each doubling
                roots = np.array([find(i) for i in data])
                changes = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
                whole = (changes[tree.last_at] == changes[tree.lo_at]).tolist()
                fresh = 2 * done + 1
            own, nq = sequences[q], int(n[q])
            here = place.get(q, -1) if side[q] == 0 else -1
            below = None
            if sketch is not None:  # a bit of the query's that a set lacks is a number that it lacks
                lacks = np.bitwise_count(sketch[q] & ~of_data[here + 1 :]).sum(1, dtype=np.int64)
                may = (PART + SHARE) * (len(own) - lacks) >= SHARE * (nq + n_data[here + 1 :])
                if not may.any():
                    continue
                below = [0] * (here + 2) + np.cumsum(may).tolist()  # how many sets before each place may link
            marks[own] = 1
            after = len(own) - np.searchsorted(own, np.arange(keep + 1))  # of the query's numbers, those from each number on
            mine = find(q)
            todo = [(tree.root, 0)]
            while todo:
                at_node, overlap = todo.pop()
                if tree.hi[at_node] <= here + 1 or below and below[tree.hi[at_node]] == below[tree.lo[at_node]] or whole[at_node] and find(data[tree.lo[at_node]]) == mine:
                    continue
                if PART * tree.most[at_node] < SHARE * nq or SHARE * tree.least[at_node] > PART * nq:
                    continue
                numbers = tree.numbers[at_node]
                overlap += int(marks[numbers].sum())
                rest = int(after[numbers[-1] + 1]) if len(numbers) else len(own)
                if (PART + SHARE) * (overlap + min(rest, tree.rest[at_node])) < SHARE * (nq + tree.least[at_node]):
                    continue
                if tree.children[at_node]:
                    todo.extend((c, overlap) for c in tree.children[at_node])
                    continue
                for k in range(tree.lo[at_node], tree.hi[at_node]):
                    y = data[k]
                    if k > here and y != q and find(y) != mine and PART * overlap >= SHARE * (nq + int(n[y]) - overlap):
                        links.append((q, y))
                        parent[find(y)] = mine
            marks[own] = 0
    return pa.table([pa.array([nodes[a] for a, _ in links], pa.binary()), pa.array([nodes[b] for _, b in links], pa.binary())], ["a", "b"])


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, the smallest id that links reach.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; the set of a text is its distinct shingles of five words, with fewer words the whole
    sequence, without words empty, which links with nothing, its own component. Two rows link when 100 * intersection >= 75 * union;
    so rows with equal sets do. Null text is empty text. Null ids take part; a component has the smallest id that isn't
    null, or null. Repeated rows are rows of their own with the same result. No rows give no rows; other columns are not read.

    Shingles are counted over the corpus by blocks and ranges (see `blocks`). In the order rarest first, two linked sets share a
    shingle among the first n - ceil(0.75 n) + 1 of each; a set whose first ones occur nowhere else has no partner and goes no further.
    Equal sets are one node from here on. Sets that share a prefix shingle are connected through the least of them, not in pairs; each connected group is
    joined by a prefix tree in one task if it fits CHUNK shingles. A larger group is cut into chunks, each with the group's pivot set; what
    then isn't connected with the group's largest part meets the whole group in a grid of chunks, so that no link between two parts is lost.
    """
    spark = docs.sparkSession
    workers_find_package(spark)

    def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, 1):
            ids = [i for b in block for i in b.column(0).to_pylist()]
            at, vocab, sizes = coded_words([b.column(1) for b in block])
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([len(at)]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int32())), pa.array([pack(at)]), pa.array([pack(vocab)])], ["block", "tokens", "ids", "sizes", "words", "vocab"])

    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = stage_by(base.mapInArrow(read_blocks, "block string, tokens long, ids array<long>, sizes array<int>, words binary, vocab binary"), "block", "jaccard-blocks")
    ranges = ranges_for(blocks.agg(F.sum("tokens")).first()[0] or 0, parallelism(spark))

    def sets_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return shingle_sets(unpack(row["vocab"])[unpack(row["words"])], row["sizes"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                # twice or more within a block is all that matters here: equal sets of a block count once each, as in other blocks
                found, count = np.unique(sets_of(row)[0] & COUNTED, return_counts=True)
                yield sent(row["block"], found, narrow(count), None, ranges)

    counted = stage(blocks.select("block", "sizes", "words", "vocab").mapInArrow(keys, SENT).groupBy("range").applyInArrow(summed(1), RETURNED).select("block", "range", "numbers"), "jaccard-counts")

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        flat, sizes = sets_of(row)
        df = together(right["range"].to_pylist(), right["numbers"].to_pylist())
        counts = df[key_places(flat)]
        edges = np.cumsum(sizes)[:-1]
        out: list[tuple] = []
        sent_already: set[bytes] = set()
        for i, s, own in zip(row["ids"], np.split(flat, edges), np.split(counts, edges), strict=True):
            n = len(s)
            digest = xxhash.xxh3_128_digest(s.tobytes())
            prefix = tokens = None
            if n:
                shared = s[own > 1]
                left_over = n - least_common(n) + 1 - (n - len(shared))
                if left_over > 0 and digest not in sent_already:
                    sent_already.add(digest)
                    order = np.lexsort((shared, own[own > 1]))[:left_over]
                    prefix, tokens = shared[order].view(np.int64).tolist(), pack(shared)
            out.append((i, n, digest, prefix, tokens, len(shared) if n else 0))
        columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64()))]
        return pa.table(columns, ["doc_id", "n", "node", "prefix", "tokens", "size"])

    found = blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(candidates, "doc_id long, n long, node binary, prefix array<long>, tokens binary, size long")
    found = stage(found, "jaccard-sets")
    unstage(blocks, counted)

    nodes = stage(found.filter("tokens is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("size").alias("size"), F.first("prefix").alias("prefix")), "jaccard-nodes")
    # who may link is told by 64-bit hashes of nodes, as sets are by those of words: Spark sums numbers without sorting
    prefixes = stage(nodes.select(F.xxhash64("node").alias("node"), F.explode("prefix").alias("token")), "jaccard-prefixes")
    leaders = stage(prefixes.groupBy("token").agg(F.min("node").alias("leader"), F.count("*").alias("holders")).filter("holders > 1").drop("holders"), "jaccard-leaders")
    candidates_of = prefixes.join(leaders.hint("merge"), "token").filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    groups = components(candidates_of)
    unstage(prefixes, leaders)

    sets = stage(nodes.drop("prefix").withColumn("hash", F.xxhash64("node")).join(groups.select(F.col("node").alias("hash"), F.col("component").alias("group")).hint("merge"), "hash").drop("hash"), "jaccard-grouped")
    unstage(groups, nodes)
    of_group = sets.groupBy("group").agg(F.ceil(F.sum("size") / CHUNK).alias("chunks"), F.min("node").alias("pivot"))
    of_group = stage(of_group, "jaccard-groups")
    tokens = [F.col(c) for c in ("node", "n", "tokens")]
    none = F.lit(None).cast("binary")
    placed = sets.join(of_group.hint("merge"), "group")
    own_chunk = placed.select("group", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), *tokens, F.lit(0).alias("side"), none.alias("label"))
    pivots = placed.filter("node = pivot and chunks > 1").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("node"), F.col("chunks")).alias("own"), *tokens, F.lit(0).alias("side"), none.alias("label")).filter("own <> chunk").drop("own")
    links = stage(own_chunk.unionByName(pivots).groupBy("group", "chunk").applyInArrow(tree_links, "a binary, b binary"), "jaccard-links")

    # groups in chunks: what the chunks and the pivot left apart from the largest part meets the whole group
    large = of_group.filter("chunks > 1")
    if large.limit(1).count():
        parts = components(links)
        labelled = placed.filter("chunks > 1").join(parts.hint("merge"), "node", "left").withColumn("label", F.coalesce("component", "node"))
        labelled = stage(labelled.select("group", "chunks", "label", "size", *tokens), "jaccard-parts")
        unstage(parts)
        sizes = labelled.groupBy("group", "label").agg(F.count("*").alias("members"), F.sum("size").alias("size"))
        rest = sizes.groupBy("group").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("all"), F.max_by("size", F.struct("members", "label")).alias("main_size")).filter("parts > 1")
        rest = stage(rest.select("group", "main", F.greatest(F.ceil((F.col("all") - F.col("main_size")) / CHUNK), F.lit(1)).alias("rows")), "jaccard-rest")
        again = labelled.join(rest.hint("merge"), "group")
        row, column = F.pmod(F.xxhash64("node"), F.col("rows")), F.pmod(F.xxhash64("node"), F.col("chunks"))
        each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
        asks = again.filter("label <> main").select("group", row.alias("row"), each("chunks").alias("column"), *tokens, F.lit(1).alias("side"), "label")
        data = again.select("group", each("rows").alias("row"), column.alias("column"), *tokens, F.lit(2).alias("side"), "label")
        more = stage(asks.unionByName(data).groupBy("group", "row", "column").applyInArrow(tree_links, "a binary, b binary"), "jaccard-links")
        links = links.unionByName(more)
    classes = components(links)
    labelled = found.select("doc_id", "n", "node").join(classes.hint("merge"), "node", "left").withColumn("class", F.coalesce("component", "node"))
    labelled = stage(labelled.select("doc_id", "n", "class"), "jaccard-classes")
    smallest = stage(labelled.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("component_id")), "jaccard-smallest")
    unstage(found, sets)
    out = labelled.filter("n > 0").join(smallest.hint("merge"), "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(labelled.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


__all__ = ["Tree", "jaccard_classes", "shingle_sets", "shingles", "tree_links"]
