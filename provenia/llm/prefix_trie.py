"""The trie of conversation prefixes by an LCP-aware mergesort: sorted runs carry the turns that neighbours share, a loser tree merges them, a stack of
open nodes emits each node when its last conversation has passed."""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenia.llm.common import parallelism, stage, unstage, workers_find_package

#: Conversations whose first turns are shared: a base (a multiple of GROUP) lends its first turns, fewer than HEADS of them, to the GROUP ids from its own on.
GROUP, HEADS = 100, 6
#: Bytes of a turn in a key; turns of the corpus for each range of keys; sequences of a sorted run; ids whose text is one piece of a digest.
TURN, RANGE_TURNS, RUN, IDS = 16, 200_000, 2048, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two keys share at their start, of which the first known are known to be equal."""
    most = min(len(a), len(b)) // TURN
    while known < most and a[known * TURN : known * TURN + TURN] == b[known * TURN : known * TURN + TURN]:
        known += 1
    return known


def sorted_run(keys: list[bytes], places: list[int]) -> list[tuple[int, bytes, int]]:
    """(lcp with the one before, key, place), in order of keys."""
    run, before = [], b""
    for key, place in sorted(zip(keys, places, strict=True)):
        run.append((lcp(before, key), key, place))
        before = key
    return run


def merged(runs: list[list[tuple[int, bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """The runs' entries in order, each with its lcp with the entry before, by a loser tree.

    All candidates on the path to be replayed carry their lcp with the last winner. Of two, the one with the longer lcp is the smaller, and
    the other's lcp stays right; only where both are equal are turns compared, from there on, and the loser's lcp becomes that with the new winner. So
    no turn that is known to be shared is looked at again.
    """
    k = len(runs)
    heads: list[tuple[int, bytes | None, int, Iterator]] = []
    for run in runs:
        rest = iter(run)
        heads.append((*next(rest, (-1, None, 0)), rest))
    losers = [-1] * max(k, 1)
    now = list(heads)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs by their candidates."""
        (ha, ka, pa_, ra), (hb, kb, pb, rb) = now[a], now[b]
        if ka is None or kb is None:
            return (b, a) if ka is None else (a, b)
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        h = lcp(ka, kb, ha)
        if (ka[h * TURN : h * TURN + TURN], a) <= (kb[h * TURN : h * TURN + TURN], b):
            now[b] = (h, kb, pb, rb)
            return a, b
        now[a] = (h, ka, pa_, ra)
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while k and now[winner][1] is not None:
        h, key, place, rest = now[winner]
        yield h, key, place
        now[winner] = (*next(rest, (-1, None, 0)), rest)
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


@dataclass(slots=True)
class Node:
    """A node and what has passed below it so far. side: 0 on the path of the range's first sequence, 1 on that of its last alone, else null."""

    depth: int
    chars: int
    side: int | None
    convs: int = 0
    least: int | None = None
    ends: str | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Range:
    """The nodes of one range of sequences, from its sequences in order.

    A node on the path of the first or the last sequence may be shared with the ranges beside it. It is a border node, and its numbers here are
    parts: of its conversations, of the inner nodes below it, and of its inner children. All others are inner nodes and final.
    """

    def __init__(self):
        self.inner: list[tuple[Node, Node]] = []  # with their parents
        self.first: list[Node] = []
        self.last: list[Node] = []
        self.first_key = self.last_key = b""

    def read(self, entries: Iterator[tuple[int, bytes, int]], chars: list[list[int]], copies: list[int], least: list[int | None], ends: list[str]) -> None:
        path: list[Node] = []
        for shared, key, at in entries:
            if not self.first:
                self.first_key = key
            while len(path) > shared + 1:
                self._close(path)
            while len(path) <= len(key) // TURN:
                path.append(Node(len(path), chars[at][len(path) - 1] if path else 0, None if self.first else 0))
            top = path[-1]
            top.convs, top.least, top.ends = top.convs + copies[at], smaller(top.least, least[at]), ends[at]
            self.first = self.first or path[:]
            self.last_key = key
        self.last = path[:]
        for node in path:
            node.side = 1 if node.side is None else node.side
        while path:
            self._close(path)

    def _close(self, path: list[Node]) -> None:
        node = path.pop()
        if node.side is None:
            node.saved += (node.convs - 1) * node.chars
            node.leaves = node.leaves or 1
            self.inner.append((node, path[-1]))
        if path:
            up = path[-1]
            up.convs, up.least, up.children = up.convs + node.convs, smaller(up.least, node.least), up.children + (node.side is None)
            up.leaves, up.saved = up.leaves + node.leaves, up.saved + node.saved


def names(key: bytes) -> list[bytes]:
    """For each depth of a path what tells its node from all others: a chain of 128-bit hashes."""
    out = [b"\0" * 16]
    for i in range(0, len(key), TURN):
        out.append(xxhash.xxh3_128_digest(out[-1] + key[i : i + TURN]))
    return out


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes for a turn; the role's length comes first, so that no two pairs are the same bytes."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TURN)


def decimal(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(""))


def rebuilt(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, key (the digests of its turns, one after the other) and chars (array of their code points): each conversation with its base's first turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_digest(role, text).alias("digest"), F.length(text).alias("chars"))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    # one exchange, by base, serves both the conversations and their groups
    convs = rows.withColumn("base", base).repartition(parallelism(turns.sparkSession), "base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("own"))
    lent = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, HEADS - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(decimal(F.col("conv_id"))) % HEADS).cast("int")
    empty = F.slice(F.col("own"), 1, 0)
    whole = F.concat(F.slice(F.coalesce(F.col("lent"), empty), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    whole = convs.withColumn("lent", lent).withColumn("h", h).select("conv_id", whole.alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def id_digests(members: DataFrame, n: int) -> DataFrame:
    """seq and ends: the SHA-256 of the decimal ids of each seq's rows (seq, conv_id), ascending, nulls first, comma-joined.

    Rows are dealt by range of (seq, id), so a seq with very many is spread over tasks; each task joins its ids to pieces of IDS. Then the pieces of a
    seq go by their order through one digest, of which only the state is held.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        seq = least = None
        done: list[tuple[bytes, int | None, str]] = []

        def pieces() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.string())], ["seq", "least", "ids"])

        for b in batches:
            for s, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (s != seq or len(held) == IDS):
                    done.append((seq, least, ",".join(held)))
                    held = []
                if not held:
                    seq, least = s, i
                held.append("" if i is None else str(i))
            yield pieces()
            done = []
        if held:
            done = [(seq, least, ",".join(held))]
            yield pieces()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = state = None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for s, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if state is not None and s == seq:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    done.append((seq, state.hexdigest()))
                seq, state = s, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["seq", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([state.hexdigest()])], ["seq", "ends"])

    pieces = members.select("seq", "conv_id").repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(joined, "seq binary, least long, ids string")
    return pieces.repartition(n, "seq").sortWithinPartitions("seq", "least").mapInArrow(hashed, "seq binary, ends string")


RANGE_SCHEMA = "part int, side int, depth long, node binary, parent binary, conv_id long, parent_conv_id long, up_side int, n_convs long, n_children long, n_leaves long, saved long, chars long, ends string"


def read_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range (key, chars, copies, least, ends): each batch is cut into sorted runs, the runs are merged, and the nodes come out.

    side is null for inner nodes. Of these, those below a border node have its side and no parent_conv_id yet.
    """
    runs, keys, places, at = [], [], [], 0
    chars, copies, least, ends = [], [], [], []
    for b in batches:
        for to, column in zip((chars, copies, least, ends), b.columns[1:], strict=True):
            to += column.to_pylist()
        for key in b.column(0).to_pylist():
            keys.append(key)
            places.append(at)
            at += 1
            if len(keys) == RUN:
                runs.append(sorted_run(keys, places))
                keys, places = [], []
    if keys:
        runs.append(sorted_run(keys, places))
    found, part = Range(), TaskContext.get().partitionId()
    found.read(merged(runs), chars, copies, least, ends)
    columns = [c.split() for c in RANGE_SCHEMA.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*rows, strict=True), columns, strict=True)], [c for c, _ in columns])

    own = lambda n: (n.convs, n.children, n.leaves, n.saved, n.chars, n.ends)
    for side, path, key in ((0, found.first, found.first_key), (1, found.last, found.last_key)):
        name = names(key)
        # what is on both paths counts on the first
        rows = [(part, side, n.depth, name[n.depth], name[n.depth - 1] if n.depth else None, n.least if n.side == side else None, None, None, *(own(n) if n.side == side else (0, 0, 0, 0, n.chars, None))) for n in path]
        if rows:
            yield told(rows)
    for i in range(0, len(found.inner), 10_000):
        yield told([(part, None, n.depth, None, None, n.least, up.least if up.side is None else None, up.side, *own(n)) for n, up in found.inner[i : i + 10_000]])


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns go by the turn column, nulls first, ties by a hash of role and text; a null role or text is empty. Each is rebuilt with the first
    crc32(id) % HEADS turns of its base, id - id % GROUP, in place of its own. Each distinct sequence of first turns is a node, the root has none.
    A null conv_id is a conversation of its own without a base; its decimal form is empty and sorts first, and a node that only it passes has
    a null conv_id. Repeated rows are turns of their own. No rows give no nodes; other columns are not read.

    Turns are hashed where they are read, so texts are never moved; one exchange by base makes conversations, whose digests must fit a row. Equal
    sequences become one, summed before the exchange. Distinct ones are dealt by sampled ranges of their keys, one for each RANGE_TURNS turns, so that a
    first turn that very many share is spread over tasks; a range's sequences are sorted in runs, merged and turned into nodes in one task. Nodes on the first
    and last path of a range are parts of nodes; they are summed by node, and what lies below them is summed along the paths.
    """
    spark = turns.sparkSession
    workers_find_package(spark)
    convs = stage(rebuilt(turns, conv_col, turn_col, role_col, text_col).withColumn("seq", F.unhex(F.sha2("key", 256))), "trie-convs")
    distinct = convs.groupBy("seq").agg(F.first("key").alias("key"), F.first("chars").alias("chars"), F.count("*").alias("copies"), F.min("conv_id").alias("least"))
    ends = id_digests(convs, parallelism(spark))
    distinct = stage(distinct.join(ends.hint("merge"), "seq").select("key", "chars", "copies", "least", "ends"), "trie-sequences")
    unstage(convs)
    total = distinct.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    ranges = max(parallelism(spark), -(-total // RANGE_TURNS))
    nodes = stage(distinct.repartitionByRange(ranges, "key").mapInArrow(read_range, RANGE_SCHEMA), "trie-nodes")
    unstage(distinct)

    # border nodes: two paths for each range
    paths = nodes.filter("side is not null")
    own = paths.groupBy("node").agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("chars").alias("chars"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.min(F.struct("part", "side")).alias("home"))
    below = own.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    own = own.join(below.hint("merge"), "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = stage(own.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("gain", (F.col("n_convs") - 1) * F.col("chars")), "trie-border")
    at_home = (F.col("home.part") == F.col("part")) & (F.col("home.side") == F.col("side"))
    downward = Window.partitionBy("part", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    placed = paths.select("part", "side", "depth", "node").join(own.select("node", "home", "leaf", "gain", "conv_id").hint("merge"), "node")
    # each border node counts on one path, for itself and for all that are above it there
    placed = stage(placed.select("part", "side", "depth", "node", "conv_id", *[F.sum(F.when(at_home, F.col(c)).otherwise(0)).over(downward).alias(c) for c in ("leaf", "gain")]), "trie-paths")
    sums = placed.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("gain").alias("gain"))
    border = own.drop("leaf", "gain").join(sums.hint("merge"), "node").join(own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")).hint("merge"), "parent", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(NO_ENDS)).alias("ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    border = border.select(*columns, (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved") + F.col("gain")).alias("saved_tokens"), text("ends"))

    told = [*columns, "n_leaves", F.col("saved").alias("saved_tokens"), text("ends")]
    inner = nodes.filter("side is null and up_side is null").select(*told)
    up = placed.select("part", F.col("side").alias("up_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up_conv"))
    top = nodes.filter("side is null and up_side is not null").drop("parent_conv_id").join(up.hint("merge"), ["part", "up_side", "depth"]).withColumnRenamed("up_conv", "parent_conv_id").select(*told)
    return border.unionByName(inner).unionByName(top)


__all__ = ["Range", "lcp", "merged", "names", "prefix_trie", "sorted_run", "unstage"]
