"""Mixing sources to target weights by Pfair scheduling: blocks of each source get release times and deadlines, earliest deadline first."""

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import free_name, stage, unstage, with_position, workers_find_package

#: Documents in a block; blocks of a schedule up to which it is broadcast, else it is joined by an exchange.
BLOCK, BROADCAST = 32, 50_000
#: Sources that a mix may have: one weight each, on the driver and in a broadcast. More is an error, not a cut.
SOURCES = 100_000
NO_SOURCE = "\x00"


def exact(weight) -> Fraction:
    """The weight as it is written: 0.1 is a tenth; "1/3" and fractions are themselves."""
    return Fraction(str(weight))


def quotas(weights: dict[str, float], period: int) -> dict[str, Fraction]:
    """Slots of each source in a period, exactly: they needn't be whole."""
    total = sum(map(exact, weights.values()))
    return {s: exact(w) / total * period for s, w in weights.items()}


def whole_period(weights: dict[str, float]) -> int:
    """The shortest period in which each source's slots are whole."""
    return math.lcm(*(q.denominator for q in quotas(weights, 1).values()))


def schedule(slots: dict[str, Fraction], period: int, blocks: dict[str, int] | None = None) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) for the blocks of one period; with blocks only so many of each source.

    Block k of a source with q of the period's p slots may run from slot floor(k p / q) and has to before ceil((k + 1) p / q). In each slot
    the released block with the earliest deadline runs. The shares sum to 1, so no deadline is missed, also where blocks are left out, and
    after any number of slots each source is less than one block from its share until it is used up. Where all q are whole, all are
    exact at the period's end, so that it repeats. Only the next block of each source is in memory.
    """
    step = {s: Fraction(period) / q for s, q in slots.items()}
    release = lambda s, k: k * step[s].numerator // step[s].denominator
    coming = [(0, s, 0) for s in slots if blocks is None or blocks[s] > 0]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        if slot >= period:
            return
        while coming and coming[0][0] <= slot:
            at, s, k = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(k + 1) * step[s].numerator // step[s].denominator), s, k, at))
        deadline, s, k, at = heapq.heappop(ready)
        yield s, k, slot, at, deadline
        if blocks is None or k + 1 < blocks[s]:
            heapq.heappush(coming, (release(s, k + 1), s, k + 1))
        slot += 1


def mix_order(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: doc_id, source, block, release, deadline, slot, position.

    weights names sources; those it leaves out have weight 1, as all have without it; weights must be positive. A null source is a
    source. Within a source documents go by id, nulls last, in blocks of `block`; repeated rows are rows of their own. Nothing is dropped
    or repeated: when a source is used up its slots stay empty, and the others go on in order. position counts the rows of the whole order from 0.
    No rows give no rows. Other columns are not read.

    Weights are taken as exact fractions, so at every slot each source is less than one block from its share until it is used up.
    The sources, SOURCES at most, come to the driver. The schedule has the blocks of one period, that in which all shares are whole (with
    equal weights one slot for each source), but no more than there are blocks; a task writes it, without holding it, and up to BROADCAST blocks it
    is broadcast. Ranks within sources come from ranges of (source, id), so that a source with a third of all rows is spread over tasks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"))
    rows = stage(with_position(rows, ["source", F.asc_nulls_last("doc_id")], "place"), "mix-places")
    found = rows.groupBy("source").agg(F.min("place").alias("first"), F.ceil(F.count("*") / block).alias("blocks")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"a mix may have {SOURCES} sources; what has more is no source column")
    told = {r["source"]: (weights or {}).get(r["source"], 1) for r in found}
    if any(exact(w) <= 0 for w in told.values()):
        raise ValueError("weights must be positive")
    period = whole_period(told)
    share = quotas(told, period)
    if any(r["blocks"] * period / share[r["source"]] >= 1 << 62 for r in found):
        raise ValueError("weights are too far apart for slots of 64 bits")
    # what a source has of one period: of more than its blocks it needs no more
    own = {r["source"]: min(int(share[r["source"]]), r["blocks"]) for r in found}
    dims = spark.createDataFrame([(r["source"], r["first"], own[r["source"]]) for r in found], "source string, first long, quota long")
    workers_find_package(spark)

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["source", "k", "in_slot", "in_release", "in_deadline"]
        for _ in batches:
            plan = schedule(share, period, own)
            while part := list(itertools.islice(plan, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i else pa.string()) for i, x in enumerate(zip(*part, strict=True))], names)

    slots = stage(spark.range(1, numPartitions=1).mapInArrow(planned, "source string, k long, in_slot long, in_release long, in_deadline long"), "mix-schedule")
    slots = slots.hint("broadcast" if sum(own.values()) <= BROADCAST else "merge")
    out = rows.join(F.broadcast(dims), "source").withColumn("rank", F.col("place") - F.col("first")).withColumn("block", F.floor(F.col("rank") / block))
    turn = F.floor(F.col("block") / F.col("quota")) * F.lit(min(period, (1 << 63) - 1))
    out = out.withColumn("k", F.col("block") % F.col("quota")).withColumn("turn", turn).join(slots, ["source", "k"])
    out = out.select("doc_id", "source", "block", "rank", *[(F.col("turn") + F.col(f"in_{c}")).alias(c) for c in ("release", "deadline", "slot")])
    out = with_position(out, ["slot", "rank"], "position")
    return out.select("doc_id", F.when(F.col("source") != NO_SOURCE, F.col("source")).alias("source"), "block", "release", "deadline", "slot", "position")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs in the order of the mix: ranges of positions, each sorted. Rows with the same id go together, at the first's position."""
    order = stage(mix_order(docs, weights), "mix-order")
    key, position = free_name(docs, "mix_key"), free_name(docs, "mix_position")
    no_id = F.lit(-(1 << 63))
    order = order.groupBy(F.coalesce("doc_id", no_id).alias(key)).agg(F.min("position").alias(position))
    out = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), no_id)).join(order.hint("merge"), key)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, position).sortWithinPartitions(position).select(docs.columns)


__all__ = ["mix_order", "mixed", "quotas", "schedule", "unstage", "whole_period"]
