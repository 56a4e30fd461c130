"""Importance resampling towards a target distribution over hashed word n-grams, with an integer dictionary of words."""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.blocks import blocks_of
from provenia.llm.common import stage, unstage, with_position, workers_find_package

#: Words in the longest feature; buckets that features are hashed to; the words a document needs to be drawn; the share drawn, in hundredths; the seed.
ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: For each byte what it is in a word: itself, A-Z in lower case, a space for what no word holds.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Dictionary(dict):
    """From a word to its integer id; the words in the order of their ids."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        return found


def features(texts: list[list[bytes]], order: int = ORDER, buckets: int = BUCKETS) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of tokenised texts: their numbers of features, and the buckets of all features with the text that each is of.

    Words become integers by a dictionary. An n-gram is a tuple of ids, built from the n-gram one shorter (itself a number by then) and its last word.
    Each distinct tuple's bytes are put together and hashed once; every occurrence gets the bucket through its tuple's number.
    """
    known = Dictionary()
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((known[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    spelled, tuples, found = known.words, ids, []
    for n in range(1, order + 1):
        starts = np.flatnonzero(owner[: max(len(ids) - n + 1, 0)] == owner[n - 1 :])  # texts lie one after the other: the n words are of one text
        if n > 1:
            distinct, number = np.unique(tuples[starts] * len(known) + ids[starts + n - 1], return_inverse=True)
            spelled = [spelled[p // len(known)] + b" " + known.words[p % len(known)] for p in distinct.tolist()]
            tuples = np.zeros(len(ids), np.int64)
            tuples[starts] = number
        hashed = np.fromiter((zlib.crc32(s) % buckets for s in spelled), np.int64, len(spelled))
        found.append((owner[starts], hashed[tuples[starts]]))
    owners, hashed = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.bincount(owners, minlength=len(texts)).tolist(), owners, hashed


def bucketed(docs: DataFrame, id_col: str, text_col: str, order: int, buckets: int) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_features, used and times (arrays of int: the buckets it has and how often)."""
    workers_find_package(docs.sparkSession)

    def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, 1):
            ids = [i for b in block for i in b.column(0).to_pylist()]
            texts = [words(t.as_py()) for b in block for t in b.column(1)]
            sizes, owners, hashed = features(texts, order, buckets)
            each, times = np.unique(owners * buckets + hashed, return_counts=True)
            edges = np.searchsorted(each, np.arange(len(texts) + 1) * buckets).astype(np.int32)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(edges), pa.array(a.astype(np.int32)))  # noqa: B023, E731
            columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64()), lists(each % buckets), lists(times)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "used", "times"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(read_blocks, "doc_id long, n_words long, n_features long, used array<int>, times array<int>")


def totals(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """bucket and its features in all rows, of those that have any. A task sums its rows in an array of one number a bucket before they are exchanged."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            used, times = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            total += np.bincount(used, times, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", name])

    return rows.select("used", "times").mapInArrow(summed, f"bucket int, {name} long").groupBy("bucket").agg(F.sum(name).alias(name))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """For each bucket a thousand times the logarithm of its smoothed share of the target over that of the source, floored."""
    all_s, all_t = sum(source.values()) + buckets, sum(target.values()) + buckets
    ratio = lambda i: (target.get(i, 0) + 1.0) * all_s / ((source.get(i, 0) + 1.0) * all_t)
    return np.array([math.floor(1000 * math.log(ratio(i))) for i in range(buckets)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """A draw from the standard Gumbel distribution by the hash of seed and id, times a thousand, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_features, weight, score, rank (1, 2, ... of those drawn, else null).

    Features are the runs of 1 to `order` words, repeats counted, hashed into `buckets`. A bucket's gain compares its share in target with
    its share in docs; weight is the floored mean gain of a row's features, 0 without features; score adds Gumbel noise from a hash of the id, so that
    the highest scores are a draw without replacement. Of the rows with least_words words, floor(percent / 100 of them) highest scores are drawn, ties to the
    smaller id, null ids last. Null text is empty text; a null id is hashed as an empty text. Repeated rows are rows of their own; of those with one id
    and score either may come first. An empty target has a share of 1 / buckets everywhere. No rows give no rows; other columns are not read.

    Texts are read once. Each block of text has its own dictionary, so no vocabulary of the corpus is built, sent or shuffled; what a row keeps is its
    buckets, at most one pair of integers for each distinct feature. Broadcast are the gains, one number a bucket.
    Only (score, id) of the rows that may be drawn are exchanged, in ranges, to be ranked.
    """
    rows = stage(bucketed(docs, id_col, text_col, order, buckets), "importance-rows")
    wanted = totals(bucketed(target.select(F.lit(0).alias("id"), target_col), "id", target_col, order, buckets), buckets, "t")
    # one row for each bucket at most comes to the driver
    counted = [{r["bucket"]: r[name] for r in part.collect()} for part, name in ((totals(rows, buckets, "s"), "s"), (wanted, "t"))]
    sent = docs.sparkSession.sparkContext.broadcast(gains(*counted, buckets))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            used, times = b.column(3), b.column(4)
            worth = sent.value[used.flatten().to_numpy(zero_copy_only=False)] * times.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(used.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            sums = np.diff(np.concatenate([[0], np.cumsum(worth)])[ends])
            n = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    scored = rows.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")
    scored = stage(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance-scores")
    unstage(rows)
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    ranked = with_position(able, [F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(rest.select(*columns, "rank"))


__all__ = ["features", "gains", "resampled", "words"]
