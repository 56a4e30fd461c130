"""Substring deduplication by hashing units of text: repeated units are removed but for their first occurrence, with their offsets."""

import re
from collections.abc import Iterator
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.blocks import mix
from provenia.llm.common import free_name, stage, unstage, workers_find_package

#: Words that repeated units in a row have together before they are removed; a lone short one may repeat by chance. Half the length of the
#: passages meant (50 words), whose edges may belong to units that reach beyond them.
LEAST_WORDS = 25
#: Where a line is cut: before white space that follows the end of a sentence.
SENTENCE_END = re.compile(r"(?<=[.!?])(?=[\x20\x09-\x0D])")
#: A clause begins at a word whose hash is the least among so many words before and after it, wherever its sentence begins or ends; so the clauses
#: of a passage are the same in all texts but for its edges. They have five words on average, three at least.
NEAR = 2
#: Units whose hashes are compared together: clauses are too short to say by themselves that a passage is repeated.
SPANS = {"clause": 3, "sentence": 1, "line": 1, "paragraph": 1}
#: Bytes of words that a worker remembers the hashes of, and the longest word it does; speed depends on them, results don't.
REMEMBERED, LONGEST = 32 << 20, 64


class WordDigests(dict):
    """From a word's bytes to its MD5."""

    size = 0

    def __missing__(self, word: bytes) -> bytes:
        found = md5(word, usedforsecurity=False).digest()
        if len(word) <= LONGEST:
            self.size += len(word) + 200
            if self.size > REMEMBERED:
                self.clear()
                self.size = 0
            self[word] = found
        return found


def clauses(text: str, digests: WordDigests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, stop, words and digest (rows of two 64-bit numbers) of the clauses of a text. The white space after a clause is its own."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, 2), np.uint64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = np.concatenate([[True], (points == 32) | (points - 9 <= 4), [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, end = edges[::2], int(edges[-1])
    hashes = np.frombuffer(b"".join(map(digests.__getitem__, words)), ">u8").reshape(-1, 2).astype(np.uint64)
    order = (hashes[:, 0] >> np.uint64(32)).astype(np.int64)
    cut = np.ones(n, bool)
    for k in range(1, min(NEAR, n - 1) + 1):
        cut[k:] &= order[k:] < order[:-k]
        cut[:-k] &= order[:-k] <= order[k:]
    cut[0] = True
    at = np.flatnonzero(cut)
    sizes = np.diff(np.append(at, n))
    place = (np.arange(n) - np.repeat(at, sizes)).astype(np.uint64)
    digest = np.stack([np.add.reduceat(mix(hashes[:, i], place + np.uint64(i << 40)), at) for i in (0, 1)], axis=1)
    return starts[at], np.append(starts[at[1:]], end), sizes.astype(np.int32), digest


def units(text: str, by: str = "sentence") -> Iterator[tuple[int, int, int, bytes]]:
    """(start, stop, words, digest) of each unit that has a word; offsets in code points.

    Units are, by "sentence", the sentences of each line, the white space before a sentence with it; by "line" whole lines; by "paragraph" the
    passages between blank lines. Normalised: A-Z in lower case, each run of ASCII white space one space.
    """
    at = 0
    between = "\n\n" if by == "paragraph" else "\n"
    for part in text.split(between):
        for piece in SENTENCE_END.split(part) if by == "sentence" else [part]:
            words = piece.encode("utf-8", "surrogatepass").lower().split()
            if words:
                yield at, at + len(piece), len(words), blake2b(b" ".join(words), digest_size=16).digest()
            at += len(piece)
        at += len(between)


def cut_text(text: str, by: str, digests: WordDigests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, stop and words of the units of a text, and the digests of its windows: each SPANS[by] units in a row, or all if there are fewer."""
    if by == "clause":
        start, stop, words, digest = clauses(text, digests)
    else:
        found = list(units(text, by))
        start, stop, words = (np.array([u[k] for u in found], np.int64) for k in (0, 1, 2))
        digest = np.frombuffer(b"".join(u[3] for u in found), "<u8").reshape(-1, 2)
    if not len(start):
        return start, stop, words, digest
    n = min(SPANS[by], len(start))
    window = digest[: len(start) - n + 1]
    for k in range(1, n):
        window = mix(window, digest[k : len(start) - n + 1 + k])
    return start, stop, words, window


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, by: str = "clause", row_col: str | None = None) -> DataFrame:
    """A row for each unit to remove: doc_id, unit (its number among the units with words), start, stop, n_words, kept_doc_id, kept_start, run_words, and row with row_col.

    Units are sentences, lines or paragraphs (see `units`), or clauses (see NEAR) in windows of three. A window stays where it occurs first, by id (null
    ids last), then by offset; of rows with the same id one is first. The units of later windows go, in the same document too, if they stand in a run of such units of
    least_words words or more together (run_words); with least_words=1 all do. kept_doc_id and kept_start tell where the window stays; of several, that of the first
    that has the unit. Null and empty texts, and blank units, have none. Documents without repeated units give no rows. Other columns are not read.
    row_col names a column of longs that tells rows apart.

    Texts are read once. Digests are grouped with a partial minimum before the shuffle, and those that occur twice are joined back, with no more than
    row and number, by an exchange on both sides that adaptive execution splits where a window is very frequent. What is found meets its
    document's offsets by row; a document's units are one row.
    """
    if by not in SPANS:
        raise ValueError(f"no unit: {by}")
    workers_find_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = WordDigests()
        for b in batches:
            found = [cut_text(t.as_py() or "", by, digests) for t in b.column(2)]
            lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))
            halves = [[f[3][:, i].view(np.int64) if len(f[3]) else np.zeros(0, np.int64) for f in found] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists([f[0] for f in found], np.int64), lists([f[1] for f in found], np.int64), lists([f[2] for f in found], np.int32), lists(halves[0], np.int64), lists(halves[1], np.int64)], ["given", "doc_id", "start", "stop", "words", "a", "b"])

    given = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    base = docs.select(given.alias("given"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cuts = base.mapInArrow(cut, "given long, doc_id long, start array<long>, stop array<long>, words array<int>, a array<long>, b array<long>")
    cuts = stage(cuts.withColumn("row", F.coalesce("given", F.monotonically_increasing_id())).drop("given"), "units")
    each = cuts.select("row", "doc_id", F.posexplode(F.arrays_zip("a", "b", "start")).alias("window", "x")).select("row", "doc_id", "window", "x.*")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "window", "start"))
    firsts = each.filter("a is not null").groupBy("a", "b").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = stage(firsts.select("a", "b", "first"), "unit-firsts")
    later = each.filter("a is not null").select("a", "b", "row", "window").join(firsts.hint("merge"), ["a", "b"]).filter((F.col("row") != F.col("first.row")) | (F.col("window") != F.col("first.window")))
    hits = later.select("row", F.struct("window", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start")).alias("hit")).groupBy("row").agg(F.collect_list("hit").alias("hits"))
    span, told = SPANS[by], "row long, doc_id long, unit int, start long, stop long, n_words int, kept_doc_id long, kept_start long, run_words long"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in told.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32()}
        for b in batches:
            rows: list[tuple] = []
            for row, doc_id, start, stop, words, found in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                kept: dict[int, dict] = {}
                for hit in sorted(found, key=lambda h: h["window"]):
                    for unit in range(hit["window"], min(hit["window"] + span, len(start))):
                        kept.setdefault(unit, hit)
                gone = sorted(kept)
                at = 0
                while at < len(gone):
                    to = at + 1
                    while to < len(gone) and gone[to] == gone[to - 1] + 1:
                        to += 1
                    total = sum(words[u] for u in gone[at:to])
                    if total >= least_words:
                        rows += [(row, doc_id, u, start[u], stop[u], words[u], kept[u]["kept_doc_id"], kept[u]["kept_start"], total) for u in gone[at:to]]
                    at = to
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kinds[c.split()[1]]) for x, c in zip(zip(*rows, strict=True), told.split(", "), strict=True)], names)

    out = cuts.select("row", "doc_id", "start", "stop", "words").join(hits, "row").select("row", "doc_id", "start", "stop", "words", "hits").mapInArrow(runs, told)
    return out.select("doc_id", "unit", "start", "stop", "n_words", "kept_doc_id", "kept_start", "run_words", *["row"] * bool(row_col))


def without(text: F.Column, spans: F.Column) -> F.Column:
    """text without spans, array<struct<start, stop>> in order; offsets are those of the original text."""
    n = F.size(spans)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["stop"])
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, (before(i) + 1).cast("int"), (F.coalesce(F.get(spans, i)["start"], F.length(text).cast("long")) - before(i)).cast("int")))
    return F.array_join(parts, "")


def deduplicated(docs: DataFrame, removed: str = "removed", text_col: str = "text", **options) -> DataFrame:
    """docs with their texts cut, and removed: array<struct<start, stop>> of the original offsets, empty where nothing goes.

    Rows are told apart by a number of their own, so ids may be null or stand on several rows; a null text stays null. A column of docs
    with the name of removed keeps it, and the new one gets underscores before its own. Rows are written once to the shared folder, where
    that number is fixed; then the texts of all rows meet their spans in one exchange.
    """
    row, removed = free_name(docs, "unit_row"), free_name(docs, removed)
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "substring-rows")
    spans = repeated_units(rows, text_col=text_col, row_col=row, **options).groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(removed))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    out = rows.join(spans, row, "left").withColumn(removed, F.coalesce(removed, none))
    return out.withColumn(text_col, F.when(F.size(removed) > 0, without(F.col(text_col), F.col(removed))).otherwise(F.col(text_col))).select(*docs.columns, removed)


__all__ = ["clauses", "cut_text", "deduplicated", "repeated_units", "units", "unstage", "without"]
