"""Packing documents into sequences of a fixed length by cost: longest pieces first, each into the cheapest sequence with room."""

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.bpe import VOCABULARY_BYTES, byte_symbols
from provenia.llm.common import stage, unstage, workers_find_package

#: Tokens of a sequence; the id that ends each document.
LENGTH, END = 2048, 1
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, for what a layer does to each token and what attention does to each pair of them, in units of
#: the latter. A layer of width w has about 24 w^2 to 4 w; this is that of a width of 1,024.
LINEAR, QUADRATIC = 6_144, 1
#: Tokens that are packed together: documents go to the sequences of their own window. Some 500 sequences.
WINDOW = 1 << 20
#: The pieces of a text in byte-level vocabularies, which no merge crosses: a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """The ids of whole texts by a byte-level BPE file whose ids are the ranks of its merges; strings of its added tokens are those tokens."""

    def __init__(self, spec: str):
        told = json.loads(spec)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        vocab = {s: i for s, i in told["model"]["vocab"].items() if all(c in byte_of for c in s)}
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        merged = [vocab[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"])]
        if merged != sorted(merged):
            raise ValueError("ids must follow the order of merges")
        ranks = {bytes(map(byte_of.__getitem__, s)): i for s, i in vocab.items() if s not in added}
        self.bpe = tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> bytes:
        return self.bpe.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


_loaded: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(spec)
    return _loaded[key]


def cost(n: int) -> int:
    return LINEAR * n + QUADRATIC * n * n


def capacities(tokens: int, length: int, last: bool) -> list[int]:
    """Sequences that hold so many tokens: whole ones and, at the last, powers of two for what is left."""
    out = [length] * (tokens // length)
    rest = tokens % length
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1] * last


def pack(pieces: list[tuple[int, int, int]], rooms: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for pieces (document, start, length) that together fill the rooms.

    Longest first, each goes to the sequence of the least cost among those with room for it. If none has, it is cut: the roomiest
    sequence is filled, the cheapest among equals, and the rest takes its turn by its length.
    """
    room, spent, out = np.array(rooms, np.int64), np.zeros(len(rooms)), []
    queue = [(-n, document, start) for document, start, n in pieces if n]
    heapq.heapify(queue)
    while queue:
        n, document, start = heapq.heappop(queue)
        n = -n
        fits = room >= n
        if fits.any():
            at, took = int(np.argmin(np.where(fits, spent, np.inf))), n
        else:
            at = int(np.argmin(np.where(room == room.max(), spent, np.inf)))
            took = int(room[at])
            heapq.heappush(queue, (took - n, document, start + took))
        out.append((document, start, took, at, rooms[at] - int(room[at])))
        room[at] -= took
        spent[at] += cost(took)
    return out


def windows(sizes: Iterator[tuple[int, int]], length: int = LENGTH, window: int = WINDOW) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Packs documents (number, tokens) as they come, a window at a time: lists of (document, start, length, sequence, offset); sequences count on.

    Of a document longer than a sequence whole sequences are cut off first. What doesn't fill a sequence goes on to the next window: the shortest
    pieces, one of them cut. At the end it fills sequences of powers of two, so nothing is padded. Memory is that of one window.
    """
    held: list[tuple[int, int, int]] = []
    total = made = 0

    def packed(last: bool) -> list[tuple[int, int, int, int, int]]:
        nonlocal held, total, made
        held.sort(key=lambda p: -p[2])
        rest, on = (0 if last else total % length), []
        while rest:
            document, start, n = held.pop()
            took = min(n, rest)
            on.append((document, start + n - took, took))
            if took < n:
                held.append((document, start, n - took))
            rest -= took
        rooms = capacities(total, length, last)
        out = [(d, s, n, made + at, offset) for d, s, n, at, offset in pack(held, rooms)]
        made += len(rooms)
        held, total = on, sum(p[2] for p in on)
        return out

    for document, n in sizes:
        whole = n // length
        if whole:
            yield [(document, k * length, length, made + k, 0) for k in range(whole)]
            made += whole
        if n % length:
            held.append((document, whole * length, n % length))
            total += n % length
        if total >= window:
            yield packed(False)
    yield packed(True)


def packed_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, window: int = WINDOW, outputs: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with outputs ids (array of int).

    A document's ids are those of the vocabulary (path of a byte-level BPE file, read on the driver, sent with the tasks) and then `end`. Each id lies
    in one piece, and the pieces of a sequence lie one after the other from offset 0. Sequences have `length` ids (a power of two) but for at most
    one of each lower power of two at the end of each task, so that no padding is needed. Null text is empty text: one piece, the end. Null and repeated
    ids stay, each row a document of its own. No rows give no rows; other columns are not read.

    Each task packs its own rows, a window at a time, so nothing is shuffled and no source, id or long text is hot; cost is balanced within windows.
    sequence_id has the task's partition above 2^40. The pieces are written to the shared folder, so that what reads them later sees the same ids
    if an executor is lost meanwhile.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    workers_find_package(spark)
    if os.path.getsize(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is no vocabulary file: over {VOCABULARY_BYTES} bytes")
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * outputs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = _encoder(spec.value), TaskContext.get().partitionId() << 40
        texts: dict[int, tuple[int | None, bytes]] = {}  # of the documents that a window still holds

        def sizes() -> Iterator[tuple[int, int]]:
            at = 0
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encoder.encode(text.as_py() or "") + end.to_bytes(4, "little")
                    texts[at] = (i, ids)
                    yield at, len(ids) // 4
                    at += 1

        left: dict[int, int] = {}
        for part in windows(sizes(), length, window):
            rows = []
            for d, start, n, sequence, offset in part:
                i, ids = texts[d]
                piece = ids[4 * start : 4 * (start + n)]
                rows.append((i, start, n, zlib.crc32(piece), len(ids) // 4, first + sequence, offset) + ((np.frombuffer(piece, "<u4").astype("int32"),) if outputs else ()))
                left[d] = left.get(d, len(ids) // 4) - n
                if not left[d]:
                    del texts[d], left[d]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32()) if name == "ids" else pa.int64()) for x, name in zip(zip(*rows, strict=True), names, strict=True)], names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{n}` {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return stage(base.mapInArrow(cut, schema), "packed")


__all__ = ["Encoder", "capacities", "cost", "pack", "packed_documents", "unstage", "windows"]
