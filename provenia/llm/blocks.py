"""Documents in blocks of hashed words: compact sorted keys go out to ranges and come back as numbers in the same order.

The language model and the n-gram join both need, for the keys of each block (words, word pairs, shingles), a number over the
whole corpus. A block sends its sorted distinct keys, cut by ranges of the key space, as packed bytes; a range adds up what
all blocks sent and returns to each block one number for each of its keys, in the order sent. Keys are spread evenly by their hash, and
a block sends a key once however often it holds it, so no key and no block is hot. The number of ranges follows that of the corpus's tokens,
so that a range's keys fit a task at any size; a block sends nothing to ranges of which it has no key, so it never sends more rows than it has keys.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

#: Text bytes that make a block full; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
#: Tokens of the corpus for each range of the key space.
RANGE_TOKENS = 4_000_000
#: Columns of what blocks send and of what ranges return.
SENT = "block string, range int, keys binary, numbers binary, groups binary"
RETURNED = "block string, range int, numbers binary, total long, kinds long, once array<long>, all array<long>"
MIX = np.uint64(0x9E3779B97F4A7C15)
#: By byte, whether it is white space.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def pack(a: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: the upper bytes of sorted or small numbers take no space."""
    a = np.ascontiguousarray(a)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)  # tobytes alone goes byte by byte
    return zstandard.ZstdCompressor(level=1).compress(a.dtype.str.encode() + planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype(raw[:3].decode())
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=3).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


class WordHashes(dict):
    """From a word's bytes to its 64-bit hash; forgets all at the bound, which only costs time. Words of over 64 bytes, as whole texts without spaces are, aren't
    remembered, so the bound is one of bytes too."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = found
        return found


def hashed_words(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, A-Z lower-cased, as hashes; bytes.lower and bytes.split do exactly that."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def coded_words(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts one after another, as `hashed_words` has them: each word's place in a vocabulary of sorted hashes, that, and each text's words.

    Arrow tells words apart by their bytes, so that each distinct one becomes a Python object and is hashed once in a block.
    """
    a = pa.concat_arrays([t.cast(pa.large_binary()) for t in texts]).fill_null(b"")
    at = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, 8 * a.offset)
    data = a.buffers()[2]
    raw = np.frombuffer(data.slice(at[0], at[-1] - at[0]).to_pybytes().lower() if data else b"", np.uint8)
    at = at - at[0]
    letter = ~BLANK[raw]
    first, last = letter.copy(), letter.copy()  # of a word; a word ends where its text does
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    border = at[(at > 0) & (at < len(raw))]
    first[border] = letter[border]
    last[border - 1] = letter[border - 1]
    start = np.flatnonzero(first)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) - start + 1, out=ends[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw[letter])]).dictionary_encode()
    distinct = found.dictionary
    cut = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1, 8 * distinct.offset).tolist()
    said = distinct.buffers()[2].to_pybytes() if len(distinct) else b""
    vocab = np.fromiter((xxhash.xxh3_64_intdigest(said[i:j]) for i, j in zip(cut, cut[1:], strict=False)), np.uint64, len(distinct))
    order = np.argsort(vocab)
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return place[found.indices.to_numpy()], vocab[order], np.diff(np.searchsorted(start, at))


def sorted_order(keys: np.ndarray) -> np.ndarray:
    """An order in which keys are sorted. Keys' upper bits and places are sorted as one number, some times faster than places by keys; where the bits cut off tell keys apart, by keys."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64)
    bits = np.uint64((n - 1).bit_length())
    least = keys.min()
    span = int(keys.max() - least).bit_length()
    over = np.uint64(max(0, span + int(bits) - 64))
    both = ((keys - least) >> over << bits) | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    found = keys[order]
    return order if not over or (found[1:] >= found[:-1]).all() else np.argsort(keys)


def narrow(a: np.ndarray) -> np.ndarray:
    """Counts as the smallest unsigned numbers that hold them."""
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs in which order counts."""
    x = (a ^ (a >> np.uint64(32))) * MIX + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def blocks_of(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of a task in blocks of about BLOCK_BYTES of text, in their order."""
    held, size = [], 0
    for batch in batches:
        at = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > BLOCK_BYTES:
                held.append(batch.slice(at, i - at))
                yield held
                held, size, at = [], 0, i
            size += int(n)
        held.append(batch.slice(at))
    if any(b.num_rows for b in held):
        yield held


def ranges_for(tokens: int, least: int) -> int:
    """Ranges of the key space for a corpus of so many tokens, least at least."""
    return max(least, -(-tokens // RANGE_TOKENS))


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the key space begins and the last ends in sorted keys."""
    edges = (np.arange(1, ranges) * (2.0**64 / ranges)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def sent(block: str, keys: np.ndarray, counts: np.ndarray, groups: np.ndarray | None, ranges: int) -> pa.RecordBatch:
    """What a block sends: a row for each range of which it has keys."""
    at = cuts(keys, ranges)
    full = np.flatnonzero(np.diff(at)).tolist()
    part = lambda a: pa.array([pack(a[at[i] : at[i + 1]]) for i in full], pa.binary())
    columns = [pa.array([block] * len(full), pa.string()), pa.array(full, pa.int32()), part(keys), part(counts), pa.nulls(len(full), pa.binary()) if groups is None else part(groups)]
    return pa.RecordBatch.from_arrays(columns, ["block", "range", "keys", "numbers", "groups"])


def summed(kinds: int):
    """What a range does, for keys in so many groups: to each block it returns its keys' sums; it tells its total, its keys that have any, and by group keys seen once and their sum."""

    def each(table: pa.Table) -> pa.Table:
        keys = [unpack(x.as_py()) for x in table["keys"]]
        sizes = np.array([len(k) for k in keys])
        every = np.concatenate(keys)
        order = sorted_order(every)
        new = np.concatenate([[True], np.diff(every[order]) != 0])
        numbers = np.concatenate([unpack(x.as_py()) for x in table["numbers"]])
        sums = np.add.reduceat(numbers[order], np.flatnonzero(new), dtype=np.uint64)
        at = np.empty(len(every), np.int64)
        at[order] = np.cumsum(new) - 1
        group = np.zeros(len(sums), np.uint8)
        if table["groups"].null_count == 0:
            group[at] = np.concatenate([unpack(x.as_py()) for x in table["groups"]])
        once = np.bincount(group[sums == 1], minlength=kinds).tolist()
        total = np.bincount(group, sums.astype(np.float64), minlength=kinds).astype(np.int64).tolist()
        back = [pack(narrow(x)) for x in np.split(sums[at], np.cumsum(sizes)[:-1])]
        n = len(keys)
        columns = [table["block"], table["range"], pa.array(back, pa.binary()), pa.array([int(sums.sum())] * n), pa.array([int((sums > 0).sum())] * n), pa.array([once] * n, pa.list_(pa.int64())), pa.array([total] * n, pa.list_(pa.int64()))]
        return pa.table(columns, ["block", "range", "numbers", "total", "kinds", "once", "all"])

    return each


def together(ranges: list[int], parts: list[bytes]) -> np.ndarray:
    """What the ranges returned to a block, as numbers in the order of its keys."""
    return np.concatenate([np.zeros(0, np.uint32), *(unpack(x) for _, x in sorted(zip(ranges, parts, strict=True)))])
