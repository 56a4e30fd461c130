"""Byte-pair encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols."""

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import workers_find_package

#: Fixed values of word-end vocabularies: the pieces of a text, its white space (Unicode's White_Space), the end mark.
# The tokenizer's tables are of Unicode 16: letters and numbers of later versions, which `regex` knows already, are neither there.
LATER_LETTERS = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959"
    r"\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3\U000187F8-\U000187FF"
    r"\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24"
    r"\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4"
    r"\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
LATER_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
PIECES = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{LATER_LETTERS}]]+|[\p{{N}}--[{LATER_NUMBERS}]]|[[^\s\p{{L}}\p{{N}}]||[{LATER_LETTERS}{LATER_NUMBERS}]]+"
# Its lower case is of Unicode 17: (first, last, distance) of the capitals that Python's lower() doesn't know yet.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)
LOWER = {c: c + by for first, last, by in LATER_CAPITALS for c in range(first, last + 1)} | {0x3A3: 0x3C3}
WORD_END = "</w>"
#: Python's split() takes these for white space; Unicode doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Chunks that a worker remembers; at the bound it forgets them all. Speed depends on it, results don't.
REMEMBERED = 400_000
#: The largest vocabulary file that is sent with the tasks.
VOCABULARY_BYTES = 64 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The symbols after all merges, least rank first, leftmost first among equal ranks.

    The list is doubly linked by position. The queue holds (rank, position, left, right, merged); an entry is stale, and is skipped, when its
    two symbols are no longer there.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), symbols[:]
    queue = [(found[0], i, pair[0], pair[1], found[1]) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (found := ranks.get(pair))]
    heapq.heapify(queue)
    while queue:
        _, i, left, right, merged = heapq.heappop(queue)
        j = after[i]
        if alive[i] != left or j >= n or alive[j] != right:
            continue
        alive[i], alive[j] = merged, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if found := ranks.get((merged, alive[k])):
                heapq.heappush(queue, (found[0], i, merged, alive[k], found[1]))
        h = before[i]
        if h >= 0 and (found := ranks.get((alive[h], merged))):
            heapq.heappush(queue, (found[0], h, alive[h], merged, found[1]))
    return [s for s in alive if s >= 0]


class Bpe(dict):
    """A vocabulary with its merges; as a dict, from a chunk without white space to its ids as little-endian 32-bit bytes."""

    def __init__(self, spec: str):
        super().__init__()
        told = json.loads(spec)
        vocab = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.strings = [""] * (1 + max(*vocab.values(), *self.special.values()))
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(told["model"]["merges"])}
        names = byte_symbols()
        self.inner, self.final = [vocab[s] for s in names], [vocab[s + WORD_END] for s in names]
        self.pieces, self.specials = regex.compile(PIECES), regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.space = regex.compile(r"\s+")
        self.words: dict[str, bytes] = {}

    def word(self, piece: str) -> bytes:
        found = self.words.get(piece)
        if found is None:
            data = piece.encode("utf-8", "surrogatepass")
            symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
            found = np.array(merge_word(symbols, self.ranks), dtype="<u4").tobytes()
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[piece] = found
        return found

    def plain(self, part: str) -> bytes:
        part = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).translate(LOWER).lower()
        return b"".join(map(self.word, self.pieces.findall(part)))

    def __missing__(self, chunk: str) -> bytes:
        if "<|" in chunk:
            found = b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self.plain(p) for p in self.specials.split(chunk) if p)
        else:
            found = self.plain(chunk)
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a whole text; no piece and no normalisation crosses white space, so it goes chunk by chunk."""
        chunks = self.space.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.__getitem__, chunks))

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings, a space between two, as a tokenizer without a decoder joins them."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_loaded: dict[str, Bpe] = {}


def _vocabulary(spec: str) -> Bpe:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True, decoded: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, and with outputs ids (array of int) and, unless decoded=False, decoded; then the columns to keep.

    vocabulary is the path of a word-end BPE file, read on the driver (VOCABULARY_BYTES at most) and sent with the tasks. Null text is empty
    text and gives no ids. Rows keep their ids, null or repeated; other columns are not read. Rows are independent: no shuffle.
    """
    workers_find_package(docs.sparkSession)
    if os.path.getsize(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is no vocabulary file: over {VOCABULARY_BYTES} bytes")
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[2:])
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * outputs + ", decoded string" * (outputs and decoded) + kept

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(spec.value)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                back = bpe.decode(ids)
                for to, x in zip(rows, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), np.frombuffer(ids, "<u4").astype("int32") if outputs else None, back if outputs and decoded else None), strict=True):
                    to.append(x)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            columns = [batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))]
            n = 4 + outputs + (outputs and decoded)
            yield pa.RecordBatch.from_arrays(columns[:n] + batch.columns[2:], names[:n] + list(keep))

    return base.mapInArrow(coded, schema)
