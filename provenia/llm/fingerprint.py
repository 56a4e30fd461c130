"""Order MinHash fingerprints of whole texts, in SQL functions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.functions.dialect import fence
from provenia.llm.common import stage, unstage, with_position

#: Tokens in a k-mer; minimal k-mers that are selected, each by a hash of its own; positions of a fingerprint, each of a pair of them. (So many minima are
#: still compiled as one stage.)
K, MINIMA, POSITIONS = 2, 80, 80
#: The code points of scripts that are written without spaces (Thai to Tibetan, Burmese, Khmer, Chinese and Japanese with their later blocks).
UNSPACED = r"\u0E00-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: A token is a character of these, or a run of others up to white space, but no longer than this.
LONGEST = 8
TOKEN = rf"[^\x20\x09-\x0D{UNSPACED}]{{1,{LONGEST}}}|[{UNSPACED}]"
#: A k-mer occurrence in a 64-bit number: the upper bits of its hash, then its place in the text in 24 bits.
PLACE_BITS = 24
LOW, HIGH = (1 << PLACE_BITS) - 1, -(1 << PLACE_BITS)


def _hash(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def let(value: Column, use) -> Column:
    """use(value) with value computed once for the row; inside a lambda Spark would compute it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_kmers(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column out, array<long>: the occurrence-numbered k-mers of column text, each a hash above PLACE_BITS and its place in the text below.

    k-mers are K tokens in a row (fewer at the end of the text), see TOKEN. Equal k-mers of a text are numbered by
    occurrence, and (k-mer, number) is hashed. Works on any length: in texts of more than 2^24 tokens a place counts in steps. A text
    without tokens has one empty k-mer.
    """
    w, s, again, starts = (f"_{out}_{x}" for x in ("w", "s", "again", "starts"))
    # each step is fenced: inside a lambda of the next Spark would compute it anew for each element
    df = df.withColumn(w, fence(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))))
    df = df.withColumn(w, F.when(F.size(w) > 0, F.col(w)).otherwise(F.array(F.lit(""))))
    step = F.greatest(F.length(F.bin(F.size(w).cast("long"))) - PLACE_BITS, F.lit(0))
    kmer = lambda x, i: F.xxhash64(x, *[F.get(F.col(w), i + j) for j in range(1, K)])
    placed = let(step, lambda by: F.transform(w, lambda x, i: kmer(x, i).bitwiseAND(F.lit(HIGH)).bitwiseOR(F.call_function("shiftright", i, by).cast("long"))))
    df = df.withColumn(s, fence(F.sort_array(placed)))
    # sorted by hash, then place: at all but its first occurrence a k-mer has the hash before (null before the first of all)
    same = lambda arr, x, i: F.coalesce(_hash(x.bitwiseXOR(F.get(F.col(arr), i - 1))) == 0, F.lit(False))
    df = df.withColumn(again, fence(F.filter(s, lambda x, i: same(s, x, i))))
    # later occurrences are numbered 1, 2, ... within each run of equal hashes
    here = F.filter(F.sequence(F.lit(0), F.size(again) - 1), lambda i: (i == 0) | (_hash(F.get(F.col(again), i)) != _hash(F.get(F.col(again), i - 1))))
    df = df.withColumn(starts, fence(F.when(F.size(again) > 0, here).otherwise(F.array().cast("array<int>"))))
    number = F.flatten(F.transform(starts, lambda at, r: F.sequence(F.lit(1), F.coalesce(F.get(F.col(starts), r + 1), F.size(again)) - at)))
    numbered = let(number, lambda occ: F.transform(again, lambda x, i: F.xxhash64(_hash(x), F.get(occ, i)).bitwiseAND(F.lit(HIGH)).bitwiseOR(x.bitwiseAND(F.lit(LOW)))))
    firsts = F.when(F.size(again) > 0, F.filter(s, lambda x, i: ~same(s, x, i))).otherwise(F.col(s))
    return df.withColumn(out, fence(F.concat(firsts, numbered))).drop(w, s, again, starts)


def with_fingerprint(df: DataFrame, text: str, out: str, keys: list[str]) -> DataFrame:
    """A row for each value of keys (which tell the texts apart): keys and out, array<int> of POSITIONS, the Order MinHash of column text; null text has null.

    Each of MINIMA hashes selects its least k-mer. A position is a pair of neighbours among these, the last with the first: the two are put into text order and
    hashed as a tuple. So equal texts have equal fingerprints, and the share of equal positions falls with what an edit changes and with what it
    moves. (Two least by one hash would be the same but for drawing without replacement; so each is a plain minimum, and counts in two pairs.)
    Minima are summed where the rows are, and again after an exchange if the rows don't lie by keys already.
    """
    each = with_kmers(df.select(*keys, text), text, "_kmers").select(*keys, F.explode("_kmers").alias("_x"))
    least = []
    for i in range(MINIMA // 2):
        h = F.xxhash64(F.lit(i), _hash(F.col("_x")))
        for j, half in enumerate((F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1)))):
            least.append(F.min(F.shiftleft(half, PLACE_BITS).bitwiseOR(F.col("_x").bitwiseAND(F.lit(LOW)))).alias(f"_{2 * i + j}"))
    found = each.groupBy(*keys).agg(*least)
    ring = lambda by: F.array(*[F.col(f"_{(i + by) % MINIMA}") for i in range(MINIMA)])
    place = lambda m: m.bitwiseAND(F.lit(LOW))
    told = F.zip_with(ring(0), ring(1), lambda a, b: F.when(place(a) <= place(b), F.hash(_hash(a), _hash(b))).otherwise(F.hash(_hash(b), _hash(a))))
    return found.select(*keys, told.alias(out))


def likeness(a: str, b: str) -> Column:
    """0 to 1: the square root of the share of positions at which two fingerprints are equal. A position is equal if both of its k-mers are, so this
    estimates the share of k-mers that the texts have in common and in the same order."""
    return F.sqrt(F.size(F.filter(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda x: x["a"] == x["b"])) / F.lit(float(POSITIONS)))


def as_text(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars/2) code points replaced by the first as many (or all) of the next document's, by descending
    id; the first follows the last. Null text is empty text. Null ids come last. Rows with the same id and text have one place in the order
    (and equal results); rows with the same id and different texts are in the order of a hash. A single document is next to itself.
    Other columns are not read; no rows give no rows.
    Places are found on (id, hash, length) alone. Whole texts are shuffled once, to meet their place; then only the passages that
    the edits insert. The join needs no other order of the texts, since both sides lie by the same key.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = base.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("x"), "doc_id", "text")
    narrow = stage(base.select("k", "x", "doc_id", F.length("text").alias("n")).groupBy("k", "x").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies")), "fingerprint-ids")
    n_rows = narrow.count()
    places = stage(with_position(narrow, [F.desc_nulls_last("doc_id"), "x"]), "fingerprint-places")
    before = places.select(F.pmod(F.col("pos") + 1, F.lit(max(n_rows, 1))).alias("pos"), F.col("k").alias("ck"), F.col("x").alias("cx"), (F.col("n") / 2).cast("long").alias("need"))
    links = stage(places.join(before.hint("merge"), "pos").select("k", "x", "doc_id", "n", "copies", "ck", "cx", "need"), "fingerprint-links")

    repeated = not links.filter("copies > 1").isEmpty()
    if repeated:  # of rows with the same id and text one is fingerprinted
        texts = base.dropDuplicates(["k", "x"])
    else:
        texts = base
    # both uses of `full` read the same columns of the texts, so that one exchange serves them
    full = texts.drop("doc_id").join(links.hint("merge"), ["k", "x"])
    given = full.select(F.col("ck").alias("k"), F.col("cx").alias("x"), F.substring("text", F.lit(1), F.col("need").cast("int")).alias("insert"), F.col("k").alias("nk"), F.col("x").alias("nx"))
    own = full.select("k", "x", "doc_id", "text", "n").join(given.hint("merge"), ["k", "x"])
    own = own.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 2)).cast("int")), "insert"))
    own = own.select("k", "x", "nk", "nx", "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.inline(F.array(F.struct(F.lit(False).alias("changed"), F.col("text").alias("text")), F.struct(F.lit(True).alias("changed"), F.col("edited").alias("text")))))
    # the rows lie by (k, x), so what is grouped by more than these needs no further exchange
    keys = ["k", "x", "nk", "nx", "doc_id", "n_chars", "edited_sha256"]
    prints = with_fingerprint(own, "text", "print", [*keys, "changed"])
    prints = prints.groupBy(*keys).agg(F.max(F.when(~F.col("changed"), F.col("print"))).alias("own"), F.max(F.when(F.col("changed"), F.col("print"))).alias("other"))
    prints = stage(prints, "fingerprints")
    following = prints.select(F.col("k").alias("nk"), F.col("x").alias("nx"), F.col("own").alias("next_own"))
    out = prints.join(following.hint("merge"), ["nk", "nx"])
    if repeated:
        out = base.select("k", "x").join(out.hint("merge"), ["k", "x"])
    return out.select("doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "next_own").alias("near_next"))


__all__ = ["as_text", "fingerprints", "likeness", "unstage", "with_fingerprint", "with_kmers"]
