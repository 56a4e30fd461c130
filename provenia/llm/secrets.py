"""Secret scans with corpus-wide ownership frequency: what many owners share is an example, what one owner holds looks live."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenia.llm.common import stage, unstage


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# What a candidate looks like, in Java's and RE2's dialect alike.
NAMES = either_case("(password|passwd|secret|token|api_?key)")
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A bare token: a run of 16+ such characters, with a digit among them.
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "bare")
PATTERNS = (ASSIGN, ACCESS, HEX, BARE)
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your[_-]|(.)\1{5}"
SHORTEST_VALUE = 6


def hits(text: F.Column, pattern: str, group: int) -> F.Column:
    """The matches of pattern in text, leftmost and not overlapping: array<struct<gap, size, value>>, gap being the characters since the match before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    made = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m"), values.alias("v")), lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("value")))
    none = F.array().cast("array<struct<gap:int,size:int,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(made, lambda x: x["value"].isNotNull())).otherwise(none)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"), owner_col: str = "source", example_owners: int = 3) -> tuple[DataFrame, DataFrame]:
    """(a row for each row of docs with its row number and id, a row for each span: row, kind, start, stop, class, repos, owners).

    Spans count code points, stop is exclusive. Kinds: `assign` (a secret's name with a value of 6+ characters), `access`, `hex`, and
    `bare`, which the frequencies add: a token that overlaps no other span, is live, and either is the value of another kind's span
    somewhere in the corpus or mixes upper case, lower case and digits in 20+ characters.
    Each candidate value is hashed; a hash's repositories and owners are counted over the whole corpus. Held by `example_owners` owners or
    more it is an `example`; with a placeholder word, six equal characters in a row or under six different ones a `placeholder`; else `live`.
    Null text is empty text without spans; a null owner or repository counts as one owner or repository. Repeated rows are rows of their own.
    The text is read once; only matches are shuffled. A hash held by very many rows is summed before the shuffle, and the
    join back reads both sides by an exchange, so that adaptive execution can split it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    repo = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in repo_cols])
    seen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("owner"), repo.alias("repo"), *[hits(text, p, 2 if k == "assign" else 0).alias(k) for k, p in zip(KINDS, PATTERNS, strict=True)])
    seen = stage(seen.withColumn("row", F.monotonically_increasing_id()), "secret-hits")

    def marked(kind: int) -> F.Column:
        return F.transform(KINDS[kind], lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))

    each = F.flatten(F.array(*map(marked, range(len(KINDS)))))
    found = seen.select("row", "owner", "repo", F.explode(each).alias("x")).select("row", "owner", "repo", "x.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("stop") - F.col("size"))
    found = found.filter((F.col("kind") != 0) | (F.length("value") >= SHORTEST_VALUE))
    # a bare token that a base span overlaps is no span of its own
    base = F.col("kind") < KINDS.index("bare")
    order = Window.partitionBy("row").orderBy("start", "kind")
    found = found.withColumn("_before", F.max(F.when(base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.min(F.when(base, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing)))
    free = (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.col("stop")) >= F.col("stop"))
    found = found.filter(base | free)
    value = F.col("value")
    mixed = (F.length(value) >= 20) & F.regexp_like(value, F.lit("[A-Z]")) & F.regexp_like(value, F.lit("[a-z]"))
    odd = F.regexp_like(value, F.lit(PLACEHOLDER)) | (F.size(F.array_distinct(F.split(value, ""))) < 6)
    found = stage(found.select("row", "owner", "repo", "kind", "start", "stop", F.unhex(F.sha2(value, 256)).alias("hash"), mixed.alias("mixed"), odd.alias("odd")), "secret-spans")

    per_repo = found.groupBy("hash", "owner", "repo").agg(F.max(base).alias("named"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("named").alias("named"))
    owned = stage(per_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.max("named").alias("named")), "secret-owners")
    kind_class = F.when(F.col("owners") >= example_owners, "example").when(F.col("odd"), "placeholder").otherwise("live")
    spans = found.join(owned.hint("merge"), "hash").withColumn("class", kind_class).filter(base | (F.col("class") == "live") & (F.col("named") | F.col("mixed")))
    spans = spans.select("row", F.col("kind"), "start", "stop", "class", "repos", "owners")
    return seen.select("row", "doc_id"), spans


def scanned(docs: DataFrame, **columns) -> DataFrame:
    """A row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    rows, spans = secret_scan(docs, **columns)
    name = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("stop")).alias("said"))
    of = lambda k: F.count_if(F.col("kind") == KINDS.index(k)).alias(f"n_{k}")
    summed = spans.groupBy("row").agg(of("assign"), of("access"), of("hex"), F.count_if(F.col("class") == "live").alias("n_live"), F.count_if(F.col("class") == "example").alias("n_example"), F.sort_array(F.collect_list(one)).alias("all"))
    said = lambda keep: F.array_join(F.transform(F.filter(F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,said:string>>")), keep), lambda x: x["said"]), ",")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = rows.join(summed, "row", "left")
    return out.select("doc_id", *map(zero, ("n_assign", "n_access", "n_hex")), F.sha2(said(lambda x: x["kind"] < KINDS.index("bare")), 256).alias("base_sha256"), said(lambda x: F.lit(True)).alias("spans"), *map(zero, ("n_live", "n_example")))


__all__ = ["KINDS", "PATTERNS", "scanned", "secret_scan", "unstage"]
