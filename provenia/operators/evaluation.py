"""Results against the truth: joins that never guess a pairing, and the counts made of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenia.functions.dialect import fence, walled
from provenia.functions.repair import same_value
from provenia.operators.extraction import NORMALISED, NOT_EXTRACTED, NOT_NORMALISABLE, column
from provenia.operators.selection import medians
from provenia.plans.schema import KINDS


def same_by_kind(actual: Column, expected: Column, kind: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for k in KINDS:
        out = F.when(kind == k, same_value(actual, F.when(kind == k, expected), k)).otherwise(out)
    return out


def keys_to_files(truth: DataFrame, metadata: DataFrame) -> DataFrame:
    """truth(doc_key, ...) with file: the one that metadata(doc_key, file) names, else the key with .pdf."""
    return truth.join(metadata.select("doc_key", "file"), "doc_key", "left").withColumn("file", F.coalesce("file", F.concat("doc_key", F.lit(".pdf"))))


def aligned(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected(file, doc_key, ordinal) with the segment found at the same place in the file, and `misaligned` where the file's counts differ.

    found: file, segment. A misaligned file is paired with nothing, for its n-th instance need not be the n-th document.
    """
    by_file = Window.partitionBy("file")
    e = expected.withColumn("_rank", F.row_number().over(by_file.orderBy("ordinal"))).withColumn("_n", F.count("*").over(by_file))
    f = found.select("file", "segment").withColumn("_rank", F.row_number().over(by_file.orderBy("segment"))).withColumn("_found", F.count("*").over(by_file))
    counts = f.select("file", "_found").distinct()
    out = e.join(counts, "file", "left").withColumn("misaligned", F.col("_n") != F.coalesce("_found", F.lit(0)))
    out = out.join(f.select("file", "_rank", "segment"), ["file", "_rank"], "left").withColumn("segment", F.when(~F.col("misaligned"), F.col("segment")))
    return out.drop("_rank", "_n", "_found")


def paired(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected(file, doc_key, ordinal, ...) with all columns of found(file, segment, ...) at the same place in the file, and `misaligned`.

    Like aligned, for results in wide form: one join brings a document its whole instance. Where a file's counts differ, found's columns are NULL.
    """
    by_file = Window.partitionBy("file")
    e = expected.withColumn("_rank", F.row_number().over(by_file.orderBy("ordinal"))).withColumn("_n", F.count("*").over(by_file))
    f = found.withColumn("_rank", F.row_number().over(by_file.orderBy("segment"))).withColumn("_found", F.count("*").over(by_file))
    out = e.join(f, ["file", "_rank"], "left").withColumn("misaligned", F.coalesce(F.col("_n") != F.col("_found"), F.lit(True)))
    return out.withColumns({c: F.when(~F.col("misaligned"), F.col(c)) for c in found.columns if c != "file"}).drop("_rank", "_n", "_found")


def compared_cells(pairs: DataFrame, cells: dict[str, tuple[str, Column]]) -> DataFrame:
    """Of paired documents the rows of compared; cells: for each field its kind and the column of pairs that has the truth. A field is compared as its own kind only, before it is a row."""
    truths = pairs.withColumns({f"_t_{n}": fence(truth.cast("string")) for n, (_, truth) in cells.items()})
    right = lambda n, kind: ~F.col("misaligned") & same_value(F.col(column(n))["value"], F.col(f"_t_{n}"), kind)
    told = truths.withColumns(walled({f"_c_{n}": right(n, kind) for n, (kind, _) in cells.items()}))
    one = lambda n, kind: F.struct(F.lit(n).alias("field"), F.lit(kind).alias("kind"), F.col(column(n))["value"].alias("value"), F.coalesce(F.col(column(n))["outcome"], F.lit(NOT_EXTRACTED)).alias("outcome"), F.col(f"_t_{n}").alias("expected"), F.col("misaligned"), F.col(f"_c_{n}").alias("correct"))
    return told.select("doc_key", F.inline(F.array(*[one(n, kind) for n, (kind, _) in cells.items()]))).select("doc_key", "field", "kind", "value", "outcome", "expected", "misaligned", "correct")


def paired_verdicts(pairs: DataFrame, any_mandatory: bool) -> DataFrame:
    """verdicts of paired documents, whose own verdict is in `outcome`."""
    out = pairs.select(F.when(F.col("misaligned"), "reject" if any_mandatory else "pass").otherwise(F.col("outcome")).alias("verdict"))
    return out.groupBy("verdict").agg(F.count("*").alias("documents"))


def diagnosis(rows: DataFrame) -> DataFrame:
    """By document, of compared rows: fields, correct, not_extracted, not_normalisable, wrong, and first_loss, the stage at which the document is lost first."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    wrong = (F.col("outcome") == NORMALISED) & ~F.col("correct") & ~F.col("misaligned")
    out = rows.groupBy("doc_key").agg(F.max("misaligned").alias("misaligned"), F.count("*").alias("fields"), F.count_if("correct").alias("correct"), is_(NOT_EXTRACTED).alias("not_extracted"), is_(NOT_NORMALISABLE).alias("not_normalisable"), F.count_if(wrong).alias("wrong"))
    loss = F.when(F.col("misaligned"), "misaligned").when(F.col("not_extracted") > 0, NOT_EXTRACTED).when(F.col("not_normalisable") > 0, NOT_NORMALISABLE).when(F.col("wrong") > 0, "wrong")
    return out.withColumn("first_loss", loss)


def composition(documents: DataFrame, by: list[str]) -> DataFrame:
    """How many documents have each value of each of the attributes; a missing one counts as `n/d`."""
    told = F.array(*[F.struct(F.lit(c).alias("attribute"), F.coalesce(F.col(c).cast("string"), F.lit("n/d")).alias("value")) for c in by])
    return documents.select(F.inline(told)).groupBy("attribute", "value").agg(F.count("*").alias("documents"))


def compared(pairs: DataFrame, results: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_key, field, kind, value, outcome, expected, misaligned, correct. pairs: aligned; results: file, segment, field, kind, value, outcome; truth: doc_key, field, kind, expected."""
    wanted = pairs.select("file", "doc_key", "segment", "misaligned").join(truth.select("doc_key", "field", "kind", "expected"), "doc_key")
    out = wanted.join(results.select("file", "segment", "field", "value", "outcome"), ["file", "segment", "field"], "left")
    out = out.withColumn("outcome", F.coalesce("outcome", F.lit("non_estratto")))
    return out.withColumn("correct", ~F.col("misaligned") & same_by_kind(F.col("value"), F.col("expected"), F.col("kind"))).select("doc_key", "field", "kind", "value", "outcome", "expected", "misaligned", "correct")


def field_accuracy(rows: DataFrame) -> DataFrame:
    """By field: total, not_extracted, not_normalisable, normalised, correct, invented (a value that is wrong), accuracy."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    wrong = F.count_if(F.col("value").isNotNull() & ~F.col("correct") & ~F.col("misaligned"))
    return rows.groupBy("field").agg(F.count("*").alias("total"), is_("non_estratto").alias("not_extracted"), is_("non_normalizzabile").alias("not_normalisable"), is_("normalizzato").alias("normalised"), F.count_if("correct").alias("correct"), wrong.alias("invented"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def document_accuracy(rows: DataFrame) -> DataFrame:
    """One row: documents, those with every field right, and those in misaligned files."""
    by_doc = rows.groupBy("doc_key").agg(F.min("correct").alias("right"), F.max("misaligned").alias("misaligned"))
    return by_doc.agg(F.count("*").alias("documents"), F.count_if("right").alias("correct"), F.count_if("misaligned").alias("misaligned"))


def verdicts(pairs: DataFrame, results: DataFrame, any_mandatory: bool) -> DataFrame:
    """Counts by verdict over expected documents: those of misaligned files reject if the schema has a mandatory field, else pass."""
    seen = results.select("file", "segment", "verdict").distinct()
    lost = "reject" if any_mandatory else "pass"
    out = pairs.join(seen, ["file", "segment"], "left").withColumn("verdict", F.when(F.col("misaligned"), lost).otherwise(F.col("verdict")))
    return out.groupBy("verdict").agg(F.count("*").alias("documents"))


def coverage_accuracy(rows: DataFrame, by: list[str], answered: Column, right: Column) -> DataFrame:
    """By group: total, answered, right, coverage (answered of all) and accuracy (right of answered), 0 where there is nothing to divide by."""
    n, a, r = F.count("*"), F.count_if(answered), F.count_if(answered & right)
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    return rows.groupBy(*by).agg(n.alias("total"), a.alias("answered"), r.alias("right"), ratio(a, n).alias("coverage"), ratio(r, a).alias("accuracy"))


def worst(rows: DataFrame, name: str, score: str) -> DataFrame:
    """The name of the least score; of equal ones the first by name."""
    return rows.agg(F.min_by(name, F.struct(score, name)).alias("worst"), F.min(score).alias("score"))


#: The page type that a document of each quality has, and the flag of one that stands on its head.
TYPE_OF_QUALITY = {"digitale": "digitale", "scansione_pulita": "scansione", "scansione_sporca": "scansione", "ibrida": "ibrida"}
ROTATED = "ruotata"


def expected_pages(documents: DataFrame) -> DataFrame:
    """What triage_report expects, of metadata(doc_key, file, page_from, page_to, quality, flags): a row for each file: ranges, page_type, rotation; those of its first document."""
    first = F.min_by(F.struct("quality", F.array_contains("flags", ROTATED).alias("turned")), "doc_key")
    out = documents.groupBy("file").agg(F.array_sort(F.collect_set(F.struct(F.col("page_from").alias("from"), F.col("page_to").alias("to")))).alias("ranges"), F.count("*").cast("int").alias("documents"), first.alias("of"))
    kind = F.coalesce(*[F.when(F.col("of.quality") == q, t) for q, t in TYPE_OF_QUALITY.items()])
    return out.select("file", "ranges", "documents", kind.alias("page_type"), F.when(F.col("of.turned"), 180).otherwise(0).alias("rotation"))


def triage_report(found: DataFrame, pages: DataFrame, expected: DataFrame) -> DataFrame:
    """A row for each file of expected(file, ranges array<struct<from, to>>, documents, page_type, rotation).

    found: file, page_from, page_to, seg_confidence of its instances; pages: file, page_type, page_rotation of triage. count_matches and ranges_match (as sets);
    certain_but_wrong: counts said to be certain that differ; n_pages, types_right; rotation_known (pages with a rotation at all) and, of these, rotation_right.
    """
    f = found.groupBy("file").agg(F.array_sort(F.collect_set(F.struct(F.col("page_from").cast("int").alias("from"), F.col("page_to").cast("int").alias("to")))).alias("got"), F.count("*").alias("instances"), F.first("seg_confidence").alias("confidence"))
    told = expected.select("file", F.col("page_type").alias("want_type"), F.col("rotation").alias("want_rotation"))
    p = pages.join(told, "file").groupBy("file").agg(F.count("*").alias("n_pages"), F.count_if(F.col("page_type") == F.col("want_type")).alias("types_right"), F.count("page_rotation").alias("rotation_known"), F.count_if(F.col("page_rotation") == F.col("want_rotation")).alias("rotation_right"))
    out = expected.join(f, "file", "left").join(p, "file", "left")
    count = F.coalesce(F.col("instances") == F.col("documents"), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("file", "confidence", count.alias("count_matches"), F.coalesce(F.col("got") == F.array_sort(F.array_distinct("ranges")), F.lit(False)).alias("ranges_match"), ((F.col("confidence") == "certa") & ~count).alias("certain_but_wrong"), *map(zero, ("n_pages", "types_right", "rotation_known", "rotation_right")))


def triage_rates(report: DataFrame) -> DataFrame:
    """One row over triage_report: shares of files with right counts and ranges, of pages with the right type, of pages with a rotation, and of these with the right one."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, pages, known = F.count("*"), F.sum("n_pages"), F.sum("rotation_known")
    return report.agg(n.alias("files"), F.count_if("certain_but_wrong").alias("certain_but_wrong"), ratio(F.count_if("count_matches"), n).alias("counts"), ratio(F.count_if("ranges_match"), n).alias("ranges"), ratio(F.sum("types_right"), pages).alias("types"), ratio(known, pages).alias("rotation_coverage"), ratio(F.sum("rotation_right"), known).alias("rotation"))


def contract_faults(rows: DataFrame) -> DataFrame:
    """Of the long form of results: by rule how many rows break it. Each value has an origin and no value has none; each value has a confidence; a missing one a status."""
    v = F.col("value").isNull()
    rules = {"value_origin": v == F.col("origin").isNull(), "value_confidence": v == F.col("confidence").isNull(), "missing_status": v == F.col("status").isNotNull(), "known_verdict": F.col("verdict").isin("pass", "warning", "reject")}
    counts = rows.agg(*[F.count_if(~ok).alias(k) for k, ok in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("faults")) for k in rules])))


def feature_margins(pages: DataFrame, digital_below: float, scan_above: float, dense_above: float) -> DataFrame:
    """By page type: pages, least, greatest and median coverage and density, and as factors how far coverage stays from its threshold (margin), and how far
    the density of digital pages stays above, and that of others below, dense_above (density_margin). Pages of a null type are a type."""
    out = pages.groupBy("page_type").agg(F.count("*").alias("pages"), *[g(x).alias(f"{n}_{x}") for x in ("coverage", "density") for n, g in (("min", F.min), ("max", F.max))])
    middle = medians(pages, ["page_type"], {x: f"median_{x}" for x in ("coverage", "density")})
    out = out.join(middle.withColumnRenamed("page_type", "_type"), F.col("page_type").eqNullSafe(F.col("_type"))).drop("_type")
    digital, scan = F.col("page_type") == "digitale", F.col("page_type") == "scansione"
    margin = F.when(digital, F.try_divide(F.lit(digital_below), F.col("max_coverage"))).when(scan, F.try_divide(F.col("min_coverage"), F.lit(scan_above)))
    density = F.when(digital, F.try_divide(F.col("min_density"), F.lit(dense_above))).when(scan, F.try_divide(F.lit(dense_above), F.col("max_density")))
    return out.withColumn("margin", margin).withColumn("density_margin", density)


def cleaned(x: Column) -> Column:
    return F.regexp_replace(F.upper(x), r"[^\p{L}\p{N}]", "")


def recovery_rate(rows: DataFrame, by: list[str]) -> DataFrame:
    """By group: how many expected values still stand in the recognised text, both upper case and without all but letters and digits."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.contains(cleaned(F.col("text")), cleaned(F.col("expected")))).alias("recovered"))
