"""Truth, metadata, prices and files as tables; each says what is wrong with its input."""

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.plans.schema import Schema


class TruthError(ValueError):
    """Ground truth that doesn't fit its schema."""


class PriceError(ValueError):
    """A price table that can't be used."""


def truth(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """(doc_key, field, kind, expected) of a JSON file {oracle_version, documento, documenti: key -> field -> text or null}; every document has exactly the schema's fields."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    told = raw.select(F.schema_of_variant("v").alias("kind"), F.schema_of_variant(F.try_variant_get("v", "$.oracle_version", "variant")).alias("version"), F.try_variant_get("v", "$.documento", "string").alias("document"), F.schema_of_variant(F.try_variant_get("v", "$.documenti", "variant")).alias("docs")).first()
    if told is None or not (told["kind"] or "").startswith("OBJECT"):
        raise TruthError(f"{path}: not a JSON object")
    if told["version"] != "BIGINT":
        raise TruthError("oracle_version must be a whole number")
    if told["document"] != schema.document:
        raise TruthError(f"documento is {told['document']!r}, the schema's is {schema.document!r}")
    if not (told["docs"] or "").startswith("OBJECT"):
        raise TruthError("documenti must be an object")
    docs = raw.selectExpr("try_variant_get(v, '$.documenti', 'variant') AS d").selectExpr("inline(map_entries(cast(d as map<string, variant>)))").toDF("doc_key", "d")
    cells = docs.selectExpr("doc_key", "map_entries(cast(d as map<string, variant>)) AS cells").select("doc_key", F.transform("cells", lambda c: c["key"]).alias("have"), "cells")
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    bad = cells.select("doc_key", F.array_sort(F.array_except(names, "have")).alias("missing"), F.array_sort(F.array_except("have", names)).alias("extra"), F.filter(F.transform("cells", lambda c: F.when(~F.schema_of_variant(c["value"]).isin("STRING", "VOID"), c["key"])), lambda k: k.isNotNull()).alias("odd")).filter("size(missing) + size(extra) + size(odd) > 0").first()
    if bad:
        raise TruthError(f"{bad['doc_key']}: missing {bad['missing']}, extra {bad['extra']}, neither text nor null {bad['odd']}")
    kinds = F.create_map(*[F.lit(x) for f in schema.fields for x in (f.name, f.kind)])
    return cells.select("doc_key", F.inline(F.transform("cells", lambda c: F.struct(c["key"].alias("field"), F.try_variant_get(c["value"], "$", "string").alias("expected"))))).withColumn("kind", kinds[F.col("field")])


METADATA = "doc_key string, file string, page_from int, page_to int, layout string, reading string, single_rate boolean, quality string, flags array<string>"


def metadata(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """(doc_key, file, page_from, page_to, layout, reading, single_rate, quality, flags) of a JSON file, flat or under `documenti`; an attribute that isn't there is
    NULL, no flags an empty array; a file that isn't there is an empty table unless required."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], METADATA)
    raw = spark.read.text(path, wholetext=True).selectExpr("parse_json(value) AS v").selectExpr("coalesce(try_variant_get(v, '$.documenti', 'map<string,variant>'), cast(v as map<string,variant>)) AS m")
    rows = raw.selectExpr("inline(map_entries(m))").toDF("doc_key", "d").filter("schema_of_variant(d) like 'OBJECT%'")
    told = {"file": ("file", "string"), "page_from": ("pagine[0]", "int"), "page_to": ("pagine[1]", "int"), "layout": ("layout", "string"), "reading": ("tipo_lettura", "string"), "single_rate": ("monoraria", "boolean"), "quality": ("qualita", "string")}
    flags = "coalesce(try_variant_get(d, '$.flag_attivi', 'array<string>'), cast(array() as array<string>)) AS flags"
    return rows.selectExpr("doc_key", *[f"try_variant_get(d, '$.{at}', '{kind}') AS {name}" for name, (at, kind) in told.items()], flags)


PRICES = "model string, input_price double, output_price double, cache_write_price double, cache_read_price double, image_kind string, updated string"


def prices(spark: SparkSession, path: str) -> DataFrame:
    """(model, input_price, output_price, cache_write_price, cache_read_price, image_kind, updated) of a YAML price table. Prices change: the package has none of its own."""
    try:
        with open(path, encoding="utf-8") as f:
            told = yaml.safe_load(f)
    except (OSError, yaml.YAMLError) as e:
        raise PriceError(str(e)) from e
    if not isinstance(told, dict) or not isinstance(told.get("modelli"), dict) or not told["modelli"] or not isinstance(told.get("aggiornato_il"), str):
        raise PriceError("aggiornato_il and modelli are needed")

    def number(m: str, d: dict, k: str, optional: bool = False) -> float | None:
        x = d.get(k)
        if x is None and optional:
            return None
        if isinstance(x, bool) or not isinstance(x, int | float):
            raise PriceError(f"{m}: {k} must be a number")
        return float(x)

    rows = []
    for m, d in told["modelli"].items():
        if not isinstance(d, dict):
            raise PriceError(f"{m}: must be a mapping")
        image = d.get("token_immagine")
        if image is not None and (not isinstance(image, dict) or not all(isinstance(image.get(k), str) for k in ("tipo", "formula", "fonte", "verificato_il"))):
            raise PriceError(f"{m}: token_immagine needs tipo, formula, fonte, verificato_il")
        rows.append((m, number(m, d, "costo_input_per_milione"), number(m, d, "costo_output_per_milione"), number(m, d, "costo_cache_scrittura_per_milione", True), number(m, d, "costo_cache_lettura_per_milione", True), image and image["tipo"], told["aggiornato_il"]))
    return spark.createDataFrame(rows, PRICES)


def inventory_of(files: DataFrame) -> DataFrame:
    """(path, file, supplier, sha256, bytes) of files(path, content); the supplier is the folder's name."""
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -1).alias("file"), F.try_element_at(parts, F.lit(-2)).alias("supplier"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def inventory(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """inventory_of the files below root; those without a byte are left out, as the scan does."""
    return inventory_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root))
