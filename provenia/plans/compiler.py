"""A schema compiled to one plan: pages to instances to fields to evidence to verdict. All but the optional model stage are Column expressions."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.operators.classify import classify_files
from provenia.operators.evidence import gate, with_evidence
from provenia.operators.extraction import TIER1, Extractor, column, long_form, missing, tier0
from provenia.operators.invariants import derive, with_judgements
from provenia.operators.ranges import declared_instances
from provenia.operators.segmentation import instances
from provenia.operators.stages import staged
from provenia.operators.triage import normalised_text, triage
from provenia.plans.schema import Field, Schema

#: A model stage: instances with something missing come in, with `asked` (names); out come their file and segment with reply (map of field
#: to canonical value), cost and error.
Tier1 = Callable[[DataFrame, list[Field]], DataFrame]


def prepared(pages: DataFrame) -> DataFrame:
    return triage(normalised_text(pages)) if "page_type" not in pages.columns else normalised_text(pages)


def fill(df: DataFrame, schema: Schema) -> DataFrame:
    """Values of `reply` where a field has none; a value found before is never replaced."""

    use = lambda f: F.col(column(f.name))["value"].isNull() & F.col("reply")[f.name].isNotNull()
    values = {f"n_{f.name}": F.coalesce(F.col(column(f.name))["value"], F.col("reply")[f.name]) for f in schema.fields}
    origins = {f"o_{f.name}": F.when(use(f), TIER1).otherwise(F.col(column(f.name))["origin"]) for f in schema.fields}

    def filled(f: Field) -> Column:
        old = F.col(column(f.name))
        return F.struct(F.col(f"n_{f.name}").alias("value"), old["raw"].alias("raw"), old["outcome"].alias("outcome"), F.col(f"o_{f.name}").alias("origin"))

    return df.withColumns(values | origins).withColumns({column(f.name): filled(f) for f in schema.fields}).drop(*values, *origins)


def values(pages: DataFrame, schema: Schema, extractor: Extractor = tier0, ranges: DataFrame | None = None) -> DataFrame:
    """The first half of extract, for who asks for values alone: instances with f_ and d_ columns of fields, found or derived; nothing is judged."""
    found = instances(prepared(pages), schema.segmentation) if ranges is None else declared_instances(prepared(pages), ranges)
    return derive(extractor(found, schema), schema)


def extract(pages: DataFrame, schema: Schema, tier1: Tier1 | None = None, extractor: Extractor = tier0, strict: bool = False, ranges: DataFrame | None = None) -> DataFrame:
    """One row for each instance: file, instance_id, pages and bounds, f_, d_, i_, e_, c_ columns of fields and invariants, outcome, reason, cost.

    pages needs file, page_no, text, width and height; images, chars, rotation, osd_rotation and n_chars are used where they are. One shuffle, by file.
    Derivation runs before the model stage, so that nothing is asked that arithmetic gives; rows without anything missing never
    reach the model; after it, derivation runs once more on those that did. strict: see `operators.invariants.judged`.
    With ranges(doc_key, file, page_from, page_to) these are the instances, by `operators.ranges`, and the schema's segmentation isn't used.
    """
    out = values(pages, schema, extractor, ranges)
    error: Column = F.lit(None).cast("string")
    out = out.withColumn("cost", F.lit(0.0)).withColumn("tier1_error", error)
    if tier1 is not None:
        out = out.withColumn("asked", missing(schema))
        whole, open_ = out.filter(F.size("asked") == 0), out.filter(F.size("asked") > 0)
        told = tier1(open_, list(schema.fields)).select("file", "segment", "reply", F.col("cost").alias("_cost"), F.col("error").alias("_error"))
        asked = fill(open_.join(told, ["file", "segment"], "left"), schema)
        asked = derive(asked, schema).withColumn("cost", F.coalesce("_cost", F.lit(0.0))).withColumn("tier1_error", F.col("_error")).drop("reply", "_cost", "_error")
        out = whole.unionByName(asked).drop("asked")
    out = with_judgements(out, schema, strict=strict)
    out = with_evidence(out, schema, tier1 is not None, F.col("tier1_error"))
    return gate(out, schema)


def extract_classified(pages: DataFrame, schemas: dict[str, Schema], tier1: Tier1 | None = None) -> DataFrame:
    """Files of mixed types in long form: file, instance_id, class, schema, field, kind, value, raw, outcome, origin, confidence, verdict, reason.

    A class goes to its schema; one without a class goes to the fallback. A file whose schema isn't given is one row: its class and schema, the
    verdict reject, the reason that there is no schema, all else null. Pages are prepared and files classified once, into a table by schema in the
    shared folder, of which each schema reads its own part.
    """
    routed = staged(prepared(pages).join(classify_files(pages).select("file", "class", "schema"), "file"), "routed", by="schema")
    out = None
    for name, schema in schemas.items():
        own = routed.filter(F.col("schema") == name).drop("schema")
        rows = fields_of(extract(own.drop("class"), schema, tier1), schema).withColumn("schema", F.lit(name)).join(own.select("file", "class").distinct(), "file")
        out = rows if out is None else out.unionByName(rows)
    lost = routed.filter(~F.col("schema").isin(*schemas)) if schemas else routed
    lost = lost.select("file", "class", "schema").distinct().withColumn("verdict", F.lit("reject")).withColumn("reason", F.concat(F.lit("no schema given for "), F.col("class")))
    return lost if out is None else out.unionByName(lost, allowMissingColumns=True)


def fields_of(results: DataFrame, schema: Schema, parts: tuple[str, ...] = ("confidence", "status", "passed", "failed", "derivation")) -> DataFrame:
    """The long form of results with evidence: a row for each field, with its instance's verdict and the parts asked for: nothing else is made or carried along."""
    said = lambda f: {"confidence": F.col(f"c_{f.name}"), "status": F.col(f"e_{f.name}")["status"], "passed": F.col(f"e_{f.name}")["invariants"]["passed"], "failed": F.col(f"e_{f.name}")["invariants"]["failed"], "derivation": F.col(f"d_{f.name}")}
    more = lambda f: [said(f)[p].alias(p) for p in parts]
    long = long_form(results.withColumnRenamed("outcome", "verdict"), schema, ["file", "instance_id", "segment", "verdict", "reason"], more)
    return long.select("file", "instance_id", "segment", "verdict", "reason", "field", "kind", "position", "value", "raw", "outcome", "origin", *parts)


def contract(results: DataFrame, schema: Schema, *keep: str) -> DataFrame:
    """file, instance_id, the columns to keep, and result: the public JSON of each instance. Nulls and empty lists are written, the cost has six places, the class is null."""
    fields = F.struct(*[F.struct(F.col(column(f.name))["value"].alias("value"), F.col(f"e_{f.name}").alias("evidence"), F.col(f"c_{f.name}").alias("confidence")).alias(f.name) for f in schema.fields])
    document = F.struct(F.lit(schema.document).alias("schema"), F.lit(schema.version).alias("schema_versione"), F.lit(None).cast("string").alias("classificazione"), F.col("pages").alias("pagine"))
    whole = F.struct(F.col("instance_id").alias("istanza_id"), document.alias("documento"), fields.alias("campi"), F.col("outcome").alias("esito"), F.col("reason").alias("motivo"), F.round("cost", 6).alias("costo_tier1_usd"), F.col("tier1_error").alias("tier1_errore"))
    return results.select("file", "instance_id", *keep, F.to_json(whole, {"ignoreNullFields": "false"}).alias("result"))
