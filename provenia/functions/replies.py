"""Model replies: a JSON object, perhaps in a fence, as canonical values by field kind."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.functions.dialect import fence
from provenia.functions.repair import STEPS, repair
from provenia.plans.schema import Field

FENCE = r"(?is)\A\s*```(?:json)?\s*|\s*```\s*\z"


def parsed_object(text: Column) -> Column:
    """The reply as a variant; NULL unless it is a JSON object. Nothing is read from the middle of other text."""
    v = F.try_parse_json(F.regexp_replace(text, FENCE, ""))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def scalar_text(v: Column, kind: str) -> Column:
    """A JSON value as raw text for its kind: text as it is, numbers for decimals, whole numbers for integers; else NULL."""
    of = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    text = F.try_variant_get(v, "$", "string")
    number = F.startswith(of, F.lit("DECIMAL")) | of.isin("BIGINT", "DOUBLE", "FLOAT")
    whole = F.try_variant_get(v, "$", "decimal(38,10)")
    out = F.when(of == "STRING", text)
    if kind == "decimal":
        out = out.when(number, text)
    if kind == "integer":
        out = out.when(number & (whole == F.floor(whole)), whole.cast("decimal(38,0)").cast("string"))
    return out


def accept_iso(value: Column, raw: Column) -> Column:
    return F.coalesce(value, F.when(F.regexp_like(raw, F.lit(r"\A\d{4}-\d{2}-\d{2}\z")), F.try_to_date(raw, "yyyy-MM-dd").cast("string")))


def reply_values(text: Column, fields: list[Field], iso_dates: bool = False) -> dict[str, Column]:
    """Each field's repaired value from a reply. As documents are read day first, an ISO date is refused unless iso_dates."""
    obj, out = parsed_object(text), {}
    for f in fields:
        raw = scalar_text(F.try_variant_get(obj, f"$['{f.name}']", "variant"), f.kind)
        value = repair(raw, f.kind)
        out[f.name] = accept_iso(value, raw) if iso_dates and f.kind == "date" else value
    return out


def with_reply_values(df: DataFrame, text: Column, fields: list[Field], iso_dates: bool = False, prefix: str = "") -> DataFrame:
    """df with reply_values of text as columns named like the fields, after prefix: each reply is parsed once, each step of each field is computed once."""
    out = df.withColumn("_reply", fence(F.try_parse_json(F.regexp_replace(text, FENCE, ""))))
    out = out.withColumn("_reply", fence(F.when(F.startswith(F.schema_of_variant("_reply"), F.lit("OBJECT")), F.col("_reply"))))
    name = lambda f: prefix + f.name
    part = lambda x, f: f"_{x}_{f.name}"
    out = out.withColumns({part("v", f): fence(F.try_variant_get("_reply", f"$['{f.name}']", "variant")) for f in fields})
    out = out.withColumns({part("r", f): fence(scalar_text(F.col(part("v", f)), f.kind)) for f in fields}).withColumns({name(f): F.col(part("r", f)) for f in fields})
    for i in range(max(len(STEPS[f.kind]) for f in fields)):
        out = out.withColumns({name(f): fence(STEPS[f.kind][i](F.col(name(f)))) for f in fields if i < len(STEPS[f.kind])})
    if iso_dates:
        out = out.withColumns({name(f): accept_iso(F.col(name(f)), F.col(part("r", f))) for f in fields if f.kind == "date"})
    return out.drop("_reply", *[part(x, f) for f in fields for x in "vr"])
