"""Fields from an instance's text: a capture that is unique, repaired, with a diagnosis."""

import importlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.functions.dialect import captures, fence, unique_of, walled
from provenia.functions.repair import STEPS
from provenia.operators.stages import workers_find_package
from provenia.plans.schema import Field, Schema

NOT_EXTRACTED, NOT_NORMALISABLE, NORMALISED = "non_estratto", "non_normalizzabile", "normalizzato"
TIER0, TIER1, DERIVED = "tier0", "tier1", "derivato"
#: An extractor gives each field's diagnosis; others than the default can be passed to `plans.compiler.extract`.
Extractor = Callable[[DataFrame, Schema], DataFrame]
#: What an extractor repairs: instances with more columns, and by field the raw capture made of them.
Captured = Callable[[DataFrame, Schema], tuple[DataFrame, dict[str, Column]]]


def column(name: str) -> str:
    return f"f_{name}"


def diagnosis(raw: Column, value: Column) -> Column:
    return F.when(raw.isNull(), NOT_EXTRACTED).when(value.isNull(), NOT_NORMALISABLE).otherwise(NORMALISED)


def from_raw(instances: DataFrame, schema: Schema, raw: dict[str, Column]) -> DataFrame:
    """instances with f_<field>: struct(value, raw, outcome, origin) for each field of the schema, from the raw captures of those that have one.

    Raw values and the first step of their repair are made in one go: raw stands in both, which compiled code takes for one.
    """
    none = F.lit(None).cast("string")
    steps = {f.name: STEPS[f.kind] if f.name in raw else () for f in schema.fields}
    first = {f"r_{n}": raw[n] for n in steps if n in raw} | {f"v_{n}": steps[n][0](raw[n]) for n in steps if n in raw}
    out = instances.withColumns(walled(first) | {f"{x}_{n}": none for n in steps if n not in raw for x in "rv"})
    for i in range(1, max(map(len, steps.values()))):  # a step for all fields at a time: each has its input as a column, which it names more than once
        more = {f"v_{n}": steps[n][i](F.col(f"v_{n}")) for n in steps if i < len(steps[n])}
        out = out.withColumns(walled(more) if i == 1 else {c: fence(x) for c, x in more.items()})

    def told(f: Field) -> Column:
        r, v = F.col(f"r_{f.name}"), F.col(f"v_{f.name}")
        return F.struct(v.alias("value"), r.alias("raw"), diagnosis(r, v).alias("outcome"), F.when(v.isNotNull(), TIER0).alias("origin"))

    return out.withColumns({column(f.name): told(f) for f in schema.fields}).drop(*[f"{x}_{f.name}" for f in schema.fields for x in "rv"])


def raw_by_rules(instances: DataFrame, schema: Schema) -> tuple[DataFrame, dict[str, Column]]:
    """instances with m_<field>, all captures of each field that has a rule, and its raw value made of them."""
    ruled = [f for f in schema.fields if f.pattern]
    found = instances.withColumns(walled({f"m_{f.name}": captures(F.col("text"), f.pattern) for f in ruled})) if ruled else instances
    return found, {f.name: unique_of(F.col(f"m_{f.name}"), f.pattern) for f in ruled}


def tier0(instances: DataFrame, schema: Schema) -> DataFrame:
    """from_raw with the captures of the fields' rules."""
    found, raw = raw_by_rules(instances, schema)
    return from_raw(found, schema, raw).drop(*[f"m_{n}" for n in raw])


def finding(finder: str, names: list[str]) -> Callable[[pa.Array], pa.Array]:
    """A batch of texts to a batch of structs, a raw value for each name, as the finder names them."""
    module, _, name = finder.partition(":")

    def find(texts: pa.Array) -> pa.Array:
        told = getattr(importlib.import_module(module), name)
        said = [told(t or "", list(names)) for t in texts.to_pylist()]
        text = lambda v: None if v is None else str(v)
        return pa.StructArray.from_arrays([pa.array([text(x.get(n)) for x in said], pa.string()) for n in names], [f"u_{i}" for i in range(len(names))])

    return find


def raw_by(finder: str) -> Captured:
    """captured() by Python code: see found_by."""

    def captured(instances: DataFrame, schema: Schema) -> tuple[DataFrame, dict[str, Column]]:
        workers_find_package(instances.sparkSession)
        names = [f.name for f in schema.fields]
        if not names:
            return instances, {}
        kind = ", ".join(f"u_{i} string" for i in range(len(names)))
        # said to differ each time, so that it is called once and not for each value
        find = F.arrow_udf(finding(finder, names), f"struct<{kind.replace(' string', ': string')}>").asNondeterministic()
        return instances.withColumn("_told", find(F.col("text"))), {n: F.col("_told")[f"u_{i}"] for i, n in enumerate(names)}

    return captured


def found_by(finder: str) -> Extractor:
    """An extractor whose raw values come from Python code, "module:function", that workers can import: (text, names) -> {name: raw value or None}.

    It sees an instance's whole text, once, in Arrow batches. What it leaves out is not extracted; its values are repaired as those of patterns are. The rows stay as they are dealt: no shuffle.
    """

    def extractor(instances: DataFrame, schema: Schema) -> DataFrame:
        rows, raw = raw_by(finder)(instances, schema)
        return from_raw(rows, schema, raw).drop("_told")

    return extractor


def found_rows(instances: DataFrame, schema: Schema, keys: list[str], captured: Captured = raw_by_rules) -> DataFrame:
    """The rows of long_form over from_raw, for who asks for nothing else: raw captures become rows first, and a row is repaired by its own kind.

    So the plan has each kind's repair once and not once for each field: code that long isn't compiled by the JVM, which then reads it step by step for each instance.
    """
    rows, raw = captured(instances, schema)
    one = lambda i, f: F.struct(F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"), F.lit(i).alias("position"), F.lit(f.mandatory).alias("mandatory"), raw.get(f.name, F.lit(None).cast("string")).alias("raw"))
    out = rows.select(*keys, F.inline(F.array(*[one(i, f) for i, f in enumerate(schema.fields)]))).withColumn("value", F.col("raw"))
    kinds = list(dict.fromkeys(f.kind for f in schema.fields))
    for i in range(max(len(STEPS[k]) for k in kinds)):
        for step in dict.fromkeys(STEPS[k][i] for k in kinds if i < len(STEPS[k])):  # once for all kinds that have it
            own = F.col("kind").isin([k for k in kinds if STEPS[k][i : i + 1] == (step,)])
            out = out.withColumn("value", fence(F.when(own, step(F.col("value"))).otherwise(F.col("value"))))
    return out.select(*keys, "field", "kind", "position", "mandatory", "value", "raw", diagnosis(F.col("raw"), F.col("value")).alias("outcome"), F.when(F.col("value").isNotNull(), TIER0).alias("origin"))


def nothing(instances: DataFrame, schema: Schema) -> DataFrame:
    """The extractor that finds nothing."""
    none = F.lit(None).cast("string")
    empty = F.struct(none.alias("value"), none.alias("raw"), F.lit(NOT_EXTRACTED).alias("outcome"), none.alias("origin"))
    return instances.withColumns({column(f.name): empty for f in schema.fields})


def long_form(results: DataFrame, schema: Schema, keys: list[str], more: Callable[[Field], list[Column]] = lambda f: []) -> DataFrame:
    """One row for each field: keys, field, kind, position, value, raw, outcome, origin, and more of each field."""
    rows = F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(f.kind).alias("kind"), F.lit(i).alias("position"), F.lit(f.mandatory).alias("mandatory"), *[F.col(column(f.name))[x].alias(x) for x in ("value", "raw", "outcome", "origin")], *more(f)) for i, f in enumerate(schema.fields)])
    return results.select(*keys, F.inline(rows))


def missing(schema: Schema) -> Column:
    """The names of the fields without a value, in the order of the schema."""
    return F.array_compact(F.array(*[F.when(F.col(column(f.name))["value"].isNull(), f.name) for f in schema.fields]))
