"""Evidence of each field, the confidence that follows from it, and the verdict that follows from all fields."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.functions.dialect import walled
from provenia.operators.extraction import DERIVED, TIER0, TIER1, column
from provenia.plans.schema import Field, Schema

NOT_TRIED, FAILED, NOT_FOUND = "tier1_non_tentato", "tier1_fallito", "non_trovato"
HIGH, MEDIUM, LOW = "alta", "media", "bassa"
PASS, WARNING, REJECT = "pass", "warning", "reject"
REPAIR_TYPE = "array<struct<tipo:string,da:string,a:string>>"
DETAIL = "array<struct<id:string,esito:string,severita:string,messaggio:string>>"


def own(f: Field, schema: Schema) -> list[int]:
    """The places in `judged` of the invariants that refer to the field. Which these are is known when the plan is made."""
    return [k for k, i in enumerate(schema.invariants) if f.name in i.fields()]


def count(f: Field, schema: Schema, failed: bool) -> str:
    """SQL: how many of the field's own invariants were evaluated and failed, or passed."""
    said = [f"if(get(judged, {k}).evaluated and get(judged, {k}).message is {'not ' if failed else ''}null, 1, 0)" for k in own(f, schema)]
    return f"({' + '.join(said)})" if said else "0"


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def detail(f: Field, schema: Schema) -> Column:
    """The field's own invariants that were evaluated: array of struct(id, esito, severita, messaggio). Joined from arrays of one, as lambdas aren't compiled."""
    struct = lambda j: f"named_struct('id', {j}.id, 'esito', if({j}.message is null, 'pass', 'fail'), 'severita', {j}.severity, 'messaggio', {j}.message)"
    said = [f"if(get(judged, {k}).evaluated, cast(array({struct(f'get(judged, {k})')}) as {DETAIL}), cast(array() as {DETAIL}))" for k in own(f, schema)]
    return F.expr(f"concat({', '.join(said)})" if said else f"cast(array() as {DETAIL})")


def evidence(f: Field, schema: Schema, tier1: bool) -> Column:
    """struct(origin, status, repair, derivation, invariants(passed, failed, dettaglio)) of df with fields, derivations, _error and the field's detail as _j_<field>."""
    x, d, j = (quoted(n) for n in (column(f.name), f"d_{f.name}", f"_j_{f.name}"))
    status = f"case when {x}.value is null then " + (f"if(_error is null, '{NOT_FOUND}', '{FAILED}') end" if tier1 else f"'{NOT_TRIED}' end")
    step = f"array(named_struct('tipo', 'ripara', 'da', {x}.raw, 'a', {x}.value))"
    repair = f"if({x}.origin = '{TIER0}' and {x}.raw != {x}.value, cast({step} as {REPAIR_TYPE}), cast(array() as {REPAIR_TYPE}))"
    invariants = f"named_struct('passed', {count(f, schema, False)}, 'failed', {count(f, schema, True)}, 'dettaglio', {j})"
    return F.expr(f"named_struct('origin', {x}.origin, 'status', {status}, 'repair', {repair}, 'derivation', {d}, 'invariants', {invariants})")


def confidence(value: Column, origin: Column, failed: Column) -> Column:
    return F.when(value.isNull(), None).when(failed > 0, LOW).when(origin.isin(TIER1, DERIVED), MEDIUM).otherwise(HIGH)


def with_evidence(df: DataFrame, schema: Schema, tier1: bool = False, error: Column | None = None) -> DataFrame:
    """df with e_<field> and c_<field> (confidence). Only the details stand behind a fence, so a reader of one part of the evidence has only that part made."""
    error = F.lit(None).cast("string") if error is None else error
    out = df.withColumns(walled({f"_j_{f.name}": detail(f, schema) for f in schema.fields}) | {"_error": error})
    made = {f"e_{f.name}": evidence(f, schema, tier1) for f in schema.fields}
    sure = {f"c_{f.name}": confidence(F.col(column(f.name))["value"], F.col(column(f.name))["origin"], F.expr(count(f, schema, True))) for f in schema.fields}
    return out.withColumns(made | sure).drop("_error", *[f"_j_{f.name}" for f in schema.fields])


def gate(df: DataFrame, schema: Schema) -> DataFrame:
    """df with outcome and reason, from values and what the invariants say; evidence isn't needed for them.

    A missing mandatory field rejects, and the reason names all that are missing; else the first failed invariant of severity reject, by field, then in
    the field's order; else any failure warns.
    """
    mandatory = [f for f in schema.fields if f.mandatory]
    lost = lambda f: F.col(column(f.name))["value"].isNull()
    gone = F.concat_ws(", ", *[F.when(lost(f), f.name) for f in mandatory])  # leaves out nulls
    any_gone = reduce(or_, map(lost, mandatory), F.lit(False))
    grave = dict.fromkeys(k for f in schema.fields for k, i in enumerate(schema.invariants) if i.severity == REJECT and f.name in i.fields())
    message = lambda k: F.get("judged", F.lit(k))["message"]
    out = df.withColumn("_fatal", F.coalesce(*map(message, grave)) if grave else F.lit(None).cast("string"))
    failed = reduce(or_, [message(k).isNotNull() for k in range(len(schema.invariants))], F.lit(False))
    out = out.withColumn("outcome", F.when(any_gone | F.col("_fatal").isNotNull(), REJECT).when(failed, WARNING).otherwise(PASS))
    reason = F.when(any_gone, F.concat(F.lit("campi obbligatori mancanti: "), gone)).otherwise(F.concat(F.lit("invariante violata: "), F.col("_fatal")))
    return out.withColumn("reason", reason).drop("_fatal")
