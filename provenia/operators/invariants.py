"""Declared invariants: each is judged or not, holds or not; and what arithmetic alone can derive from them."""

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.functions.dialect import fence, walled
from provenia.functions.patterns import java_full
from provenia.functions.repair import as_date, as_decimal, as_integer, decimal_text, scale_of
from provenia.operators.extraction import DERIVED, column
from provenia.plans.schema import Invariant, Schema

#: The text of a field, or with a reader what it reads as: v("x"), v("x", as_decimal).
Values = Callable[..., Column]


def needs(i: Invariant) -> list[tuple[str, Callable[[Column], Column]]]:
    """The fields of an invariant that it reads as something else than text."""
    p = i.params
    if i.kind == "differenza_giorni":
        return [(p["da"], as_date), (p["a"], as_date), (p["risultato"], as_integer)]
    read = {"somma_approssimata": as_decimal, "valore_minimo": as_decimal, "ordine_date": as_date}.get(i.kind)
    return [(n, read) for n in i.fields()] if read else []


def with_readings(df: DataFrame, invariants: list[Invariant], text: Callable[[str], Column]) -> tuple[DataFrame, Values, list[str]]:
    """df with each reading that the invariants need as a column, once; how to get at them; and their names."""
    wanted = dict.fromkeys(x for i in invariants for x in needs(i))
    name = {x: f"_{x[1].__name__}_{x[0]}" for x in wanted}
    out = df.withColumns(walled({name[n, read]: read(text(n)) for n, read in wanted})) if wanted else df
    return out, lambda n, read=None: text(n) if read is None else F.col(name[n, read]), list(name.values())


def exact(x: float | int) -> Column:
    return F.lit(Decimal(str(x))).cast("decimal(38,10)")


def _said(x: Column) -> Column:
    """A decimal without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")


def _sum(names: list[str], v: Values) -> Column:
    out = v(names[0], as_decimal)
    for n in names[1:]:
        out = (out + v(n, as_decimal)).cast("decimal(38,10)")
    return out


def _days(i: Invariant, v: Values) -> Column:
    return F.datediff(v(i.params["a"], as_date), v(i.params["da"], as_date)).cast("bigint") + i.params["offset"]


def _approx_sum(i: Invariant, v: Values) -> Column:
    p = i.params
    names, rate = list(p["addendi"]), Decimal(str(p["tolleranza_relativa"]))
    total, added = v(p["totale"], as_decimal), _sum(names, v)
    allowed = F.abs(total).cast("decimal(28,10)") * F.lit(rate).cast("decimal(9,8)")
    broken = F.abs(added - total).cast("decimal(28,10)") > allowed
    return F.when(broken, F.concat(F.lit(f"somma di {', '.join(names)} = "), _said(added), F.lit(f", atteso {p['totale']} = "), v(p["totale"]), F.lit(f" (tolleranza relativa {rate})")))


def _day_difference(i: Invariant, v: Values) -> Column:
    p, n = i.params, v(i.params["risultato"], as_integer)
    return F.when(_days(i, v) != n, F.concat(F.lit(f"{p['a']} - {p['da']} + {p['offset']} = "), _days(i, v).cast("string"), F.lit(f", {p['risultato']} dichiarato = "), n.cast("string")))


def _least_value(i: Invariant, v: Values) -> Column:
    p = i.params
    return F.when(v(p["campo"], as_decimal) < exact(p["minimo"]), F.concat(F.lit(f"{p['campo']} = "), v(p["campo"]), F.lit(f", atteso >= {Decimal(str(p['minimo']))}")))


def _date_order(i: Invariant, v: Values) -> Column:
    a, b = i.params["precedente"], i.params["successiva"]
    return F.when(v(b, as_date) < v(a, as_date), F.concat(F.lit(f"{b} = "), v(b), F.lit(f" precede {a} = "), v(a)))


def _format(i: Invariant, v: Values) -> Column:
    p = i.params
    return F.when(~F.regexp_like(v(p["campo"]), F.lit(java_full(p["pattern"]))), F.concat(F.lit(f"{p['campo']} = '"), v(p["campo"]), F.lit(f"' non rispetta il formato '{p['pattern']}'")))


#: For each kind the message of a violation, NULL where it holds or an operand is missing or not of its type.
MESSAGES: dict[str, Callable[[Invariant, Values], Column]] = {"somma_approssimata": _approx_sum, "differenza_giorni": _day_difference, "valore_minimo": _least_value, "ordine_date": _date_order, "formato": _format}


def _readable(i: Invariant, v: Values) -> Column:
    """Whether every operand is of the type that the invariant needs."""
    out = F.lit(True)
    for n, read in needs(i):
        out = out & v(n, read).isNotNull()
    return out


def judged(i: Invariant, v: Values, strict: bool = False) -> Column:
    """struct(id, severity, evaluated, message). Evaluated means that each operand is present; strict asks that it is readable too."""
    present = F.lit(True)
    for n in i.fields():
        present = present & v(n).isNotNull()
    if strict:
        present = present & _readable(i, v)
    return F.struct(F.lit(i.id).alias("id"), F.lit(i.severity).alias("severity"), present.alias("evaluated"), F.when(present, MESSAGES[i.kind](i, v)).alias("message"))


JUDGED = "array<struct<id:string,severity:string,evaluated:boolean,message:string,fields:array<string>>>"


def with_judgements(df: DataFrame, schema: Schema, value: Callable[[str], Column] | None = None, strict: bool = False) -> DataFrame:
    """df with `judged`: what each invariant of the schema says, in its order, with the fields it refers to."""
    df, v, made = with_readings(df, list(schema.invariants), value or (lambda n: F.col(column(n))["value"]))
    every = []
    for i in schema.invariants:
        x = judged(i, v, strict)
        every.append(F.struct(*[x[c].alias(c) for c in ("id", "severity", "evaluated", "message")], F.array(*map(F.lit, i.fields())).alias("fields")))
    return df.withColumns(walled({"judged": F.array(*every) if every else F.array().cast(JUDGED)})).drop(*made)


def violations() -> Column:
    """Of df with_judgements: the violated invariants in the order of the schema."""
    return F.transform(F.filter("judged", lambda x: x["message"].isNotNull()), lambda x: F.struct(x["id"].alias("id"), x["severity"].alias("severity"), x["message"].alias("message")))


def derived_value(i: Invariant, target: str, v: Values) -> Column | None:
    """What the invariant gives for target if only that one is missing; NULL if anything it needs is missing or unreadable; None if it derives nothing for it."""
    p = i.params
    if i.kind == "differenza_giorni":
        start, end, n = v(p["da"], as_date), v(p["a"], as_date), v(p["risultato"], as_integer)
        span = (n - p["offset"]).try_cast("int")
        fits = F.abs(span) <= 3_000_000
        return {p["da"]: F.when(fits, F.date_sub(end, span)).cast("string"), p["a"]: F.when(fits, F.date_add(start, span)).cast("string"), p["risultato"]: _days(i, v).cast("string")}.get(target)
    if i.kind == "somma_approssimata" and target == p["totale"]:
        names = list(p["addendi"])
        return decimal_text(_sum(names, v), F.greatest(*[scale_of(v(n)) for n in names], F.lit(0)))
    return None


#: Kinds of invariants from which a value can follow.
DERIVING = ("differenza_giorni", "somma_approssimata")
LINEAGE = "array<struct<tipo:string,invariante_id:string,da_campi:array<string>>>"


def apart(invariants: list[Invariant]) -> list[list[Invariant]]:
    """The invariants in their order, cut into runs in which no two share a field: those of a run can't see each other's values."""
    out: list[list[Invariant]] = []
    for i in invariants:
        if out and not any(set(i.fields()) & set(j.fields()) for j in out[-1]):
            out[-1].append(i)
        else:
            out.append([i])
    return out


def derive(df: DataFrame, schema: Schema) -> DataFrame:
    """df with missing fields filled by one pass over the invariants in the order of the schema: later ones see what earlier ones gave, none is looked at twice.

    Adds to d_<field> how: struct(tipo, invariante_id, da_campi). A derived field has origin `derivato`; a given value is never changed.
    """
    text = lambda n: F.col(column(n))["value"]
    out = df
    for f in schema.fields:
        if f"d_{f.name}" not in out.columns:
            out = out.withColumn(f"d_{f.name}", F.array().cast(LINEAGE))
    for run in apart([i for i in schema.invariants if i.kind in DERIVING]):
        out, v, made = with_readings(out, run, text)
        found: dict[str, tuple[Invariant, Column]] = {}
        for i in run:
            for target in dict.fromkeys(i.fields()):
                value = derived_value(i, target, v)
                if value is not None:
                    ready = v(target).isNull()
                    for n in i.fields():
                        ready = ready if n == target else ready & v(n).isNotNull()
                    found[target] = i, F.when(ready, value)
        # Values are columns of their own and structs only name them: Catalyst copies what a struct is made of into each use of its fields.
        out = out.withColumns(walled({f"t_{n}": x for n, (_, x) in found.items()}))
        merged = {f"n_{n}": fence(F.coalesce(F.col(column(n))["value"], F.col(f"t_{n}"))) for n in found} | {f"o_{n}": F.when(F.col(f"t_{n}").isNotNull(), DERIVED).otherwise(F.col(column(n))["origin"]) for n in found}
        out = out.withColumns(merged)
        steps: dict[str, Column] = {}
        for n, (i, _) in found.items():
            old, new = F.col(column(n)), F.col(f"t_{n}")
            steps[column(n)] = F.struct(F.col(f"n_{n}").alias("value"), old["raw"].alias("raw"), old["outcome"].alias("outcome"), F.col(f"o_{n}").alias("origin"))
            how = F.array(F.struct(F.lit(i.kind).alias("tipo"), F.lit(i.id).alias("invariante_id"), F.array(*[F.lit(x) for x in i.fields() if x != n]).alias("da_campi"))).cast(LINEAGE)
            steps[f"d_{n}"] = F.when(new.isNotNull(), how).otherwise(F.col(f"d_{n}"))
        out = out.withColumns(steps).drop(*[f"{x}_{n}" for n in found for x in "tno"], *made)
    return out
