"""The verdict from values and judgements, and that it asks for no evidence."""

from pyspark.sql import functions as F

from provenia.operators.evidence import gate, with_evidence
from provenia.operators.invariants import LINEAGE, with_judgements
from provenia.plans.schema import Field, Invariant, Schema

LETTER = {"pattern": "[a-z]"}
SCHEMA = Schema(1, "two", (Field("a", "string", True), Field("b", "string")), tuple(Invariant(i, "formato", how, {"campo": c, **LETTER}) for i, c, how in (("b1", "b", "reject"), ("a1", "a", "warning"), ("a2", "a", "reject"))))


def judged(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, a string, b string")
    none = F.lit(None).cast("string")
    value = lambda c: F.struct(F.col(c).alias("value"), F.col(c).alias("raw"), none.alias("outcome"), F.when(F.col(c).isNotNull(), "tier0").alias("origin"))
    df = df.select("n", *[value(c).alias(f"f_{c}") for c in "ab"], *[F.array().cast(LINEAGE).alias(f"d_{c}") for c in "ab"])
    return gate(with_evidence(with_judgements(df, SCHEMA), SCHEMA), SCHEMA)


def test_gate(spark):
    """Missing before invalid; of rejecting failures the first by field; an absent optional field isn't judged."""
    rows = judged(spark, ("x", "y"), (None, "9"), ("9", "8"), ("x", "8"), ("x", None)).orderBy("n").collect()
    assert [r.outcome for r in rows] == ["pass", "reject", "reject", "reject", "pass"]
    assert rows[0].reason is None and "a" in rows[1].reason and "a = '9'" in rows[2].reason and "b = '8'" in rows[3].reason
    assert [(r.c_a, r.c_b) for r in rows] == [("alta", "alta"), (None, "bassa"), ("bassa", "bassa"), ("alta", "bassa"), ("alta", None)]
    bad = rows[2].e_a.invariants
    assert (bad.passed, bad.failed, [d.id for d in bad.dettaglio]) == (0, 2, ["a1", "a2"]) and rows[1].e_a.status == "tier1_non_tentato"


def test_verdict_makes_no_evidence(spark):
    plan = judged(spark, ("x", "y")).select("n", "outcome", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert "dettaglio" not in plan and "repair" not in plan
