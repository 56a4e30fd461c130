"""The wide form of results and the evaluation: code that the JVM compiles, as in test_compiled, and results as before."""

import pytest
from pyspark.sql import functions as F

from provenia.operators.evaluation import compared_cells, same_by_kind
from provenia.operators.extraction import from_raw, tier0
from provenia.operators.invariants import apart
from provenia.plans.schema import Field, Invariant, Schema, parse
from provenia.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["result_json", "eval_diagnosis", "eval_field_accuracy", "eval_document_accuracy", "eval_verdicts", "gate_verdicts", "derive_values"])
def test_wide_methods_are_compiled(spark, query):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[query](spark, SMALL)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) < 8000


def test_empty_captures_by_pattern(spark):
    rules = r"{schema_version: 1, documento: x, campi: [{nome: a, tipo: string, estrazione: {tipo: regex, pattern: 'A(\d*);'}}, {nome: b, tipo: integer, estrazione: {tipo: regex, pattern: 'B(?:(\d+)|-)'}}, {nome: c, tipo: date}]}"
    texts = spark.createDataFrame([(0, "A; B-"), (1, "A7; B8 B8"), (2, "A7;A8; B1 B2"), (3, ""), (4, None)], "k int, text string")
    got = {r["k"]: [tuple(r[f"f_{n}"]) for n in "abc"] for r in tier0(texts, parse(rules)).collect()}
    none, no = (None, None, "non_estratto", None), "non_normalizzabile"
    assert got == {0: [(None, "", no, None), none, none], 1: [("7", "7", "normalizzato", "tier0"), ("8", "8", "normalizzato", "tier0"), none], 2: [none] * 3, 3: [none] * 3, 4: [none] * 3}


def test_no_field_has_a_rule(spark):
    schema = Schema(1, "x", (Field("a", "string"),))
    row = tier0(spark.createDataFrame([("t",)], "text string"), schema).first()
    assert tuple(row["f_a"]) == (None, None, "non_estratto", None)
    assert from_raw(spark.createDataFrame([(" x  y ",)], "text string"), schema, {"a": F.col("text")}).first()["f_a"]["value"] == "x y"


def test_runs_share_no_field():
    of = lambda n, *names: Invariant(n, "somma_approssimata", "warning", {"addendi": list(names[:-1]), "totale": names[-1], "tolleranza_relativa": 0})
    every = [of("1", "a", "b", "t"), of("2", "c", "d"), of("3", "t", "u"), of("4", "e", "f"), of("5", "u", "e")]
    assert [[i.id for i in run] for run in apart(every)] == [["1", "2"], ["3", "4"], ["5"]]


def test_cells_as_by_kind(spark):
    cases = [("string", " X ", "x"), ("string", None, None), ("date", "2024-02-29", "2024-02-29"), ("date", "x", "2024-01-01"), ("integer", "07", "7"), ("decimal", "1.50", "1.5"), ("decimal", None, "1"), ("decimal", "1", None)]
    one = "struct<value:string,outcome:string>"
    for misaligned in (False, True):
        df = spark.createDataFrame([("D", misaligned, *[(v, "o") for _, v, _ in cases], *[t for _, _, t in cases])], ", ".join(["doc_key string", "misaligned boolean", *[f"f_{i} {one}" for i in range(8)], *[f"t{i} string" for i in range(8)]]))
        got = [r["correct"] for r in compared_cells(df, {str(i): (k, F.col(f"t{i}")) for i, (k, _, _) in enumerate(cases)}).orderBy("field").collect()]
        flat = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, kind string, value string, expected string").orderBy("i")
        want = [r["c"] for r in flat.select((~F.lit(misaligned) & same_by_kind(F.col("value"), F.col("expected"), F.col("kind"))).alias("c")).collect()]
        assert got == want
