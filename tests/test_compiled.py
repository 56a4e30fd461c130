"""Code that the JVM compiles: it leaves methods of 8,000 bytes and more to its interpreter."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from provenia.functions.repair import repair
from provenia.operators.extraction import found_rows, long_form, raw_by, tier0
from provenia.operators.segmentation import instances
from provenia.plans.compiler import prepared
from provenia.plans.schema import parse, shipped
from provenia.queries import BILL, LABELS, QUERIES
from provenia.sources.bills import bill_pages, cents

SMALL = "/root/testdata/sf0.001"
KEYS = ["file", "instance_id", "segment"]


@pytest.mark.parametrize("query", ["extract_fields", "extract_diagnosis_counts", "extract_by_label", "extract_found_by"])
def test_methods_are_compiled(spark, query):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan has no code before it runs
    try:
        plan = QUERIES[query](spark, SMALL)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) < 8000


def test_rows_as_from_wide_form(spark):
    schema = shipped(BILL)
    found = instances(prepared(bill_pages(spark, SMALL)), schema.segmentation)
    want, got = long_form(tier0(found, schema), schema, KEYS), found_rows(found, schema, KEYS)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_by_python(spark):
    texts = spark.createDataFrame([("a", "POD: X\nEnergia F1: 1.234,50 kWh"), ("b", None), ("c", "POD: X\nPOD: Y")], "file string, text string")
    rows = found_rows(texts, parse(LABELS), ["file"], raw_by("provenia.queries:labelled_values")).filter("raw is not null").collect()
    assert sorted((r["file"], r["field"], r["raw"], r["value"]) for r in rows) == [("a", "kwh_f1", "1.234,50", "1234.50"), ("a", "pod", "X", "X")]


def test_numbers_by_few_patterns(spark):
    decimals = {"5": "5", "+5.": "5", ".5": "0.5", "-.5": "-0.5", "+.5": "0.5", "007": "7", "-007.10": "-7.10", "0": "0", "00": "0", "-0": "-0", "0.50": "0.50", "1.234": None, "-1.234": None, "1.234.567": "1234567", "1.234,50": "1234.50", "1,5": "1.5", ",5": "0.5", "1,2,3": None, "+-5": None, ".5.": "5", ".": None, "-": None, "": None, "1 2": None, " 7,0 ": "7.0", "1.23": "1.23"}
    integers = {"0": "0", "-0": "0", "-000": "0", "-007": "-7", "007": "7", "1.234": "1234", "+1": None, "-": None, "": None, " 12 ": "12", "100": "100", "-10": "-10"}
    for kind, cases in (("decimal", decimals), ("integer", integers)):
        df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", repair(F.col("t"), kind).alias("v"))
        assert {r["t"]: r["v"] for r in df.collect()} == cases


def test_cents_as_decimals(spark):
    values = [0.0, 1.0, -3.0, 50.0, 0.005, 0.015, 1.005, -1.005, 2.675, 1e15, 123456789.12, 9.99e14, None]
    got = [r["c"] for r in spark.createDataFrame([(v,) for v in values], "x double").select(cents(F.col("x")).alias("c")).collect()]
    assert got == [None if v is None else int(Decimal(repr(v)).quantize(Decimal("0.01"), ROUND_HALF_UP) * 100) for v in values]
