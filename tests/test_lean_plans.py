"""What is asked of the bills is made without lambdas, without what nobody reads, and by patterns that leave most places after one look."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from provenia.functions.patterns import java
from provenia.operators.segmentation import instances, segment_pages
from provenia.plans.compiler import extract, fields_of, prepared
from provenia.plans.schema import shipped
from provenia.sources.bills import italian

SCHEMA = shipped("bolletta_luce_it")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def pages(spark):
    text = "Fattura n. 1\nFornitore: A\nDal 01/01/2024 al 31/01/2024 (31 giorni)\nTotale da pagare: € 1.234,50\nEnergia F1: 1,00 kWh\nEnergia F2: 2,00 kWh\nEnergia F3: 3,00 kWh\nEnergia totale: 60,00 kWh"
    return spark.createDataFrame([("f.pdf", 1, text, 595.0, 842.0)], "file string, page_no int, text string, width double, height double")


def test_verdicts_and_counts_without_lambdas(pages):
    results = extract(pages, SCHEMA)
    own = plan(instances(prepared(pages), SCHEMA.segmentation)).count("lambdafunction")  # an instance's pages are put together by some
    assert plan(results.select("outcome", "reason", *[f"c_{f.name}" for f in SCHEMA.fields])).count("lambdafunction") <= own
    r = results.select("outcome", "reason", "c_kwh_totale", "c_periodo_da").first()
    assert tuple(r) == ("reject", "campi obbligatori mancanti: pod", "bassa", "alta")


def test_only_the_parts_asked_for(pages):
    rows = fields_of(extract(pages, SCHEMA), SCHEMA, ("status",))
    assert "failed" not in rows.columns and "confidence" not in rows.columns
    assert "esito" not in plan(rows)
    assert {r["field"]: r["status"] for r in rows.collect()}["pod"] == "tier1_non_tentato"


@pytest.mark.parametrize("pattern", [r"(?:ab|cd)(\d)", r"(?:\bab|c)(\d)", r"(?:(?i:ab)|cd)\s*(\d)", r"ax(\d)|bx\d", r"(?i)(?:ka|sb)(\d)"])
def test_alternatives_begin_with_a_class(spark, pattern):
    assert java(pattern).startswith("[")
    texts = ["ab1 cd2 ab3", "xab1 c2", "AB1 aB 2 cd\t3", "ax1 bx2", "Ka1 ſB2 kA3", "", "a b c d"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_extract_all("t", F.lit(java(pattern)), F.lit(1)).alias("g"))
    assert [r["g"] for r in got.collect()] == [[m.group(1) or "" for m in re.finditer(pattern, t)] for t in texts]


def test_italian_as_before(spark):
    values = [Decimal(x) for x in ("0", "0.5", "999.99", "1000", "1234.5", "999999.99", "1000000", "1234567.89", "-0.01", "-1234.5", "-1234567", "9999999999999999.99")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x decimal(18,2)")
    rows = df.select(italian(F.col("x")).alias("got"), F.translate(F.format_number("x", 2), ",.", ".,").alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_windows_of_segmentation(spark, pages):
    out = segment_pages(pages.withColumn("page_type", F.lit("digitale")), SCHEMA.segmentation)
    assert len(re.findall(r"\bWindow \[", plan(out))) <= 3
