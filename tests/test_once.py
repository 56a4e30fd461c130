"""What is costly is done once: expressions aren't copied into their uses, and pages move once."""

import re

import pytest
from pyspark.sql import functions as F

from provenia.functions.patterns import java
from provenia.functions.repair import repair
from provenia.plans.schema import shipped
from provenia.queries import BILL, QUERIES, instances, prepared
from provenia.sources.bills import bill_pages

SMALL = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_of_bills_move_once(spark):
    plan = physical(instances(prepared(bill_pages(spark, SMALL)), shipped(BILL).segmentation))
    assert "hashpartitioning(o_custkey" not in plan and plan.count("hashpartitioning(file") == 1


def test_public_json_is_read_once(spark):
    plan = physical(QUERIES["result_json_fields"](spark, SMALL))
    assert "get_json_object" not in plan and plan.count("json_tuple(") == 1


@pytest.mark.parametrize("pattern", [r"\bal\s+(\d)", r"(?:\b_x|b)\b", r"(?i)\bal (\d)", r"\b\bal (\d)", r"(?a)\bal (\d)", r"\b-a", r"a\b"])
def test_boundary_before_a_word_character(spark, pattern):
    texts = ["al 1", "dal 1", "-al 1", "éal 1", "AL 1 al 2", "_al 1", "b_x _x b", "x-a -a", "", "a", "٣al 1", "\nal\n3"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.regexp_extract_all("t", F.lit(java(pattern)), F.lit(0))).collect()]
    assert got == [[m.group(0) for m in re.finditer(pattern, t)] for t in texts]


def test_boundary_looks_back_only_where_the_word_begins():
    assert java(r"\bal").startswith("(?=a)(?<!") and java(r"\bal").count("(?<") == 1


def test_repair_of_decimals_that_need_none_and_others(spark):
    cases = {"0": "0", "-0": "-0", "12": "12", "1.5": "1.5", "-0.50": "-0.50", "007": "7", "+3": "3", "3.": "3", ".5": "0.5", "-.5": "-0.5", "1.234,5": "1234.5", "1,": "1", "1,2,3": None, "1.234": None, "0.123": None, "1,234": "1.234", "1.2.3": "123", "a,1": None, ",": None, "": None, "-": None, "00,10": "0.10"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", repair(F.col("t"), "decimal")).collect()
    assert dict(map(tuple, rows)) == cases
