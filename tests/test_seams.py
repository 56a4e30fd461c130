"""Parts that a user calls and no query does: truth by file, violations alone, the deterministic model stage."""

from provenia.operators.evaluation import keys_to_files
from provenia.operators.invariants import violations, with_judgements
from provenia.operators.tier1 import fixture_stage
from provenia.plans.compiler import extract
from provenia.plans.schema import parse
from pyspark.sql import functions as F
from test_engine import SMALL, pages


def test_truth_goes_to_files(spark):
    truth = spark.createDataFrame([("a", "code", "1"), ("b", "code", "2"), ("b", "days", None), (None, "code", "3")], "doc_key string, field string, expected string")
    meta = spark.createDataFrame([("b", "other.pdf", 1), ("c", "c.pdf", 1), ("a", None, 1)], "doc_key string, file string, page_from int")
    got = sorted((r.doc_key or "", r.field, r.file) for r in keys_to_files(truth, meta).collect())
    assert got == [("", "code", None), ("a", "code", "a.pdf"), ("b", "code", "other.pdf"), ("b", "days", "other.pdf")]
    assert keys_to_files(truth.limit(0), meta).count() == 0


def test_violations_alone(spark):
    names = "code since until days a b total".split()
    rows = [(0, "X1", "2025-01-02", "2025-01-01", "9", "-1", "1", "5"), (1, "X1", "2025-01-01", "2025-01-02", "2", "1", "1", "2"), (2, *[None] * 7)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
    got = {r.i: r.v for r in with_judgements(df, parse(SMALL), value=F.col).select("i", violations().alias("v")).collect()}
    assert [(v.id, v.severity) for v in got[0]] == [("sum", "reject"), ("span", "warning"), ("order", "warning"), ("least", "warning")] and all(v.message for v in got[0])
    assert got[1] == [] and got[2] == []


def test_deterministic_model_stage(spark):
    schema = parse(SMALL)
    known, unknown = "Code X1", "Code X2"
    page = lambda x: spark.createDataFrame([(x,)], "t string").select(pages_key(F.array(F.encode("t", "UTF-8")))).first()[0]
    from provenia.functions.keys import pages_key

    fixture = spark.createDataFrame([(page(known), {"code": "Z", "a": "1.5", "b": None})], "key string, values map<string,string>")
    rows = pages(spark, ("f.pdf", 1, known, []), ("g.pdf", 1, unknown, []))
    stage = fixture_stage(fixture, 400)
    got = {r.file: r for r in extract(rows, schema, tier1=stage).collect()}
    f, g = got["f.pdf"], got["g.pdf"]
    assert (f.f_code.value, f.f_a.value, f.f_a.origin, f.f_b.value, f.tier1_error) == ("X1", "1.5", "tier1", None, None)
    # a quarter of the text's and the prompt's length in, five tokens for each of two values out, at 1 and 5 dollars a million
    assert abs(f.cost - (len(known) // 4 + 100 + 10 * 5) / 1e6) < 1e-12
    assert (g.cost, g.tier1_error) == (0.0, "no reply for these pages")
    assert [r.cost for r in extract(rows, schema, tier1=stage).filter("file = 'f.pdf'").collect()] == [f.cost]
