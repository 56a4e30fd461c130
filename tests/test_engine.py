"""The extraction engine's rules, each on inputs whose answer is known by hand."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from provenia.functions.dialect import first_capture, unique_capture
from provenia.functions.keys import cache_key
from provenia.functions.repair import agree, repair, same_value
from provenia.functions.replies import reply_values, with_reply_values
from provenia.operators import cost, evaluation
from provenia.operators.arbitration import arbitrate
from provenia.operators.classify import classify, classify_files
from provenia.operators.invariants import with_judgements
from provenia.operators.segmentation import instances, letters, stem
from provenia.operators.tier1 import ProviderError, prompt, with_provider
from provenia.operators.triage import image_coverage, page_type, straightened, triage
from provenia.plans.compiler import contract, extract, extract_classified, fields_of
from provenia.plans.schema import Field, SchemaError, parse, shipped
from provenia.sources.cache import ReplyLog
from provenia.sources.sink import exit_code, manifest, save_results, saved_results
from provenia.sources.loaders import PriceError, TruthError, metadata, prices, truth

SMALL = """
schema_version: 1
documento: small
campi:
  - {nome: code, tipo: string, obbligatorio: true, estrazione: {tipo: regex, pattern: 'Code (\\w+)'}}
  - {nome: since, tipo: date, estrazione: {tipo: regex, pattern: 'from (\\S+)'}}
  - {nome: until, tipo: date, estrazione: {tipo: regex, pattern: 'to (\\S+)'}}
  - {nome: days, tipo: integer, estrazione: {tipo: regex, pattern: '(\\d+) days'}}
  - {nome: a, tipo: decimal, estrazione: {tipo: regex, pattern: 'a=(\\S+)'}}
  - {nome: b, tipo: decimal, estrazione: {tipo: regex, pattern: 'b=(\\S+)'}}
  - {nome: total, tipo: decimal, estrazione: {tipo: regex, pattern: 'total=(\\S+)'}}
invarianti:
  - {id: sum, tipo: somma_approssimata, addendi: [a, b], totale: total, tolleranza_relativa: 0.01, severita: reject}
  - {id: span, tipo: differenza_giorni, da: since, a: until, risultato: days, offset: 1, severita: warning}
  - {id: order, tipo: ordine_date, precedente: since, successiva: until, severita: warning}
  - {id: least, tipo: valore_minimo, campo: a, minimo: 0, severita: warning}
  - {id: form, tipo: formato, campo: code, pattern: 'X\\d+', severita: warning}
segmentazione: {tipo: cambio_valore, pattern: 'Code (\\w+)', minimo_pagine: 1}
"""
PAGE = "file string, page_no int, text string, width double, height double, images array<struct<x0:double,top:double,x1:double,bottom:double>>"
WHOLE = [(0.0, 0.0, 100.0, 100.0)]


def each(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def pages(spark, *rows):
    return spark.createDataFrame([(f, n, t, 100.0, 100.0, scan) for f, n, t, scan in rows], PAGE)


# --- repair and comparison


@pytest.mark.parametrize(
    "kind, cases",
    [
        ("decimal", {"1.234,56": "1234.56", "25.56": "25.56", "1.234": None, "1.234.567": "1234567", "12": "12", "": None, "abc": None, "1,2,3": None, "-0,5": "-0.5", " 7,00 ": "7.00", "NaN": None, "1e5": None, "0,00": "0.00"}),
        ("date", {"01/02/2025": "2025-02-01", "01-02.2025": "2025-02-01", "31/02/2025": None, "1/2/2025": None, "29/02/2024": "2024-02-29", "29.02.2023": None, "00/01/2025": None, "01/13/2025": None, "01/01/0000": None, "01/01/0001": "0001-01-01", "2025-01-05": None}),
        ("integer", {"1.234": "1234", "-5": "-5", "30 giorni": None, "²": None, "007": "7", "30.0": "300"}),
        ("string", {"  a \t b\n": "a b", "   ": None, " x y": "x y"}),
    ],
)
def test_repair(spark, kind, cases):
    assert dict(zip(cases, each(spark, list(cases), lambda v: repair(v, kind)), strict=True)) == cases
    assert each(spark, [None], lambda v: repair(v, kind)) == [None]


def test_two_kinds_of_equality(spark):
    df = spark.createDataFrame([("ABC ", "abc"), ("a  b", "a b"), (None, None), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(same_value(F.col("a"), F.col("b"), "string")).collect()] == [True, False, True, False]
    numbers = spark.createDataFrame([("1.50", "1.5"), ("x", "1")], "a string, b string")
    assert [r[0] for r in numbers.select(same_value(F.col("a"), F.col("b"), "decimal")).collect()] == [True, False]
    assert [r[0] for r in numbers.select(agree(F.col("a"), F.col("b"), "decimal")).collect()] == [True, False]
    with pytest.raises(Exception, match="truth is no decimal"):
        spark.createDataFrame([("1", "x")], "a string, b string").select(same_value(F.col("a"), F.col("b"), "decimal")).collect()


def test_captures(spark):
    text = ["n 1 n 1", "n 1 n 2", "none", None, "n 7"]
    assert each(spark, text, lambda v: unique_capture(v, r"n\s(\d)")) == ["1", None, None, None, "7"]
    assert each(spark, text, lambda v: first_capture(v, r"n\s(\d)")) == ["1", "1", None, None, "7"]


# --- pages and instances


def test_coverage_and_type(spark):
    box = lambda *b: F.array(F.struct(*[F.lit(x).alias(n) for x, n in zip(b, ("x0", "top", "x1", "bottom"), strict=True)]))
    said = spark.range(1).select(image_coverage(box(0.0, 0.0, 50.0, 50.0), F.lit(100.0), F.lit(100.0)), image_coverage(box(0.0, 0.0, 50.0, 50.0), F.lit(0.0), F.lit(100.0)))
    assert tuple(said.first()) == (0.25, 0.0)
    assert each(spark, [0.1, 0.15, 0.5, 0.85, 0.9], page_type, "double") == ["digitale", "ibrida", "ibrida", "ibrida", "scansione"]


def test_upside_down_page(spark):
    df = spark.createDataFrame([([("c", 30.0), ("d", 31.0), ("a", 10.0), ("b", 10.5)],), ([],)], "chars array<struct<text:string,top:double>>")
    assert [r[0] for r in df.select(straightened(F.col("chars"))).collect()] == ["ab\ncd", ""]


def test_segments(spark):
    config = parse(SMALL).segmentation
    rows = pages(
        spark,
        *[("f/three.pdf", i + 1, t, []) for i, t in enumerate(["cover", "Code A", "more", "Code B", "Code A"])],
        ("none.pdf", 1, "x", []), ("none.pdf", 2, "y", []),
        ("scan.pdf", 1, "Code A", []), ("scan.pdf", 2, "Code B", WHOLE),
        ("one.pdf", 1, "Code A Code B", []),
    )
    got = {(r.file, r.instance_id, r.page_from, r.page_to, r.seg_confidence, r.text) for r in instances(triage(rows), config).collect()}
    assert got == {
        ("f/three.pdf", "threea", 1, 3, "certa", "cover\nCode A\nmore"), ("f/three.pdf", "threeb", 4, 4, "certa", "Code B"), ("f/three.pdf", "threec", 5, 5, "certa", "Code A"),
        ("none.pdf", "none", 1, 2, "presunta", "x\ny"), ("scan.pdf", "scan", 1, 2, "non_determinabile", "Code A"), ("one.pdf", "one", 1, 1, "certa", "Code A Code B"),
    }
    assert {r.seg_confidence for r in instances(triage(rows), None).collect()} == {"certa"}


def test_names(spark):
    assert each(spark, [0, 25, 26, 701, 702], letters, "long") == ["a", "z", "aa", "zz", "aaa"]
    assert each(spark, ["a/b.c.pdf", "x", ".hidden"], stem) == ["b.c", "x", ".hidden"]


def test_classes(spark):
    text = ["Totale da pagare kWh", "totale da pagare SMC", "totale da pagare kWh smc", "CODICE OFFERTA", "x", None, "totale da pagare 3kWhx"]
    assert each(spark, text, classify) == ["bolletta_luce", "bolletta_gas", "sconosciuto", "cte", "sconosciuto", "sconosciuto", "sconosciuto"]
    rows = pages(spark, ("a", 1, "totale da", []), ("a", 2, "pagare kWh", []), ("b", 4, "totale da pagare smc", []))
    assert {(r.file, r["class"], r.schema, r.fell_back) for r in classify_files(rows).collect()} == {("a", "bolletta_luce", "bolletta_luce_it", False), ("b", "sconosciuto", "bolletta_luce_it", True)}


# --- invariants, derivation, evidence, verdict


def judgements(spark, rows, strict=False):
    names = "code since until days a b total".split()
    df = spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    out = with_judgements(df, parse(SMALL), value=F.col, strict=strict).orderBy("i").collect()
    return [{j.id: None if not j.evaluated else j.message is None for j in r.judged} for r in out]


def test_invariants(spark):
    sums = judgements(spark, [{"a": "50", "b": "51", "total": "100"}, {"a": "50", "b": "51.01", "total": "100"}, {"a": "0", "b": "0.00", "total": "0"}, {"a": "0", "b": "0.01", "total": "0"}, {"a": "1", "total": "1"}])
    assert [x["sum"] for x in sums] == [True, False, True, False, None]
    spans = judgements(spark, [{"since": "2025-01-01", "until": "2025-01-31", "days": "31"}, {"since": "2025-01-02", "until": "2025-01-01", "days": "31"}, {"since": "2025-01-01", "until": "2025-01-01"}])
    assert [(x["span"], x["order"]) for x in spans] == [(True, True), (False, False), (None, True)]
    assert [(x["least"], x["form"]) for x in judgements(spark, [{"a": "0", "code": "X1"}, {"a": "-0.01", "code": "X1\n"}, {}])] == [(True, True), (False, False), (None, None)]


def test_present_but_unreadable_passes_unless_strict(spark):
    row = [{"since": "soon", "until": "2025-01-01", "days": "1"}]
    assert judgements(spark, row)[0]["span"] is True and judgements(spark, row, strict=True)[0]["span"] is None


def by_field(results, schema):
    out: dict = {}
    for r in fields_of(results, schema).collect():
        out.setdefault(r.instance_id, {})[r.field] = r
    return out


def test_extraction_to_verdict(spark):
    schema = parse(SMALL)
    good = "Code X1 from 01/01/2025 to 31/01/2025 a=1,50 b=2,00"
    results = extract(pages(spark, ("good.pdf", 1, good, []), ("bad.pdf", 1, "Code Y from 02/01/2025 to 01/01/2025", []), ("odd.pdf", 1, "Code X2 a=1,00 b=2,00 total=9,00", []), ("none.pdf", 1, "x", WHOLE)), schema)
    got = by_field(results, schema)
    x = got["good"]
    assert (x["days"].value, x["days"].origin, x["days"].confidence) == ("31", "derivato", "media")
    assert x["days"].derivation[0].asDict() == {"tipo": "differenza_giorni", "invariante_id": "span", "da_campi": ["since", "until"]}
    assert (x["total"].value, x["total"].origin) == ("3.50", "derivato") and x["a"].confidence == "alta"
    assert {k: (v["code"].verdict, v["code"].reason) for k, v in got.items() if k != "odd"} == {"good": ("pass", None), "bad": ("warning", None), "none": ("reject", "campi obbligatori mancanti: code")}
    assert got["odd"]["code"].verdict == "reject" and got["odd"]["code"].reason.startswith("invariante violata: somma di a, b = 3") and got["odd"]["a"].confidence == "bassa"
    assert (got["none"]["code"].status, got["none"]["code"].outcome) == ("tier1_non_tentato", "non_estratto")
    counts = {r["outcome"]: r["count"] for r in results.groupBy("outcome").count().collect()}
    assert exit_code({"verdicts": counts}) == 1 and exit_code({"verdicts": counts | {"reject": 0}}) == 0
    told = {r.instance_id: json.loads(r.result) for r in contract(results, schema).collect()}
    assert told["good"]["documento"]["classificazione"] is None and told["good"]["motivo"] is None and told["good"]["campi"]["code"]["evidence"]["repair"] == []
    assert told["good"]["campi"]["a"]["evidence"]["repair"] == [{"tipo": "ripara", "da": "1,50", "a": "1.50"}]


def test_addends_are_never_derived(spark):
    schema = parse(SMALL)
    x = by_field(extract(pages(spark, ("f.pdf", 1, "Code X1 a=1,00 total=3,00", [])), schema), schema)["f"]
    assert x["b"].value is None


def test_model_stage_fills_and_never_overwrites(spark):
    schema = parse(SMALL)

    def provider(_, text, asked):
        if "days" not in asked:
            raise ProviderError("down")
        return '```json\n{"code": "Z9", "since": "2025-01-01", "days": 10, "a": 1.5}\n```', 0.25

    rows = pages(spark, ("f.pdf", 1, "Code X1", []), ("g.pdf", 1, "Code X1 from 01/01/2025 to 31/01/2025 31 days", []))
    results = extract(rows, schema, tier1=with_provider(provider))
    x = by_field(results, schema)
    assert (x["f"]["code"].value, x["f"]["since"].value, x["f"]["since"].origin, x["f"]["a"].value) == ("X1", "2025-01-01", "tier1", "1.5")
    assert (x["f"]["until"].value, x["f"]["until"].origin) == ("2025-01-10", "derivato")  # derivation runs again after the model
    assert (x["f"]["total"].status, x["g"]["a"].status) == ("non_trovato", "tier1_fallito")
    assert {r.file: (r.cost, r.tier1_error) for r in results.collect()} == {"f.pdf": (0.25, None), "g.pdf": (0.0, "down")}
    assert "day, month and year" in prompt([Field("d", "date")]) and "day, month and year" not in prompt([Field("s", "string")])


def test_mixed_files_go_to_their_schemas(spark):
    rows = pages(spark, ("gas.pdf", 1, "Totale da pagare: 10,00 Smc", []), ("other.pdf", 1, "nothing", []))
    out = extract_classified(rows, {n: shipped(n) for n in ("bolletta_luce_it", "bolletta_gas_it", "cte_it")})
    assert {(r.file, r.schema) for r in out.select("file", "schema").distinct().collect()} == {("gas.pdf", "bolletta_gas_it"), ("other.pdf", "bolletta_luce_it")}


# --- replies, cache, cost, two sources, evaluation


def test_replies(spark):
    fields = [Field("t", "decimal"), Field("n", "integer"), Field("s", "string")]
    texts = ['{"t": "1.234,5", "n": 3, "s": " a  b "}', '```JSON\n{"t": 2.5, "n": 3.5, "s": 1}\n```', '[{"s": "x"}]', 'see {"s": "x"}', '{"n": true}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    got = [tuple(r)[1:] for r in df.select("i", *[v.alias(n) for n, v in reply_values(F.col("v"), fields).items()]).orderBy("i").collect()]
    assert [tuple(r)[2:] for r in with_reply_values(df, F.col("v"), fields).orderBy("i").collect()] == got
    assert got == [("1234.5", "3", "a b"), ("2.5", None, None), (None,) * 3, (None,) * 3, (None,) * 3, (None,) * 3]


def test_cache(spark, tmp_path):
    cache = ReplyLog(spark, f"{tmp_path}/replies", days=1)
    assert cache.read(0).count() == 0
    cache.write(spark.createDataFrame([("k", '{"a": 1}'), ("bad", "no json"), ("list", "[1]")], "key string, reply string"), now=0)
    cache.write(spark.createDataFrame([("k", '{"a": 2}')], "key string, reply string"), now=10)
    assert [tuple(r)[:2] for r in cache.read(20).collect()] == [("k", '{"a": 2}')] and cache.read(200_000).count() == 0
    assert [r.key for r in cache.missing(spark.createDataFrame([("k",), ("new",)], "key string"), 20).collect()] == ["new"]
    key = lambda *p: cache_key(F.array(*[F.lit(x.encode()) for x in p]), F.lit("p"), F.lit("m"), F.lit("1"))
    assert len(set(spark.range(1).select(key("AB", "C").alias("a"), key("A", "BC").alias("b")).first())) == 2


def test_costs(spark, tmp_path):
    tokens = lambda kind: cost.image_tokens(F.lit(kind), F.lit(1000), F.lit(600))
    assert tuple(spark.range(1).select(tokens("lineare_wh_750"), tokens("tile_512_openai"), tokens("tile_512_openai_stima_al_rialzo")).first()) == (800, 765, 3060)
    with pytest.raises(Exception, match="unknown image formula"):
        spark.range(1).select(tokens("other")).collect()
    free = spark.createDataFrame([(1.0, 1.0, None)], "input_price double, output_price double, cache_read_price double")
    with pytest.raises(Exception, match="no cache_read_price"):
        free.select(cost.call_cost(F.lit(1), F.lit(1), None, F.lit(5))).collect()
    calls = spark.createDataFrame([(i, 4.0) for i in range(6)], "i int, cost double")
    assert [r.skipped for r in cost.within_budget(calls, 7.0, ["i"]).orderBy("i").collect()] == [False, False, True, True, True, True]
    with pytest.raises(PriceError):
        prices(spark, "/nowhere.yaml")
    table = tmp_path / "prices.yaml"
    table.write_text("aggiornato_il: x\nmodelli:\n  one: {costo_input_per_milione: 1, costo_output_per_milione: 2.5, token_immagine: {tipo: lineare_wh_750, formula: f, fonte: s, verificato_il: d}}\n")
    assert [tuple(r) for r in prices(spark, str(table)).collect()] == [("one", 1.0, 2.5, None, None, "lineare_wh_750", "x")]
    with pytest.raises(Exception, match="no price for"):
        cost.with_prices(spark.createDataFrame([("none such",)], "model string"), prices(spark, str(table))).collect()
    none = prices(spark, str(table)).limit(0)
    assert cost.estimate(spark.createDataFrame([(1, 8, 1, [])], "key int, prompt_chars long, asked int, images array<struct<width:long,height:long>>"), none).count() == 0


def test_coverage_of_any_boxes(spark):
    """Against each cell's centre by itself: boxes on borders, turned round, beyond the page, without an end or a number."""
    r = random.Random(1)
    rows = []
    for i in range(80):
        w, h = r.choice([(595.0, 842.0), (64.0, 64.0), (1.0, 3.0), (0.0, 5.0)])
        side = lambda n: sorted(r.choice([r.uniform(-9, n + 9), (r.randrange(-3, 68) + 0.5) * n / 64, n]) for _ in range(2))
        boxes = [(x[0], y[0], x[1], y[1]) for x, y in ((side(w), side(h)) for _ in range(r.randrange(4)))]
        odd = [(5.0, 0.0, 1.0, 9.0), (None, 0.0, 9.0, 9.0), (0.0, 0.0, math.inf, h / 3), (math.nan, 0.0, 9.0, 9.0)]
        rows.append((i, w, h, boxes + r.sample(odd, i % 3) if i % 9 else None))
    df = spark.createDataFrame(rows, "i int, w double, h double, b array<struct<x0:double,top:double,x1:double,bottom:double>>")
    got = {x.i: x.c for x in df.select("i", image_coverage(F.col("b"), F.col("w"), F.col("h")).alias("c")).collect()}
    inside = lambda a, x, b: a is not None and b is not None and not math.isnan(a) and a <= x <= b
    for i, w, h, boxes in rows:
        n = 0
        for j in range(64 if boxes and w > 0 else 0):
            across = [b for b in boxes if inside(b[1], (j + 0.5) * h / 64, b[3])]
            n += sum(any(inside(b[0], (k + 0.5) * w / 64, b[2]) for b in across) for k in range(64))
        assert got[i] == n / 4096, (w, h, boxes)


def test_two_sources(spark):
    said = lambda rows: spark.createDataFrame(rows, "k int, field string, kind string, value string")
    a, b = said([(1, "x", "decimal", "1.50"), (1, "y", "string", "A"), (1, "z", "date", "soon")]), said([(1, "x", "decimal", "1.5"), (1, "y", "string", "b"), (1, "w", "string", "q"), (1, "z", "date", "soon")])
    assert {r.field: (r.agreed, r.value) for r in arbitrate(a, b, ["k"]).collect()} == {"x": (True, "1.50"), "y": (False, None), "w": (False, None), "z": (True, "soon")}


def test_misaligned_files_are_never_paired(spark):
    expected = spark.createDataFrame([("f", "d1", 1), ("f", "d2", 2), ("g", "d3", 1)], "file string, doc_key string, ordinal int")
    found = spark.createDataFrame([("f", 0), ("g", 0)], "file string, segment long")
    assert {(r.doc_key, r.segment, r.misaligned) for r in evaluation.aligned(expected, found).collect()} == {("d1", None, True), ("d2", None, True), ("d3", 0, False)}


# --- sources


def test_schema_errors():
    for bad in ("a: [", "[]", SMALL.replace("schema_version: 1", "schema_version: true"), SMALL.replace("tipo: decimal", "tipo: money"), SMALL.replace("addendi: [a, b]", "addendi: [a, q]"), SMALL.replace("nome: b,", "nome: a,"), SMALL.replace("minimo_pagine: 1", "minimo_pagine: 0"), SMALL.replace("severita: reject", "severita: fatal")):
        with pytest.raises(SchemaError):
            parse(bad)
    assert [len(shipped(n).fields) for n in ("bolletta_luce_it", "bolletta_gas_it", "cte_it")] == [10, 7, 8]


def test_truth_and_metadata(spark, tmp_path):
    schema = parse(SMALL)
    cells = {f.name: None for f in schema.fields} | {"code": "X1"}
    p = tmp_path / "truth.json"

    def said(**changes):
        p.write_text(json.dumps({"oracle_version": 1, "documento": "small", "documenti": {"D1": cells}} | changes))
        return truth(spark, str(p), schema)

    assert {(r.doc_key, r.field, r.expected) for r in said().collect()} == {("D1", k, v) for k, v in cells.items()}
    for wrong in ({"oracle_version": "1"}, {"documento": "other"}, {"documenti": {"D1": {"code": "X"}}}, {"documenti": {"D1": cells | {"more": "1"}}}, {"documenti": {"D1": cells | {"code": 5}}}, {"documenti": []}):
        with pytest.raises(TruthError):
            said(**wrong)
    told = {"D1": {"file": "a.pdf", "pagine": [1, 3], "layout": "L", "tipo_lettura": "effettiva", "monoraria": True, "qualita": "digitale", "flag_attivi": ["monoraria", "ruotata"]}, "D2": {"file": "a.pdf"}}
    p.write_text(json.dumps({"composizione": {"x": 1}, "documenti": told}))
    assert sorted(tuple(r) for r in metadata(spark, str(p)).collect()) == [("D1", "a.pdf", 1, 3, "L", "effettiva", True, "digitale", ["monoraria", "ruotata"]), ("D2", "a.pdf", None, None, None, None, None, None, [])]
    want = evaluation.expected_pages(metadata(spark, str(p)).filter("doc_key = 'D1'")).first()
    assert (want.documents, want.page_type, want.rotation, [tuple(x) for x in want.ranges]) == (1, "digitale", 180, [(1, 3)])
    assert metadata(spark, f"{tmp_path}/none.json").count() == 0
    with pytest.raises(FileNotFoundError):
        metadata(spark, f"{tmp_path}/none.json", required=True)


def test_stream_of_files(spark, tmp_path):
    from provenia.streaming.files import start

    schema = parse(SMALL)
    rows = pages(spark, ("a.pdf", 1, "Code X1", []), ("b.pdf", 1, "Code X2", []), ("b.pdf", 2, "Code X3", []))
    files = rows.groupBy("file").agg(F.collect_list(F.struct("page_no", "text", "width", "height", "images")).alias("pages"))
    files.write.parquet(f"{tmp_path}/in")
    start(spark.readStream.schema(files.schema).parquet(f"{tmp_path}/in"), schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert {r.instance_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a", "ba", "bb"}


def test_command(spark, tmp_path, capsys):
    from provenia.__main__ import main

    (tmp_path / "s.yaml").write_text(SMALL)
    pages(spark, ("a.pdf", 1, "Code X1", []), ("b.pdf", 1, "Code X2", [])).write.parquet(f"{tmp_path}/pages")
    assert main(["extract", f"{tmp_path}/nothing"]) == 2
    assert main(["extract", f"{tmp_path}/pages", "--schema", f"{tmp_path}/none.yaml"]) == 2
    capsys.readouterr()
    assert main(["extract", f"{tmp_path}/pages", "--schema", f"{tmp_path}/s.yaml"]) == 0
    assert [x["istanza_id"] for x in json.loads(capsys.readouterr().out)] == ["a", "b"]
    (tmp_path / "strict.yaml").write_text(SMALL.replace("'Code (\\w+)'", "'Code (\\d+)'"))
    assert main(["extract", f"{tmp_path}/pages", "--schema", f"{tmp_path}/strict.yaml", "--to", f"{tmp_path}/out"]) == 1
    told = manifest(f"{tmp_path}/out")
    assert told["results"] == 2 and told["verdicts"] == {"reject": 2} and capsys.readouterr().out == ""
    assert sorted(json.loads(r["result"])["istanza_id"] for r in saved_results(spark, f"{tmp_path}/out").collect()) == ["a", "b"]
    assert main(["extract", f"{tmp_path}/pages", "--schema", f"{tmp_path}/s.yaml", "--to", f"{tmp_path}/out"]) == 2  # there are results already


def test_sink_computes_once_and_leaves_nothing_of_a_failed_job(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    @F.udf("string")
    def counted(i):
        import uuid
        from pathlib import Path

        Path(str(seen), uuid.uuid4().hex).touch()
        return json.dumps({"i": i, "s": 'é\n"'})

    rows = spark.range(50).repartition(6).select(counted("id").alias("result"), F.when(F.col("id") % 7 == 0, "reject").otherwise("pass").alias("outcome"))
    told = save_results(rows, f"{tmp_path}/good")
    assert len(list(seen.iterdir())) == 50 and told["verdicts"] == {"pass": 42, "reject": 8} and told["results"] == 50
    parts = [json.loads((tmp_path / "good" / p["name"]).read_text()) for p in told["parts"]]
    assert sorted(x["i"] for p in parts for x in p) == list(range(50)) and [len(p) for p in parts] == [p["results"] for p in told["parts"]]
    assert sorted(json.loads(r["result"])["i"] for r in saved_results(spark, f"{tmp_path}/good").collect()) == list(range(50))
    for bad in (F.when(F.col("id") == 33, F.raise_error(F.lit("dies")).cast("string")).otherwise("{}"), F.when(F.col("id") == 33, "{").otherwise("{}")):
        with pytest.raises(Exception):  # noqa: B017
            save_results(spark.range(50).repartition(6).select(bad.alias("result"), F.lit("pass").alias("outcome")), f"{tmp_path}/bad")
        assert not (tmp_path / "bad" / "manifest.json").exists()
    # what a task may have written after its job was given up is gone once a job commits
    again = save_results(rows, f"{tmp_path}/bad")
    assert {p.name for p in (tmp_path / "bad").glob("part-*")} == {p["name"] for p in again["parts"]}
    assert save_results(rows.limit(0), f"{tmp_path}/none") == {"parts": [], "results": 0, "verdicts": {}} and saved_results(spark, f"{tmp_path}/none").count() == 0
