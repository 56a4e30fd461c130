"""Queries for the driver: each operator on tables that the driver has."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenia.functions.keys import cache_key, pages_key
from provenia.functions.repair import repair
from provenia.functions.replies import with_reply_values
from provenia.operators import cost, evaluation
from provenia.operators.arbitration import arbitrate, arbitration_stats
from provenia.operators.classify import classify, classify_files
from provenia.operators.dispatch import with_providers
from provenia.operators.extraction import Captured, found_rows, long_form, missing, raw_by, raw_by_rules, tier0
from provenia.operators.invariants import with_judgements
from provenia.operators.orientation import page_orientation
from provenia.operators.ranges import declared_pages
from provenia.operators.segmentation import instances, segments
from provenia.operators.selection import medians
from provenia.operators.stages import shared_dir
from provenia.operators.triage import DIGITAL, HYBRID, SCAN, image_coverage, page_rotation, page_type, text_density, triage
from provenia.plans.compiler import contract, extract, extract_classified, fields_of, fill, prepared, values
from provenia.plans.schema import Field, Invariant, Schema, parse, shipped
from provenia.sources.bills import HEIGHT, WIDTH, bill_pages, bills, italian
from provenia.sources.cache import ReplyLog
from provenia.sources.loaders import PRICES, inventory_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BILL = "bolletta_luce_it"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier 0 on the bills: a row for each field of each instance, before derivation."""
    schema = shipped(BILL)
    return found_rows(instances(prepared(bill_pages(spark, sf_dir)), schema.segmentation), schema, ["file", "instance_id", "segment"])


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(bill_pages(spark, sf_dir), shipped(BILL))


def result_rows(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """The bills' fields with all parts of what is said of them, or with those named."""
    return fields_of(results(spark, sf_dir), shipped(BILL), *[parts] if parts else [])


@query
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("file", "instance_id", "field", "value", "raw", "outcome")


@query
def extract_diagnosis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).groupBy("field", "outcome").agg(F.count("*").alias("n"))


@query
def unique_capture_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = shipped(BILL).only("importo_totale")  # one field is asked, so one is compiled
    one = long_form(tier0(instances(prepared(bill_pages(spark, sf_dir)), schema.segmentation), schema), schema, ["file", "instance_id"])
    return one.filter("outcome = 'non_estratto'").select("file", "instance_id")


#: Fields of a bill by their labels instead of patterns.
LABELS = """
schema_version: 1
documento: etichette
campi:
  - {nome: pod, tipo: string, estrazione: {tipo: etichetta, testo: POD}}
  - {nome: fornitore, tipo: string, estrazione: {tipo: etichetta, testo: Fornitore, parole: 2}}
  - {nome: kwh_f1, tipo: decimal, estrazione: {tipo: etichetta, testo: Energia F1}}
  - {nome: kwh_totale, tipo: decimal, estrazione: {tipo: etichetta, testo: Energia totale}}
"""


def labelled_values(text: str, names: list[str]) -> dict[str, str | None]:
    """Values of lines "label: value unit", if a label has one and the same: the finder of extract_found_by."""
    labels = {"pod": "POD", "fornitore": "Fornitore", "kwh_f1": "Energia F1", "kwh_totale": "Energia totale"}
    seen: dict[str, set[str]] = {}
    for line in text.split("\n"):
        label, colon, value = line.partition(": ")
        if colon:
            seen.setdefault(label, set()).add(value.removesuffix(" kWh"))
    return {n: min(seen[labels[n]]) for n in names if len(seen.get(labels[n], ())) == 1}


def by_label(spark: SparkSession, sf_dir: str, captured: Captured) -> DataFrame:
    found = instances(prepared(bill_pages(spark, sf_dir)), shipped(BILL).segmentation)
    return found_rows(found, parse(LABELS), ["file", "instance_id"], captured).select("file", "instance_id", "field", "value", "raw", "outcome")


@query
def extract_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_label(spark, sf_dir, raw_by_rules)


@query
def extract_found_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_label(spark, sf_dir, raw_by("provenia.queries:labelled_values"))


@query
def repair_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("p"), F.col("l_partkey").cast("bigint").alias("k"))
    three = F.concat(F.floor(F.col("k") / 1000).cast("string"), F.lit("."), F.lpad((F.col("k") % 1000).cast("string"), 3, "0"))
    raw = F.when(F.col("l_linenumber") % 4 == 0, italian(F.col("p"))).when(F.col("l_linenumber") % 4 == 1, F.col("p").cast("string")).when(F.col("l_linenumber") % 4 == 2, three).otherwise(F.concat(F.lit("1."), F.lpad((F.col("k") % 1000).cast("string"), 3, "0"), F.lit(".567")))
    return x.select("l_orderkey", "l_linenumber", raw.alias("raw"), repair(raw, "decimal").alias("value"))


@query
def repair_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    shapes = [F.date_format(d, s) for s in ("dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy")]
    k = F.col("o_orderkey")
    raw = F.when(k % 11 == 0, F.concat(F.lit("31/02/"), F.date_format(d, "yyyy"))).when(k % 7 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 3 == 0, shapes[0]).when(k % 3 == 1, shapes[1]).otherwise(shapes[2])
    return x.select("o_orderkey", repair(raw, "date").alias("value"))


@query
def repair_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(" giorni"))).otherwise(F.concat(F.lit("-"), F.col("p_size").cast("string")))
    return x.select("p_partkey", repair(raw, "integer").alias("value"))


@query
def repair_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 5 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t\n ")), F.lit("\n")))
    return table(spark, sf_dir, "part").select("p_partkey", repair(raw, "string").alias("value"))


@query
def segment_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances(prepared(bill_pages(spark, sf_dir)), shipped(BILL).segmentation).select("file", "instance_id", "page_from", "page_to", "seg_confidence")


@query
def segmentation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_invoices(spark, sf_dir).groupBy("seg_confidence").agg(F.count("*").alias("instances"), F.count_distinct("file").alias("files"))


def runs(rows: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    out = segments(rows, by, order, F.col(key)).groupBy(*by, "segment")
    return out.agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


@query
def segment_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")


@query
def segment_event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").drop("first", "last")


def boxed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), (F.col("p_size") * WIDTH / 50).alias("x1"), F.lit(HEIGHT).alias("bottom"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", image_coverage(F.array(box, box), F.lit(WIDTH), F.lit(HEIGHT)).alias("coverage"))


@query
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed_parts(spark, sf_dir).select("p_partkey", "coverage", page_type(F.col("coverage")).alias("page_type"))


@query
def page_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.when(F.col("doc_id") % 50 == 0, 0.0).otherwise(WIDTH)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text_density(F.col("n_chars"), width, F.lit(HEIGHT)), 8).alias("density"))


@query
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = ["\nTotale da pagare 3 kWh.", "\nTOTALE DA PAGARE: 3 Smc", "\ntotale da pagare kWh smc", "\nCondizioni Economiche", "\nCodice offerta 1", ""]
    tail = F.get(F.array(*map(F.lit, tails)), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", classify(F.concat("text", tail)).alias("class"))


SHIPPED = {i.id: i for i in shipped(BILL).invariants}


def verdict_of(df: DataFrame, keys: list[str], *named: Invariant) -> DataFrame:
    """keys, id, verdict (pass, fail, none) of invariants on plain text columns."""
    out = with_judgements(df, type("S", (), {"invariants": named}), value=F.col).select(*keys, F.inline("judged"))
    return out.select(*keys, "id", F.when(~F.col("evaluated"), "none").when(F.col("message").isNull(), "pass").otherwise("fail").alias("verdict"))


@query
def inv_approx_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bills(spark, sf_dir)
    off = (F.col("kwh") * F.when(F.col("o_orderkey") % 3 == 0, F.lit(1.005).cast("decimal(5,3)")).when(F.col("o_orderkey") % 3 == 1, F.lit(1.006).cast("decimal(5,3)")).otherwise(F.lit(1).cast("decimal(5,3)"))).cast("decimal(18,2)")
    rows = b.select("o_orderkey", *[F.when(F.col("o_orderkey") % 31 != 0, F.col(c)).cast("string").alias(f"kwh_{c}") for c in ("f1", "f2", "f3")], off.cast("string").alias("kwh_totale"))
    return verdict_of(rows, ["o_orderkey"], SHIPPED["somma_fasce"])


@query
def inv_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    x = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", F.to_date("o_orderdate").cast("string").alias("periodo_da"), F.to_date("l_shipdate").cast("string").alias("periodo_a"), F.when(F.col("l_orderkey") % 4 > 0, F.col("l_linenumber") * 10).cast("string").alias("giorni"))
    return verdict_of(x, ["l_orderkey", "l_linenumber"], SHIPPED["periodo_ordinato"], SHIPPED["giorni_inclusivi"]).groupBy("id", "verdict").agg(F.count("*").alias("n"))


@query
def inv_min_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("kwh_totale"))
    return verdict_of(x, ["c_custkey"], SHIPPED["kwh_totale_non_negativo"]).drop("id")


@query
def inv_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = Invariant("brand", "formato", "reject", {"campo": "p_brand", "pattern": r"Brand#\d\d"})
    return verdict_of(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_partkey"], two).drop("id")


@query
def inv_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = results(spark, sf_dir).select(F.inline("judged"))
    return x.groupBy("id").agg(F.count_if(F.col("evaluated") & F.col("message").isNull()).alias("passed"), F.count_if(F.col("message").isNotNull()).alias("failed"), F.count_if(~F.col("evaluated")).alias("not_judged"))


@query
def derive_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = values(bill_pages(spark, sf_dir), shipped(BILL))
    return long_form(out, shipped(BILL), ["file", "instance_id"]).select("file", "instance_id", "field", "value", "origin")


@query
def derive_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = result_rows(spark, sf_dir, "derivation").select("field", F.inline("derivation"))
    return rows.groupBy("field", "tipo", "invariante_id", F.array_join("da_campi", ",").alias("da_campi")).agg(F.count("*").alias("n"))


@query
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = result_rows(spark, sf_dir, "status", "passed", "failed").groupBy("field", "origin", "status", F.col("passed").cast("long").alias("passed"), F.col("failed").cast("long").alias("failed"))
    return rows.agg(F.count("*").alias("n"))


@query
def confidence_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_rows(spark, sf_dir, "confidence").groupBy("field", "confidence").agg(F.count("*").alias("n"))


@query
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("file", "instance_id", "outcome", "reason")


@query
def gate_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract(results(spark, sf_dir), shipped(BILL))


@query
def result_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of the public JSON gets back by path."""
    said = F.json_tuple("result", "istanza_id", "esito", "motivo").alias("instance_id", "outcome", "reason")  # all paths in one reading
    return result_json(spark, sf_dir).select("file", said)


@query
def fill_not_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model stage's replies filled into what tier 0 found."""
    schema = Schema(1, "order", (Field("value", "string"),))
    x, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first, second = F.when(k % 3 > 0, F.col("o_orderpriority")), F.when(k % 4 > 0, F.col("o_orderstatus"))
    own = F.struct(first.alias("value"), first.alias("raw"), F.lit("").alias("outcome"), F.when(first.isNotNull(), "tier0").alias("origin"))
    out = fill(x.select("o_orderkey", own.alias("f_value"), F.create_map(F.lit("value"), second).alias("reply")), schema)
    return out.select("o_orderkey", F.col("f_value.value").alias("value"), F.col("f_value.origin").alias("origin"))


@query
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model stage would be asked for, by order, where tier 0 leaves something open."""
    schema = Schema(1, "order", (Field("a", "string"), Field("b", "string"), Field("c", "string")))
    k = F.col("o_orderkey")
    value = lambda n: F.struct(F.when(k % n > 0, F.col("o_orderstatus")).alias("value"))
    x = table(spark, sf_dir, "orders").select("o_orderkey", value(3).alias("f_a"), value(5).alias("f_b"), value(7).alias("f_c"))
    return x.select("o_orderkey", F.array_join(missing(schema), ",").alias("asked")).filter("asked <> ''")


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of four pages for each order: gas, electricity, offers and others, told on the first, the third, or too late on the fourth page; some null."""
    k = F.col("o_orderkey")
    word = F.get(F.array(*map(F.lit, ("kWh", "Smc", "kWh e smc", "Codice offerta 7", "niente"))), (k % 5).cast("int"))
    at = F.get(F.array(F.lit(1), F.lit(3), F.lit(4)), (k % 3).cast("int"))
    text = lambda n: F.when(F.lit(n) == 1, F.when(k % 5 < 3, "TOTALE DA PAGARE 1 ").otherwise("")).otherwise(F.when(k % 7 > 0, F.lit("pagina ")))
    page = lambda n: F.struct(F.lit(n).alias("page_no"), F.concat(text(n), F.when(at == n, word).otherwise("")).alias("text"))
    pages = F.inline(F.array(*[page(n) for n in (1, 2, 3, 4)]))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("F"), k.cast("string"), F.lit(".pdf")).alias("file"), pages).select("*", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


@query
def classify_bill_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_files(mixed_files(spark, sf_dir))


@query
def extract_mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed files with two of three schemas at hand: how many of each class go to which schema, and those that have none."""
    out = extract_classified(mixed_files(spark, sf_dir), {n: shipped(n).only("pod") if n == BILL else shipped(n) for n in (BILL, "cte_it")})
    return out.groupBy("class", "schema", F.when(F.col("field").isNull(), F.col("reason")).alias("lost")).agg(F.count_distinct("file").alias("files"))


@query
def page_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's own rotation, else for scans and hybrids what a detector found."""
    k = F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, (DIGITAL, HYBRID, SCAN))), (k % 3).cast("int"))
    rotation = page_rotation((k % 4 * 90).cast("int") * F.when(k % 5 == 0, 1).otherwise(0), kind, F.when(k % 7 > 0, (k % 2 * 180).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", rotation.cast("int").alias("rotation"))


@query
def page_orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of characters in a part's name's length, turned by the part's key; too few to tell, and half of them turned the other way, for some."""
    k = F.col("p_partkey")
    turn, n = (k % 4).cast("int"), (F.length("p_name") + k % 13).cast("int")
    x, y = lambda i: 50.0 + (i % 12) * 6.0, lambda i: 80.0 + F.floor(i / 12) * 14.0

    # each place in steps, so that none is computed once for each use in the next
    place = lambda i: F.struct(x(i).alias("x"), y(i).alias("y"), ((k % 11 == 0) & (i % 24 >= 12)).alias("back"))

    def turned(p):
        # a page of 600 by 800 points, turned clockwise about its corner
        px, py = p["x"], p["y"]
        ax = F.when(turn == 0, px).when(turn == 1, 800.0 - py).when(turn == 2, 600.0 - px).otherwise(py)
        ay = F.when(turn == 0, py).when(turn == 1, px).when(turn == 2, 800.0 - py).otherwise(600.0 - px)
        return F.struct(ax.alias("x"), ay.alias("y"), p["back"].alias("back"))

    flipped = lambda p: F.struct(F.when(p["back"], 600.0 - p["x"]).otherwise(p["x"]).alias("x"), F.when(p["back"], 800.0 - p["y"]).otherwise(p["y"]).alias("y"))
    box = lambda p: F.struct((p["x"] - 2.5).alias("x0"), (p["y"] - 4.0).alias("top"), (p["x"] + 2.5).alias("x1"), (p["y"] + 4.0).alias("bottom"))
    boxes = F.sequence(F.lit(0), F.when(k % 11 == 0, 48).otherwise(n * 4) - 1)
    for made in (place, turned, flipped, box):
        boxes = F.transform(boxes, made)
    boxes = F.when(k % 17 == 0, F.slice(boxes, 1, 19)).when(k % 19 > 0, boxes)
    # few bytes make much work here: rows are dealt by key, whatever files they lie in
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select("p_partkey", page_orientation(boxes).alias("rotation"))


@query
def provider_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model names made of orders' priorities and keys, given to providers by their longest prefix."""
    k = F.col("o_orderkey")
    name = F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lower(F.regexp_extract("o_orderpriority", "[A-Z]+", 0)), F.lit("-"), (k % 50).cast("string")))
    known = [("high", "one"), ("high-4", "two"), ("high-42", "three"), ("low-", "one"), ("low-1", "two"), ("urgent-7", "three"), ("not-", "two"), ("not-1", "one"), ("not-1", "four"), ("nota", "never")]
    calls = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("model"))
    return with_providers(calls, spark.createDataFrame(known, "prefix string, provider string")).select("o_orderkey", "provider", F.col("dispatch_error").isNotNull().alias("unknown"))


@query
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.encode("text", "UTF-8"), F.encode("lang", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", cache_key(parts, F.lit("prompt"), F.col("source"), F.lit("1")).alias("key"))


@query
def reply_log_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls against a log of replies of several days: the latest valid one that is young enough is a hit; others are corrupt, expired or missing."""
    d = F.col("doc_id")
    x = table(spark, sf_dir, "documents")
    key = cache_key(F.array(F.encode("text", "UTF-8"), F.encode(d.cast("string"), "UTF-8")), F.lit("prompt"), F.lit("steady"), F.lit("1")).alias("key")
    log = ReplyLog(spark, f"{shared_dir(spark)}/reply-log-{uuid.uuid4().hex}", days=2)
    reply = lambda n: F.when(d % 5 == n, "[1]").when(d % 7 == n, "no json").otherwise(F.concat(F.lit('{"n": '), d.cast("string"), F.lit("}"))).alias("reply")
    for day in range(4):
        log.write(x.filter(d % 4 == day).select(key, reply(day)), now=day * 86_400.0)
    log.write(x.filter(d % 9 == 0).select(key, reply(3)), now=3.5 * 86_400)
    return log.status(x.filter(d % 11 > 0).select("doc_id", key).unionByName(x.filter(d % 11 == 0).select("doc_id", F.lit("other").alias("key"))), now=3.5 * 86_400).select("doc_id", "status")


def two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    total, status = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderpriority")
    said = lambda c, field, kind: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), c.alias("value"))
    a = o.select("o_orderkey", F.inline(F.array(said(F.when(k % 7 > 0, total).cast("string"), "total", "decimal"), said(F.when(k % 5 == 0, "x").otherwise(status), "status", "string"))))
    b = o.select("o_orderkey", F.inline(F.array(said(F.concat((total + F.when(k % 3 == 0, 1).otherwise(0)).cast("decimal(18,2)").cast("string"), F.lit("0")), "total", "decimal"), said(F.upper(status), "status", "string"))))
    t = o.select("o_orderkey", F.inline(F.array(said(total.cast("string"), "total", "decimal"), said(status, "status", "string")))).withColumnRenamed("value", "expected").drop("kind")
    return a, b, t


@query
def arbitrate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = two_sources(spark, sf_dir)
    return arbitrate(a, b, ["o_orderkey"]).select("o_orderkey", "field", "agreed", "value")


@query
def arbitration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, t = two_sources(spark, sf_dir)
    out = arbitration_stats(arbitrate(a, b, ["o_orderkey"]), t, ["o_orderkey"])
    return out.withColumns({c: F.round(c, 6) for c in ("disagreement_rate", "accuracy_agreed")})


EVALUATED = ("pod", "periodo_da", "periodo_a", "giorni", "kwh_totale", "importo_totale")


def pairs(spark: SparkSession, sf_dir: str, wanted: str = "outcome") -> DataFrame:
    """Each order with its bill's fields, extracted once, and with their verdict or, wanted = "values", without."""
    doc = bills(spark, sf_dir).select(F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("doc_key"), F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("file"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("start", "o_orderkey")).alias("ordinal"), "o_orderkey", "o_custkey", "start", F.col("stop"), F.col("days"), F.col("kwh"), F.col("total"))
    found = values(bill_pages(spark, sf_dir), shipped(BILL)) if wanted == "values" else results(spark, sf_dir)
    return evaluation.paired(doc, found.select("file", "segment", *(["outcome"] if wanted == "outcome" else []), *[f"f_{n}" for n in EVALUATED]))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bills' results compared with what the orders say."""
    pod = F.concat(F.lit("IT"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("E"), F.lpad((F.col("o_orderkey") % 100000000).cast("string"), 8, "0"))
    cells = {"pod": ("string", F.when(F.col("o_orderkey") % 19 != 0, pod)), "periodo_da": ("date", F.col("start")), "periodo_a": ("date", F.col("stop")), "giorni": ("integer", F.col("days")), "kwh_totale": ("decimal", F.col("kwh")), "importo_totale": ("decimal", F.col("total"))}
    return evaluation.compared_cells(pairs(spark, sf_dir, "values"), cells)


@query
def eval_field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.field_accuracy(evaluated(spark, sf_dir))
    return out.select("field", "total", "not_extracted", "not_normalisable", "normalised", "correct", "invented", F.round("accuracy", 6).alias("accuracy"))


@query
def eval_document_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.document_accuracy(evaluated(spark, sf_dir))


@query
def eval_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which stage documents are lost."""
    out = evaluation.diagnosis(evaluated(spark, sf_dir))
    return out.groupBy("misaligned", "first_loss").agg(F.count("*").alias("documents"), F.sum("correct").alias("correct"), F.sum("not_extracted").alias("not_extracted"), F.sum("wrong").alias("wrong"))


@query
def eval_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.paired_verdicts(pairs(spark, sf_dir), any(f.mandatory for f in shipped(BILL).fields))


@query
def composition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select(F.col("lang"), F.col("source"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 2 == 0).alias("single_rate"))
    return evaluation.composition(x, ["lang", "source", "single_rate"])


@query
def triage_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances, page types and rotations against what the orders say: a second page is a scan where the order's key has that fault."""
    doc = bills(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("start", "o_orderkey")))
    file = F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("file")
    told = doc.select(F.lpad(F.col("rank").cast("string"), 9, "0").alias("doc_key"), file, (F.col("rank") * 2 - 1).cast("int").alias("page_from"), (F.col("rank") * 2).cast("int").alias("page_to"), F.lit("digitale").alias("quality"), F.array(F.lit("ruotata")).alias("flags"))
    pages = prepared(bill_pages(spark, sf_dir)).withColumn("page_rotation", F.when(F.col("page_no") % 3 > 0, F.when(F.col("page_no") % 2 == 0, 180).otherwise(0)))
    report = evaluation.triage_report(instances(pages, shipped(BILL).segmentation), pages, evaluation.expected_pages(told))
    out = evaluation.triage_rates(report)
    return out.select("files", "certain_but_wrong", *[F.round(c, 6).alias(c) for c in ("counts", "ranges", "types", "rotation_coverage", "rotation")])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = (F.col("n_chars") >= 1000).cast("int")
    return evaluation.coverage_accuracy(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), ["lang"], F.col("quality").isNotNull(), F.col("quality") == rule)


@query
def coverage_vs_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("coverage", "accuracy")})


@query
def worst_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.worst(coverage_vs_accuracy(spark, sf_dir), "lang", "accuracy")


@query
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    n = F.when(k % 4 == 0, F.lit("30.0")).when(k % 4 == 1, F.lit("true")).when(k % 4 == 2, F.lit("30.5")).otherwise((k % 100).cast("string"))
    body = F.concat(F.lit('{"total": '), total, F.lit(', "n": '), n, F.lit(', "s": '), F.when(k % 3 == 0, F.lit("12")).otherwise(F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))), F.lit("}"))
    text = F.when(k % 13 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 17 == 0, F.lit("no object")).otherwise(body)
    fields = [Field("total", "decimal"), Field("n", "integer"), Field("s", "string"), Field("gone", "string")]
    return with_reply_values(x.select("o_orderkey", text.alias("text")), F.col("text"), fields).drop("text")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    images = F.array_repeat(F.struct((F.lit(1000) + d % 300).cast("long").alias("width"), (F.lit(1400) + d % 200).cast("long").alias("height")), (d % 3).cast("int") + 1)
    return table(spark, sf_dir, "documents").select(d.alias("key"), F.col("n_chars").alias("prompt_chars"), (d % 5 + 1).alias("asked"), images.alias("images"))


#: Example prices, of no real model: (model, input, output, cache write, cache read, image formula, updated).
PRICED = [("steady", 4.0, 16.0, 5.0, 0.5, "lineare_wh_750", "-"), ("quick", 0.8, 3.2, 1.0, 0.1, "lineare_wh_750", "-"), ("tiled", 2.0, 9.0, None, None, "tile_512_openai", "-"), ("tiled-quick", 0.2, 0.7, None, None, "tile_512_openai_stima_al_rialzo", "-"), ("text-only", 0.1, 0.2, None, None, None, "-")]


@query
def token_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = calls(spark, sf_dir)
    cached = x.filter("key % 10 = 0").select("key", F.lit("quick").alias("model"))
    out = cost.estimate(x, spark.createDataFrame(PRICED, PRICES), cached)
    return out.select("model", "calls", "tokens_in", "tokens_out", F.round("cost", 4).alias("cost"))


@query
def model_bake_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models over the same documents, one after the other, with one budget for both; some calls fail, and two fields are asked."""
    k = F.col("doc_id")
    models = F.explode(F.array(F.lit("steady"), F.lit("tiled"))).alias("model")
    x = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source", models)
    told = x.select("model", k.cast("string").alias("doc_key"), k.alias("ordinal"), F.col("n_chars").cast("long").alias("tokens_in"), (k % 50).alias("tokens_out"), F.when(k % 9 > 0, (k % 97).cast("double")).alias("latency"), (k % 41 == 0).alias("failed"), F.when(k % 4 == 0, k % 3).otherwise(0).alias("violations"))
    asked = F.array(F.struct(F.when(k % 3 > 0, F.col("lang")).alias("value"), F.col("lang").alias("expected"), ((k % 3 > 0) & (k % 5 > 0)).alias("correct")), F.struct(F.col("source").alias("value"), F.col("source").alias("expected"), (k % 7 > 0).alias("correct")))
    rows = x.select("model", k.cast("string").alias("doc_key"), F.inline(asked))
    out = cost.bake_off(told, spark.createDataFrame(PRICED, PRICES), rows, ["steady", "tiled"], 12.0)
    return out.withColumns({"cost": F.round("cost", 4)} | {c: F.round(c, 6) for c in ("cost_per_document", "p50_latency", "accuracy", "document_accuracy")})


@query
def budget_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("cost"))
    return cost.within_budget(x, 1_000_000.0, ["doc_id"]).select("doc_id", F.round("spent_before", 2).alias("spent_before"), "skipped")


@query
def latency_p50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.latency_p50(table(spark, sf_dir, "events").select("event_type", F.col("value").alias("latency")), ["event_type"]).withColumn("p50", F.round("p50", 6))


@query
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.encode("text", "UTF-8"), F.encode("lang", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", pages_key(parts).alias("key"))


@query
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "pages")
    return inventory_of(x.select(F.concat_ws("/", "url", F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("content")))


@query
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.contract_faults(result_rows(spark, sf_dir, "confidence", "status"))


@query
def contract_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with planted faults of each rule."""
    k = F.col("o_orderkey")
    value = F.when(k % 3 > 0, F.col("o_orderstatus"))
    unless = lambda n, x: F.when((k % n == 0) != value.isNotNull(), x)
    rows = table(spark, sf_dir, "orders").select(value.alias("value"), unless(11, F.lit("tier0")).alias("origin"), unless(13, F.lit(1.0)).alias("confidence"), F.when((k % 17 == 0) != value.isNull(), "non_estratto").alias("status"), F.when(k % 19 == 0, "maybe").otherwise("pass").alias("verdict"))
    return evaluation.contract_faults(rows)


def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part, with an image from its top left corner to a share of its width, so that all types and many shares occur, and its name as text."""
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), ((F.col("p_partkey") % 51 / 50) * WIDTH).alias("x1"), F.lit(HEIGHT).alias("bottom"))
    text = F.when(F.col("p_partkey") % 51 > 46, F.lit("")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), F.lit(1).alias("page_no"), text.alias("text"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.array(box).alias("images"))


@query
def feature_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.feature_margins(triage(mixed_pages(spark, sf_dir)), 0.15, 0.85, 1e-5)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c not in ("page_type", "pages")})


@query
def median_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of two columns by flag and status: every line is in one of a few groups."""
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity") * F.col("l_discount") - 1).alias("signed"))
    out = medians(x, ["l_returnflag", "l_linestatus"], {"l_extendedprice": "price", "signed": "signed"})
    return out.withColumns({c: F.round(c, 6) for c in ("price", "signed")})


@query
def declared_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of bills in ranges that overlap: each bill's pages and the next one's first, the first five of each file, all up to a million, and an open one."""
    b = bills(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("start", "o_orderkey")))
    key, rank = F.col("o_orderkey"), F.col("rank").cast("int")
    own = F.struct(F.concat(F.lit("D"), key.cast("string")).alias("doc_key"), (rank * 2 - 1).alias("page_from"), (rank * 2 + 1).alias("page_to"))
    none = F.lit(None).cast("int")
    whole = lambda name, first, last: F.when(rank == 1, F.struct(F.concat(F.lit(name), F.col("o_custkey").cast("string")).alias("doc_key"), first.alias("page_from"), last.alias("page_to")))
    every = F.array_compact(F.array(own, whole("F", F.lit(1), F.lit(5)), whole("M", F.lit(1), F.lit(1_000_000)), whole("O", F.lit(4), none), whole("E", F.lit(9), F.lit(8))))
    ranges = b.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("file"), F.inline(every))
    pages = bill_pages(spark, sf_dir).select("file", "page_no", "n_chars")
    return declared_pages(pages, ranges).groupBy("file", "doc_key").agg(F.count("*").alias("pages"), F.min("page_no").alias("first"), F.max("page_no").alias("last"), F.sum("page_no").alias("places"))


@query
def extract_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bill extracted from the two pages that the orders declare for it, whatever its pages' type."""
    b = bills(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("start", "o_orderkey")))
    ranges = b.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("file"), F.col("o_orderkey").cast("string").alias("doc_key"), (F.col("rank") * 2 - 1).cast("int").alias("page_from"), (F.col("rank") * 2).cast("int").alias("page_to"))
    out = extract(bill_pages(spark, sf_dir), shipped(BILL).only("pod", "giorni", "importo_totale"), ranges=ranges)
    return out.select("file", "instance_id", "page_from", "page_to", *[F.col(f"f_{c}")["value"].alias(c) for c in ("pod", "giorni", "importo_totale")])


NAMED = """
schema_version: 1
documento: ordine
campi:
  - {nome: priority, tipo: string, estrazione: {tipo: regex, pattern: '^(?P<rank>\\d)-(?P<word>[A-Z ]+)\\Z'}}
  - {nome: clerk, tipo: integer, estrazione: {tipo: regex, pattern: '(?i)CLERK#0*(?P<n>\\d+)$'}}
  - {nome: twice, tipo: string, estrazione: {tipo: regex, pattern: '(?P<d>\\d)(?P=d)'}}
  - {nome: closed, tipo: string, estrazione: {tipo: regex, pattern: '\\A(?P<open><)?\\w+(?(open)>|!)\\Z'}}
"""


@query
def named_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema whose patterns use named groups, references to them, conditions, folded case and Python's ends of text."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    schema = parse(NAMED)
    mark = F.concat(F.when(k % 2 == 0, "<").otherwise(""), F.lit("ok"), F.when(k % 3 == 0, ">").otherwise("!"))
    one = lambda text, name: tier0(o.select("o_orderkey", text.alias("text")), schema.only(name)).select("o_orderkey", F.lit(name).alias("field"), F.col(f"f_{name}")["value"].alias("value"), F.col(f"f_{name}")["outcome"].alias("outcome"))
    clerk = F.concat(F.lit("clerk#000"), (k % 1000).cast("string"), F.lit("\n"))
    return one(F.col("o_orderpriority"), "priority").unionByName(one(clerk, "clerk")).unionByName(one(k.cast("string"), "twice")).unionByName(one(mark, "closed"))


@query
def recovery_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 4 == 0, F.substring("p_name", 3, 100)).otherwise(F.concat_ws("-", F.lit("??"), F.upper("p_name"), F.lit("!")))
    rows = x.select("p_size", text.alias("text"), F.replace("p_name", F.lit(" "), F.lit(" . ")).alias("expected"))
    return evaluation.recovery_rate(rows, ["p_size"])
