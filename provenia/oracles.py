"""The queries' answers in SQL, computed from source columns and fault moduli wherever a query reads them back out of text."""

IT = "translate(format('{{:,.2f}}', CAST({0} AS DOUBLE)), ',.', '.,')"


def italian(x: str) -> str:
    return IT.format(x)


POD = "'IT' || lpad(CAST(c % 1000 AS VARCHAR), 3, '0') || 'E' || lpad(CAST(k % 100000000 AS VARCHAR), 8, '0')"

#: One row for each bill: k order, c customer, dates, amounts, place in its file, and the segment of its instance.
BILLS = """
bands AS (SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS f1,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS f2,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS f3 FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d0, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS d1, o_orderkey % 60 + 1 AS days,
    CAST(o_totalprice AS DECIMAL(18,2)) AS total, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, coalesce(f3, 0) AS f3, coalesce(f1, 0) + coalesce(f2, 0) + coalesce(f3, 0) AS kwh
    FROM orders LEFT JOIN bands ON l_orderkey = o_orderkey),
b AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d0, k) AS n, count(*) OVER (PARTITION BY c) AS bills, bool_or(k % 17 = 0) OVER (PARTITION BY c) AS scanned,
    CASE WHEN k % 13 = 0 THEN CAST(round(CAST(kwh AS DECIMAL(18,4)) * 11 / 10 + 1, 2) AS DECIMAL(18,2)) ELSE kwh END AS printed_kwh,
    'C' || c || '.pdf' AS file FROM o),
x AS (SELECT *, CASE WHEN scanned THEN 0 ELSE n - 1 END AS seg,
    'C' || c || CASE WHEN scanned OR bills = 1 THEN '' WHEN n <= 26 THEN chr(CAST(96 + n AS INTEGER)) ELSE chr(CAST(96 + (n - 1) // 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER)) END AS instance_id FROM b)"""


def cell(field: str, raw: str, value: str, where: str = "true") -> str:
    return f"SELECT file, instance_id, seg, '{field}' AS field, {raw} AS raw, {value} AS value FROM x WHERE {where}"


def _money(field: str, c: str) -> str:
    return cell(field, italian(c), f"CAST({c} AS VARCHAR)", "k % 17 <> 0")


#: What is printed on digital pages, then the one capture of each field of each instance, then values in columns.
READ = (
    "WITH "
    + BILLS
    + ", printed AS ("
    + " UNION ALL ".join(
        [
            cell("pod", POD, POD, "k % 17 <> 0 AND k % 19 <> 0"),
            cell("fornitore", "'Fornitore ' || c % 7", "'Fornitore ' || c % 7"),
            cell("periodo_da", "CASE WHEN k % 23 = 0 THEN '31/02/' || year(d0) ELSE strftime(d0, '%d/%m/%Y') END", "CASE WHEN k % 23 <> 0 THEN CAST(d0 AS VARCHAR) END"),
            cell("periodo_a", "strftime(d1, '%d/%m/%Y')", "CAST(d1 AS VARCHAR)"),
            cell("giorni", "CAST(days AS VARCHAR)", "CAST(days AS VARCHAR)", "k % 5 <> 0"),
            _money("kwh_totale", "printed_kwh"),
            _money("kwh_f1", "f1"),
            _money("kwh_f2", "f2"),
            _money("kwh_f3", "f3"),
            cell("importo_totale", f"CASE WHEN k % 29 = 0 THEN CAST(CAST(floor(total) AS BIGINT) // 1000 AS VARCHAR) || '.' || lpad(CAST(CAST(floor(total) AS BIGINT) % 1000 AS VARCHAR), 3, '0') ELSE {italian('total')} END", "CASE WHEN k % 29 <> 0 THEN CAST(total AS VARCHAR) END"),
            cell("importo_totale", italian("total + 10"), "CAST(total + 10 AS VARCHAR)", "k % 11 = 0"),
        ]
    )
    + """),
inst AS (SELECT file, instance_id, seg, min(n) * 2 - 1 AS page_from, max(n) * 2 AS page_to, bool_or(scanned) AS scanned FROM x GROUP BY ALL),
names AS (SELECT unnest(['pod', 'fornitore', 'periodo_da', 'periodo_a', 'giorni', 'kwh_totale', 'kwh_f1', 'kwh_f2', 'kwh_f3', 'importo_totale']) AS field),
one AS (SELECT file, instance_id, seg, field, min(raw) AS raw, min(value) AS value FROM printed GROUP BY ALL HAVING count(DISTINCT raw) = 1),
got AS (SELECT i.file, i.instance_id, i.seg, f.field, one.value, one.raw, CASE WHEN one.raw IS NULL THEN 'non_estratto' WHEN one.value IS NULL THEN 'non_normalizzabile' ELSE 'normalizzato' END AS outcome
    FROM inst i CROSS JOIN names f LEFT JOIN one ON one.file = i.file AND one.seg = i.seg AND one.field = f.field),
w AS (SELECT file, instance_id, seg, """
    + ", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in ("pod", "fornitore", "periodo_da", "periodo_a", "giorni", "kwh_totale", "kwh_f1", "kwh_f2", "kwh_f3", "importo_totale"))
    + """ FROM got GROUP BY ALL),
g AS (SELECT *, CASE WHEN kwh_totale IS NULL AND kwh_f1 IS NOT NULL AND kwh_f2 IS NOT NULL AND kwh_f3 IS NOT NULL THEN CAST(CAST(kwh_f1 AS DECIMAL(18,2)) + CAST(kwh_f2 AS DECIMAL(18,2)) + CAST(kwh_f3 AS DECIMAL(18,2)) AS VARCHAR) END AS d_kwh,
    CASE WHEN periodo_da IS NULL AND periodo_a IS NOT NULL AND giorni IS NOT NULL THEN CAST(CAST(periodo_a AS DATE) - (CAST(giorni AS INTEGER) - 1) AS VARCHAR) END AS d_da,
    CASE WHEN periodo_a IS NULL AND periodo_da IS NOT NULL AND giorni IS NOT NULL THEN CAST(CAST(periodo_da AS DATE) + (CAST(giorni AS INTEGER) - 1) AS VARCHAR) END AS d_a,
    CASE WHEN giorni IS NULL AND periodo_da IS NOT NULL AND periodo_a IS NOT NULL THEN CAST(CAST(periodo_a AS DATE) - CAST(periodo_da AS DATE) + 1 AS VARCHAR) END AS d_giorni FROM w),
v AS (SELECT file, instance_id, seg, pod, fornitore, coalesce(periodo_da, d_da) AS periodo_da, coalesce(periodo_a, d_a) AS periodo_a, coalesce(giorni, d_giorni) AS giorni, coalesce(kwh_totale, d_kwh) AS kwh_totale, kwh_f1, kwh_f2, kwh_f3, importo_totale, d_kwh, d_da, d_a, d_giorni FROM g),
inv AS (SELECT *, CASE WHEN kwh_f1 IS NULL OR kwh_f2 IS NULL OR kwh_f3 IS NULL OR kwh_totale IS NULL THEN NULL ELSE abs(CAST(kwh_f1 AS DECIMAL(18,4)) + CAST(kwh_f2 AS DECIMAL(18,4)) + CAST(kwh_f3 AS DECIMAL(18,4)) - CAST(kwh_totale AS DECIMAL(18,4))) <= abs(CAST(kwh_totale AS DECIMAL(18,4))) * 0.005 END AS somma_fasce,
    CASE WHEN periodo_da IS NULL OR periodo_a IS NULL OR giorni IS NULL THEN NULL ELSE CAST(periodo_a AS DATE) - CAST(periodo_da AS DATE) + 1 = CAST(giorni AS BIGINT) END AS giorni_inclusivi,
    CAST(kwh_totale AS DECIMAL(18,2)) >= 0 AS kwh_totale_non_negativo, CAST(kwh_f1 AS DECIMAL(18,2)) >= 0 AS kwh_f1_non_negativo, CAST(kwh_f2 AS DECIMAL(18,2)) >= 0 AS kwh_f2_non_negativo, CAST(kwh_f3 AS DECIMAL(18,2)) >= 0 AS kwh_f3_non_negativo, CAST(importo_totale AS DECIMAL(18,2)) >= 0 AS importo_totale_non_negativo,
    CAST(periodo_a AS DATE) >= CAST(periodo_da AS DATE) AS periodo_ordinato, regexp_full_match(pod, 'IT[0-9]{3}E[0-9]{8}') AS formato_pod FROM v)"""
)
FIELDS = ("pod", "fornitore", "periodo_da", "periodo_a", "giorni", "kwh_totale", "kwh_f1", "kwh_f2", "kwh_f3", "importo_totale")
CHECKS = {
    "somma_fasce": ("kwh_f1", "kwh_f2", "kwh_f3", "kwh_totale"),
    "giorni_inclusivi": ("periodo_da", "periodo_a", "giorni"),
    "kwh_totale_non_negativo": ("kwh_totale",),
    "kwh_f1_non_negativo": ("kwh_f1",),
    "kwh_f2_non_negativo": ("kwh_f2",),
    "kwh_f3_non_negativo": ("kwh_f3",),
    "importo_totale_non_negativo": ("importo_totale",),
    "periodo_ordinato": ("periodo_da", "periodo_a"),
    "formato_pod": ("pod",),
}
DERIVED = {"kwh_totale": "d_kwh", "periodo_da": "d_da", "periodo_a": "d_a", "giorni": "d_giorni"}


def _row(f: str) -> str:
    judged = [i for i, names in CHECKS.items() if f in names]
    count = lambda ok: " + ".join(f"CAST(coalesce({i} = {ok}, false) AS BIGINT)" for i in judged) or "CAST(0 AS BIGINT)"
    origin = f"CASE WHEN {f} IS NULL THEN NULL " + (f"WHEN {DERIVED[f]} IS NOT NULL THEN 'derivato' " if f in DERIVED else "") + "ELSE 'tier0' END"
    return f"SELECT file, instance_id, seg, '{f}' AS field, {f} AS value, {origin} AS origin, CASE WHEN {f} IS NULL THEN 'tier1_non_tentato' END AS status, {count('true')} AS passed, {count('false')} AS failed FROM inv"


ROWS = READ + ", rows AS (" + " UNION ALL ".join(map(_row, FIELDS)) + "), told AS (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN failed > 0 THEN 'bassa' WHEN origin = 'derivato' THEN 'media' ELSE 'alta' END AS confidence FROM rows)"
BROKEN = " OR ".join(f"coalesce(NOT {i}, false)" for i in CHECKS)
GATE = READ + f", gate AS (SELECT file, instance_id, seg, CASE WHEN pod IS NULL OR periodo_da IS NULL OR periodo_a IS NULL THEN 'reject' WHEN {BROKEN} THEN 'warning' ELSE 'pass' END AS outcome, CASE WHEN pod IS NULL OR periodo_da IS NULL OR periodo_a IS NULL THEN 'campi obbligatori mancanti: ' || concat_ws(', ', CASE WHEN pod IS NULL THEN 'pod' END, CASE WHEN periodo_da IS NULL THEN 'periodo_da' END, CASE WHEN periodo_a IS NULL THEN 'periodo_a' END) END AS reason FROM inv)"

_TRUTH = {"pod": f"CASE WHEN k % 19 <> 0 THEN {POD} END", "periodo_da": "CAST(d0 AS VARCHAR)", "periodo_a": "CAST(d1 AS VARCHAR)", "giorni": "CAST(days AS VARCHAR)", "kwh_totale": "CAST(kwh AS VARCHAR)", "importo_totale": "CAST(total AS VARCHAR)"}
EVAL = (
    ROWS
    + ", truth AS ("
    + " UNION ALL ".join(f"SELECT 'D' || k AS doc_key, file, seg, scanned AND bills > 1 AS misaligned, '{f}' AS field, {t} AS expected FROM x" for f, t in _TRUTH.items())
    + """), cmp AS (SELECT t.doc_key, t.field, t.misaligned, CASE WHEN t.misaligned THEN NULL ELSE r.value END AS value, CASE WHEN t.misaligned THEN 'non_estratto' ELSE g.outcome END AS outcome,
    NOT t.misaligned AND CASE WHEN t.field IN ('kwh_totale', 'importo_totale') THEN CAST(r.value AS DECIMAL(18,2)) IS NOT DISTINCT FROM CAST(t.expected AS DECIMAL(18,2)) ELSE lower(r.value) IS NOT DISTINCT FROM lower(t.expected) END AS correct
    FROM truth t LEFT JOIN rows r ON r.file = t.file AND r.seg = t.seg AND r.field = t.field LEFT JOIN got g ON g.file = t.file AND g.seg = t.seg AND g.field = t.field)"""
)

ARBITRATED = """WITH s AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS t, o_orderpriority AS p, o_orderkey AS k FROM orders),
r AS (SELECT o_orderkey, 'total' AS field, k % 7 > 0 AND k % 3 <> 0 AS agreed, CASE WHEN k % 7 > 0 AND k % 3 <> 0 THEN CAST(t AS VARCHAR) END AS value, k % 7 > 0 AS ra, k % 3 <> 0 AS rb FROM s
UNION ALL SELECT o_orderkey, 'status', k % 5 <> 0, CASE WHEN k % 5 <> 0 THEN p END, k % 5 <> 0, true FROM s)"""


def runs(table: str, by: str, order: str, key: str) -> str:
    return f"""WITH c AS (SELECT *, CASE WHEN lag({key}) OVER w IS DISTINCT FROM {key} AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS new FROM {table} WINDOW w AS (PARTITION BY {by} ORDER BY {order})),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM c)"""


#: Files of four pages with a word on the first, third or fourth, of which the first three are read; the third may be null.
MIXED = """WITH w AS (SELECT 'F' || o_orderkey || '.pdf' AS file, o_orderkey % 5 AS w, o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AND o_orderkey % 7 > 0 AS seen FROM orders),
c AS (SELECT file, CASE WHEN NOT seen OR w IN (2, 4) THEN 'sconosciuto' WHEN w = 0 THEN 'bolletta_luce' WHEN w = 1 THEN 'bolletta_gas' ELSE 'cte' END AS class FROM w),
f AS (SELECT file, class, CASE class WHEN 'bolletta_gas' THEN 'bolletta_gas_it' WHEN 'cte' THEN 'cte_it' ELSE 'bolletta_luce_it' END AS schema FROM c)"""

ORACLES: dict[str, str] = {
    "extract_fields": READ + " SELECT file, instance_id, field, value, raw, outcome FROM got",
    "extract_diagnosis_counts": READ + " SELECT field, outcome, count(*) AS n FROM got GROUP BY ALL",
    "unique_capture_ambiguity": READ + " SELECT file, instance_id FROM got WHERE field = 'importo_totale' AND outcome = 'non_estratto'",
    **{q: READ + " SELECT file, instance_id, field, value, raw, outcome FROM got WHERE field IN ('pod', 'fornitore', 'kwh_f1', 'kwh_totale')" for q in ("extract_by_label", "extract_found_by")},
    "repair_decimal": f"""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, l_partkey AS k FROM lineitem),
y AS (SELECT l_orderkey, l_linenumber, CAST(k // 1000 AS VARCHAR) AS a, lpad(CAST(k % 1000 AS VARCHAR), 3, '0') AS z, p FROM x)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN {italian("p")} WHEN 1 THEN CAST(p AS VARCHAR) WHEN 2 THEN a || '.' || z ELSE '1.' || z || '.567' END AS raw,
CASE l_linenumber % 4 WHEN 0 THEN CAST(p AS VARCHAR) WHEN 1 THEN CAST(p AS VARCHAR) WHEN 2 THEN NULL ELSE '1' || z || '567' END AS value FROM y""",
    "repair_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS value FROM orders",
    "repair_integer": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size * 1000 + p_partkey % 1000 AS VARCHAR) WHEN 2 THEN CAST(-p_size AS VARCHAR) END AS value FROM part",
    "repair_string": "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS value FROM part",
    "segment_invoices": READ + " SELECT file, instance_id, CAST(page_from AS INTEGER) AS page_from, CAST(page_to AS INTEGER) AS page_to, CASE WHEN scanned THEN 'non_determinabile' ELSE 'certa' END AS seg_confidence FROM inst",
    "segmentation_confidence": READ + " SELECT CASE WHEN scanned THEN 'non_determinabile' ELSE 'certa' END AS seg_confidence, count(*) AS instances, count(DISTINCT file) AS files FROM inst GROUP BY 1",
    "segment_roles": runs("conversations", "conv_id", "turn", "role") + " SELECT conv_id, segment, count(*) AS n, min(turn) AS first, max(turn) AS last FROM s GROUP BY ALL",
    "segment_event_runs": runs("events", "user_id", "ts, event_id", "event_type") + " SELECT user_id, segment, count(*) AS n FROM s GROUP BY ALL",
    "page_coverage": "WITH c AS (SELECT p_partkey, len(list_filter(range(64), lambda i: (i + 0.5) / 64 <= p_size / 50.0)) / 64.0 AS coverage FROM part) SELECT p_partkey, CAST(coverage AS DOUBLE) AS coverage, CASE WHEN coverage < 0.15 THEN 'digitale' WHEN coverage > 0.85 THEN 'scansione' ELSE 'ibrida' END AS page_type FROM c",
    "page_density": "SELECT doc_id, round(CASE WHEN doc_id % 50 = 0 THEN 0.0 ELSE n_chars / (595.0::DOUBLE * 842.0) END, 8) AS density FROM documents",
    "classify_documents": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'bolletta_luce' WHEN 1 THEN 'bolletta_gas' WHEN 3 THEN 'cte' WHEN 4 THEN 'cte' ELSE 'sconosciuto' END AS class FROM documents",
    "inv_approx_sum": "WITH " + BILLS + """ SELECT k AS o_orderkey, 'somma_fasce' AS id, CASE WHEN k % 31 = 0 THEN 'none' WHEN abs(kwh - t) <= abs(t) * 0.005 THEN 'pass' ELSE 'fail' END AS verdict
FROM (SELECT k, kwh, CAST(round(kwh * CAST(CASE k % 3 WHEN 0 THEN 1.005 WHEN 1 THEN 1.006 ELSE 1 END AS DECIMAL(5,3)), 2) AS DECIMAL(18,2)) AS t FROM o)""",
    "inv_dates": """WITH x AS (SELECT CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b, CASE WHEN l_orderkey % 4 > 0 THEN l_linenumber * 10 END AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT id, verdict, count(*) AS n FROM (SELECT 'periodo_ordinato' AS id, CASE WHEN b >= a THEN 'pass' ELSE 'fail' END AS verdict FROM x UNION ALL SELECT 'giorni_inclusivi', CASE WHEN n IS NULL THEN 'none' WHEN b - a + 1 = n THEN 'pass' ELSE 'fail' END FROM x) GROUP BY ALL""",
    "inv_min_value": "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'pass' ELSE 'fail' END AS verdict FROM customer",
    "inv_format": "SELECT p_partkey, CASE WHEN regexp_full_match(p_brand, 'Brand#[0-9][0-9]') THEN 'pass' ELSE 'fail' END AS verdict FROM part",
    "inv_tristate": READ + " " + " UNION ALL ".join(f"SELECT '{i}' AS id, count(*) FILTER ({i}) AS passed, count(*) FILTER (NOT {i}) AS failed, count(*) FILTER ({i} IS NULL) AS not_judged FROM inv" for i in CHECKS),
    "derive_values": ROWS + " SELECT file, instance_id, field, value, origin FROM told",
    "derive_lineage": READ + """ SELECT field, tipo, invariante_id, da_campi, n FROM (SELECT 'kwh_totale' AS field, 'somma_approssimata' AS tipo, 'somma_fasce' AS invariante_id, 'kwh_f1,kwh_f2,kwh_f3' AS da_campi, count(d_kwh) AS n FROM v
UNION ALL SELECT 'periodo_da', 'differenza_giorni', 'giorni_inclusivi', 'periodo_a,giorni', count(d_da) FROM v UNION ALL SELECT 'periodo_a', 'differenza_giorni', 'giorni_inclusivi', 'periodo_da,giorni', count(d_a) FROM v
UNION ALL SELECT 'giorni', 'differenza_giorni', 'giorni_inclusivi', 'periodo_da,periodo_a', count(d_giorni) FROM v) WHERE n > 0""",
    "evidence_rows": ROWS + " SELECT field, origin, status, passed, failed, count(*) AS n FROM told GROUP BY ALL",
    "confidence_hist": ROWS + " SELECT field, confidence, count(*) AS n FROM told GROUP BY ALL",
    "gate_verdicts": GATE + " SELECT file, instance_id, outcome, reason FROM gate",
    "gate_hist": GATE + " SELECT outcome, count(*) AS n FROM gate GROUP BY ALL",
    "fill_not_overwrite": "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END) AS value, CASE WHEN o_orderkey % 3 > 0 THEN 'tier0' WHEN o_orderkey % 4 > 0 THEN 'tier1' END AS origin FROM orders",
    "arbitrate_sources": ARBITRATED + " SELECT o_orderkey, field, agreed, value FROM r",
    "arbitration_summary": ARBITRATED
    + """ SELECT count(*) AS compared, count(*) FILTER (NOT agreed) AS disagreements, round(count(*) FILTER (NOT agreed) / count(*), 6) AS disagreement_rate, count(*) FILTER (NOT agreed AND ra) AS a_right, count(*) FILTER (NOT agreed AND rb) AS b_right,
count(*) FILTER (NOT agreed AND NOT ra AND NOT rb) AS neither_right, round(count(*) FILTER (agreed AND ra) / count(*) FILTER (agreed), 6) AS accuracy_agreed FROM r""",
    "eval_field_accuracy": EVAL
    + """ SELECT field, count(*) AS total, count(*) FILTER (outcome = 'non_estratto') AS not_extracted, count(*) FILTER (outcome = 'non_normalizzabile') AS not_normalisable, count(*) FILTER (outcome = 'normalizzato') AS normalised,
count(*) FILTER (correct) AS correct, count(*) FILTER (value IS NOT NULL AND NOT correct AND NOT misaligned) AS invented, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM cmp GROUP BY ALL""",
    "eval_document_accuracy": EVAL + " SELECT count(*) AS documents, count(*) FILTER (r) AS correct, count(*) FILTER (m) AS misaligned FROM (SELECT doc_key, bool_and(correct) AS r, bool_or(misaligned) AS m FROM cmp GROUP BY 1)",
    "eval_verdicts": GATE + " SELECT CASE WHEN x.scanned AND x.bills > 1 THEN 'reject' ELSE gate.outcome END AS verdict, count(*) AS documents FROM x JOIN gate ON gate.file = x.file AND gate.seg = x.seg GROUP BY 1",
    "coverage_vs_accuracy": """SELECT lang, total, answered, "right", round(answered / total, 6) AS coverage, round(CASE WHEN answered = 0 THEN 0 ELSE "right" / answered END, 6) AS accuracy FROM
(SELECT lang, count(*) AS total, count(quality) AS answered, count(*) FILTER (quality = CAST(n_chars >= 1000 AS INTEGER)) AS "right" FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)""",
    "worst_attribute": """SELECT lang AS worst, score FROM (SELECT lang, round(count(*) FILTER (quality = CAST(n_chars >= 1000 AS INTEGER)) / count(quality), 6) AS score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) ORDER BY score, worst LIMIT 1""",
    "reply_parse": """SELECT k AS o_orderkey, CASE WHEN ok THEN t END AS total, CASE WHEN ok AND k % 4 = 0 THEN '30' WHEN ok AND k % 4 = 3 THEN CAST(k % 100 AS VARCHAR) END AS n, CASE WHEN ok AND k % 3 <> 0 THEN p END AS s, CAST(NULL AS VARCHAR) AS gone
FROM (SELECT o_orderkey AS k, rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') AS t, o_orderpriority AS p, o_orderkey % 13 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 17 <> 0) AS ok FROM orders)""",
    "token_cost_estimate": """WITH c AS (SELECT doc_id AS d, n_chars // 4 AS p, (doc_id % 5 + 1) * 8 AS o, doc_id % 3 + 1 AS m, 1000 + doc_id % 300 AS w, 1400 + doc_id % 200 AS h FROM documents),
m AS (SELECT * FROM (VALUES ('steady', 4.0, 16.0, 1), ('quick', 0.8, 3.2, 1), ('tiled', 2.0, 9.0, 2), ('tiled-quick', 0.2, 0.7, 3)) AS v(model, i, u, f)),
t AS (SELECT model, i, u, o, p + c.m * CASE f WHEN 1 THEN ceil(w * h / 750) WHEN 2 THEN 85 + 170 * ceil(w / 512) * ceil(h / 512) ELSE 4 * (85 + 170 * ceil(w / 512) * ceil(h / 512)) END AS n FROM c, m WHERE NOT (d % 10 = 0 AND model = 'quick'))
SELECT model, count(*) AS calls, CAST(sum(n) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round(CAST(sum(n) * any_value(i) / 1e6 + sum(o) * any_value(u) / 1e6 AS DOUBLE), 4) AS cost FROM t GROUP BY 1""",
    "model_bake_off": """WITH c AS (SELECT m.model, m.place, doc_id AS d, lang, source, doc_id % 41 = 0 AS failed, CASE WHEN doc_id % 41 = 0 THEN 0 ELSE n_chars * m.i / 1e6 + doc_id % 50 * m.u / 1e6 END AS cost FROM documents, (VALUES ('steady', 1, 4.0::DOUBLE, 16.0::DOUBLE), ('tiled', 2, 2.0::DOUBLE, 9.0::DOUBLE)) AS m(model, place, i, u)),
s AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY place, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 12 AS skipped FROM c),
b AS (SELECT *, NOT skipped AND NOT failed AS made, d % 3 > 0 AND d % 5 > 0 AS one, d % 7 > 0 AS two FROM s),
a AS (SELECT model, count(*) AS calls, count(*) FILTER (made) AS made, count(*) FILTER (failed AND NOT skipped) AS failed, count(*) FILTER (skipped) AS skipped, coalesce(sum(cost) FILTER (made), 0) AS cost, median(CASE WHEN d % 9 > 0 THEN CAST(d % 97 AS DOUBLE) END) FILTER (made) AS p,
count(*) FILTER (made AND one) + count(*) FILTER (made AND two) AS correct, count(*) FILTER (made) * 2 AS total, count(*) FILTER (made AND d % 3 > 0 AND d % 5 = 0 AND lang IS NOT NULL) + count(*) FILTER (made AND NOT two AND source IS NOT NULL) AS invented, count(*) FILTER (made AND one AND two) AS documents_correct, CAST(coalesce(sum(CASE WHEN d % 4 = 0 THEN d % 3 ELSE 0 END) FILTER (made), 0) AS BIGINT) AS violations FROM b GROUP BY 1)
SELECT model, calls, made, failed, skipped, round(cost, 4) AS cost, round(cost / calls, 6) AS cost_per_document, round(p, 6) AS p50_latency, correct, total, invented, round(CASE WHEN total = 0 THEN 0 ELSE correct / total END, 6) AS accuracy, documents_correct, round(documents_correct / calls, 6) AS document_accuracy, violations, skipped > 0 AS stopped FROM a""",
    "budget_window": "WITH s AS (SELECT doc_id, CAST(coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS spent_before FROM documents) SELECT doc_id, spent_before, spent_before > 1000000 AS skipped FROM s",
    "latency_p50": "SELECT event_type, round(median(value), 6) AS p50 FROM events GROUP BY 1",
    "content_keys": "SELECT doc_id, sha256(text || lang) AS key FROM documents",
    "inventory": "SELECT url || '/' || page_id AS path, CAST(page_id AS VARCHAR) AS file, string_split(url, '/')[-1] AS supplier, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS bytes FROM pages",
    "contract_faults": """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS v FROM orders)
SELECT unnest(['value_origin', 'value_confidence', 'missing_status', 'known_verdict']) AS rule, unnest([count(*) FILTER (k % 11 = 0), count(*) FILTER (k % 13 = 0), count(*) FILTER (k % 17 = 0), count(*) FILTER (k % 19 = 0)]) AS faults FROM r""",
    "result_json_fields": GATE + " SELECT file, instance_id, outcome, reason FROM gate",
    "missing_fields": "SELECT * FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'a' END, CASE WHEN o_orderkey % 5 = 0 THEN 'b' END, CASE WHEN o_orderkey % 7 = 0 THEN 'c' END) AS asked FROM orders) WHERE asked <> ''",
    "page_rotations": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 = 0 AND p_partkey % 4 > 0 THEN p_partkey % 4 * 90 WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 2 * 180 END ELSE 0 END AS INTEGER) AS rotation FROM part",
    "classify_bill_files": MIXED + " SELECT file, class, schema, class = 'sconosciuto' AS fell_back FROM f",
    "extract_mixed_files": MIXED + " SELECT class, schema, CASE WHEN schema = 'bolletta_gas_it' THEN 'no schema given for ' || class END AS lost, count(*) AS files FROM f GROUP BY ALL",
    "cache_keys": r"""SELECT doc_id, sha256(unhex(lpad(hex(strlen(text)), 16, '0')) || encode(text) || unhex(lpad(hex(strlen(lang)), 16, '0')) || encode(lang) || '\x00'::BLOB || encode('prompt') || '\x00'::BLOB || encode(source) || '\x00'::BLOB || encode('1')) AS key FROM documents""",
    "reply_log_status": """WITH w AS (SELECT doc_id AS d, doc_id % 4 AS n, doc_id % 4 AS written FROM documents UNION ALL SELECT doc_id, 3, 3.5 FROM documents WHERE doc_id % 9 = 0),
r AS (SELECT d, max(CASE WHEN written < 1.5 THEN 1 WHEN d % 5 = n OR d % 7 = n THEN 2 ELSE 3 END) AS best FROM w GROUP BY d)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE ['expired', 'corrupt', 'hit'][best] END AS status FROM documents JOIN r ON d = doc_id""",
    "provider_dispatch": """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 23 <> 0 THEN lower(regexp_extract(o_orderpriority, '[A-Z]+')) || '-' || o_orderkey % 50 END AS model FROM orders),
t(prefix, provider) AS (VALUES ('high', 'one'), ('high-4', 'two'), ('high-42', 'three'), ('low-', 'one'), ('low-1', 'two'), ('urgent-7', 'three'), ('not-', 'two'), ('not-1', 'four'), ('nota', 'never')),
b AS (SELECT o_orderkey, arg_max(provider, length(prefix)) AS provider FROM m JOIN t ON starts_with(model, prefix) GROUP BY 1)
SELECT o_orderkey, provider, provider IS NULL AS unknown FROM m LEFT JOIN b USING (o_orderkey)""",
    "page_orientations": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 17 = 0 OR p_partkey % 19 = 0 OR p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 4 * 90 END AS INTEGER) AS rotation FROM part",
    "composition_counts": """SELECT attribute, value, count(*) AS documents FROM (SELECT unnest(['lang', 'source', 'single_rate']) AS attribute, unnest([coalesce(lang, 'n/d'), coalesce(source, 'n/d'), CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 2 = 0 AS VARCHAR) ELSE 'n/d' END]) AS value FROM documents) GROUP BY ALL""",
    "eval_diagnosis": EVAL
    + """, d AS (SELECT doc_key, bool_or(misaligned) AS misaligned, count(*) FILTER (correct) AS correct, count(*) FILTER (outcome = 'non_estratto') AS not_extracted, count(*) FILTER (outcome = 'non_normalizzabile') AS odd, count(*) FILTER (outcome = 'normalizzato' AND NOT correct AND NOT misaligned) AS wrong FROM cmp GROUP BY 1)
SELECT misaligned, CASE WHEN misaligned THEN 'misaligned' WHEN not_extracted > 0 THEN 'non_estratto' WHEN odd > 0 THEN 'non_normalizzabile' WHEN wrong > 0 THEN 'wrong' END AS first_loss, count(*) AS documents, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(not_extracted) AS BIGINT) AS not_extracted, CAST(sum(wrong) AS BIGINT) AS wrong FROM d GROUP BY ALL""",
    "triage_attributes": """WITH x AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n, bool_or(o_orderkey % 17 = 0) OVER (PARTITION BY o_custkey) AS scanned FROM orders),
p AS (SELECT c, k, unnest([1, 2]) AS side, unnest([r * 2 - 1, r * 2]) AS page FROM x),
f AS (SELECT c, any_value(n) AS n, any_value(scanned) AS scanned FROM x GROUP BY c)
SELECT (SELECT count(*) FROM f) AS files, CAST(0 AS BIGINT) AS certain_but_wrong, round((SELECT count(*) FILTER (n = 1 OR NOT scanned) / count(*) FROM f), 6) AS counts, round((SELECT count(*) FILTER (n = 1 OR NOT scanned) / count(*) FROM f), 6) AS ranges,
round(count(*) FILTER (side = 1 OR k % 17 <> 0) / count(*), 6) AS types, round(count(*) FILTER (page % 3 > 0) / count(*), 6) AS rotation_coverage, round(count(*) FILTER (page % 3 > 0 AND page % 2 = 0) / count(*) FILTER (page % 3 > 0), 6) AS rotation FROM p""",
    "contract_check": "SELECT unnest(['value_origin', 'value_confidence', 'missing_status', 'known_verdict']) AS rule, CAST(0 AS BIGINT) AS faults",
    "feature_margins": """WITH p AS (SELECT len(list_filter(range(64), lambda i: (i + 0.5) / 64 <= p_partkey % 51 / 50.0)) / 64.0::DOUBLE AS c, CASE WHEN p_partkey % 51 > 46 THEN 0 ELSE length(p_name) END / (595.0::DOUBLE * 842.0) AS n FROM part),
t AS (SELECT *, CASE WHEN c < 0.15 THEN 'digitale' WHEN c > 0.85 THEN 'scansione' ELSE 'ibrida' END AS page_type FROM p),
g AS (SELECT page_type, count(*) AS pages, min(c) AS c0, max(c) AS c1, median(c) AS c2, min(n) AS n0, max(n) AS n1, median(n) AS n2 FROM t GROUP BY 1)
SELECT page_type, pages, round(c0, 9) AS min_coverage, round(c1, 9) AS max_coverage, round(c2, 9) AS median_coverage, round(n0, 9) AS min_density, round(n1, 9) AS max_density, round(n2, 9) AS median_density,
round(CASE page_type WHEN 'digitale' THEN 0.15 / nullif(c1, 0) WHEN 'scansione' THEN c0 / 0.85 END, 9) AS margin, round(CASE page_type WHEN 'digitale' THEN n0 / 1e-5 WHEN 'scansione' THEN 1e-5 / nullif(n1, 0) END, 9) AS density_margin FROM g""",
    "median_price": "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS price, round(median(CASE WHEN l_linenumber % 3 > 0 THEN l_quantity * l_discount - 1 END), 6) AS signed FROM lineitem GROUP BY 1, 2",
    "declared_ranges": "WITH " + BILLS + """, p AS (SELECT file, n * 2 - 1 AS page FROM b UNION ALL SELECT file, n * 2 FROM b),
r AS (SELECT file, 'D' || k AS doc_key, n * 2 - 1 AS a, n * 2 + 1 AS z FROM b UNION ALL SELECT DISTINCT file, 'F' || c, 1, 5 FROM b UNION ALL SELECT DISTINCT file, 'M' || c, 1, 1000000 FROM b UNION ALL SELECT DISTINCT file, 'O' || c, 4, 1000000000 FROM b)
SELECT r.file, doc_key, count(*) AS pages, CAST(min(page) AS INTEGER) AS first, CAST(max(page) AS INTEGER) AS last, CAST(sum(page) AS BIGINT) AS places FROM r JOIN p ON p.file = r.file AND p.page BETWEEN a AND z GROUP BY ALL""",
    "extract_declared": "WITH " + BILLS + f""" SELECT file, CAST(k AS VARCHAR) AS instance_id, CAST(n * 2 - 1 AS INTEGER) AS page_from, CAST(n * 2 AS INTEGER) AS page_to, CASE WHEN k % 17 <> 0 AND k % 19 <> 0 THEN {POD} END AS pod, CASE WHEN k % 5 <> 0 THEN CAST(days AS VARCHAR) END AS giorni, CASE WHEN k % 11 <> 0 AND k % 29 <> 0 THEN CAST(total AS VARCHAR) END AS importo_totale FROM b""",
    "named_patterns": """WITH t AS (SELECT o_orderkey AS k, o_orderpriority AS p, list_distinct(regexp_extract_all(CAST(o_orderkey AS VARCHAR), '00|11|22|33|44|55|66|77|88|99')) AS d FROM orders),
v AS (SELECT k, 'priority' AS field, p[1] AS value FROM t UNION ALL SELECT k, 'clerk', CAST(k % 1000 AS VARCHAR) FROM t UNION ALL SELECT k, 'twice', CASE WHEN len(d) = 1 THEN d[1][1] END FROM t UNION ALL SELECT k, 'closed', CASE WHEN k % 6 = 0 THEN '<' END FROM t)
SELECT k AS o_orderkey, field, value, CASE WHEN value IS NULL THEN 'non_estratto' ELSE 'normalizzato' END AS outcome FROM v""",
    "recovery_rate": "SELECT p_size, count(*) AS total, count(*) FILTER (p_partkey % 4 <> 0) AS recovered FROM part GROUP BY 1",
}
