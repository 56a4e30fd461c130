"""Each stage of the pipeline on its own input, against plain Python."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import pytest

pytest.importorskip("provenia.llm")
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists() or not Path(corpus_pipeline.VOCABULARY).exists(), reason="no tables or vocabulary here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        step(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        seen[name] = (before, after)
        if name != "encode":
            assert docs.columns == columns and all(before[r.doc_id] == r for r in after)
    before, after = seen["quality"]
    clean = [d for d in before if quality.get(d) == 1]
    kept = {r.doc_id for r in after}
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    before, after = seen["exact dedup"]
    least: dict = {}
    for d in sorted(before):
        least.setdefault(norm(before[d].text), d)
    assert {r.doc_id for r in after} == set(least.values())
    from test_llm import classes

    before, after = seen["near duplicates"]
    assert {r.doc_id for r in after} == {c for _, _, c in classes([(d, r.text) for d, r in before.items()])}
    before, after = seen["mix"]
    assert Counter(r.doc_id for r in after) == Counter(list(before))
    before, after = seen["encode"]
    assert {r.doc_id for r in after} == set(before) and all(r.n_tokens > 0 for r in after)


def test_near_copies_by_row(spark):
    """An id may stand on several rows or be null: one row of each group stays, and no text is lost with another's."""
    words = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(1, words("a")), (2, words("a") + " z"), (2, words("b")), (3, words("c")), (3, words("c") + " z"), (None, words("a") + " y"), (None, words("d")), (None, words("d") + " z"), (4, None), (4, "")]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert len(got) == 6 and Counter(r.doc_id for r in got) == {1: 1, 2: 1, 3: 1, None: 1, 4: 2}
    texts = {r.doc_id: r.text for r in got}
    least = lambda *x: min(x, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert texts[1] == words("a") and texts[2] == words("b")
    assert texts[3] == least(words("c"), words("c") + " z") and texts[None] == least(words("d"), words("d") + " z")


def test_order_of_the_mix_reaches_the_end(spark, tmp_path):
    """Each document's position in the last stage is its place in the schedule; small files' row counts differ, and readers deal them out by size."""
    from provenia.llm.mixing import mix_order

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.limit(190).union(docs.limit(190).selectExpr("doc_id + 100000", *[c for c in docs.columns if c != "doc_id"]).limit(50))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    corpus_pipeline.mix(spark, docs, SF).write.option("maxRecordsPerFile", 30).parquet(f"{tmp_path}/mix")
    got = {r.doc_id: r.position for r in corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mix"), SF).collect()}
    assert len(got) == 240 and got == {r.doc_id: r.position for r in mix_order(docs).collect()}


def test_encode_returns_the_ids(spark, tmp_path):
    import struct

    spark.read.parquet(f"{SF}/documents.parquet").limit(40).write.parquet(f"{tmp_path}/mix")
    out = corpus_pipeline.encode(spark, spark.read.parquet(f"{tmp_path}/mix"), SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "position"]
    for r in out.collect():
        assert len(r.ids) == r.n_tokens and hashlib.sha256(struct.pack(f"<{r.n_tokens}I", *r.ids)).hexdigest() == r.ids_sha256


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
