"""Pages that arrive one by one."""

PAGE = "file string, page_no int, total_pages int, text string, width double, height double"


def page(file, number, total, text=None):
    return (file, number, total, text if text is not None else f"Code {file[0].upper()}{number}", 595.0, 842.0)


def test_pages_one_by_one(spark, tmp_path):
    """A file in three batches, out of order and with repeats, gives what a batch gives; its pages leave the state."""
    from provenia.plans.compiler import contract, extract
    from provenia.streaming.pages import start
    from test_engine import SMALL, parse

    schema = parse(SMALL)
    batches = [
        [page("a.pdf", 3, None), page("b.pdf", 1, 2), page("a.pdf", 3, None, "Code other"), (None, 1, 1, "x", 1.0, 1.0)],
        [page("a.pdf", 1, 3), page("b.pdf", None, 2), page("b.pdf", 1, 2)],
        [page("a.pdf", 2, 3), page("c.pdf", 1, 1, ""), page("a.pdf", 2, 3)],
        [page("a.pdf", 1, 3), page("c.pdf", 1, 1)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start(stream, schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 4
    got = sorted((r.file, r.instance_id, r.result, r.whole) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    whole = spark.createDataFrame([page("a.pdf", n, 3) for n in (1, 2, 3)] + [page("c.pdf", 1, 1, "")], PAGE).drop("total_pages")
    want = sorted((r.file, r.instance_id, r.result, True) for r in contract(extract(whole, schema), schema).collect())
    assert got == want and len(want) == 4
    state = spark.read.format("statestore").option("stateVarName", "pages").load(f"{tmp_path}/state")
    assert {r.key.file for r in state.collect()} == {"b.pdf"}


def test_a_file_whose_time_is_up_leaves_as_it_is(spark, tmp_path):
    import time

    from provenia.streaming.pages import whole_files

    rows = [page("a.pdf", 1, 3), page("a.pdf", 2, 3), page("z.pdf", 1, 1), page("n.pdf", 1, None)]
    spark.createDataFrame(rows, PAGE).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    out = whole_files(spark.readStream.schema(PAGE).parquet(f"{tmp_path}/in"), wait_ms=2000).writeStream.foreachBatch(lambda df, n: seen.extend(df.collect()))
    query = out.option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    left = lambda: sum(spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/state").count() for name in ("pages", "total", "left"))
    until = time.time() + 90
    while time.time() < until and (len(seen) < 4 or left()):
        time.sleep(2)
    query.stop()
    assert sorted((r.file, r.page_no, r.whole) for r in seen) == [("a.pdf", 1, False), ("a.pdf", 2, False), ("n.pdf", 1, False), ("z.pdf", 1, True)]
    assert left() == 0
