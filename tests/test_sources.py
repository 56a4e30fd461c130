"""Pages from files, and pages that arrive one by one."""

import pytest
from pyspark.sql import functions as F

from provenia.sources.loaders import inventory
from provenia.sources.pages import Piece, pages_of_files, planned


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "files"
    (root / "acme").mkdir(parents=True)
    (root / "acme" / "a.txt").write_text("one\ftwo\fthree")
    (root / "acme" / "b.txt").write_bytes(b"good\xff\fbad")
    (root / "c.txt").write_text("")
    (root / "d.other").write_text("no")
    (root / "long.txt").write_text("\f".join(f"page {i} " + "x" * 50 for i in range(1, 41)))
    return root


def test_plan_covers_each_page_once():
    tasks = planned([("a", 5), ("b", 5), ("c", 25), ("d", 0), ("e", 9)], task_bytes=10, split_pages=4)
    assert tasks == [[Piece("a"), Piece("b")], [Piece("c", 1, 4)], [Piece("c", 5, 8)], [Piece("c", 9, None)], [Piece("d"), Piece("e")]]
    assert planned([]) == []
    pages = [n for task in tasks for p in task if p.path == "c" for n in range(p.first, (p.last or 100) + 1)]
    assert pages == list(range(1, 101))


def test_pages_of_files(spark, folder):
    got = pages_of_files(spark, str(folder), pattern="*.txt", task_bytes=500, split_pages=7)
    rows = got.collect()
    assert [(r.page_no, r.text) for r in sorted((r for r in rows if r.file == "a.txt"), key=lambda r: r.page_no)] == [(1, "one"), (2, "two"), (3, "three")]
    assert [(r.page_no, r.text) for r in rows if r.file == "c.txt"] == [(1, "")]
    broken = [r for r in rows if r.file == "b.txt"]
    assert len(broken) == 1 and broken[0].page_no is None and broken[0].fault.startswith("UnicodeDecodeError") and broken[0].path.endswith("acme/b.txt")
    assert sorted(r.page_no for r in rows if r.file == "long.txt") == list(range(1, 41))
    assert not [r for r in rows if r.file == "d.other"]
    assert got.rdd.getNumPartitions() > 3


def test_filters_reach_the_parser(spark, folder):
    got = pages_of_files(spark, str(folder), parser="provenia.sources.pages:text_pages", pattern="*.txt", task_bytes=500, split_pages=7)
    first = got.filter("page_no <= 2 and file = 'a.txt'").select("page_no", "text")
    assert got.rdd.getNumPartitions() > 3 and first.rdd.getNumPartitions() == 1 and got.filter("file = 'long.txt' and page_no > 7 and page_no < 15").rdd.getNumPartitions() == 1
    assert sorted(map(tuple, first.collect())) == [(1, "one"), (2, "two")]
    assert sorted(r.page_no for r in got.filter("file in ('long.txt', 'a.txt') and page_no > 2 and page_no < 5").collect()) == [3, 3, 4]
    assert got.filter("page_no = 40").select("file").collect()[0].file == "long.txt"
    assert got.filter("page_no < 0").count() == 0
    assert {r.file for r in got.filter(F.col("fault").isNotNull()).collect()} == {"b.txt"}


def test_no_files_and_a_parser_that_dies_late(spark, tmp_path, folder):
    (tmp_path / "none").mkdir()
    assert pages_of_files(spark, str(tmp_path / "none")).count() == 0
    rows = pages_of_files(spark, str(folder), parser="provenia.sources.pages:text_pages", pattern="nothing*").collect()
    assert rows == []


def test_inventory(spark, folder):
    import hashlib

    got = {r.file: (r.supplier, r.sha256, r.bytes) for r in inventory(spark, str(folder), "*.txt").collect()}
    assert got["a.txt"] == ("acme", hashlib.sha256(b"one\x0ctwo\x0cthree").hexdigest(), 13) and set(got) == {"a.txt", "b.txt", "long.txt"}
