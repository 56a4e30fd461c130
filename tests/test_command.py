"""The command over a folder of files, with a provider."""

import json
import sys

import pytest

PROVIDER = '''
import os, uuid
from provenia.operators.tier1 import ProviderError

def ask(pages, prompt, names):
    open(os.path.join({calls!r}, uuid.uuid4().hex), "w").close()
    if b"refuse" in pages[0]:
        raise ProviderError("refused")
    return '{{"code": "X9"}}', 0.25
'''


@pytest.fixture
def given(spark, tmp_path, monkeypatch):
    from test_engine import SMALL

    for d in ("calls", "files/x", "files/y", "code"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "code" / "given_provider.py").write_text(PROVIDER.format(calls=str(tmp_path / "calls")))
    monkeypatch.syspath_prepend(str(tmp_path / "code"))
    before = spark.sparkContext.environment.get("PYTHONPATH", "")
    spark.sparkContext.environment["PYTHONPATH"] = f"{tmp_path}/code:{before}"
    (tmp_path / "s.yaml").write_text(SMALL)
    (tmp_path / "files/x/a.txt").write_text("Code X1\fmore")
    (tmp_path / "files/y/a.txt").write_text("no code here")
    (tmp_path / "files/y/bad.txt").write_bytes(b"\xff")
    (tmp_path / "files/y/c.txt").write_text("refuse")
    yield tmp_path
    spark.sparkContext.environment["PYTHONPATH"] = before
    sys.modules.pop("given_provider", None)


def test_folder_of_files(given, capsys):
    from provenia.__main__ import main

    argv = ["extract", f"{given}/files", "--schema", f"{given}/s.yaml", "--parser", "provenia.sources.pages:text_pages"]
    assert main(argv) == 2  # for the file that can't be read; the others are there
    out = capsys.readouterr()
    assert [(x["istanza_id"], x["campi"]["code"]["value"]) for x in json.loads(out.out)] == [("a", "X1"), ("a", None), ("c", None)]
    assert "bad.txt: UnicodeDecodeError" in out.err and "can't be read: 1" in out.err
    assert main([*argv[:-1], "no_such_module:parser"]) == 2


def test_provider_is_paid_once(given, capsys):
    from provenia.__main__ import main

    argv = ["extract", f"{given}/files", "--schema", f"{given}/s.yaml", "--parser", "provenia.sources.pages:text_pages", "--tier1", "given_provider:ask"]
    assert main([*argv, "--replies", f"{given}/log"]) == 2  # no model named
    assert main([*argv[:-1], "given_provider:nothing"]) == 2
    assert list((given / "calls").iterdir()) == []
    capsys.readouterr()
    for calls in (3, 4):  # the refused call is made again, the others are in the log
        main([*argv, "--replies", f"{given}/log", "--model", "m-1"])
        told = {x["documento"]["pagine"][0]["indice"]: x for x in json.loads(capsys.readouterr().out) if x["istanza_id"] == "c"}
        assert told[1]["tier1_errore"] == "refused" and len(list((given / "calls").iterdir())) == calls
