"""Very long texts and hot keys of operators whose other tests have short ones."""

import hashlib

from pyspark.sql import functions as F

from provenia.llm.chat import format_chats, parsed
from provenia.llm.secrets import scanned
from provenia.llm.substring_dedup import repeated_units


def test_chats_of_very_long_turns_and_many_without_a_conversation(spark):
    long = "é [/INST] \\ </s>[ROLE x] " * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long[::-1]), (1, 2, "assistant", "x" * 1_000_000)] + [(None, i, "user" if i % 2 else "assistant", f"turn {i} </s>") for i in range(5000)]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.withColumn("back", parsed(F.col("formatted"))).collect()}
    for conv, turns in ((1, rows[:3]), (None, rows[3:])):
        assert got[conv].identical
        assert [(t.role, t.text, t.loss) for t in got[conv].back] == [(r, t, r == "assistant") for _, _, r, t in turns]


def test_secrets_in_a_very_long_text(spark):
    filler = "日本 words and more words, " * 60_000
    text = f"{filler}password=abcdefgh {'a1' * 300_000} {filler}AKIA{'B' * 16}"
    [got] = scanned(spark.createDataFrame([(1, text, "s", "l")], "doc_id long, text string, source string, lang string")).collect()
    n = len(filler)
    want = [("assign", n, n + 17), ("hex", n + 18, n + 18 + 600_000), ("access", len(text) - 20, len(text))]
    assert (got.n_assign, got.n_access, got.n_hex) == (1, 1, 1)
    assert got.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_repeated_passages_in_a_very_long_text(spark):
    own = " ".join(f"w{i}" for i in range(150_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"{own} {passage} end"), (2, f"start {passage} {own.replace('w', 'v')}")]
    got = repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    at = rows[1][1].index(passage)
    assert got and {r.doc_id for r in got} == {2} and all(at <= r.start and r.stop <= at + len(passage) + 1 for r in got if r.n_words < 60)
    assert sum(r.n_words for r in got) >= 45
