"""The optional model stage: a prompt made from the schema, a seam for providers, and a deterministic provider for tests."""

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenia.functions.keys import cache_key, pages_key
from provenia.functions.replies import with_reply_values
from provenia.operators.stages import staged, workers_find_package
from provenia.plans.schema import Field
from provenia.sources.cache import Journal, ReplyLog

TYPES = {"string": "free text", "date": "date as YYYY-MM-DD", "integer": "whole number", "decimal": "number with a point before its decimals"}
#: Fixed values of the deterministic provider: tokens for each value given, and dollars per million tokens in and out.
FAKE_TOKENS, FAKE_PRICES = 5, (1.0, 5.0)


class ProviderError(RuntimeError):
    """A call that gave no complete reply; the row keeps what it has and the error goes to its result."""


def prompt(fields: list[Field]) -> str:
    """What a provider is asked, from the schema alone; the rule on dates is there only if one is asked for."""
    lines = [f"- {f.name}: {TYPES[f.kind]}." + (f" {f.description}" if f.description else "") for f in fields]
    rules = ["A field that the pages don't show, or that can't be read, is null. Never guess or compute one.", "Answer with one JSON object and nothing else; its keys are " + ", ".join(f.name for f in fields) + "."]
    if any(f.kind == "date" for f in fields):
        rules.append("A date needs day, month and year as printed, unless the field's own description says otherwise; else it is null.")
    return "\n".join(["Read these fields from the pages of a document:", *lines, "Rules:", *[f"- {r}" for r in rules]])


#: (pages as bytes, prompt, fields asked) -> (reply text, cost in dollars); raises ProviderError.
Provider = Callable[[list[bytes], str, list[str]], tuple[str, float]]


def with_provider(provider: Provider, iso_dates: bool = True) -> Callable[[DataFrame, list[Field]], DataFrame]:
    """A model stage that calls provider for each row that comes in, in Arrow batches. A provider's error is its row's; other errors are the job's."""

    def stage(df: DataFrame, fields: list[Field]) -> DataFrame:
        workers_find_package(df.sparkSession)
        text = prompt(fields)

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                replies, costs, errors = [], [], []
                for page, asked in zip(b.column("text").to_pylist(), b.column("asked").to_pylist(), strict=True):
                    try:
                        reply, cost, error = *provider([(page or "").encode()], text, asked), None
                    except ProviderError as e:
                        reply, cost, error = None, 0.0, str(e)
                    replies.append(reply)
                    costs.append(cost)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([b.column("file"), b.column("segment"), pa.array(replies, pa.string()), pa.array(costs, pa.float64()), pa.array(errors, pa.string())], ["file", "segment", "answer", "cost", "error"])

        told = df.select("file", "segment", "text", "asked").mapInArrow(call, "file string, segment long, answer string, cost double, error string")
        told = with_reply_values(told, F.col("answer"), fields, iso_dates, "said_")
        pairs = [x for f in fields for x in (F.lit(f.name), F.col(f"said_{f.name}"))]
        return told.select("file", "segment", F.create_map(*pairs).alias("reply"), "cost", "error")

    return stage


def with_paid_replies(provider: Provider, log: ReplyLog, model: str, version: str = "1", iso_dates: bool = True, slices: int = 8, now: float | None = None) -> Callable[[DataFrame, list[Field]], DataFrame]:
    """A model stage that pays for each reply once: what `log` has is not asked for, and what is asked for is in the log before the next slice starts.

    Calls are told apart by `functions.keys.cache_key` of pages, prompt with the fields asked, model and version; equal calls are one. Those without a reply
    that is young enough are made in slices, by a hash of their key. A task notes each reply in the slice's journal before it makes the next call, and looks there
    first; the slice's replies are then appended to the log, and its journal goes. So a task that is tried again, and a job that is
    started again after it died, ask for nothing that has come back before. (A reply that is on its way when a worker dies is lost; two
    attempts at once would both pay, so speculation must be off.) A provider's error is its rows', and is not kept; other errors are the job's.
    The cost of a call is that of the first of its rows; rows whose reply was in the log cost nothing.
    """

    def stage(df: DataFrame, fields: list[Field]) -> DataFrame:
        spark = df.sparkSession
        if spark.conf.get("spark.speculation", "false") == "true":
            raise ValueError("spark.speculation would pay twice")
        workers_find_package(spark)
        text = prompt(fields)
        asked = F.concat(F.lit(text + "\n"), F.array_join("asked", ","))
        key = cache_key(F.array(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), asked, F.lit(model), F.lit(version))
        calls = staged(df.select("file", "segment", "text", "asked", key.alias("key")), "calls")
        open_ = log.missing(calls.dropDuplicates(["key"]).select("key", "text", "asked"), now).withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int"))
        open_ = staged(open_, "calls-open")
        paid = []
        for i in range(slices):
            part = hashlib.sha256(f"{model}\0{version}\0{slices}\0{i}".encode()).hexdigest()[:16]
            journal_at = log.journal(part)

            def call(batches: Iterator[pa.RecordBatch], journal_at: str = journal_at) -> Iterator[pa.RecordBatch]:
                journal = Journal(journal_at)
                for b in batches:
                    rows: list[tuple] = []
                    for k, page, names in zip(*(b.column(c).to_pylist() for c in ("key", "text", "asked")), strict=True):
                        known = journal.get(k)
                        if known is None:
                            try:
                                known = provider([(page or "").encode()], text, names)
                            except ProviderError as e:
                                rows.append((k, None, 0.0, str(e)))
                                continue
                            journal.put(k, *known)
                        rows.append((k, *known, None))
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.float64(), pa.string()), strict=True)] if rows else [pa.nulls(0, t) for t in (pa.string(), pa.string(), pa.float64(), pa.string())], ["key", "answer", "cost", "error"])

            made = staged(open_.filter(F.col("slice") == i).select("key", "text", "asked").mapInArrow(call, "key string, answer string, cost double, error string"), "calls-made")
            log.write(made.filter("error is null").select("key", F.col("answer").alias("reply"), "cost"), now)
            log.forget(part)
            paid.append(made)
        made = reduce(DataFrame.unionByName, paid)
        once = F.row_number().over(Window.partitionBy("key").orderBy("file", "segment")) == 1
        # what was paid for just now counts even if it is no JSON object; the log doesn't give such replies out again
        told = calls.select("file", "segment", "key").join(log.read(now).select("key", "reply"), "key", "left").join(made, "key", "left")
        told = told.select("file", "segment", F.coalesce("answer", "reply").alias("answer"), F.when(once, F.coalesce("cost", F.lit(0.0))).otherwise(0.0).alias("cost"), "error")
        told = with_reply_values(told, F.col("answer"), fields, iso_dates, "said_")
        pairs = [x for f in fields for x in (F.lit(f.name), F.col(f"said_{f.name}"))]
        return told.select("file", "segment", F.create_map(*pairs).alias("reply"), "cost", "error")

    return stage


def fixture_stage(fixture: DataFrame, prompt_chars: int) -> Callable[[DataFrame, list[Field]], DataFrame]:
    """The deterministic model stage: fixture(key, values map<string,string>) by the hash of the instance's text; no row there is an error.

    Tokens in are a quarter of the pages' and the prompt's length, tokens out so many for each value, at least one.
    """

    def stage(df: DataFrame, fields: list[Field]) -> DataFrame:
        key = pages_key(F.array(F.encode("text", "UTF-8")))
        x = df.select("file", "segment", F.octet_length("text").alias("n"), key.alias("key")).join(fixture, "key", "left")
        given = F.size(F.filter(F.map_values("values"), lambda v: v.isNotNull()))
        tokens_in, tokens_out = F.floor(F.col("n") / 4) + prompt_chars // 4, F.greatest(given * FAKE_TOKENS, F.lit(1))
        cost = (tokens_in * FAKE_PRICES[0] + tokens_out * FAKE_PRICES[1]) / 1e6
        there = F.col("values").isNotNull()
        return x.select("file", "segment", F.coalesce("values", F.create_map().cast("map<string,string>")).alias("reply"), F.when(there, cost).otherwise(0.0).alias("cost"), F.when(~there, "no reply for these pages").alias("error"))

    return stage
