"""What model calls cost: tokens, images, estimates before any call, and a budget that stops a run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenia.operators.selection import medians
from provenia.operators.stages import staged

#: Fixed value: tokens of the answer for each field asked.
OUTPUT_PER_FIELD = 8
CHARS_PER_TOKEN = 4


def image_tokens(kind: Column, width: Column, height: Column) -> Column:
    """Tokens of an image of so many pixels by kind of formula; an unknown kind is an error, no formula is NULL."""
    tiles = 85 + 170 * F.ceil(width / 512) * F.ceil(height / 512)
    known = F.when(kind == "lineare_wh_750", F.ceil(width * height / 750)).when(kind == "tile_512_openai", tiles).when(kind == "tile_512_openai_stima_al_rialzo", 4 * tiles)
    return known.when(kind.isNotNull(), F.raise_error(F.concat(F.lit("unknown image formula: "), kind)).cast("bigint"))


def call_cost(tokens_in: Column, tokens_out: Column, cache_written: Column | None = None, cache_read: Column | None = None) -> Column:
    """Dollars of a call joined with its model's prices; tokens of a cache without a price are an error, never free."""
    per = lambda n, price: n * price / 1e6
    out = per(tokens_in, F.col("input_price")) + per(tokens_out, F.col("output_price"))
    for n, price in ((cache_written, "cache_write_price"), (cache_read, "cache_read_price")):
        if n is not None:
            free = F.raise_error(F.lit(f"no {price}")).cast("double")
            out = out + F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).when(F.col(price).isNull(), free).otherwise(per(n, F.col(price)))
    return out


def with_prices(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls(model, ...) with their model's prices; a model without one is an error."""
    out = calls.join(prices, "model", "left")
    return out.withColumn("input_price", F.when(F.col("input_price").isNull(), F.raise_error(F.concat(F.lit("no price for "), F.col("model"))).cast("double")).otherwise(F.col("input_price")))


def estimate(calls: DataFrame, prices: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """By model: calls, tokens_in, tokens_out, cost of calls not yet made.

    calls: key, prompt_chars, asked (number of fields), images array<struct<width, height>> in pixels. cached: key, model of replies that are there already. A
    model without an image formula is left out whole, for an estimate without the images would be too low.

    A call counts alike for all models of one image formula, and there are few formulas: calls are summed once for each formula that prices
    names, whatever the number of models, and what a model has cached is summed from those calls alone and taken off.
    """
    named = prices.filter("image_kind is not null")
    formulas = [r[0] for r in named.select("image_kind").distinct().collect()]
    pictures = lambda kind: F.aggregate("images", F.lit(0).cast("bigint"), lambda a, i: a + image_tokens(F.lit(kind), i["width"], i["height"]).cast("bigint"))
    tokens_in = lambda kind: F.floor(F.col("prompt_chars") / CHARS_PER_TOKEN) + pictures(kind)
    of = F.array(*[F.struct(F.lit(k).alias("image_kind"), tokens_in(k).alias("n_in"), (F.col("asked") * OUTPUT_PER_FIELD).alias("n_out")) for k in formulas])
    counted = [F.count("*").alias("calls"), F.sum("n_in").alias("tokens_in"), F.sum("n_out").alias("tokens_out")]
    if not formulas:
        of = F.array().cast("array<struct<image_kind:string,n_in:bigint,n_out:bigint>>")
    every = calls.select(F.inline(of)).groupBy("image_kind").agg(*counted)
    out = named.select("model", "image_kind", "input_price", "output_price").join(every, "image_kind")
    if cached is not None:
        again = cached.select("key", "model").distinct().join(named.select("model", "image_kind"), "model").join(calls, "key")
        own = again.withColumn("x", F.get(F.filter(of, lambda x: x["image_kind"] == F.col("image_kind")), F.lit(0))).select("model", "x.n_in", "x.n_out")
        out = out.join(own.groupBy("model").agg(*[c.alias(f"_{n}") for c, n in zip((F.count("*"), F.sum("n_in"), F.sum("n_out")), ("calls", "in", "out"), strict=True)]), "model", "left")
        less = lambda c, n: (F.col(c) - F.coalesce(f"_{n}", F.lit(0))).alias(c)
        out = out.select("model", "input_price", "output_price", less("calls", "calls"), less("tokens_in", "in"), less("tokens_out", "out")).filter("calls > 0")
    return out.select("model", "calls", "tokens_in", "tokens_out", call_cost(F.col("tokens_in"), F.col("tokens_out")).alias("cost"))


def within_budget(calls: DataFrame, limit: float, order: list[str], by: list[str] | None = None) -> DataFrame:
    """calls(cost) with spent_before and skipped: the call that passes the limit still counts, those after it are skipped.

    Without `by` this is one budget over one order of all calls, which is a sequence by its nature: each range of the order is summed
    by itself, and only the ranges' sums meet.
    """
    spent = F.coalesce(F.sum("cost").over(Window.partitionBy(*(by or ["_range"])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("double"))
    if by:
        return calls.withColumn("spent_before", spent).withColumn("skipped", F.col("spent_before") > limit)
    # ranges are cut by a sample, anew at each use; a table fixes the cut, for the sums and the rows alike
    n, row_range = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.spark_partition_id()
    dealt = staged(calls.repartitionByRange(n, *order).withColumn("_range", row_range), "budget")
    sums = dealt.groupBy("_range").agg(F.sum("cost").alias("_sum"))
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("double")).alias("_before"))
    # a row for each shuffle partition at most
    out = dealt.withColumn("spent_before", spent).join(F.broadcast(sums), "_range").withColumn("spent_before", F.col("spent_before") + F.col("_before"))
    return out.withColumn("skipped", F.col("spent_before") > limit).drop("_range", "_before")


def bake_off(calls: DataFrame, prices: DataFrame, rows: DataFrame, models: list[str], limit: float | None = None) -> DataFrame:
    """A row for each model tried: calls, made, failed, skipped, cost, cost_per_document, p50_latency, correct, total, invented, accuracy, documents_correct,
    document_accuracy, violations, stopped.

    calls: model, doc_key, ordinal, tokens_in, tokens_out, latency, failed, violations (of the reply's values); one for each document. rows: model, doc_key, value, expected,
    correct of the fields asked. models are tried in their order, and the limit is one budget over all of them: the call that passes it still counts, and
    no call of any model starts after it. A failed call costs nothing and has no latency, fields or violations. Accuracy is that of the fields of calls that
    were made; a document is correct if all its fields are, and its share, like the cost of a document, is of all calls, skipped and failed ones too.
    """
    order = F.array_position(F.array(*map(F.lit, models)), F.col("model")).alias("_model")
    priced = with_prices(calls.filter(F.col("model").isin(*models)), prices).withColumn("failed", F.coalesce("failed", F.lit(False)))
    priced = priced.select("*", order).withColumn("cost", F.when(F.col("failed"), 0.0).otherwise(call_cost(F.col("tokens_in"), F.col("tokens_out"))))
    priced = within_budget(priced, limit, ["_model", "ordinal", "doc_key"]) if limit is not None else priced.withColumn("skipped", F.lit(False))
    made = ~F.col("skipped") & ~F.col("failed")
    sums = [F.count("*").alias("calls"), F.count_if(made).alias("made"), F.count_if(F.col("failed") & ~F.col("skipped")).alias("failed"), F.count_if("skipped").alias("skipped"), F.coalesce(F.sum(F.when(made, F.col("cost"))), F.lit(0.0)).alias("cost"), F.coalesce(F.sum(F.when(made, F.col("violations"))), F.lit(0)).alias("violations")]
    by_model = priced.groupBy("model").agg(*sums)
    middle = medians(priced.filter(made).select("model", "latency"), ["model"], {"latency": "p50_latency"})
    seen = rows.join(priced.filter(made).select("model", "doc_key").distinct(), ["model", "doc_key"], "left_semi")
    wrong = F.col("value").isNotNull() & ~F.col("correct")
    by_document = seen.groupBy("model", "doc_key").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"), F.count_if(wrong).alias("invented"))
    judged = by_document.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("correct", "total", "invented")], F.count_if(F.col("correct") == F.col("total")).alias("documents_correct"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = by_model.join(middle, "model", "left").join(judged, "model", "left").select("model", "calls", "made", "failed", "skipped", "cost", "p50_latency", "violations", *map(zero, ("correct", "total", "invented", "documents_correct")))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = out.withColumn("cost_per_document", ratio("cost", "calls")).withColumn("accuracy", ratio("correct", "total")).withColumn("document_accuracy", ratio("documents_correct", "calls"))
    return out.withColumn("stopped", F.col("skipped") > 0)


def latency_p50(calls: DataFrame, by: list[str]) -> DataFrame:
    """By group the exact median of latency, null if it has none."""
    return medians(calls, by, {"latency": "p50"})
