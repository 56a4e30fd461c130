"""Which provider a model belongs to: the one with the longest prefix of its name."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_providers(calls: DataFrame, prefixes: DataFrame, model_col: str = "model") -> DataFrame:
    """calls with provider and dispatch_error: the provider of prefixes(prefix, provider) whose prefix of the model's name is the longest.

    A model that no prefix fits, and a null one, has no provider and says so in dispatch_error; its row stays. The empty prefix fits all names. Of a prefix with
    several providers the least by name counts. Columns of calls named provider or dispatch_error are replaced.

    Each distinct name is cut into all its prefixes, which meet the table by an equi-join; so nothing is compared with each prefix in turn, and the calls
    themselves are joined once, by name.
    """
    names = calls.select(F.col(model_col).cast("string").alias("_name")).filter("_name is not null").distinct()
    cut = names.select("_name", F.explode(F.transform(F.sequence(F.lit(0), F.length("_name")), lambda n: F.substring("_name", F.lit(1), n))).alias("prefix"))
    known = prefixes.select(F.col("prefix").cast("string"), F.col("provider").cast("string")).filter("prefix is not null and provider is not null").groupBy("prefix").agg(F.min("provider").alias("_provider"))
    best = cut.join(known, "prefix").groupBy("_name").agg(F.max_by("_provider", F.length("prefix")).alias("_provider"))
    out = calls.drop("provider", "dispatch_error").join(best, F.col(model_col).cast("string") == F.col("_name"), "left")
    error = F.when(F.col("_provider").isNull(), F.concat(F.lit("no provider known for model "), F.coalesce(F.col(model_col).cast("string"), F.lit("null"))))
    return out.withColumn("provider", F.col("_provider")).withColumn("dispatch_error", error).drop("_name", "_provider")
