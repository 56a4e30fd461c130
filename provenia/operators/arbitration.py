"""Two sources on the same fields: where they agree the first's value, elsewhere nothing and a disagreement."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.functions.repair import agree
from provenia.plans.schema import KINDS


def agreement(a: Column, b: Column, kind: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for k in KINDS:
        out = F.when(kind == k, agree(a, b, k)).otherwise(out)
    return out


def arbitrate(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, kind, a, b, agreed, value: rows of both (keys, field, kind, value) met by keys and field; one that a source lacks is NULL there."""
    on = [*keys, "field"]
    a, b = first.select(*on, "kind", F.col("value").alias("a")), second.select(*on, F.col("kind").alias("_kind"), F.col("value").alias("b"))
    out = a.join(b, on, "full").withColumn("kind", F.coalesce("kind", "_kind")).drop("_kind")
    out = out.withColumn("agreed", agreement(F.col("a"), F.col("b"), F.col("kind")))
    return out.withColumn("value", F.when(F.col("agreed"), F.col("a")))


def arbitration_stats(arbitrated: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: compared, disagreements, their share; of those how often a, b or neither is right; accuracy where both agree. truth: keys, field, expected."""
    x = arbitrated.join(truth, [*keys, "field"])
    right = lambda c: agreement(F.col(c), F.col("expected"), F.col("kind"))
    x = x.select("agreed", right("a").alias("ra"), right("b").alias("rb"))
    n, apart = F.count("*"), F.count_if(~F.col("agreed"))
    return x.agg(n.alias("compared"), apart.alias("disagreements"), F.coalesce(F.try_divide(apart, n), F.lit(0.0)).alias("disagreement_rate"), F.count_if(~F.col("agreed") & F.col("ra")).alias("a_right"), F.count_if(~F.col("agreed") & F.col("rb")).alias("b_right"), F.count_if(~F.col("agreed") & ~F.col("ra") & ~F.col("rb")).alias("neither_right"), F.coalesce(F.try_divide(F.count_if(F.col("agreed") & F.col("ra")), n - apart), F.lit(0.0)).alias("accuracy_agreed"))
