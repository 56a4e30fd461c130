"""Exact medians without gathering values: counts by the leading bits of the value, refined where the middle lies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenia.operators.stages import staged

#: Bits that a round looks at: a group has at most 2^DIGIT counts in each of the 64 / DIGIT rounds.
DIGIT = 16
#: Of a 64-bit floating-point number: bits of its fraction, and the bias of its exponent.
FRACTION, BIAS = 52, 1023


def ordered(x: Column) -> Column:
    """A double as a long in the same order: the bits of its size, negative for negative numbers; NaN after all others, as Spark sorts it."""
    size = F.abs(x)
    near = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    # the logarithm may be off by one next to a power of two; what is below the least normal number has its exponent
    exponent = F.greatest(F.when(power(near) > size, near - 1).when(power(near + 1) <= size, near + 1).otherwise(near), F.lit(1 - BIAS))
    share = size / power(exponent)
    normal = (exponent + BIAS) * F.lit(1 << FRACTION) + ((share - 1) * float(1 << FRACTION)).cast("long")
    small = (share * float(1 << FRACTION)).cast("long")
    top = F.lit(2047 << FRACTION)
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == F.lit(float("inf")), top).when(share < 1, small).otherwise(normal)
    return F.when(F.isnan(x), top + 1).otherwise(F.when(x < 0, -bits).otherwise(bits))


def medians(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """A row for each group of by: its keys and, for each column, under the name given, the exact median of its values; for an even number the mean of the middle two.

    Null values don't count; a group without others has null. A null key is a group. No rows give no groups.

    Values of all columns are written once, narrow, to the shared folder. A round counts them by group and leading bits, summed before the exchange, finds in
    which count the middle ranks are, and goes on with the values that share those bits; after the last one a count holds one value. A group of any size
    is never sorted or held, and never has more than 2^DIGIT counts in a window.
    """
    keys = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    told = F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(keys.alias("keys"), F.inline(told))
    rows = staged(rows.select(F.struct("keys", "of").alias("g"), "value", ordered(F.col("value")).alias("k")), "median-values")
    groups = rows.groupBy("g").agg(F.count("value").alias("n"))
    ranks = F.array(*[F.struct(F.lit(i).alias("which"), F.floor((F.col("n") - 1 + i) / 2).alias("rank")) for i in (0, 1)])
    targets = groups.filter("n > 0").select("g", F.lit(0).cast("long").alias("prefix"), F.inline(ranks))
    near = rows.filter("value is not null")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        first = shift == 64 - DIGIT
        if not first:
            wanted = targets.select("g", F.col("prefix").alias("up")).distinct()
            near = rows.withColumn("up", F.shiftright("k", shift + DIGIT)).join(wanted, ["g", "up"])
        counts = near.groupBy("g", F.shiftright("k", shift).alias("next")).agg(F.count("*").alias("here"), F.min("value").alias("value"))
        counts = counts.withColumn("prefix", F.lit(0).cast("long") if first else F.shiftright("next", DIGIT))
        counts = counts.withColumn("upto", F.sum("here").over(Window.partitionBy("g", "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)))
        found = targets.drop("value").join(counts, ["g", "prefix"]).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("here")))
        targets = staged(found.select("g", "which", F.col("next").alias("prefix"), (F.col("rank") - F.col("upto") + F.col("here")).alias("rank"), "value"), "median-targets")
    middle = targets.groupBy("g").agg(F.avg("value").alias("m"))
    out = groups.select("g").join(middle, "g", "left").groupBy("g.keys")
    out = out.agg(*[F.max(F.when(F.col("g.of") == c, F.col("m"))).alias(name) for c, name in columns.items()])
    return out.select(*[F.col(f"keys.{c}").alias(c) for c in by], *columns.values())
