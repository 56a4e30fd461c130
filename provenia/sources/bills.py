"""Synthetic bills as pages, made from orders and their lines: seeded by keys alone, so that each run gives the same pages and truth is known.

A customer is a file; an order is a bill of two pages. Faults, each by the order key: `% 5 == 0` no day count, `% 11` a second, other total,
`% 13` a wrong sum of bands, `% 17` the second page scanned, `% 19` no identifier, `% 23` an impossible start date, `% 29` a total that could be read two ways.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH, HEIGHT = 595.0, 842.0


def italian(x: Column) -> Column:
    """1234.5 as 1.234,50, by its text, for format_number is slow; short, for it stands six times in the code of the pages."""
    t = F.translate(x.cast("decimal(18,2)").cast("string"), ".", ",")
    return F.when(F.length(t) < 7, t).otherwise(F.regexp_replace(t, r"\B(?=(?:[0-9]{3})+,)", "."))


def cents(x: Column) -> Column:
    """x in cents, rounded as a decimal(18,2) is; whole numbers, as quantities are, without making a decimal of each."""
    whole = F.floor(x).cast("bigint")
    return F.when((whole == x) & whole.between(-(10**15), 10**15), whole * 100).otherwise((x.cast("decimal(18,2)") * 100).cast("bigint"))


def of_cents(x: Column) -> Column:
    return (x.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")


def fault(n: int) -> Column:
    return F.col("o_orderkey") % n == 0


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order: keys, dates, days, total, and the three bands as sums of quantities by return flag."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    # sums are of whole cents: decimals are made once for each order
    lines = lines.select("l_orderkey", "l_returnflag", cents(F.col("l_quantity")).alias("cents"))
    band = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("cents")).otherwise(0))
    bands = lines.groupBy("l_orderkey").agg(band("A").alias("f1"), band("N").alias("f2"), band("R").alias("f3"))
    out = orders.join(bands, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    days = (F.col("o_orderkey") % 60 + 1).cast("int")
    start = F.to_date("o_orderdate")
    f = [F.coalesce(c, F.lit(0).cast("bigint")) for c in ("f1", "f2", "f3")]
    return out.select("o_orderkey", "o_custkey", start.alias("start"), F.date_add(start, days - 1).alias("stop"), days.alias("days"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"), *[of_cents(c).alias(f"f{i}") for i, c in enumerate(f, 1)], of_cents(f[0] + f[1] + f[2]).alias("kwh"))


def bill_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages(file, page_no, text, n_chars, width, height, rotation, images) of all bills."""
    # by file as what reads the pages is, so that no page moves after it is made
    file = F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(".pdf"))
    # an order is few bytes but its pages are much work: the number of partitions is given, so that adaptive execution doesn't join them by size
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    b = bills(spark, sf_dir).withColumn("file", file).repartition(n, "file").withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("start", "o_orderkey")))
    iso = lambda c: F.col(c).cast("string")
    date = lambda c: F.when(iso(c).between("0001", "9999-12-31"), F.concat(F.substring(iso(c), 9, 2), F.lit("/"), F.substring(iso(c), 6, 2), F.lit("/"), F.substring(iso(c), 1, 4))).otherwise(F.date_format(c, "dd/MM/yyyy"))
    start = F.when(fault(23), F.concat(F.lit("31/02/"), F.date_format("start", "yyyy"))).otherwise(date("start"))
    period = F.concat(F.lit("Dal "), start, F.lit(" al "), date("stop"), F.when(fault(5), F.lit("")).otherwise(F.concat(F.lit(" ("), F.col("days").cast("string"), F.lit(" giorni)"))))
    whole = F.floor("total").cast("bigint")
    two_ways = F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"))
    total = F.concat(F.lit("Totale da pagare: € "), F.when(fault(29), two_ways).otherwise(italian(F.col("total"))))
    other = F.when(fault(11), F.concat(F.lit("Importo totale: EUR "), italian(F.col("total") + 10)))
    text = lambda *lines: F.concat_ws("\n", *lines)  # noqa: E731  # leaves out what is NULL
    text_a = text(F.concat(F.lit("Fattura n. "), F.col("o_orderkey").cast("string")), F.concat(F.lit("Fornitore: Fornitore "), (F.col("o_custkey") % 7).cast("string")), period, total, other)
    pod = F.when(~fault(19), F.concat(F.lit("POD: IT"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("E"), F.lpad((F.col("o_orderkey") % 100000000).cast("string"), 8, "0")))
    sum_ = F.when(fault(13), (F.col("kwh") * 11 / 10 + 1).cast("decimal(18,2)")).otherwise(F.col("kwh"))
    kwh = lambda label, c: F.concat(F.lit(f"Energia {label}: "), italian(c), F.lit(" kWh"))
    text_b = text(pod, kwh("F1", F.col("f1")), kwh("F2", F.col("f2")), kwh("F3", F.col("f3")), kwh("totale", sum_))
    none = F.array().cast("array<struct<x0:double,top:double,x1:double,bottom:double>>")
    full = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), F.lit(WIDTH).alias("x1"), F.lit(HEIGHT).alias("bottom")))
    # texts are columns before they are rows: what stands in a generator isn't compiled
    b = b.select("file", "rank", text_a.alias("text_a"), text_b.alias("text_b"), F.when(fault(17), full).otherwise(none).alias("images_b"))
    page = lambda n, text, images: F.struct((F.col("rank") * 2 - 2 + n).cast("int").alias("page_no"), F.col(text).alias("text"), images.alias("images"))
    pages = b.select("file", F.inline(F.array(page(1, "text_a", none), page(2, "text_b", F.col("images_b")))))
    return pages.select("file", "page_no", "text", F.length("text").alias("n_chars"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(0).alias("rotation"), "images")
