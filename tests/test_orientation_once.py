"""A page's characters are made once, however often votes name them."""

from pyspark.sql import functions as F

from provenia.operators.orientation import page_orientation


def test_characters_of_a_page_are_made_once(spark):
    boxes = spark.createDataFrame([([],)], "boxes array<struct<x0:double,top:double,x1:double,bottom:double>>")
    plan = boxes.select(page_orientation(F.col("boxes")).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.split("\n")[0].count("boxes#") == 1
