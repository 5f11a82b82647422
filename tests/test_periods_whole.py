"""Periods beyond the number that joins once took."""

from pyspark.sql import functions as F

from strata.operators import timelines


def test_every_period_is_dense(spark):
    periods = spark.range(100_050).select(F.col("id").alias("label"), F.col("id").alias("start"))
    scored = spark.createDataFrame([("a", 7, 1.0)], "author string, period long, impact double")
    assert timelines.densify(scored, periods, ("impact",)).count() == 100_050
