"""Places in one order over all rows, without a task that takes all rows in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key ranges that are ranked side by side, and rows of the sample for each cut between them.
RANGES, SAMPLED = 64, 16


def placed(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place from 1 on by the ascending columns of order (nulls first), and their number as `_total`.

    Rows are dealt to key ranges; a place is the place within the range and the number of rows before the range. The
    cuts come from rows chosen by the hash of their key, about RANGES * SAMPLED however many rows there are, so they
    also part rows that tie in the first columns. Cuts and counts are single values of the same lazy plan."""
    rows = df.withColumn("_k", F.struct(*order))
    total = rows.agg(F.count("*")).scalar()
    sampled = rows.select("_k", total.alias("_total")).where(F.expr(f"pmod(xxhash64(_k), greatest(1, _total div {RANGES * SAMPLED})) = 0"))
    cuts = sampled.agg(F.filter(F.array_sort(F.collect_list("_k")), lambda _, i: i % SAMPLED == SAMPLED - 1)).scalar()
    rows = rows.withColumn("_cuts", cuts).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_k")))).drop("_cuts")
    counts = rows.groupBy("_range").agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("_range", "n"))).scalar()
    before = F.aggregate("_counts", F.lit(0).cast("long"), lambda n, c: n + F.when(c["_range"] < F.col("_range"), c["n"]).otherwise(0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_k"))
    ranked = rows.withColumns({"_within": within, "_counts": counts, "_total": total})
    return ranked.withColumn(name, before + F.col("_within")).drop("_k", "_range", "_within", "_counts")
