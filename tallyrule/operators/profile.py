"""Order statistics and fingerprints of features, from counts of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrule.functions.numeric import round_up


def long_form(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, value) rows of finite values."""
    keep = keep or []
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("_")).select(*keep, "_.feature", "_.value").where("value IS NOT NULL AND NOT isnan(value)")


def value_range(x: Column, cells: int = 4096) -> Column:
    """The number of the range that a finite value lies in: `cells` ranges between two powers of two, in the order of the values.

    A logarithm that is off by one at a power of two moves the cell by `cells` the other way, so the order holds. Values nearer
    to 0 than 1e-300 share range 0.
    """
    size = F.abs(x)
    power = F.floor(F.log2(size))
    cell = (power + 1100) * cells + F.floor((size / F.pow(F.lit(2.0), power) - 1) * cells)
    return F.when(size < 1e-300, F.lit(0).cast("long")).otherwise(F.when(x < 0, -cell).otherwise(cell))


def order_statistics(df: DataFrame, features: list[str], ps: list[float]) -> DataFrame:
    """(feature, p, value): the element at floor(p*(n-1)) of the sorted values.

    Values are counted first (combined on the map side), and the counts summed by ranges of values, of which a column has a bounded
    number. The window over ranges finds the one that holds each element; only the values of these ranges are sorted, range by range.
    """
    counts = long_form(df, features).groupBy("feature", "value").agg(F.count("*").alias("n")).withColumn("range", value_range(F.col("value")))
    by = Window.partitionBy("feature")
    before = Window.unboundedPreceding, -1
    ranges = counts.groupBy("feature", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("feature", "range", "n", F.coalesce(F.sum("n").over(by.orderBy("range").rowsBetween(*before)), F.lit(0)).alias("start"), F.sum("n").over(by).alias("total"))
    wanted = ranges.select("*", F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")).withColumn("at", F.floor(F.col("p") * (F.col("total") - 1)) - F.col("start"))
    wanted = wanted.where((F.col("at") >= 0) & (F.col("at") < F.col("n"))).groupBy("feature", "range").agg(F.collect_list(F.struct("p", "at")).alias("wanted"))
    inside = counts.join(wanted, ["feature", "range"])
    upto = F.sum("n").over(Window.partitionBy("feature", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("upto", upto).select("feature", "value", "n", "upto", F.inline("wanted"))
    return found.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select("feature", "p", "value")


def fingerprints(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, lo, q1, med, q3, hi), rounded to six places."""
    stats = order_statistics(df, features, [0.25, 0.5, 0.75])
    quartiles = stats.groupBy("feature").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "med"), (0.75, "q3"))])
    ends = long_form(df, features).groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ends.join(quartiles, "feature").select("feature", *[round_up(F.col(c)).alias(c) for c in ("lo", "q1", "med", "q3", "hi")])
