"""Splits and samples that depend on keys, never on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_index(df: DataFrame, key: str) -> DataFrame:
    """split: 'held' for keys with a last digit under 3."""
    return df.withColumn("split", F.when(F.col(key) % 10 < 3, "held").otherwise("train"))


def stratified(df: DataFrame, key: str, y: str, share: float, seed: int) -> DataFrame:
    """split: of each class, the floor(share * size) rows with the smallest seeded hash are 'held'.

    The hash is bucketed first: whole buckets below the cut need no ranking and stay where they are; only the rows of the bucket that
    holds the cut are exchanged and ranked, so no task sorts a class.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long")
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 40).cast("int"))
    counts = rows.groupBy(y, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(y)
    cut = counts.withColumn("_upto", F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_want", F.floor(F.lit(share) * F.sum("_n").over(w)))
    cut = cut.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want"))).select(F.col(y).alias("_y"), F.col("_b").alias("_cut"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_take"))
    rows = rows.join(F.broadcast(cut), F.col(y).eqNullSafe(F.col("_y")), "left")
    on_cut = F.coalesce(F.col("_b") == F.col("_cut"), F.lit(False))
    ranked = rows.where(on_cut).withColumn("_held", F.row_number().over(Window.partitionBy(y).orderBy("_h", key)) <= F.col("_take"))
    both = rows.where(~on_cut).withColumn("_held", F.coalesce(F.col("_b") < F.col("_cut"), F.lit(False))).union(ranked)
    return both.withColumn("split", F.when(F.col("_held"), "held").otherwise("train")).drop("_h", "_b", "_y", "_cut", "_take", "_held")


def stride(df: DataFrame, key: str, k: int) -> DataFrame:
    """Every max(1, floor(n/k))-th row by key, the first k of them; ranks come from counts of key ranges plus a rank within one."""
    n = df.count()
    step = max(1, n // k)
    ranked = _ranked(df, key)
    return ranked.where(((F.col("_rank") - 1) % step == 0) & ((F.col("_rank") - 1) / step < k)).drop("_rank")


def _starts(counts: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """(by..., at, _before): how many rows lie before each range, of counts (by..., at, _n).

    Ranges of `width` ranges are summed first: one window runs within each of them, another over their sums.
    """
    counts = counts.withColumn("_block", F.floor(F.col(at) / width))
    before = lambda parts, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*(parts or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy(*by, "_block").agg(F.sum("_n").alias("_n")).select(*by, "_block", before(by, "_block").alias("_start"))
    inner = counts.select(*by, at, "_block", before([*by, "_block"], at).alias("_inner"))
    return inner.join(blocks, [*by, "_block"]).select(*by, at, (F.col("_start") + F.col("_inner")).alias("_before"))


def _ranked(df: DataFrame, key: str, by: list[str] | None = None, width: int = 4096) -> DataFrame:
    """_rank from 1 by a whole-number key (within by): ranges of `width` keys are counted, and rows ranked within a range."""
    by = by or []
    rows = df.withColumn("_range", F.floor(F.col(key) / width))
    offsets = _starts(rows.groupBy(*by, "_range").agg(F.count("*").alias("_n")), by, "_range", width)
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(key))
    return rows.withColumn("_own", own).join(offsets, [*by, "_range"]).withColumn("_rank", F.col("_before") + F.col("_own")).drop("_own", "_before", "_range")


def systematic(df: DataFrame, key: str, y: str, per_class: int = 100) -> DataFrame:
    """Of each class, the elements floor(k * size / per_class), k from 0, by key; no rows if a class has too few."""
    ranked = _ranked(df, key, [y])
    sizes = ranked.groupBy(y).agg(F.count("*").alias("_size"))
    small = sizes.agg(F.min("_size").alias("m"), F.count("*").alias("c")).first()
    if small["m"] is None or small["m"] < per_class or small["c"] < 2:
        return df.limit(0)
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(per_class - 1)), lambda k: F.floor(k * F.col("_size") / per_class) + 1))
    wanted = sizes.select(y, at.alias("_rank"))
    return ranked.join(F.broadcast(wanted), [y, "_rank"], "left_semi").drop("_rank").select(*df.columns)
