"""Rank metrics from histograms of scores: few distinct scores, so no sort of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrule.functions.numeric import draw, round_up


def histogram(df: DataFrame, score: Column, y: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., score, pos, neg): labels counted at each score."""
    by = by or []
    rows = df.select(*by, score.alias("score"), y.cast("int").alias("y"))
    return rows.groupBy(*by, "score").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("neg"))


def _window(by: list[str]):
    return Window.partitionBy(*(by or [F.lit(0)]))


def auc(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., auc, pos, neg): the Mann-Whitney share, ties counting half; 0.5 where a class is missing."""
    by = by or []
    below = F.sum("neg").over(_window(by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    rows = hist.withColumn("won", F.col("pos") * (F.coalesce(below, F.lit(0)) + F.col("neg") / 2))
    total = rows.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    value = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos").cast("double") * F.col("neg"))).otherwise(0.5)
    return total.select(*by, round_up(value).alias("auc"), F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"))


def operating_point(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., threshold, base, spread): the score at min(n-1, floor((1-base)*n)) in order, the share of ones, and the range of scores."""
    by = by or []
    w = _window(by)
    n = F.col("pos") + F.col("neg")
    rows = hist.select(*by, "score", n.alias("n"), F.sum("pos").over(w).alias("ones"), F.sum(n).over(w).alias("all"), F.sum(n).over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    base = F.col("ones") / F.col("all")
    at = F.least(F.col("all") - 1, F.floor((F.lit(1.0) - base) * F.col("all")))
    rows = rows.withColumn("base", base).withColumn("hit", F.when(at < F.col("upto"), F.col("score")))
    out = rows.groupBy(*by).agg(F.min("hit").alias("threshold"), F.first("base").alias("base"), F.greatest(F.max("score") - F.min("score"), F.lit(1e-9)).alias("spread"))
    return out.select(*by, *[round_up(F.col(c)).alias(c) for c in ("threshold", "base", "spread")])


def accuracy(hist: DataFrame, threshold: Column) -> Column:
    """The share of a histogram's rows whose label is that of score > threshold (an aggregate column)."""
    right = F.when(F.col("score") > threshold, F.col("pos")).otherwise(F.col("neg"))
    return round_up(F.sum(right) / F.sum(F.col("pos") + F.col("neg")))


def balanced_accuracy(df: DataFrame, label: Column, y: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., balanced_accuracy): the mean recall of the classes present; a null label is a miss."""
    by = by or []
    hit = df.select(*by, F.when(y == 1, 1).otherwise(0).alias("y"), F.coalesce(label == y, F.lit(False)).cast("double").alias("hit"))
    per_class = hit.groupBy(*by, "y").agg(F.sum("hit").alias("hit"), F.count("*").alias("n"))
    return per_class.groupBy(*by).agg(round_up(F.avg(F.col("hit") / F.col("n"))).alias("balanced_accuracy"))


def resamples(rows: DataFrame, draws: int, seed: int, per_class: int = 100) -> DataFrame:
    """(resample, idx, y): each resample draws per_class ones, then per_class zeros, with replacement, from one stream.

    rows: (idx, y). Draw numbers are a function of (resample, class, k), so all resamples are made at once and joined by rank.
    """
    spark = rows.sparkSession
    ranked = rows.select("idx", F.when(F.col("y") == 1, 1).otherwise(0).alias("y"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("idx")) - 1).withColumn("size", F.count("*").over(Window.partitionBy("y")))
    sizes = ranked.groupBy("y").agg(F.first("size").alias("size"))
    k = spark.range(draws * 2 * per_class).select((F.col("id") / (2 * per_class)).cast("long").alias("resample"), F.col("id"), (1 - F.floor(F.col("id") % (2 * per_class) / per_class)).cast("int").alias("y"))
    k = k.join(F.broadcast(sizes), "y").select("resample", "y", F.floor(draw(F.col("id"), seed) * F.col("size")).cast("int").alias("rank"))
    return k.join(ranked.select("y", "rank", "idx"), ["y", "rank"]).select("resample", "idx", "y")


def bootstrap(rows: DataFrame, arms: DataFrame, pairs: list[tuple[str, str, str]], draws: int = 2000, seed: int = 20261105, per_class: int = 100) -> DataFrame:
    """(pair, resample, diff) of paired, stratified resamples. arms: (arm, idx, score, label); pairs: (arm, minus arm, 'auc' or 'bal').

    An arm without a row for every idx gives no differences.
    """
    total = rows.count()
    whole = [r["arm"] for r in arms.where("score IS NOT NULL").groupBy("arm").agg(F.countDistinct("idx").alias("n")).where(F.col("n") == total).collect()]
    drawn = resamples(rows, draws, seed, per_class).join(arms.where(F.col("arm").isin(whole)), "idx")
    by = ["resample", "arm"]
    aucs = auc(histogram(drawn, F.col("score"), F.col("y"), by), by).select(*by, F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    bals = balanced_accuracy(drawn, F.col("label"), F.col("y"), by).select(*by, F.lit("bal").alias("metric"), F.col("balanced_accuracy").alias("value"))
    values = aucs.union(bals)
    wanted = F.array(*[F.struct(F.lit(f"{a}-{b}:{m}").alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(m).alias("metric")) for a, b, m in pairs])
    sides = values.select("*", F.explode(wanted).alias("p")).where("metric = p.metric AND (arm = p.a OR arm = p.b)")
    diff = F.sum(F.when(F.col("arm") == F.col("p.a"), F.col("value")).otherwise(-F.col("value")))
    return sides.groupBy(F.col("p.pair").alias("pair"), "resample").agg(round_up(diff).alias("diff"), F.count("*").alias("n")).where("n = 2").drop("n")


def interval(diffs: DataFrame, by: str = "pair", value: str = "diff") -> DataFrame:
    """(by, lo, hi): the elements at floor(0.025 n) and floor(0.975 n) of the sorted values."""
    w = Window.partitionBy(by)
    ranked = diffs.select(by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("at"), F.count("*").over(w).alias("n"))
    pick = lambda p: F.max(F.when(F.col("at") == F.floor(F.lit(p) * F.col("n")), F.col(value)))
    return ranked.groupBy(by).agg(pick(0.025).alias("lo"), pick(0.975).alias("hi"))


def judge(rows: DataFrame, arms: DataFrame, pairs: dict[str, tuple[str, str, str]], parsed: dict[str, int], parsed_min: int = 190, **kw) -> dict:
    """Every arm's metrics, each difference claim with its interval, and whether enough replies were read."""
    joined = arms.join(rows, "idx")
    aucs = {r["arm"]: r["auc"] for r in auc(histogram(joined, F.col("score"), F.col("y"), ["arm"]), ["arm"]).collect()}
    bals = {r["arm"]: r["balanced_accuracy"] for r in balanced_accuracy(joined, F.col("label"), F.col("y"), ["arm"]).collect()}
    spans = {r["pair"]: r for r in interval(bootstrap(rows, arms, list(pairs.values()), **kw)).collect()}
    claims = []
    for name, (a, b, m) in pairs.items():
        table, span = (aucs if m == "auc" else bals), spans.get(f"{a}-{b}:{m}")
        if a not in table or b not in table or span is None:
            claims.append({"id": name, "holds": False, "why": "an arm is missing"})
            continue
        diff = round(table[a] - table[b], 6)
        claims.append({"id": name, "metric": m, "diff": diff, "lo": span["lo"], "hi": span["hi"], "holds": diff > 0 and span["lo"] > 0})
    claims.append({"id": "parsed", "parsed": parsed, "holds": bool(parsed) and all(n >= parsed_min for n in parsed.values())})
    return {"auc": aucs, "balanced_accuracy": bals, "claims": claims}
