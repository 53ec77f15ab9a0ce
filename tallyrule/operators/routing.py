"""Routing and answering: membership against a library of cards, a gate, and receipts. Inputs are never shuffled."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrule.functions.numeric import confidence, finite, membership, round_finite, round_up
from tallyrule.functions.text import canonical_json, digest, json_number, json_opening, json_string
from tallyrule.operators.scorecard import Rule, score

GATE_AUC, ROUTE_MIN = 0.60, 0.35
MODEL = "tallyrule/1"


@dataclass(frozen=True)
class Pattern:
    """A fitted card with what the router and the gate need. prints: feature -> (lo, q1, med, q3, hi)."""

    domain: str
    features: tuple[str, ...]
    rules: tuple[Rule, ...]
    threshold: float
    spread: float
    base: float
    held_auc: float
    held_acc: float
    held: int
    prints: dict[str, tuple[float, float, float, float, float]] = field(hash=False)
    pattern_id: str = ""
    seed: str = ""

    @property
    def verified(self) -> bool:
        return self.held_auc >= GATE_AUC


def route_score(p: Pattern) -> Column:
    """The mean membership of an input's features; 0 unless all of them are there."""
    total, full = F.lit(0.0), F.lit(True)
    for f in p.features:
        lo, q1, _, q3, hi = p.prints[f]
        x = F.col(f).cast("double")
        total, full = total + membership(x, F.lit(q1), F.lit(q3), F.lit(lo), F.lit(hi)), full & finite(x)
    return F.when(full, round_finite(total / len(p.features))).otherwise(0.0)


def _known(df: DataFrame, p: Pattern) -> bool:
    return all(f in df.columns for f in p.features)


def _in_order(library: list[Pattern]) -> list[Pattern]:
    """The library by domain: of equally good patterns the first one wins."""
    return sorted(library, key=lambda p: p.domain)


def route(df: DataFrame, library: list[Pattern]) -> DataFrame:
    """The inputs with route_domain and route_score of the best pattern (null and 0 for an empty library).

    The library is part of the plan, so each row ranks it in place: no join, no shuffle. The best is a maximum of (route score,
    order), inside generated code. `_at` is its place in the library by domain.
    """
    if not library:
        return df.withColumns({"route_domain": F.lit(None).cast("string"), "route_score": F.lit(0.0), "_at": F.lit(None).cast("int")})
    library = _in_order(library)
    fits = [F.struct((route_score(p) if _known(df, p) else F.lit(0.0)).alias("fit"), F.lit(-i).alias("order")) for i, p in enumerate(library)]
    out = df.withColumn("_best", F.greatest(*fits) if len(fits) > 1 else fits[0])
    out = out.withColumns({"route_score": F.col("_best.fit"), "_at": -F.col("_best.order")}).drop("_best")
    return out.withColumn("route_domain", F.array(*[F.lit(p.domain) for p in library])[F.col("_at")])


def _facts(df: DataFrame, library: list[Pattern]) -> Column:
    """What answers and receipts state of each pattern, as one array of constants."""
    return F.array(*[
        F.struct(F.lit(p.verified and _known(df, p)).alias("verified"), F.lit(float(p.threshold)).alias("threshold"), F.lit(float(p.spread)).alias("spread"), receipt_opening(p).alias("opening"))
        for p in library
    ])


def small_methods(df: DataFrame) -> None:
    """Lets stages whose generated method is over 8,000 bytes run as split projections, unless the session sets a limit itself.

    The JVM never compiles larger methods: fused into one, the expressions of a library ran three times slower.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def answer(df: DataFrame, library: list[Pattern], floor: float = ROUTE_MIN) -> DataFrame:
    """The inputs with verdict, route_domain, route_score, score, label, confidence, why and receipt hash.

    An input is answered by the best pattern if that one covers it (score at least floor) and is verified; else it abstains.
    Stateless and row by row, so it runs on streams as it is. The best pattern's constants are taken once from an array, so the
    plan grows with the library, not with the library times the results.
    """
    small_methods(df)
    library = _in_order(library)
    out = route(df, library)
    fact = (lambda name: _facts(df, library)[F.col("_at")][name]) if library else (lambda name: F.lit(None))
    why = F.when(F.col("route_domain").isNull(), "no features to route on").when(F.col("route_score") < floor, "out of distribution").when(~F.coalesce(fact("verified"), F.lit(False)), "no verified pattern")
    out = out.withColumn("why", why)
    ok = F.col("why").isNull()
    points = F.lit(None)
    for i, p in enumerate(library):
        if _known(df, p):
            points = F.when(F.col("_at") == i, score(p.rules)).otherwise(points)
    out = out.withColumn("score", F.when(ok, points).cast("double"))
    out = out.withColumns({"threshold": F.when(ok, fact("threshold")).cast("double"), "confidence": F.when(ok, confidence(F.col("score"), fact("threshold"), fact("spread"))).cast("double")})
    out = out.withColumn("label", F.when(ok, (F.col("score") > F.col("threshold")).cast("int")))
    out = out.withColumn("verdict", F.when(ok, "VERIFIED").otherwise("ABSTAIN"))
    out = out.withColumn("receipt", F.when(ok, receipt_core(fact("opening"))))
    return out.withColumn("receipt_hash", digest(F.col("receipt"))).drop("_at")


def arm_scores(sample: DataFrame, key: str, arms: dict[str, Pattern], answering: str) -> DataFrame:
    """(arm, key, score, label) of every sample row in each arm: scores of all, labels of the answering arm alone.

    Its label is null where it abstains, with a library that holds only its pattern; other arms have none.
    """
    rows = answer(sample, [arms[answering]]).withColumnRenamed("label", "_label")
    each = [F.struct(F.lit(name).alias("arm"), score(p.rules).alias("score"), (F.col("_label") if name == answering else F.lit(None)).cast("int").alias("label")) for name, p in arms.items()]
    return rows.drop("score").select(F.col(key), F.explode(F.array(*each)).alias("a")).select("a.arm", key, "a.score", "a.label")


def receipt_opening(p: Pattern) -> Column:
    """The part of a receipt's JSON that the pattern decides: a constant."""
    num = lambda x: json_number(F.lit(float(x)))
    return json_opening({
        "model": F.lit(f'"{MODEL}"'), "domain": json_string(F.lit(p.domain)), "patternId": json_string(F.lit(p.pattern_id)), "heldAuc": num(p.held_auc), "heldAcc": num(p.held_acc), "held": num(p.held), "gateAuc": F.lit(repr(GATE_AUC)),
    })


def receipt_core(opening: Column) -> Column:
    """The receipt's JSON, keys in fixed order, numbers in their shortest form."""
    return canonical_json({
        "routeScore": json_number(F.col("route_score")), "score": json_number(F.col("score")), "threshold": json_number(F.col("threshold")), "label": F.col("label").cast("string"), "verdict": F.lit('"VERIFIED"'),
    }, opening)


def verify(df: DataFrame, receipt: str = "receipt", claimed: str = "receipt_hash") -> DataFrame:
    """The rows with ok (there is a receipt) and genuine (its digest is the claimed one)."""
    ok = F.col(receipt).isNotNull() & F.col(claimed).isNotNull()
    return df.withColumns({"ok": ok, "genuine": F.coalesce(ok & (digest(F.col(receipt)) == F.col(claimed)), F.lit(False))})


def junk(library_prints: dict[str, tuple[float, float, float, float, float]]) -> dict[str, Column]:
    """An input far outside: each feature at its maximum plus four times its range (at least 1)."""
    return {f: F.lit(hi + 4 * max(hi - lo, 1.0)) for f, (lo, _, _, _, hi) in library_prints.items()}


def trust(df: DataFrame, verdict: str, label: str, y: str, answerable: str) -> DataFrame:
    """One row: how often an answerable input got its right label, or junk an abstention; and the flat majority guess for comparison."""
    right = F.when(F.col(answerable), F.coalesce(F.col(label) == F.col(y), F.lit(False))).otherwise(F.col(verdict) == "ABSTAIN")
    ones, n = F.sum(F.when(F.col(answerable), F.col(y))), F.sum(F.col(answerable).cast("int"))
    return df.agg(F.count("*").alias("n"), round_up(F.avg(right.cast("double"))).alias("trust"), round_up(F.greatest(ones, n - ones) / F.count("*")).alias("flat"))
