"""Built-in domains: generated row by row from a counter stream, so any partitioning gives the same table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrule.functions.numeric import clamp, draw, gauss

ROWS = 2400


@dataclass(frozen=True)
class Feature:
    """How a feature is drawn: 'normal' centre + scale*g, 'fold' centre + scale*|g|, 'count' a rounded fold, 'flag' with probability scale; clamped."""

    name: str
    kind: str
    centre: float
    scale: float
    lo: float = 0.0
    hi: float = 1.0

    @property
    def draws(self) -> int:
        return 1 if self.kind == "flag" else 2

    def column(self, k: Column, seed: int) -> Column:
        if self.kind == "flag":
            return F.when(draw(k, seed) < self.scale, 1.0).otherwise(0.0)
        g = gauss(k, seed)
        x = F.lit(self.centre) + F.lit(self.scale) * (g if self.kind == "normal" else F.abs(g))
        return clamp(F.floor(x + 0.5).cast("double") if self.kind == "count" else x, self.lo, self.hi)


@dataclass(frozen=True)
class Term:
    """A term of the latent risk: coefficient times the distance from an offset ('linear', 'above', 'below', 'apart')."""

    coef: float
    feature: str
    offset: float = 0.0
    shape: str = "linear"

    def column(self) -> Column:
        d = F.col(self.feature) - F.lit(self.offset)
        if self.shape == "above":
            d = F.greatest(F.lit(0.0), d)
        elif self.shape == "below":
            d = F.greatest(F.lit(0.0), -d)
        elif self.shape == "apart":
            d = F.abs(d)
        return F.lit(self.coef) * d


@dataclass(frozen=True)
class Domain:
    """A domain: its title, the field of life it serves, its stream's seed, features in draw order, latent terms and intercept."""

    name: str
    title: str
    field: str
    seed: int
    features: tuple[Feature, ...]
    terms: tuple[Term, ...]
    intercept: float

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]


# The generators' parameters.
DOMAINS = {
    d.name: d
    for d in (
        Domain("fraud", "Card fraud", "finance", 404, (Feature("amount", "normal", 60, 90, 0, 5000), Feature("hourOfDay", "normal", 13, 6, 0, 23), Feature("distanceKm", "fold", 8, 40, 0, 3000), Feature("recentTx", "fold", 2, 2, 0, 40), Feature("merchantRisk", "normal", 0.3, 0.25, 0, 1), Feature("cardNotPresent", "flag", 0, 0.4)), (Term(0.004, "amount", 120), Term(0.10, "hourOfDay", 2, "below"), Term(0.09, "hourOfDay", 22, "above"), Term(0.003, "distanceKm"), Term(0.12, "recentTx", 4), Term(1.8, "merchantRisk", 0.5), Term(0.8, "cardNotPresent")), -1.0),
        Domain("maintenance", "Predictive maintenance", "industry", 505, (Feature("vibration", "fold", 2, 1.2, 0, 20), Feature("tempC", "normal", 55, 12, 10, 120), Feature("hoursSinceService", "normal", 400, 250, 0, 3000), Feature("loadPct", "normal", 65, 18, 0, 100), Feature("ageMonths", "normal", 36, 24, 0, 240), Feature("errorRate", "fold", 0.5, 0.6, 0, 20)), (Term(0.35, "vibration", 3), Term(0.05, "tempC", 62), Term(0.0016, "hoursSinceService", 450), Term(0.03, "loadPct", 60), Term(0.012, "ageMonths", 36), Term(0.5, "errorRate", 1.0)), -1.6),
        Domain("credit", "Loan default", "finance", 606, (Feature("dti", "normal", 0.35, 0.15, 0, 1.5), Feature("utilisation", "normal", 0.5, 0.22, 0, 1.5), Feature("delinquencies", "count", 0.6, 1.0, 0, 12), Feature("incomeK", "normal", 42, 18, 8, 300), Feature("loanToValue", "normal", 0.7, 0.18, 0, 1.4), Feature("employMonths", "normal", 48, 36, 0, 480)), (Term(2.2, "dti", 0.36), Term(1.6, "utilisation", 0.5), Term(0.45, "delinquencies", 0.8), Term(-0.02, "incomeK", 42), Term(1.5, "loanToValue", 0.75), Term(-0.006, "employMonths", 48)), -0.3),
        Domain("churn", "Subscription churn", "commerce", 707, (Feature("tenureMonths", "normal", 20, 16, 0, 120), Feature("monthlySpend", "normal", 55, 25, 0, 400), Feature("supportTickets", "count", 1.5, 1.8, 0, 30), Feature("usageDropPct", "normal", 15, 20, -40, 100), Feature("contractMonthsLeft", "normal", 6, 5, 0, 24), Feature("loginsPerWeek", "normal", 6, 4, 0, 50)), (Term(-0.05, "tenureMonths", 18), Term(0.28, "supportTickets", 1.5), Term(0.035, "usageDropPct", 10), Term(-0.12, "contractMonthsLeft", 6), Term(-0.14, "loginsPerWeek", 6)), -0.4),
        Domain("energy", "Grid overload", "energy", 808, (Feature("loadMW", "normal", 600, 150, 0, 2000), Feature("tempC", "normal", 18, 11, -15, 48), Feature("hourOfDay", "normal", 14, 5, 0, 23), Feature("humidity", "normal", 55, 18, 0, 100), Feature("windMW", "normal", 120, 70, 0, 600), Feature("priceMWh", "normal", 55, 30, 0, 600)), (Term(0.006, "loadMW", 620), Term(0.07, "tempC", 20, "apart"), Term(0.12, "hourOfDay", 16, "above"), Term(-0.004, "windMW", 120), Term(0.003, "priceMWh", 55)), -1.3),
        Domain("intrusion", "Network intrusion", "security", 909, (Feature("bytesInKB", "normal", 120, 90, 0, 5000), Feature("bytesOutKB", "normal", 90, 80, 0, 5000), Feature("connSeconds", "fold", 30, 40, 0, 1000), Feature("failedLogins", "count", 0.8, 1.6, 0, 50), Feature("distinctPorts", "count", 3, 4, 1, 200), Feature("offHours", "flag", 0, 0.35)), (Term(0.5, "failedLogins", 1), Term(0.12, "distinctPorts", 4), Term(0.004, "connSeconds", 30), Term(0.001, "bytesOutKB"), Term(-0.001, "bytesInKB"), Term(0.7, "offHours")), -1.2),
        Domain("inventory", "Inventory stockout", "supply chain", 1010, (Feature("daysOfStock", "normal", 18, 10, 0, 120), Feature("leadTimeDays", "normal", 10, 6, 0, 90), Feature("demandVar", "fold", 0.4, 0.25, 0, 3), Feature("reorderGap", "normal", 5, 6, -30, 60), Feature("seasonalityIdx", "normal", 1, 0.4, 0, 3), Feature("supplierReliab", "normal", 0.82, 0.12, 0, 1)), (Term(-0.10, "daysOfStock", 16), Term(0.06, "leadTimeDays", 9), Term(1.2, "demandVar", 0.4), Term(0.05, "reorderGap", 4), Term(-2.0, "supplierReliab", 0.8)), -0.3),
        Domain("marketing", "Lead conversion", "marketing", 1111, (Feature("emailOpens", "normal", 4, 3, 0, 40), Feature("clickRate", "normal", 0.12, 0.08, 0, 1), Feature("siteVisits", "fold", 3, 3, 0, 60), Feature("timeOnSiteMin", "normal", 6, 5, 0, 120), Feature("pastPurchases", "count", 1, 1.5, 0, 40), Feature("daysSinceLast", "normal", 40, 30, 0, 400), Feature("adExposures", "fold", 8, 6, 0, 80)), (Term(0.10, "emailOpens", 4), Term(3.0, "clickRate", 0.12), Term(0.08, "siteVisits", 3), Term(0.05, "timeOnSiteMin", 6), Term(0.18, "pastPurchases", 1), Term(-0.006, "daysSinceLast", 40), Term(-0.03, "adExposures", 25, "above")), -0.4),
    )
}
#: The verticals a ladder adds rung by rung.
RUNGS = (("fraud", "maintenance", "credit"), ("churn", "energy", "intrusion", "inventory"))


def held(row: Column) -> Column:
    """Whether a row is held out: three of every ten."""
    return row % 10 < 3


def load(spark: SparkSession, name: str, rows: int = ROWS) -> DataFrame:
    """row_id, the features, y and split ('train' or 'held') of a built-in domain."""
    if name not in DOMAINS:
        raise KeyError(f"unknown domain: {name}")
    d = DOMAINS[name]
    per_row = sum(f.draws for f in d.features) + 2
    df, at = spark.range(rows).withColumnRenamed("id", "row_id"), 0
    columns = {}
    for f in d.features:
        columns[f.name] = f.column(F.col("row_id") * per_row + at, d.seed)
        at += f.draws
    latent = F.lit(d.intercept)
    for t in d.terms:
        latent = latent + t.column()
    df = df.withColumns(columns).withColumn("y", (latent + gauss(F.col("row_id") * per_row + at, d.seed) > 0).cast("int"))
    return df.withColumn("split", F.when(held(F.col("row_id")), "held").otherwise("train"))
