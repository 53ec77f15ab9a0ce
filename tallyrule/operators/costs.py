"""Cost of deciding cases by staff, rented assistants, a cloud model or an owned engine; and model tiers by memory."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrule.functions.numeric import over_years, round_up


@dataclass(frozen=True)
class Basis:
    """Sourced prices (hourly wage, yearly price rise, pence a kWh, extra watts, hours a year, seat a month, API prices a million tokens, pounds a dollar)."""

    wage: float = 19.67
    cpi: float = 0.031
    pence: float = 24.51
    watts: float = 15.0
    hours: float = 8760.0
    seat: float = 23.10
    api_in: float = 2.0
    api_out: float = 10.0
    fx: float = 0.75396


DEFAULTS = {"cases_per_week": 500.0, "minutes_per_case": 3.0, "share": 0.5, "seats": 5.0, "tokens_in": 1500.0, "tokens_out": 300.0, "years": 3.0}
LIMITS = (("cases_per_week", 1e6, "cases a week: 0 to 1,000,000"), ("minutes_per_case", 480.0, "minutes a case: 0 to 480"), ("share", 1.0, "the share of cases it answers: 0 to 1"))


def problem(c: dict[str, Column]) -> Column:
    """What is wrong with the inputs, or null."""
    ok = lambda x: F.coalesce(~F.isnan(x) & (x >= 0) & (x < float("inf")), F.lit(False))
    whole = lambda x: ok(x) & (x == F.floor(x))
    out = F.when(F.lit(False), F.lit(""))
    for name, most, why in LIMITS:
        out = out.when(~ok(c[name]) | (c[name] > most), why)
    out = out.when(~whole(c["seats"]), "licences: a whole number").when(~ok(c["tokens_in"]) | ~ok(c["tokens_out"]), "tokens: numbers")
    return out.when(~whole(c["years"]) | ~c["years"].between(1, 10), "years: 1 to 10")


def cost_case(df: DataFrame, basis: Basis = Basis(), inputs: dict[str, str] | None = None) -> DataFrame:
    """The rows with ok, why, the yearly lines, each route's yearly and total cost, and savings; money is rounded half up at each line.

    inputs maps names in DEFAULTS to columns; others take the default. Bad inputs give ok false, a reason and null amounts.
    """
    c = {k: F.col((inputs or {})[k]).cast("double") if k in (inputs or {}) else F.lit(v) for k, v in DEFAULTS.items()}
    b = {k: F.lit(float(v)) for k, v in asdict(basis).items()}
    r2 = lambda x: round_up(x, 2)
    df = df.withColumn("why", problem(c)).withColumn("ok", F.col("why").isNull())
    hours = c["cases_per_week"] * c["minutes_per_case"] / 60
    df = df.withColumns({
        "hours_per_week": r2(hours), "staff": r2(hours * 52 * b["wage"]), "seats_cost": r2(c["seats"] * 12 * b["seat"]),
        "api": r2(c["cases_per_week"] * 52 * (c["tokens_in"] * b["api_in"] + c["tokens_out"] * b["api_out"]) / 1e6 * b["fx"]), "power": r2(b["watts"] * b["hours"] / 1000 * b["pence"] / 100),
    })
    df = df.withColumn("taken_off", r2(F.col("staff") * c["share"]))
    df = df.withColumns({"today": F.col("staff"), "rent_seats": r2(F.col("staff") + F.col("seats_cost")), "cloud_api": r2(F.col("staff") - F.col("taken_off") + F.col("api")), "own": r2(F.col("staff") - F.col("taken_off") + F.col("power"))})
    routes = ("today", "rent_seats", "cloud_api", "own")
    df = df.withColumns({f"{k}_over": over_years(F.col(k), b["cpi"], F.when(F.col("ok"), c["years"]).otherwise(F.lit(1.0))) for k in routes})
    df = df.withColumns({"saving_per_year": r2(F.col("today") - F.col("own")), "saving_over": r2(F.col("today_over") - F.col("own_over")), "versus_cloud_over": r2(F.col("cloud_api_over") - F.col("own_over"))})
    amounts = ["hours_per_week", "staff", "taken_off", "seats_cost", "api", "power", *routes, *[f"{k}_over" for k in routes], "saving_per_year", "saving_over", "versus_cloud_over"]
    return df.withColumns({k: F.when(F.col("ok"), F.col(k)) for k in amounts})


# The least memory (GB) of each tier.
TIERS = ((512, "cortex-XL"), (256, "cortex-L"), (180, "cortex-M"), (100, "cortex-S"), (24, "workstation"), (0, "edge"))


def size_tier(ram: Column) -> Column:
    """The largest tier whose floor a host's memory meets; the smallest for what is less, negative or unknown."""
    out = F.when(F.lit(False), F.lit(""))
    for least, name in TIERS:
        out = out.when(ram >= least, name)
    return out.otherwise(TIERS[-1][1])


def plan(df: DataFrame, ram: str, space: int = 127) -> DataFrame:
    """Hosts with their tier, the addresses they hold, whether they hold the whole map, and whether a frontier model fits."""
    r = F.col(ram)
    return df.select("*", size_tier(r).alias("tier"), F.lit(space).alias("addresses"), (r >= 24).alias("full_map"), (r >= 100).alias("frontier"))
