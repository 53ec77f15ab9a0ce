"""Pinned values: random stream, published cards, boundaries of routing and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from tallyrule.functions import numeric as N
from tallyrule.functions import text as T
from tallyrule.operators import metrics, profile, routing, scorecard, search, splitting
from tallyrule.operators.scorecard import Rule
from tallyrule.plans.catalogue import CARDS
from tallyrule.sources import domains, tables

# Held-out AUC and accuracy of the published cards.
GRADES = {"fraud": (0.768272, 0.8), "maintenance": (0.781302, 0.904167), "credit": (0.672461, 0.638889), "churn": (0.795946, 0.723611), "energy": (0.782707, 0.743056), "intrusion": (0.756727, 0.702778), "inventory": (0.820803, 0.759722), "marketing": (0.645106, 0.615278)}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_stream(spark):
    want = [0.10204124473966658, 0.6270352604333311, 0.22736229840666056]
    assert [r[0] for r in spark.range(3).select(N.draw(F.col("id"), 20261105)).collect()] == want
    s = N.Stream(20261105)
    assert [s() for _ in range(3)] == want


@pytest.mark.parametrize("name", sorted(GRADES))
def test_published_cards(spark, name):
    p = search.pattern(domains.load(spark, name).cache(), name, domains.DOMAINS[name].names, scorecard.decode(CARDS[name]), 1)
    assert (p.held_auc, p.held_acc, p.held) == (*GRADES[name], 720)
    assert scorecard.encode(scorecard.decode(CARDS[name])) == CARDS[name]


@pytest.mark.parametrize(("name", "card", "grade"), [("science", "3fdcc6ad5cce2dddd62d", 0.770598), ("philosophy", "3fdc3aaecd0d36d9b220", 0.850178)])
def test_corpus_cards(spark, name, card, grade):
    d = tables.load_domain(spark, name)
    assert search.pattern(d.df.cache(), name, list(d.features), scorecard.decode(card), 1).held_auc == grade


def test_stem():
    assert scorecard.encode(scorecard.STEM) == "3fdcc6addcce2dddd62d"


def test_seed_is_tamper_evident():
    s = scorecard.seed_text("fraud", 7, "g:24.4.16")
    assert scorecard.read_seed(s) == ("fraud", 7, "g:24.4.16")
    assert scorecard.read_seed(s.replace(" fraud", "  fraud")) is None
    assert scorecard.read_seed(s.replace("24", "25")) is None
    assert scorecard.read_seed(None) is None


@pytest.mark.parametrize(("x", "want"), [(10.0, 1.0), (20.0, 1.0), (float("nan"), 0.0), (None, 0.0), (float("inf"), 0.0)])
def test_membership(spark, x, want):
    assert one(spark, N.membership(F.lit(x).cast("double"), F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit(40.0))) == want


def test_membership_far_away(spark):
    assert one(spark, N.membership(F.lit(100.0), F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit(40.0))) < 0.2


PATTERN = routing.Pattern("d", ("a",), (Rule("a", ">", 0.0, 2.0),), 0.0, 4.0, 0.5, 0.9, 0.8, 10, {"a": (0.0, 0.0, 0.0, 0.0, 2.0)}, "p")


def answers(spark, values, library=None):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    return routing.answer(df, [PATTERN] if library is None else library).collect()


def test_route_boundary_answers_at_equality(spark):
    edge, out, missing, nan = answers(spark, [-math.log(0.35), 5.0, None, float("nan")])
    assert edge["route_score"] == 0.35 and edge["verdict"] == "VERIFIED"
    assert [x["verdict"] for x in (out, missing, nan)] == ["ABSTAIN"] * 3


def test_confidence_and_label(spark):
    (x,) = answers(spark, [1.0])
    assert (x["label"], x["confidence"], x["score"]) == (1, 0.5, 2.0)
    zero = answers(spark, [0.0])[0]
    assert (zero["score"], zero["label"]) == (0.0, 0)  # equal to the threshold is 0


def test_unverified_and_empty_libraries_abstain(spark):
    from dataclasses import replace

    assert answers(spark, [0.0], [replace(PATTERN, held_auc=0.5)])[0]["why"] == "no verified pattern"
    assert answers(spark, [0.0], [])[0]["verdict"] == "ABSTAIN"


def test_receipts_show_tampering(spark):
    df = routing.answer(spark.createDataFrame([(1.0,)], "a double"), [PATTERN])
    assert routing.verify(df).first()["genuine"]
    assert not routing.verify(df.withColumn("receipt", F.replace("receipt", F.lit('"label":1'), F.lit('"label":0')))).first()["genuine"]
    assert not routing.verify(df.withColumn("receipt", F.lit(None).cast("string"))).first()["ok"]


def test_threshold_of_one_class(spark):
    rows = spark.createDataFrame([(0.0, 0), (2.0, 0), (2.0, 0)], "score double, y int")
    assert metrics.operating_point(metrics.histogram(rows, F.col("score"), F.col("y"))).first()["threshold"] == 2.0


def test_auc_ties_and_missing_class(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 0), ("b", 1.0, 1), ("c", 0.0, 0), ("c", 1.0, 1)], "k string, s double, y int")
    got = {r["k"]: r["auc"] for r in metrics.auc(metrics.histogram(rows, F.col("s"), F.col("y"), ["k"]), ["k"]).collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 1.0}


def test_balanced_accuracy_counts_null_as_miss(spark):
    rows = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (None, 0)], "label int, y int")
    assert metrics.balanced_accuracy(rows, F.col("label"), F.col("y")).first()[0] == 0.25


@pytest.mark.parametrize(("text", "want"), [("85", 85), (" 7%", 7), ("0.85", 0), ("101", None), ("0100", None), ("none", None), (None, None)])
def test_replies(spark, text, want):
    assert one(spark, T.parse_reply(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("x", "want"), [(-2.5, -2.0), (2.5, 3.0), (float("nan"), 0.0), (float("inf"), 0.0)])
def test_rounding_half_up(spark, x, want):
    assert one(spark, N.round_up(F.lit(x), 0)) == want


def test_json_numbers(spark):
    assert [one(spark, T.json_number(F.lit(x))) for x in (7.0, 0.5, -12.25)] == ["7", "0.5", "-12.25"]


def test_systematic_sample(spark):
    rows = spark.range(450).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = sorted(r["k"] for r in splitting.systematic(rows, "k", "y").where("y = 1").collect())
    ones = [i for i in range(450) if i % 3 == 0]
    assert got == [ones[k * len(ones) // 100] for k in range(100)]
    assert splitting.systematic(rows.where("k < 200"), "k", "y").count() == 0


def test_stratified_sizes(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    got = {r["y"]: r["count"] for r in splitting.stratified(rows, "k", "y", 0.4, 3).where("split = 'held'").groupBy("y").count().collect()}
    assert got == {1: int(143 * 0.4), 0: int(857 * 0.4)}


def test_order_statistics_of_empty_table(spark):
    assert profile.order_statistics(spark.createDataFrame([], "a double"), ["a"], [0.5]).count() == 0


def test_hypotheses():
    feats = ["amount", "hourOfDay"]
    assert search.parse_hypotheses('x [{"feature":"Amount","direction":"LOW"},{"feature":"nope"}]', feats) == [("amount", "low")]
    assert search.parse_hypotheses("hourOfDay is below normal", feats) == [("hourOfDay", "low")]
    assert search.parse_hypotheses("", feats) == []
    assert search.genome_of([], feats) == scorecard.STEM


def test_search_is_deterministic_and_finds_signal(spark):
    df = spark.range(600).select(F.col("id").alias("row_id"), (F.pmod(F.xxhash64("id"), F.lit(10))).cast("double").alias("spend"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5))).cast("double").alias("noise"))
    df = splitting.by_index(df.withColumn("y", (F.col("spend") >= 6).cast("int")), "row_id").cache()
    effort = search.Effort(30, 4, 12)
    a, b = (search.grow(df, "t", ["spend", "noise"], 7, effort) for _ in range(2))
    assert a.rules == b.rules and a.held_auc > 0.9
    lib = search.build_library({"t": (df, ["spend", "noise"])}, effort=effort)
    assert list(lib.patterns) == ["t"]
    again = search.grow_tier(lib, {"t": (df, ["spend", "noise"])}, effort)
    assert again.patterns["t"].held_auc >= lib.patterns["t"].held_auc


def test_noise_is_cut(spark):
    df = splitting.by_index(spark.range(600).select(F.col("id").alias("row_id"), F.rand(3).alias("a"), F.rand(4).alias("b"), (F.rand(5) < 0.5).cast("int").alias("y")), "row_id")
    lib = search.build_library({"n": (df, ["a", "b"])}, effort=search.Effort(8, 2, 3))
    assert not lib.patterns and lib.cut[0]["domain"] == "n"


def test_forge_with_a_member_down(spark):
    df = domains.load(spark, "fraud", 600).cache()
    out = search.forge(df, "fraud", domains.DOMAINS["fraud"].names, {"one": '[{"feature":"amount","direction":"high"}]', "two": None}, effort=search.Effort(8, 2, 3))
    assert out["dropped"] == ["two"] and out["val_auc"] >= max(v for _, v in out["scoreboard"])
    assert "PATTERN BOOK" in out["book"]


def test_evolution_never_falls(spark):
    df = domains.load(spark, "fraud", 400).cache()
    out = search.evolve(df, "fraud", domains.DOMAINS["fraud"].names[:3], generations=1, population=2, effort=search.Effort(4, 1, 2))
    assert out["curve"] == sorted(out["curve"]) and out["auc"] >= out["baseline"]


def test_judge(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(40)], "idx long, y int")
    arms = rows.select(F.lit("P").alias("arm"), "idx", F.col("y").cast("double").alias("score"), F.col("y").alias("label")).union(rows.select(F.lit("F"), "idx", F.lit(0.5), F.lit(1)))
    out = metrics.judge(rows, arms, {"X": ("P", "F", "auc"), "Z": ("P", "gone", "auc")}, {"m": 195}, draws=20)
    assert out["auc"] == {"P": 1.0, "F": 0.5} and [c["holds"] for c in out["claims"]] == [True, False, True]


def test_seeds_grow_again(spark):
    df, names = domains.load(spark, "fraud").cache(), domains.DOMAINS["fraud"].names
    p = search.germinate(df, names, scorecard.seed_text("fraud", 1, "f:" + CARDS["fraud"]))
    assert p.held_auc == GRADES["fraud"][0] and search.germinate(df, names, p.seed).pattern_id == p.pattern_id
    assert search.germinate(df, names, p.seed[:-1] + "x") is None
    assert search.germinate(df, names, scorecard.seed_text("fraud", 3, "g:6.2.2")).domain == "fraud"


@pytest.mark.parametrize("value", [None, float("nan"), float("inf"), float("-inf"), 1e308, -1e308, 0.0, -0.0])
def test_hostile_inputs_never_fail(spark, value):
    df = spark.createDataFrame([(value,)], "a double")
    row = routing.answer(df, [PATTERN]).first()
    assert row["verdict"] in ("VERIFIED", "ABSTAIN") and 0.0 <= row["route_score"] <= 1.0


def test_order_statistics_of_values_of_any_size(spark):
    values = [0.0, -0.0, 1e-310, -1e-310, 5e-301, -3.5, -8.0, -7.999999999999999, 7.999999999999999, 8.0, 8.000000000000002, 1e300, -1e300, 2.0**-1000, 3.0, 3.0, 3.0, 0.1, -0.1]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "a double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["p"]: r["value"] for r in profile.order_statistics(rows, ["a"], ps).collect()}
    assert got == {p: sorted(values)[math.floor(p * (len(values) - 1))] for p in ps}


def test_ranks_run_over_blocks_of_ranges(spark):
    keys = list(range(-50, 200, 3)) + [10_000, 10_001]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["_rank"] for r in splitting._ranked(df, "k", width=4).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_seeds_of_names(spark):
    names = ["", "churn", "a b", "Zürich", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(N.seed_of(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == [N.seed_number(n or "") for n in names]


def test_arms_abstain_far_outside(spark):
    p = routing.Pattern("d", ("x",), (Rule("x", ">", 1.0, 1.0),), 0.5, 1.0, 0.5, 0.7, 0.7, 10, {"x": (0.0, 1.0, 2.0, 3.0, 4.0)}, "i")
    rows = spark.createDataFrame([(1, 2.0), (2, 0.5), (3, 900.0)], "idx long, x double")
    got = {(r.arm, r.idx): (r.score, r.label) for r in routing.arm_scores(rows, "idx", {"P": p, "Q": p}, "P").collect()}
    assert got == {("P", 1): (1.0, 1), ("P", 2): (0.0, 0), ("P", 3): (1.0, None), ("Q", 1): (1.0, None), ("Q", 2): (0.0, None), ("Q", 3): (1.0, None)}
