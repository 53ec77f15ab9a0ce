"""CSV folders, engines, costs, text consolidation, graphs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tallyrule.engine import Engine
from tallyrule.functions import text as T
from tallyrule.operators import costs, sealed, search, textgraph
from tallyrule.sources import tables


def write_csv(path, n, label):
    r = tables.Stream(7)
    lines = ["spend,region,churned"] + [f"{(s := r.below(10))},{('north', 'south')[r.below(2)]},{label(s, r)}" for _ in range(n)]
    path.write_text("\n".join(lines))


def test_csv_signal(spark, tmp_path):
    write_csv(tmp_path / "Churn Data.csv", 240, lambda s, r: "yes" if s >= 6 else "no")
    (tmp_path / "small.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "brain.config.json").write_text(json.dumps({"targets": {"Churn Data.csv": "churned"}}))
    engine = Engine.from_csv_folder(spark, str(tmp_path), search.Effort(24, 4, 30))
    assert list(engine.library.patterns) == ["churn-data"] and engine.library.patterns["churn-data"].held_auc > 0.85
    assert "small" in engine.refused and engine.first_verified() == "churn-data"
    got = engine.think(spark.createDataFrame([(7.0, 1.0, 0.0), (999999.0, 99.0, 99.0)], ["spend", "region=north", "region=south"])).collect() if "region=north" in engine.library.patterns["churn-data"].features else []
    assert not got or got[1]["verdict"] == "ABSTAIN"
    assert engine.status().count() == 2


@pytest.mark.parametrize("text", ["a,b\n" + "\n".join(f"{i},x" for i in range(60)), "only\n1\n"])
def test_csv_refusals(spark, tmp_path, text):
    p = tmp_path / "t.csv"
    p.write_text(text)
    assert not tables.from_csv(spark, str(p)).ok


def test_terms(spark):
    got = spark.range(1).select(T.terms(F.lit("The Fraud amounts above abc 9zz amounts_x 12")).alias("t")).first()["t"]
    assert got == ["fraud", "amounts", "amounts_x"]


def test_cost_pins(spark):
    row = costs.cost_case(spark.range(1)).first()
    assert (row["staff"], row["seats_cost"]) == (25571.0, 1386.0) and row["ok"]


@pytest.mark.parametrize(("name", "value"), [("share", 1.5), ("years", 0.0), ("seats", 1.5), ("cases_per_week", -1.0), ("minutes_per_case", float("nan")), ("tokens_in", None)])
def test_cost_refusals(spark, name, value):
    row = costs.cost_case(spark.range(1).withColumn("v", F.lit(value).cast("double")), inputs={name: "v"}).first()
    assert not row["ok"] and row["why"] and row["own"] is None


@pytest.mark.parametrize(("ram", "tier"), [(15.7, "edge"), (24.0, "workstation"), (200.0, "cortex-M"), (256.0, "cortex-L"), (512.0, "cortex-XL"), (None, "edge")])
def test_tiers(spark, ram, tier):
    assert spark.range(1).select(costs.size_tier(F.lit(ram).cast("double")).alias("t")).first()["t"] == tier


def memories(spark):
    rows = [("a", "payment gateway latency alarm payment gateway"), ("b", "gateway latency payment alarm again"), ("c", "latency alarm payment gateway restated"), ("d", "gardening tomatoes sunlight"), ("e", None)]
    return spark.createDataFrame(rows, "id string, text string")


def test_clusters_and_fold(spark):
    recs = memories(spark)
    counts = textgraph.term_counts(recs, "id", "text")
    members = textgraph.clusters(recs, textgraph.cosine_pairs(counts, "id", 0.45), "id")
    assert {r["id"]: r["cluster"] for r in members.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    (dream,) = textgraph.consolidate(counts, members, "id").collect()
    assert dream["dream"] == "alarm gateway latency payment [consolidated from a, b, c]"
    q = textgraph.top_terms(counts, "id").select("term").where("term <> 'restated'")
    (f,) = textgraph.fold(recs, counts, members, q, "id").collect()
    assert f["kept"] == (f["why"] is None)
    assert textgraph.recall(q, recs).first()["recall"] == 1.0
    assert textgraph.recall(q.where("false"), recs).first()["recall"] == 1.0


def test_hebbian(spark):
    edges = spark.createDataFrame([("x", "y", 0.5), ("p", "q", 0.95)], "a string, b string, w double")
    events = spark.createDataFrame([("y", "x", True, 1), ("q", "p", True, 2), ("p", "q", False, 3), ("m", "n", False, 4), ("z", "z", True, 5)], "a string, b string, success boolean, ord long")
    assert {(r["a"], r["b"]): r["w"] for r in textgraph.hebbian(edges, events).collect()} == {("x", "y"): 0.65, ("p", "q"): 0.85, ("m", "n"): 0.0}


def test_graph(spark):
    nodes = spark.createDataFrame([("a", "f", "m"), ("b", "f", "m"), ("c", "g", "m"), ("d", "h", "k")], "domain string, field string, family string")
    sims = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, sim double")
    got = {(r["a"], r["b"]): r["w"] for r in textgraph.links(nodes, sims).collect()}
    assert got == {("a", "b"): 0.65, ("a", "c"): 0.22, ("b", "c"): 0.22}
    assert [r["domain"] for r in textgraph.isolated(nodes, textgraph.prune(textgraph.links(nodes, sims))).collect()] == ["d"]


def test_upsert_and_resume(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted((r["k"], r["v"]) for r in tables.upsert(old, new, "k").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    wanted = spark.createDataFrame([("x", 0), ("x", 1)], "arm string, idx int")
    assert [r["idx"] for r in tables.still_open(wanted, wanted.where("idx = 0")).collect()] == [1]


def test_state_and_books(spark, tmp_path):
    assert tables.read_state(spark, str(tmp_path / "none.json")) is None
    tables.write_state(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "s"))
    assert tables.read_state(spark, str(tmp_path / "s")).count() == 1
    tables.write_state(spark.range(50).coalesce(1), str(tmp_path / "many"))
    assert tables.read_state(spark, str(tmp_path / "many")).count() == 50
    (tmp_path / "one.json").write_text('{\n "a": 1,\n "b": [1,\n 2]\n}')
    assert [tuple(r) for r in tables.read_state(spark, str(tmp_path / "one.json")).collect()] == [(1, [1, 2])]
    (tmp_path / "bad.json").write_text('{"a": [')
    assert tables.read_state(spark, str(tmp_path / "bad.json")) is None
    assert len(tables.write_book(str(tmp_path / "books"), "d", "book", {"a": 1}, "mind")) == 3


def test_proposers():
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError
        return "reply"

    assert tables.propose(flaky, "p") == "reply" and len(calls) == 3
    assert tables.propose(None, "p") is None


def test_seal_and_receipts():
    text = 'x\n```json\n{"test": "T", "prompt": ["a {PageValues}"]}\n```\n'
    assert sealed.read_seal(text, "T")["prompt"] == ["a {PageValues}"]
    assert sealed.read_seal(text, "U") is None and sealed.read_seal("```json\n{\n```", "T") is None and sealed.read_seal(None, "T") is None
    r = sealed.hashed({"a": 1, "b": "é"})
    assert sealed.genuine(r) and not sealed.genuine({**r, "a": 2}) and not sealed.genuine(None)


def test_prompts(spark):
    df = spark.createDataFrame([(2.5, float("nan"))], "PageValues double, BounceRates double")
    assert df.select(sealed.prompt(["v {PageValues} {BounceRates} {PageValues}"], " book ").alias("p")).first()["p"] == "book\n\nv 2.50  2.50"
