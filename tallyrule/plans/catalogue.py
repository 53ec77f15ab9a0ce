"""The engine's own queries over the test tables, each with SQL for an independent check where SQL can express it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrule.functions import numeric as N
from tallyrule.functions import text as T
from tallyrule.operators import costs, metrics, profile, routing, sealed, search, splitting, textgraph
from tallyrule.operators.scorecard import Rule, book, decode, score, score_map
from tallyrule.sources import domains, tables
from tallyrule.streaming import answers

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: str, places: int = 6) -> str:
    return f"(floor(({x})*1e{places}+0.5)/1e{places})"


# ---- three domains on the test tables -----------------------------------------------------------------------------------

LINE = ("qty", "price", "disc", "tax")
LINE_RULES = (Rule("qty", ">", 25.0, 0.5), Rule("disc", "<=", 0.05, 0.25), Rule("tax", ">", 0.04, -0.25), Rule("price", ">", 30000.0, 1.0))
LINE_RULES_2 = (Rule("qty", ">", 13.0, 1.0), Rule("disc", "<=", 0.03, 0.5), Rule("price", "<=", 79000.0, -0.5))
ORDER_RULES = (Rule("total", ">", 250000.0, 1.0), Rule("days", "<=", 1200.0, 0.5))
PART_RULES = (Rule("size", ">", 25.0, 1.0), Rule("retail", "<=", 1000.0, -0.5))
LIBRARY = [
    routing.Pattern("line", LINE, LINE_RULES, 0.5, 2.0, 0.334, 0.62, 0.6, 18000, {"qty": (1.0, 13.0, 25.0, 38.0, 50.0), "price": (900.0, 27000.0, 53000.0, 79000.0, 105000.0), "disc": (0.0, 0.03, 0.05, 0.07, 0.1), "tax": (0.0, 0.02, 0.04, 0.06, 0.08)}, "a1"),
    routing.Pattern("order", ("total", "days"), ORDER_RULES, 1.0, 1.5, 0.4, 0.55, 0.52, 4500, {"total": (1000.0, 125000.0, 251000.0, 374000.0, 500000.0), "days": (0.0, 600.0, 1200.0, 1800.0, 2405.0)}, "b2"),
    routing.Pattern("part", ("size", "retail"), PART_RULES, 0.25, 1.5, 0.5, 0.7, 0.66, 600, {"size": (1.0, 13.0, 25.0, 38.0, 50.0), "retail": (900.0, 950.0, 1000.0, 1050.0, 1100.0)}, "c3"),
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("row_id"), "l_linenumber", "l_suppkey", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.when(domains.held(F.col("l_orderkey")), "held").otherwise("train").alias("split"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), "o_custkey", F.col("o_totalprice").alias("total"), F.datediff(F.col("o_orderdate"), F.lit("1995-01-01")).cast("double").alias("days"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y"), F.when(domains.held(F.col("o_orderkey")), "held").otherwise("train").alias("split"))


LINES_SQL = "lines AS (SELECT l_orderkey AS row_id, l_linenumber, l_suppkey, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, CAST(l_returnflag = 'R' AS INT) AS y, CASE WHEN l_orderkey % 10 < 3 THEN 'held' ELSE 'train' END AS split FROM lineitem)"
ORDERS_SQL = "ord AS (SELECT o_orderkey AS row_id, o_custkey, o_totalprice AS total, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS days, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) AS y, CASE WHEN o_orderkey % 10 < 3 THEN 'held' ELSE 'train' END AS split FROM orders)"


def score_sql(rules: tuple[Rule, ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN {r.feat} {r.op} {r.v!r} THEN {r.w!r} ELSE 0.0 END::DOUBLE" for r in rules) + ")"


def auc_sql(source: str, by: str = "") -> str:
    """AUC of (by, score, y) rows by mid-ranks."""
    part, group = (f"PARTITION BY {by} ", f"GROUP BY {by}") if by else ("", "")
    sel = f"{by}, " if by else ""
    return f"""h AS (SELECT {sel}score, sum(y) AS pos, sum(1 - y) AS neg FROM {source} GROUP BY {sel}score),
    w AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h),
    a AS (SELECT {sel}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {r6('sum(pos * (below + neg / 2.0))::DOUBLE / (sum(pos)::DOUBLE * sum(neg)::DOUBLE)')} ELSE 0.5 END::DOUBLE AS auc, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg FROM w {group})"""


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free inputs of all three domains, each with the features it has."""
    a = lines(spark, sf_dir).select(F.lit("line").alias("src"), (F.col("row_id") * 10 + F.col("l_linenumber")).alias("id"), *LINE)
    b = orders(spark, sf_dir).select(F.lit("order").alias("src"), F.col("row_id").alias("id"), "total", "days")
    c = read(spark, sf_dir, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retail"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


_NULLS = ", ".join("NULL::DOUBLE AS {}".format(x) for x in ("qty", "price", "disc", "tax"))
INPUTS_SQL = f"""{LINES_SQL}, {ORDERS_SQL}, inp AS (
    SELECT 'line' AS src, row_id * 10 + l_linenumber AS id, qty, price, disc, tax, NULL::DOUBLE AS total, NULL::DOUBLE AS days, NULL::DOUBLE AS size, NULL::DOUBLE AS retail FROM lines
    UNION ALL SELECT 'order', row_id, {_NULLS}, total, days, NULL, NULL FROM ord
    UNION ALL SELECT 'part', p_partkey, {_NULLS}, NULL, NULL, p_size::DOUBLE, p_retailprice FROM part)"""


def member_sql(x: str, p: tuple) -> str:
    lo, q1, _, q3, hi = p
    return f"CASE WHEN {x} IS NULL THEN 0.0 WHEN {x} BETWEEN {q1!r} AND {q3!r} THEN 1.0 ELSE {r6(f'exp(-(CASE WHEN {x} < {q1!r} THEN {q1!r} - {x} ELSE {x} - {q3!r} END)::DOUBLE / greatest({q3!r}::DOUBLE - {q1!r}::DOUBLE, ({hi!r}::DOUBLE - {lo!r}::DOUBLE) * 0.5, 1e-9))')} END::DOUBLE"


def _route_sql() -> str:
    cols = []
    for p in LIBRARY:
        full = " AND ".join(f"{f} IS NOT NULL" for f in p.features)
        total = " + ".join(f"({member_sql(f, p.prints[f])})" for f in p.features)
        cols.append(f"CASE WHEN {full} THEN {r6(f'({total}) / {len(p.features)}::DOUBLE')} ELSE 0.0 END::DOUBLE AS s_{p.domain}")
    best = "CASE WHEN s_line >= s_order AND s_line >= s_part THEN 'line' WHEN s_order >= s_part THEN 'order' ELSE 'part' END"
    return f"{INPUTS_SQL}, sc AS (SELECT *, {', '.join(cols)} FROM inp), rt AS (SELECT *, {best} AS route_domain, greatest(s_line, s_order, s_part) AS route_score FROM sc)"


ROUTE_SQL = _route_sql()


def _answer_sql() -> str:
    why = "CASE WHEN route_score < 0.35 THEN 'out of distribution' WHEN route_domain = 'order' THEN 'no verified pattern' END"
    sc = f"CASE route_domain WHEN 'line' THEN {score_sql(LINE_RULES)} WHEN 'part' THEN {score_sql(PART_RULES)} END"
    return f"""{ROUTE_SQL}, an AS (SELECT *, {why} AS why, CASE WHEN route_score >= 0.35 AND route_domain <> 'order' THEN {sc} END AS score FROM rt),
    an2 AS (SELECT *, CASE WHEN why IS NULL THEN CASE route_domain WHEN 'line' THEN 0.5 ELSE 0.25 END::DOUBLE END AS threshold, CASE WHEN why IS NULL THEN 'VERIFIED' ELSE 'ABSTAIN' END AS verdict, CASE route_domain WHEN 'line' THEN 2.0 ELSE 1.5 END::DOUBLE AS spread FROM an),
    ans AS (SELECT *, CASE WHEN why IS NULL THEN CAST(score > threshold AS INT) END AS label, CASE WHEN why IS NULL THEN {r6('least(1.0::DOUBLE, abs(score - threshold) / spread)')} END AS confidence FROM an2)"""


ANSWER_SQL = _answer_sql()
_NUM = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
RECEIPT_SQL = (
    f"""CASE WHEN why IS NULL THEN concat('{{"model":"{routing.MODEL}","domain":"', route_domain, '","patternId":"', CASE route_domain WHEN 'line' THEN 'a1' ELSE 'c3' END, '","heldAuc":', CASE route_domain WHEN 'line' THEN '0.62' ELSE '0.7' END, """
    f"""',"heldAcc":', CASE route_domain WHEN 'line' THEN '0.6' ELSE '0.66' END, ',"held":', CASE route_domain WHEN 'line' THEN '18000' ELSE '600' END, ',"gateAuc":0.6,"routeScore":', {_NUM('route_score')}, ',"score":', {_NUM('score')}, ',"threshold":', {_NUM('threshold')}, ',"label":', label, ',"verdict":"VERIFIED"}}') END"""
)

# ---- scores, metrics, profiles ------------------------------------------------------------------------------------------


@query(f"WITH {LINES_SQL} SELECT row_id, l_linenumber::BIGINT AS line, {score_sql(LINE_RULES)} AS score FROM lines")
def scorecard_score(spark, sf_dir):
    """Rule firing and weighted scores of every row."""
    return lines(spark, sf_dir).select("row_id", F.col("l_linenumber").cast("long").alias("line"), score(LINE_RULES).alias("score"))


@query(f"WITH {INPUTS_SQL} SELECT src, id, {score_sql(LINE_RULES)} AS score FROM inp")
def score_free_input(spark, sf_dir):
    """Rules as data over a map of whatever features an input has; absent ones never fire."""
    rules = F.array(*[F.struct(F.lit(r.feat).alias("feat"), F.lit(r.op).alias("op"), F.lit(r.v).alias("v"), F.lit(r.w).alias("w")) for r in LINE_RULES])
    values = F.map_filter(F.create_map(*[x for f in LINE for x in (F.lit(f), F.col(f))]), lambda _, v: v.isNotNull())
    return inputs(spark, sf_dir).select("src", "id", score_map(rules, values).alias("score"))


@query(f"WITH {LINES_SQL} SELECT split, {score_sql(LINE_RULES)} AS score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM lines GROUP BY 1, 2")
def score_histogram(spark, sf_dir):
    """Labels at each score (W9's input)."""
    return metrics.histogram(lines(spark, sf_dir), score(LINE_RULES), F.col("y"), ["split"]).select("split", "score", F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"))


@query(f"WITH {LINES_SQL}, s AS (SELECT split, {score_sql(LINE_RULES)} AS score, y FROM lines), {auc_sql('s', 'split')} SELECT * FROM a")
def auc_by_split(spark, sf_dir):
    """Exact AUC with ties (A4)."""
    return metrics.auc(metrics.histogram(lines(spark, sf_dir), score(LINE_RULES), F.col("y"), ["split"]), ["split"])


@query(f"WITH {ORDERS_SQL}, s AS (SELECT n_name AS nation, {score_sql(ORDER_RULES)} AS score, y FROM ord JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), {auc_sql('s', 'nation')} SELECT * FROM a")
def auc_by_nation(spark, sf_dir):
    """AUC of each nation's orders; customers and nations are dimension tables the planner broadcasts by their size (A4 over joins)."""
    rows = orders(spark, sf_dir).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("nation", F.col("n_name"))
    return metrics.auc(metrics.histogram(rows, score(ORDER_RULES), F.col("y"), ["nation"]), ["nation"])


@query(f"WITH {ORDERS_SQL}, s AS (SELECT c_mktsegment AS segment, {score_sql(ORDER_RULES)} AS score, y FROM ord JOIN customer ON o_custkey = c_custkey), {auc_sql('s', 'segment')} SELECT segment, auc, auc >= 0.5 AS kept FROM a")
def gate_kept_cut(spark, sf_dir):
    """Segments kept or cut by a gate on AUC."""
    rows = orders(spark, sf_dir).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("segment", F.col("c_mktsegment"))
    return metrics.auc(metrics.histogram(rows, score(ORDER_RULES), F.col("y"), ["segment"]), ["segment"]).select("segment", "auc", (F.col("auc") >= 0.5).alias("kept"))


_POINT = f"""s AS (SELECT {{score}} AS score, y FROM {{src}} WHERE split = 'train'), b AS (SELECT avg(y)::DOUBLE AS base, count(*) AS n, sum(y) AS ones FROM s),
    k AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS ix FROM s),
    p AS (SELECT {r6("min(k.score)")} AS threshold FROM k, b WHERE ix = least(n - 1, floor((1.0::DOUBLE - ones::DOUBLE / n) * n)::BIGINT))"""


@query(f"WITH {ORDERS_SQL}, {_POINT.format(score=score_sql(ORDER_RULES), src='ord')} SELECT (SELECT threshold FROM p) AS threshold, {r6('(SELECT ones::DOUBLE / n FROM b)')} AS base, {r6('greatest(max(score) - min(score), 1e-9)')} AS spread FROM s")
def operating_threshold(spark, sf_dir):
    """Where a score becomes a label, from the training rows (A3)."""
    train = orders(spark, sf_dir).where("split = 'train'")
    return metrics.operating_point(metrics.histogram(train, score(ORDER_RULES), F.col("y")))


@query(f"WITH {ORDERS_SQL}, {_POINT.format(score=score_sql(ORDER_RULES), src='ord')} SELECT (SELECT threshold FROM p) AS threshold, {r6(f'avg(CAST(CAST({score_sql(ORDER_RULES)} > (SELECT threshold FROM p) AS INT) = y AS INT))')} AS accuracy, count(*) AS held FROM ord WHERE split = 'held'")
def held_accuracy(spark, sf_dir):
    """Accuracy on held-out rows at the training threshold (A5)."""
    rows = orders(spark, sf_dir)
    h = metrics.histogram(rows, score(ORDER_RULES), F.col("y"), ["split"])
    point = metrics.operating_point(h.where("split = 'train'")).select("threshold")
    held = h.where("split = 'held'").join(F.broadcast(point))  # one row
    return held.groupBy("threshold").agg(metrics.accuracy(held, F.col("threshold")).alias("accuracy"), F.sum(F.col("pos") + F.col("neg")).cast("long").alias("held"))


@query(f"WITH {ORDERS_SQL}, c AS (SELECT split, y, avg(CAST(CAST({score_sql(ORDER_RULES)} > 0.5 AS INT) = y AS INT)) AS recall FROM ord GROUP BY 1, 2) SELECT split, {r6('avg(recall)')} AS balanced_accuracy FROM c GROUP BY 1")
def balanced_accuracy(spark, sf_dir):
    """Mean recall over classes."""
    return metrics.balanced_accuracy(orders(spark, sf_dir), (score(ORDER_RULES) > 0.5).cast("int"), F.col("y"), ["split"])


def _prints_sql(source: str, features: tuple[str, ...]) -> str:
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS value FROM {source} WHERE split = 'train'" for f in features)
    at = lambda p: r6(f"max(CASE WHEN ix = floor({p} * (n - 1)) THEN value END)")
    return f"l AS ({long}), o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS ix, count(*) OVER (PARTITION BY feature) AS n FROM l), fp AS (SELECT feature, {r6('min(value)')} AS lo, {at(0.25)} AS q1, {at(0.5)} AS med, {at(0.75)} AS q3, {r6('max(value)')} AS hi FROM o GROUP BY feature)"


@query(f"WITH {LINES_SQL}, {_prints_sql('lines', LINE)} SELECT * FROM fp")
def fingerprint_lines(spark, sf_dir):
    """Minimum, quartiles and maximum of training features (A1, A2)."""
    return profile.fingerprints(lines(spark, sf_dir).where("split = 'train'"), list(LINE))


@query(f"WITH {ORDERS_SQL}, {_prints_sql('ord', ('total', 'days'))} SELECT * FROM fp")
def fingerprint_orders(spark, sf_dir):
    return profile.fingerprints(orders(spark, sf_dir).where("split = 'train'"), ["total", "days"])


@query(f"WITH {LINES_SQL}, l AS (SELECT 'qty' AS feature, qty AS value FROM lines WHERE split = 'train' UNION ALL SELECT 'price', price FROM lines WHERE split = 'train'), o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS ix, count(*) OVER (PARTITION BY feature) AS n FROM l) SELECT feature, k / 16.0::DOUBLE AS p, max(value) AS value FROM o, range(1, 16) t(k) WHERE ix = floor(k / 16.0::DOUBLE * (n - 1)) GROUP BY 1, 2")
def quantile_grid(spark, sf_dir):
    """The 15 training quantiles rules can cut at (A1, G1)."""
    return profile.order_statistics(lines(spark, sf_dir).where("split = 'train'"), ["qty", "price"], [k / 16 for k in range(1, 16)])


# ---- routing, answers, receipts -----------------------------------------------------------------------------------------


@query(f"WITH {LINES_SQL} SELECT row_id, l_linenumber::BIGINT AS line, " + ", ".join(f"{member_sql(f, LIBRARY[0].prints[f])} AS m_{f}" for f in LINE) + " FROM lines")
def membership(spark, sf_dir):
    """How well each value fits a training distribution (F1)."""
    m = lambda f: N.membership(F.col(f), *[F.lit(LIBRARY[0].prints[f][i]) for i in (1, 3, 0, 4)]).alias(f"m_{f}")
    return lines(spark, sf_dir).select("row_id", F.col("l_linenumber").cast("long").alias("line"), *[m(f) for f in LINE])


@query(f"WITH {ROUTE_SQL} SELECT src, id, route_domain, route_score FROM rt")
def route_inputs(spark, sf_dir):
    """The best pattern for each input."""
    return routing.route(inputs(spark, sf_dir), LIBRARY).select("src", "id", "route_domain", "route_score")


@query(f"WITH {ANSWER_SQL} SELECT src, id, verdict, why, route_domain, route_score, score, threshold, label::DOUBLE AS label, confidence, sha256({RECEIPT_SQL}) AS receipt_hash FROM ans")
def answer_verdicts(spark, sf_dir):
    """Routed, gated, labelled and receipted answers."""
    return routing.answer(inputs(spark, sf_dir), LIBRARY).select("src", "id", "verdict", "why", "route_domain", "route_score", "score", "threshold", F.col("label").cast("double").alias("label"), "confidence", "receipt_hash")


@query(f"WITH {ANSWER_SQL} SELECT src, id, {RECEIPT_SQL} AS receipt FROM ans WHERE why IS NULL")
def receipt_text(spark, sf_dir):
    """Receipts as canonical JSON."""
    return routing.answer(inputs(spark, sf_dir), LIBRARY).where("why IS NULL").select("src", "id", "receipt")


@query(f"WITH {ANSWER_SQL} SELECT src, why IS NULL AS ok, why IS NULL AND id % 7 <> 0 AS genuine, count(*) AS n FROM ans GROUP BY 1, 2, 3")
def verify_receipts(spark, sf_dir):
    """Receipts hashed again after every seventh was changed."""
    out = routing.answer(inputs(spark, sf_dir), LIBRARY)
    out = out.withColumn("receipt", F.when(F.col("id") % 7 == 0, F.replace("receipt", F.lit("VERIFIED"), F.lit("ALTERED"))).otherwise(F.col("receipt")))
    return routing.verify(out).groupBy("src", "ok", "genuine").agg(F.count("*").alias("n"))


@query(f"WITH {ANSWER_SQL} SELECT src, count(*) AS n, count(*) FILTER (WHERE route_domain = 'part' AND why IS NULL) AS answered FROM ans GROUP BY 1")
def skill_node(spark, sf_dir):
    """One domain's pattern alone answers its own inputs and abstains on others."""
    out = routing.answer(inputs(spark, sf_dir), [LIBRARY[2]])
    return out.groupBy("src").agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "VERIFIED", 1)).alias("answered"))


_JUNK = {f: hi + 4 * max(hi - lo, 1.0) for p in LIBRARY for f, (lo, _, _, _, hi) in p.prints.items()}


@query("SELECT c_custkey, 'ABSTAIN' AS verdict, 'out of distribution' AS why FROM customer")
def ood_junk_abstain(spark, sf_dir):
    """Inputs far outside every distribution are refused."""
    junk = read(spark, sf_dir, "customer").select("c_custkey", *[c.alias(f) for p in LIBRARY for f, c in routing.junk(p.prints).items()])
    return routing.answer(junk, LIBRARY).select("c_custkey", "verdict", "why")


@query(f"""WITH {ANSWER_SQL}, tr AS (SELECT (row_id * 10 + l_linenumber) AS id, y FROM lines), held AS (SELECT ans.label, ans.verdict, l.y FROM (SELECT DISTINCT id, y, qty, price, disc, tax FROM (SELECT row_id * 10 + l_linenumber AS id, y, qty, price, disc, tax FROM lines WHERE split = 'held')) l
    JOIN (SELECT DISTINCT id, qty, price, disc, tax, label, verdict FROM ans WHERE src = 'line') ans USING (id, qty, price, disc, tax)),
    j AS (SELECT count(*) AS n FROM customer) SELECT count(*) + (SELECT n FROM j) AS n, {r6('(sum(CAST(coalesce(label = y, false) AS INT)) + (SELECT n FROM j))::DOUBLE / (count(*) + (SELECT n FROM j))')} AS trust, {r6('greatest(sum(y), count(*) - sum(y))::DOUBLE / (count(*) + (SELECT n FROM j))')} AS flat FROM held""")
def trust_scoreboard(spark, sf_dir):
    """A mixed stream of held-out rows and junk: right labels and right refusals against the flat guess."""
    held = lines(spark, sf_dir).where("split = 'held'").select((F.col("row_id") * 10 + F.col("l_linenumber")).alias("id"), "y", *LINE, F.lit(True).alias("answerable")).distinct()
    junk = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).alias("y"), *[routing.junk(LIBRARY[0].prints)[f].alias(f) for f in LINE], F.lit(False).alias("answerable"))
    return routing.trust(routing.answer(held.union(junk), LIBRARY), "verdict", "label", "y", "answerable")


_ARMS = {"forged": LIBRARY[0], "tier 3": replace(LIBRARY[0], rules=LINE_RULES_2), "tier 1": replace(LIBRARY[0], rules=LINE_RULES[:1])}
_ARMS_SQL = " UNION ALL ".join(f"SELECT '{name}' AS arm, {score_sql(p.rules)} AS score, y, {'label' if name == 'forged' else 'NULL::INT'} AS label FROM t" for name, p in _ARMS.items())


@query(f"""WITH {ANSWER_SQL}, t AS (SELECT l.*, CASE WHEN ans.route_domain = 'line' AND ans.why IS NULL THEN ans.label END AS label FROM lines l JOIN (SELECT DISTINCT id, qty, price, disc, tax, route_domain, why, label FROM ans WHERE src = 'line') ans
    ON ans.id = l.row_id * 10 + l.l_linenumber AND (ans.qty, ans.price, ans.disc, ans.tax) = (l.qty, l.price, l.disc, l.tax)),
    s AS ({_ARMS_SQL}), {auc_sql('s', 'arm')} SELECT arm, auc, n, labels, ones FROM a JOIN (SELECT arm, count(*) AS n, count(label) AS labels, coalesce(sum(label), 0)::BIGINT AS ones FROM s GROUP BY 1) USING (arm)""")
def comparison_arms(spark, sf_dir):
    """Three arms over the same rows: scores of each, labels of the one that answers, null where it abstains."""
    rows = lines(spark, sf_dir).withColumn("y_", F.col("y"))
    arms = routing.arm_scores(rows.withColumn("key", F.struct("row_id", "l_linenumber", "y_")), "key", _ARMS, "forged")
    sums = arms.groupBy("arm").agg(F.count("*").alias("n"), F.count("label").alias("labels"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones"))
    return metrics.auc(metrics.histogram(arms, F.col("score"), F.col("key.y_"), ["arm"]), ["arm"]).join(sums, "arm").select("arm", "auc", "n", "labels", "ones")


@query(f"""WITH {ANSWER_SQL}, r AS (SELECT src, id, verdict, label, sha256({RECEIPT_SQL}) AS h FROM ans WHERE src = 'part')
    SELECT id, concat('think(a held-out ', src, ' case) -> ', verdict, CASE WHEN verdict = 'VERIFIED' THEN concat(' (label ', label, ', receipt ', substr(h, 1, 12), '…)') ELSE '' END) AS line FROM r""")
def think_lines(spark, sf_dir):
    """Answers as lines for people."""
    out = routing.answer(inputs(spark, sf_dir).where("src = 'part'"), LIBRARY)
    return out.select("id", T.think_line(F.col("src"), F.col("verdict"), F.col("label"), F.col("receipt_hash")).alias("line"))


_REPORT_SQL = f"{ORDERS_SQL}, s AS (SELECT n_name AS nation, {score_sql(ORDER_RULES)} AS score, y FROM ord JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE split = 'held'), {auc_sql('s', 'nation')}"


@query(f"""WITH {_REPORT_SQL}, k AS (SELECT * FROM a WHERE auc >= 0.5)
    SELECT CASE WHEN auc >= 0.5 THEN concat('  ✓ organ ', nation, ': held-out AUC ', {_NUM('auc')}, ' on ', pos + neg, ' rows it never saw (target "urgent")') ELSE concat('  ✗ CUT ', nation, ': held-out AUC ', {_NUM('auc')}, ' below gate 0.5') END AS line FROM a
    UNION ALL SELECT concat('brain: ', count(*), ' organ(s) · ', coalesce(sum(strlen(nation)), 0), ' B of seeds · mean held-out AUC ', {_NUM('coalesce(' + r6('avg(auc)') + ', 0)')}, ' · gate 0.5') FROM k""")
def run_report(spark, sf_dir):
    """The report of a run: a line for each nation's grade on its held-out orders, and the line of the whole."""
    rows = orders(spark, sf_dir).where("split = 'held'").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    grades = metrics.auc(metrics.histogram(rows.withColumn("nation", F.col("n_name")), score(ORDER_RULES), F.col("y"), ["nation"]), ["nation"])
    kept = grades.where("auc >= 0.5").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("nation")), F.lit(0)).alias("size"), F.coalesce(N.round_up(F.avg("auc")), F.lit(0.0)).alias("mean"))
    organs = grades.select(T.organ_line(F.col("nation"), F.col("auc"), F.col("pos") + F.col("neg"), F.lit("urgent"), 0.5).alias("line"))
    return organs.union(kept.select(T.brain_line(F.col("n"), F.col("size"), F.col("mean"), 0.5).alias("line")))


@query("SELECT c_custkey, list_reduce([7::BIGINT] || list_transform(string_split(c_name, ''), lambda c: ord(c)::BIGINT), lambda h, c: (h * 131 + c) % 4294967296) % 90000 + 1 AS seed FROM customer")
def name_seeds(spark, sf_dir):
    """Seeds made from names."""
    return read(spark, sf_dir, "customer").select("c_custkey", N.seed_of(F.col("c_name")).alias("seed"))


# ---- splits and samples -------------------------------------------------------------------------------------------------


@query("SELECT CASE WHEN l_orderkey % 10 < 3 THEN 'held' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT l_orderkey) AS keys FROM lineitem GROUP BY 1")
def split_by_index(spark, sf_dir):
    """Three of ten keys held out."""
    return splitting.by_index(read(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("keys"))


@query(f"WITH {ORDERS_SQL}, h AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY CAST('0x' || substr(md5('7:' || row_id), 1, 13) AS BIGINT), row_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM ord) SELECT row_id, y, CASE WHEN r <= floor(0.4::DOUBLE * n) THEN 'held' ELSE 'train' END AS split FROM h")
def stratified_split(spark, sf_dir):
    """floor(0.4 n) of each class by a seeded hash."""
    return splitting.stratified(orders(spark, sf_dir).select("row_id", "y"), "row_id", "y", 0.4, 7).select("row_id", "y", "split")


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, greatest(1, count(*) OVER () // 60) AS step FROM orders) SELECT o_orderkey FROM r WHERE r % step = 0 AND r // step < 60")
def stride_sample(spark, sf_dir):
    """Every n-th row, 60 of them."""
    return splitting.stride(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 60)


@query(f"WITH {ORDERS_SQL}, r AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY row_id) - 1 AS ix, count(*) OVER (PARTITION BY y) AS n FROM ord) SELECT row_id, y FROM r, range(100) t(k) WHERE ix = k * n // 100")
def systematic_sample(spark, sf_dir):
    """100 evenly spaced rows of each class."""
    return splitting.systematic(orders(spark, sf_dir).select("row_id", "y"), "row_id", "y")


def draw_sql(k: str, seed: int) -> str:
    """Draw k of the counter stream, in nested selects' arithmetic."""
    a = f"((({k})::HUGEINT * {N.STEP} + {seed + N.STEP}) % 4294967296)::BIGINT"
    t = f"((xor({a}, {a} >> 15)::HUGEINT * ({a} | 1)) % 4294967296)::BIGINT"
    return f"(SELECT xor(u, u >> 14) / 4294967296.0::DOUBLE FROM (SELECT xor(t, ((t + ((xor(t, t >> 7)::HUGEINT * (t | 61)) % 4294967296)::BIGINT) % 4294967296)) AS u FROM (SELECT {t} AS t)))"


@query(f"SELECT event_id, {draw_sql('event_id', 20261105)} AS u FROM events")
def counter_stream(spark, sf_dir):
    """The random stream as a function of the draw number."""
    return read(spark, sf_dir, "events").select("event_id", N.draw(F.col("event_id"), 20261105).alias("u"))


@query(f"WITH d AS (SELECT event_id, {draw_sql('event_id * 2', 404)} AS u, {draw_sql('event_id * 2 + 1', 404)} AS v FROM events) SELECT event_id, {r6('sqrt(-2 * ln(greatest(1e-9, u))) * cos(2 * pi() * v)')} AS g, {r6('least(1.0, greatest(-1.0, sqrt(-2 * ln(greatest(1e-9, u))) * cos(2 * pi() * v)))')} AS clamped FROM d")
def gauss_stream(spark, sf_dir):
    """Normal values from pairs of draws, and clamped ones."""
    g = N.gauss(F.col("event_id") * 2, 404)
    return read(spark, sf_dir, "events").select("event_id", N.round_up(g).alias("g"), N.round_up(N.clamp(g, -1, 1)).alias("clamped"))


def _boot(spark, sf_dir):
    rows = splitting.systematic(orders(spark, sf_dir), "row_id", "y").select(F.col("row_id").alias("idx"), "y", "total", "days")
    arm = lambda name, s, cut: rows.select(F.lit(name).alias("arm"), "idx", s.alias("score"), (s > cut).cast("int").alias("label"))
    return rows.select("idx", "y"), arm("A", score(ORDER_RULES), 0.5).union(arm("B", F.floor(F.col("days") / 200).cast("double"), 6.0))


_BOOT_SQL = f"""WITH {ORDERS_SQL}, r0 AS (SELECT row_id, y, total, days, row_number() OVER (PARTITION BY y ORDER BY row_id) - 1 AS ix, count(*) OVER (PARTITION BY y) AS n FROM ord),
    smp AS (SELECT row_id AS idx, y, total, days FROM r0, range(100) t(k) WHERE ix = k * n // 100),
    rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY idx) - 1 AS rank, count(*) OVER (PARTITION BY y) AS size FROM smp),
    dr AS (SELECT id // 200 AS resample, CASE WHEN id % 200 < 100 THEN 1 ELSE 0 END AS y, {draw_sql('id', 20261105)} AS u FROM range(40000) t(id)),
    pk AS (SELECT resample, rk.* FROM dr JOIN rk ON dr.y = rk.y AND rk.rank = floor(dr.u * 100)),
    sc AS (SELECT resample, 'A' AS arm, {score_sql(ORDER_RULES)} AS score, y FROM pk UNION ALL SELECT resample, 'B', floor(days / 200), y FROM pk),
    {auc_sql('sc', 'resample, arm')}, df AS (SELECT resample, {r6("sum(CASE arm WHEN 'A' THEN auc ELSE -auc END)")} AS diff FROM a GROUP BY 1)"""


@query(f"{_BOOT_SQL} SELECT 'A-B:auc' AS pair, resample, diff FROM df")
def bootstrap_diff(spark, sf_dir):
    """Paired, stratified bootstrap differences of AUC."""
    rows, arms = _boot(spark, sf_dir)
    return metrics.bootstrap(rows, arms, [("A", "B", "auc")], 200)


@query(f"{_BOOT_SQL}, s AS (SELECT diff, row_number() OVER (ORDER BY diff) - 1 AS ix FROM df) SELECT 'A-B:auc' AS pair, max(CASE WHEN ix = 5 THEN diff END) AS lo, max(CASE WHEN ix = 195 THEN diff END) AS hi FROM s")
def bootstrap_interval(spark, sf_dir):
    """The 95 % interval of the differences."""
    rows, arms = _boot(spark, sf_dir)
    return metrics.interval(metrics.bootstrap(rows, arms, [("A", "B", "auc")], 200))


_CLAIMS_SQL = _BOOT_SQL.replace("floor(dr.u * 100))", "floor(dr.u * 100) UNION ALL SELECT -1, rk.* FROM rk)") + f""",
    lb AS (SELECT resample, arm, y, CAST(score > CASE arm WHEN 'A' THEN 0.5 ELSE 6.0 END AS INT) AS label FROM sc),
    rc AS (SELECT resample, arm, y, avg(CAST(label = y AS INT)) AS recall FROM lb GROUP BY 1, 2, 3), bl AS (SELECT resample, arm, {r6('avg(recall)')} AS bal FROM rc GROUP BY 1, 2),
    bd AS (SELECT resample, {r6("sum(CASE arm WHEN 'A' THEN bal ELSE -bal END)")} AS diff FROM bl GROUP BY 1),
    al AS (SELECT 'ranks' AS id, * FROM df UNION ALL SELECT 'labels', * FROM bd),
    ix AS (SELECT *, row_number() OVER (PARTITION BY id, resample < 0 ORDER BY diff) - 1 AS nth FROM al),
    cl AS (SELECT id, max(CASE WHEN resample < 0 THEN diff END) AS diff, max(CASE WHEN resample >= 0 AND nth = 5 THEN diff END) AS lo, max(CASE WHEN resample >= 0 AND nth = 195 THEN diff END) AS hi FROM ix GROUP BY 1)"""


@query(f"{_CLAIMS_SQL} SELECT id, diff, lo, hi, diff > 0 AND lo > 0 AS holds FROM cl UNION ALL SELECT 'gone', NULL, NULL, NULL, false UNION ALL SELECT 'parsed', NULL, NULL, NULL, true")
def judged_claims(spark, sf_dir):
    """The verdict on each claim: differences of AUC and of balanced accuracy with their intervals, a missing arm, replies read."""
    rows, arms = _boot(spark, sf_dir)
    pairs = {"ranks": ("A", "B", "auc"), "labels": ("A", "B", "bal"), "gone": ("A", "C", "auc")}
    out = metrics.judge(rows, arms, pairs, {"A": 195, "B": 190}, draws=200)
    keys = ("id", "diff", "lo", "hi", "holds")
    return spark.createDataFrame([tuple(c.get(k) for k in keys) for c in out["claims"]], "id string, diff double, lo double, hi double, holds boolean")


# ---- candidates, tiers, ensembles ---------------------------------------------------------------------------------------

CANDIDATES = [LINE_RULES, LINE_RULES_2, (Rule("qty", ">", 25.0, 1.0),), (Rule("qty", "<=", 25.0, -1.0),), (Rule("price", ">", 53000.0, 2.0), Rule("tax", "<=", 0.02, 0.25))]


def _candidates(spark, sf_dir):
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("candidate"), score(r).alias("score")) for i, r in enumerate(CANDIDATES)])
    rows = lines(spark, sf_dir).select("y", F.explode(each).alias("c")).select("y", "c.candidate", "c.score")
    return metrics.auc(metrics.histogram(rows, F.col("score"), F.col("y"), ["candidate"]), ["candidate"])


_CAND_SQL = f"WITH {LINES_SQL}, s AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS candidate, {score_sql(r)} AS score, y FROM lines" for i, r in enumerate(CANDIDATES)) + f"), {auc_sql('s', 'candidate')}"


@query(f"{_CAND_SQL} SELECT candidate, auc FROM a")
def candidate_fitness(spark, sf_dir):
    """A whole generation's AUC in one job."""
    return _candidates(spark, sf_dir).select("candidate", "auc")


@query(f"{_CAND_SQL} SELECT candidate, auc FROM a ORDER BY auc DESC, candidate LIMIT 1")
def champion_argmax(spark, sf_dir):
    """The best candidate, the first of equals."""
    return _candidates(spark, sf_dir).select("candidate", "auc").orderBy(F.desc("auc"), "candidate").limit(1)


@query(f"{_CAND_SQL} SELECT candidate, auc, row_number() OVER (ORDER BY auc DESC, candidate)::BIGINT AS rank, row_number() OVER (ORDER BY auc DESC, candidate) <= 2 AS parent FROM a")
def candidate_scoreboard(spark, sf_dir):
    """Candidates ranked, the two parents marked (W3, W4, W5); one row a candidate, so the window is bounded."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("auc"), "candidate"))
    return _candidates(spark, sf_dir).select("candidate", "auc", rank.cast("long").alias("rank"), (rank <= 2).alias("parent"))


@query(f"{_CAND_SQL} SELECT candidate, max(auc) OVER (ORDER BY candidate) AS best FROM a")
def running_best(spark, sf_dir):
    """The monotone best so far."""
    w = Window.partitionBy(F.lit(0)).orderBy("candidate").rowsBetween(Window.unboundedPreceding, 0)
    return _candidates(spark, sf_dir).select("candidate", F.max("auc").over(w).alias("best"))


def _tier(spark, sf_dir, rules, keep):
    rows = orders(spark, sf_dir).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("domain", F.col("c_mktsegment")).where(keep)
    return metrics.auc(metrics.histogram(rows, score(rules), F.col("y"), ["domain"]), ["domain"])


_T1, _T2 = ORDER_RULES, (*ORDER_RULES, Rule("total", "<=", 100000.0, -0.25))


def _tier_sql(rules, keep, name):
    return f"{name} AS (WITH s AS (SELECT c_mktsegment AS domain, {score_sql(rules)} AS score, y FROM ord JOIN customer ON o_custkey = c_custkey WHERE {keep}), {auc_sql('s', 'domain')} SELECT domain, auc FROM a)"


@query(f"WITH {ORDERS_SQL}, {_tier_sql(_T1, 'c_mktsegment <> ' + repr('BUILDING'), 't1')}, {_tier_sql(_T2, 'c_mktsegment <> ' + repr('MACHINERY'), 't2')} SELECT coalesce(t1.domain, t2.domain) AS domain, t1.auc AS auc_before, t2.auc AS auc_after, CASE WHEN t1.auc IS NOT NULL THEN coalesce(t2.auc >= t1.auc - 1e-9, false) END AS monotone, t1.auc IS NULL AS added FROM t1 FULL JOIN t2 ON t1.domain = t2.domain")
def tier_receipt(spark, sf_dir):
    """Two tiers compared: what fell, what was lost, what is new."""
    return search.tier_receipt(_tier(spark, sf_dir, _T1, "c_mktsegment <> 'BUILDING'"), _tier(spark, sf_dir, _T2, "c_mktsegment <> 'MACHINERY'"))


@query("WITH o AS (SELECT n_name AS domain, n_nationkey::BIGINT AS v FROM nation WHERE n_nationkey < 15), n AS (SELECT n_name AS domain, n_nationkey * 10::BIGINT AS v FROM nation WHERE n_nationkey > 9) SELECT coalesce(n.domain, o.domain) AS domain, coalesce(n.v, o.v)::BIGINT AS v FROM o FULL JOIN n ON o.domain = n.domain")
def index_upsert(spark, sf_dir):
    """New rows replace old ones by key, others stay."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("domain"), F.col("n_nationkey").cast("long").alias("v"))
    return tables.upsert(n.where("v < 15"), n.where("v > 9").withColumn("v", F.col("v") * 10), "domain")


WORKERS = ((LINE_RULES, 0.62), (LINE_RULES_2, 0.58), (CANDIDATES[4], 0.55), (CANDIDATES[2], 0.45))


def _ensemble(spark, sf_dir):
    rows = lines(spark, sf_dir)
    scales = search.worker_scales(rows.where("split = 'train'"), list(WORKERS))
    return rows.withColumn("ensemble", N.round_up(search.resolve(list(WORKERS), scales)))


_ENS_SQL = f"WITH {LINES_SQL}, ws AS (SELECT " + ", ".join(f"{r6(f'avg({score_sql(r)})')} AS m{i}, {r6(f'stddev_pop({score_sql(r)})')} AS s{i}" for i, (r, _) in enumerate(WORKERS)) + f" FROM lines WHERE split = 'train'), e AS (SELECT lines.*, {r6(' + '.join(f'{max(0.0, a - 0.5) ** 2!r}::DOUBLE * (({score_sql(r)} - m{i}) / s{i})' for i, (r, a) in enumerate(WORKERS)))} AS ensemble FROM lines, ws)"


@query(f"{_ENS_SQL} SELECT row_id, l_linenumber::BIGINT AS line, {r6('ensemble', 4)} AS ensemble FROM e")
def ensemble_resolve(spark, sf_dir):
    """Standardised, skill-weighted ensemble scores."""
    return _ensemble(spark, sf_dir).select("row_id", F.col("l_linenumber").cast("long").alias("line"), N.round_up(F.col("ensemble"), 4).alias("ensemble"))


@query(f"{_ENS_SQL}, s AS (" + " UNION ALL ".join([f"SELECT 'w{i}' AS worker, {score_sql(r)} AS score, y FROM e WHERE split = 'held'" for i, (r, _) in enumerate(WORKERS)] + [f"SELECT 'all', {r6('ensemble', 4)}, y FROM e WHERE split = 'held'"]) + f"), {auc_sql('s', 'worker')} SELECT max(CASE WHEN worker = 'all' THEN auc END) AS auc, max(CASE WHEN worker <> 'all' THEN auc END) AS best, {r6('avg(CASE WHEN worker <> ' + repr('all') + ' THEN auc END)')} AS mean FROM a")
def ensemble_lift(spark, sf_dir):
    """The ensemble against its best and mean worker on held-out rows."""
    rows = _ensemble(spark, sf_dir).where("split = 'held'")
    each = [F.struct(F.lit(f"w{i}").alias("worker"), score(r).alias("score")) for i, (r, _) in enumerate(WORKERS)] + [F.struct(F.lit("all").alias("worker"), N.round_up(F.col("ensemble"), 4).alias("score"))]
    long = rows.select("y", F.explode(F.array(*each)).alias("w")).select("y", "w.worker", "w.score")
    a = metrics.auc(metrics.histogram(long, F.col("score"), F.col("y"), ["worker"]), ["worker"])
    one = F.when(F.col("worker") != "all", F.col("auc"))
    return a.agg(F.max(F.when(F.col("worker") == "all", F.col("auc"))).alias("auc"), F.max(one).alias("best"), N.round_up(F.avg(one)).alias("mean"))


@query("SELECT n_name AS domain, ((row_number() OVER (ORDER BY n_nationkey) - 1) % 127)::BIGINT AS address FROM nation")
def neuron_addresses(spark, sf_dir):
    """Addresses in the space of 127 (W11); a row a domain, so the window is bounded."""
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n_nationkey")) - 1
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("domain"), (n % 127).cast("long").alias("address"))


# ---- text and graphs ----------------------------------------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS = f"""tk AS (SELECT doc_id, t, pos FROM (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_]{{2,}}'), lambda w: length(w) >= 4 AND NOT list_contains([{_STOPS}], w)) AS x FROM documents))),
    tf AS (SELECT doc_id, t AS term, count(*) AS tf, min(pos) - 1 AS pos FROM tk GROUP BY 1, 2)"""


def _doc_terms(spark, sf_dir):
    return textgraph.term_counts(read(spark, sf_dir, "documents"), "doc_id", "text")


def _top(spark, sf_dir):
    return textgraph.top_counted(textgraph.counted(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query("SELECT doc_id, " + ", ".join(f"((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{m}', ''))) // {len(m)})::BIGINT AS m_{m}" for m in ("the", "tion", "en", "que")) + " FROM documents")
def marker_counts(spark, sf_dir):
    """Non-overlapping marker counts."""
    return read(spark, sf_dir, "documents").select("doc_id", *[T.count_marker(F.col("text"), m).alias(f"m_{m}") for m in ("the", "tion", "en", "que")])


@query(f"WITH {_TERMS} SELECT doc_id, term, tf FROM tf")
def term_tf(spark, sf_dir):
    """Term frequencies."""
    return _doc_terms(spark, sf_dir).select("doc_id", "term", "tf")


@query(f"WITH {_TERMS} SELECT term, count(*) AS df FROM tf GROUP BY 1")
def term_df(spark, sf_dir):
    """Document frequencies."""
    return textgraph.document_frequency(_doc_terms(spark, sf_dir), "doc_id")


@query(f"WITH {_TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, pos) AS rank FROM tf) SELECT doc_id, term, rank::BIGINT AS rank FROM r WHERE rank <= 3")
def top_terms(spark, sf_dir):
    """Each text's three most frequent terms."""
    return _top(spark, sf_dir).select("doc_id", "term", F.col("rank").cast("long").alias("rank"))


_COS = f"{_TERMS}, nm AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY 1), pr AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.tf * y.tf) AS dot FROM tf x JOIN tf y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY 1, 2), cs AS (SELECT a, b, {r6('dot::DOUBLE / (n1.norm * n2.norm)')} AS sim FROM pr JOIN nm n1 ON a = n1.doc_id JOIN nm n2 ON b = n2.doc_id)"


@query(f"WITH {_COS} SELECT a, b, sim FROM cs WHERE sim >= 0.8")
def cosine_pairs(spark, sf_dir):
    """All pairs of texts with cosine of 0.8 and more."""
    return textgraph.cosine_pairs(_doc_terms(spark, sf_dir), "doc_id", 0.8)


_CLUSTER = f"{_COS}, eg AS (SELECT a, b FROM cs WHERE sim >= 0.8 UNION SELECT b, a FROM cs WHERE sim >= 0.8)"
CLUSTER_SQL = f"WITH RECURSIVE {_CLUSTER}, rc AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT rc.node, eg.b FROM rc JOIN eg ON rc.reach = eg.a), mb AS (SELECT node AS doc_id, min(reach) AS cluster FROM rc GROUP BY 1)"


def _clusters(spark, sf_dir):
    """The terms of the texts in clusters of two and more, and all texts' clusters."""
    docs = read(spark, sf_dir, "documents")
    members = textgraph.clusters(docs, textgraph.cosine_links(_doc_terms(spark, sf_dir), "doc_id", 0.8), "doc_id")
    within = docs.join(textgraph.small(textgraph.grouped(members).select("doc_id")), "doc_id", "left_semi")
    return textgraph.term_counts(within, "doc_id", "text"), members


@query(f"{CLUSTER_SQL} SELECT doc_id, cluster FROM mb")
def clusters(spark, sf_dir):
    """Single-linkage clusters."""
    return _clusters(spark, sf_dir)[1]


_DREAMS = f"""{CLUSTER_SQL}, sz AS (SELECT cluster, count(*) AS size, list_sort(list(doc_id)) AS ids FROM mb GROUP BY 1 HAVING count(*) > 1),
    kp AS (SELECT cluster, term, count(*) AS n FROM tf JOIN mb USING (doc_id) GROUP BY 1, 2), sh AS (SELECT cluster, string_agg(term, ' ' ORDER BY term) AS shared FROM kp JOIN sz USING (cluster) WHERE n >= greatest(2, ceil(size * 0.5)) GROUP BY 1),
    dr AS (SELECT cluster, size, coalesce(shared, '') || ' [consolidated from ' || array_to_string(ids, ', ') || ']' AS dream FROM sz LEFT JOIN sh USING (cluster))"""


@query(f"{_DREAMS} SELECT cluster, size, dream FROM dr")
def consolidate(spark, sf_dir):
    """Clusters folded to their shared terms (T5)."""
    counts, members = _clusters(spark, sf_dir)
    return textgraph.consolidate(counts, members, "doc_id").select("cluster", "size", "dream")


_QS = "qs AS (SELECT DISTINCT term AS q FROM (SELECT term, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, pos) AS rank FROM tf) WHERE rank <= 3)"


@query(f"""{_DREAMS}, {_QS}, hd AS (SELECT DISTINCT q, cluster FROM qs JOIN documents ON contains(lower(coalesce(text, '')), q) JOIN mb USING (doc_id)), oc AS (SELECT q, min(cluster) AS cluster FROM hd GROUP BY 1 HAVING count(*) = 1),
    ls AS (SELECT cluster, count(*) AS lost FROM oc JOIN dr USING (cluster) WHERE NOT contains(lower(dream), q) GROUP BY 1), bi AS (SELECT cluster, sum(length(coalesce(text, '')))::BIGINT AS bytes_in FROM documents JOIN mb USING (doc_id) GROUP BY 1)
    SELECT cluster, size, bytes_in, length(dream)::BIGINT AS bytes_out, coalesce(lost, 0) = 0 AND length(dream) < bytes_in AS kept, CASE WHEN coalesce(lost, 0) > 0 THEN 'recall drops' WHEN length(dream) >= bytes_in THEN 'no size win' END AS why FROM dr JOIN bi USING (cluster) LEFT JOIN ls USING (cluster)""")
def fold_gate(spark, sf_dir):
    """Which clusters fold without losing recall."""
    counts, members = _clusters(spark, sf_dir)
    queries = _top(spark, sf_dir).select("term")
    return textgraph.fold(read(spark, sf_dir, "documents").select("doc_id", "text"), counts, members, queries, "doc_id").select("cluster", "size", "bytes_in", "bytes_out", "kept", "why")


@query(f"""{_DREAMS}, {_QS}, hd AS (SELECT DISTINCT q, cluster FROM qs JOIN documents ON contains(lower(coalesce(text, '')), q) JOIN mb USING (doc_id)), oc AS (SELECT q, min(cluster) AS cluster FROM hd GROUP BY 1 HAVING count(*) = 1),
    ls AS (SELECT cluster, count(*) AS lost FROM oc JOIN dr USING (cluster) WHERE NOT contains(lower(dream), q) GROUP BY 1), bi AS (SELECT cluster, sum(length(coalesce(text, '')))::BIGINT AS bytes_in FROM documents JOIN mb USING (doc_id) GROUP BY 1),
    folded AS (SELECT cluster, dream FROM dr JOIN bi USING (cluster) LEFT JOIN ls USING (cluster) WHERE coalesce(lost, 0) = 0 AND length(dream) < bytes_in)
    SELECT 'dream-' || cluster AS id, dream AS text, true AS folded FROM folded UNION ALL SELECT doc_id::VARCHAR, coalesce(text, ''), false FROM documents JOIN mb USING (doc_id) WHERE cluster NOT IN (SELECT cluster FROM folded)""")
def fold_journal(spark, sf_dir):
    """What is left after folding: kept dreams and all other records as they are (U4)."""
    counts, members = _clusters(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folds = textgraph.fold(docs, counts, members, _top(spark, sf_dir).select("term"), "doc_id")
    return textgraph.journal(docs, members, folds, "doc_id")


@query("""WITH q AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]{5,}')) AS q FROM benchmark WHERE regexp_extract(text, '[A-Za-z]{5,}') <> ''), f AS (SELECT q FROM q WHERE EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), q)))
    SELECT (SELECT count(*) FROM q) AS n, (SELECT count(*) FROM f) AS found, """ + r6("(SELECT count(*) FROM f)::DOUBLE / (SELECT count(*) FROM q)") + " AS recall")  # fmt: skip
def recall_share(spark, sf_dir):
    """The share of query terms that some text contains."""
    q = read(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "[A-Za-z]{5,}", 0)).alias("term")).where("term <> ''").distinct()
    return textgraph.recall(q, read(spark, sf_dir, "documents"))


def _organs(spark, sf_dir):
    """Nations as nodes: region is the field, key mod 3 the family, part names of a third the text."""
    n = read(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_name").alias("domain"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("field"), F.concat(F.lit("f"), F.col("n_nationkey") % 3).alias("family"))
    text = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 25).cast("int").alias("k")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), " ").alias("text"))
    counts = textgraph.term_counts(n.join(text, F.col("n_nationkey") == F.col("k")).select(F.col("n_name").alias("domain"), "text"), "domain", "text")
    return nodes, textgraph.links(nodes, textgraph.cosine_pairs(counts, "domain", 0.2))


_LINKS = f"""WITH tx AS (SELECT n_name AS doc_id, string_agg(p_name, ' ' ORDER BY p_name) AS text FROM part JOIN nation ON p_partkey % 25 = n_nationkey GROUP BY 1), {_TERMS.replace('FROM documents', 'FROM tx')}, nm AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY 1),
    pr AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.tf * y.tf) AS dot FROM tf x JOIN tf y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY 1, 2), cs AS (SELECT a, b, {r6('dot::DOUBLE / (n1.norm * n2.norm)')} AS sim FROM pr JOIN nm n1 ON a = n1.doc_id JOIN nm n2 ON b = n2.doc_id),
    sm AS (SELECT * FROM cs WHERE sim >= 0.2), nd AS (SELECT n_name AS domain, n_regionkey AS field, n_nationkey % 3 AS family FROM nation),
    lk AS (SELECT x.domain AS a, y.domain AS b, CAST(x.field = y.field AS INT) AS same, CASE WHEN x.field = y.field THEN 0 ELSE CAST(x.family = y.family AS INT) END AS kin, coalesce(sim, 0.0)::DOUBLE AS sim FROM nd x JOIN nd y ON x.domain < y.domain LEFT JOIN sm ON sm.a = x.domain AND sm.b = y.domain),
    ed AS (SELECT a, b, {r6('least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.45::DOUBLE * same + 0.22::DOUBLE * kin + 0.4::DOUBLE * sim))')} AS w, same, kin, sim FROM lk WHERE same = 1 OR kin = 1 OR sim > 0)"""


@query(f"{_LINKS} SELECT * FROM ed")
def similarity_graph(spark, sf_dir):
    """Weighted links by field, family and shared terms."""
    return _organs(spark, sf_dir)[1]


@query(f"{_LINKS} SELECT * FROM ed WHERE w >= 0.8")
def prune_edges(spark, sf_dir):
    """Links over a floor."""
    return textgraph.prune(_organs(spark, sf_dir)[1], 0.8)


@query(f"{_LINKS}, kp AS (SELECT * FROM ed WHERE w >= 0.845) SELECT domain FROM nd WHERE domain NOT IN (SELECT a FROM kp UNION SELECT b FROM kp)")
def isolated_nodes(spark, sf_dir):
    """Nodes without a link over a floor."""
    nodes, edges = _organs(spark, sf_dir)
    return textgraph.isolated(nodes, textgraph.prune(edges, 0.845)).select("domain")


_HEB = """WITH RECURSIVE sq AS (SELECT event_id, event_type AS x, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, value > 10 AS ok FROM events),
    ev AS (SELECT least(x, p) AS a, greatest(x, p) AS b, ok, row_number() OVER (PARTITION BY least(x, p), greatest(x, p) ORDER BY event_id) AS k FROM sq WHERE p IS NOT NULL AND x <> p),
    st AS (SELECT DISTINCT a, b, 0::BIGINT AS k, 0.0::DOUBLE AS w FROM ev UNION ALL SELECT st.a, st.b, ev.k, floor(least(1.0, greatest(0.0, w + CASE WHEN ok THEN 0.15::DOUBLE ELSE -0.15::DOUBLE END)) * 1e6 + 0.5) / 1e6 FROM st JOIN ev ON ev.a = st.a AND ev.b = st.b AND ev.k = st.k + 1)
    SELECT a, b, arg_max(w, k) AS w FROM st GROUP BY 1, 2"""


@query(_HEB)
def hebbian_edges(spark, sf_dir):
    """Link weights after ordered successes and failures."""
    e = read(spark, sf_dir, "events")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = e.select(F.col("event_type").alias("a"), before.alias("b"), (F.col("value") > 10).alias("success"), F.col("event_id").alias("ord"))
    none = spark.createDataFrame([], "a string, b string, w double")
    return textgraph.hebbian(none, moves)


_HINT_COLS = {d: " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INT)" for w in ws) for d, ws in textgraph.HINTS.items()}


@query("WITH h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{d}' AS domain, {e} AS hits FROM documents" for d, e in _HINT_COLS.items()) + "), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, domain) AS rank FROM h) SELECT doc_id, domain, hits, rank::INT AS rank, max(CASE WHEN rank = 1 AND hits > 0 THEN domain END) OVER (PARTITION BY doc_id) AS proposal FROM r")
def imagine_hits(spark, sf_dir):
    """Keyword proposals, never graded."""
    return textgraph.imagine(read(spark, sf_dir, "documents"), "doc_id", "text")


# ---- replies, values, costs, sizes --------------------------------------------------------------------------------------


@query("WITH p AS (SELECT event_id, regexp_extract(props, '[0-9]+') AS d FROM events), s AS (SELECT event_id, CASE WHEN length(d) BETWEEN 1 AND 3 AND CAST(d AS INT) <= 100 THEN CAST(d AS INT) END AS score FROM p) SELECT event_id, score::DOUBLE AS score, CASE WHEN score IS NULL THEN NULL WHEN score >= 50 THEN 1 ELSE 0 END::DOUBLE AS label, coalesce(score, 50)::DOUBLE AS graded FROM s")
def parse_reply(spark, sf_dir):
    """Scores read from replies."""
    s = T.parse_reply(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", s.cast("double").alias("score"), T.reply_label(s).cast("double").alias("label"), T.reply_score(s).cast("double").alias("graded"))


@query("SELECT event_id, printf('%.2f', value) AS page_value, printf('%.0f', floor(value)) AS visits, '' AS unknown FROM events")
def format_value(spark, sf_dir):
    """Values with each feature's decimals (F8)."""
    return read(spark, sf_dir, "events").select("event_id", T.format_value("PageValues", F.col("value")).alias("page_value"), T.format_value("Administrative", F.floor("value").cast("double")).alias("visits"), T.format_value("other", F.col("value")).alias("unknown"))


_COST_IN = {"cases_per_week": "c_cases", "minutes_per_case": "c_minutes", "share": "c_share"}
_R2 = lambda x: r6(x, 2)
_COST_SQL = f"""WITH i AS (SELECT c_custkey, abs(c_acctbal)::DOUBLE AS c_cases, (c_custkey % 500)::DOUBLE AS c_minutes, (c_custkey % 12) / 10.0::DOUBLE AS c_share FROM customer),
    w AS (SELECT *, CASE WHEN c_minutes > 480 THEN 'minutes a case: 0 to 480' WHEN c_share > 1 THEN 'the share of cases it answers: 0 to 1' END AS why FROM i),
    l AS (SELECT *, {_R2('c_cases * c_minutes / 60 * 52 * 19.67::DOUBLE')} AS staff, {_R2('5.0::DOUBLE * 12 * 23.1::DOUBLE')} AS seats_cost, {_R2('c_cases * 52 * (1500.0::DOUBLE * 2.0 + 300.0 * 10.0) / 1e6 * 0.75396::DOUBLE')} AS api, {_R2('15.0::DOUBLE * 8760.0 / 1000 * 24.51::DOUBLE / 100')} AS power FROM w),
    t AS (SELECT *, {_R2('staff * c_share')} AS taken_off FROM l), y AS (SELECT *, staff AS today, {_R2('staff + seats_cost')} AS rent_seats, {_R2('staff - taken_off + api')} AS cloud_api, {_R2('staff - taken_off + power')} AS own FROM t)"""
_COST_OUT = ("staff", "taken_off", "seats_cost", "api", "power", "today", "rent_seats", "cloud_api", "own")


def _costs(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.abs("c_acctbal").alias("c_cases"), (F.col("c_custkey") % 500).cast("double").alias("c_minutes"), ((F.col("c_custkey") % 12) / 10.0).alias("c_share"))
    return costs.cost_case(c, inputs=_COST_IN)


@query(f"{_COST_SQL} SELECT c_custkey, why, " + ", ".join(f"CASE WHEN why IS NULL THEN {k} END AS {k}" for k in _COST_OUT) + " FROM y")
def cost_case(spark, sf_dir):
    """Yearly cost of four routes, bad inputs refused with a reason."""
    return _costs(spark, sf_dir).select("c_custkey", "why", *_COST_OUT)


_OVER = lambda k: _R2(f"{k} + {k} * 1.031::DOUBLE + {k} * (1.031::DOUBLE * 1.031::DOUBLE)")


@query(f"{_COST_SQL}, o AS (SELECT *, {_OVER('today')} AS today_over, {_OVER('own')} AS own_over FROM y) SELECT c_custkey, CASE WHEN why IS NULL THEN today_over END AS today_over, CASE WHEN why IS NULL THEN own_over END AS own_over, CASE WHEN why IS NULL THEN {_R2('today_over - own_over')} END AS saving_over FROM o")
def cost_over(spark, sf_dir):
    """Costs carried over three years with rising prices."""
    return _costs(spark, sf_dir).select("c_custkey", "today_over", "own_over", "saving_over")


@query("SELECT s_suppkey, CASE WHEN s_acctbal / 16 >= 512 THEN 'cortex-XL' WHEN s_acctbal / 16 >= 256 THEN 'cortex-L' WHEN s_acctbal / 16 >= 180 THEN 'cortex-M' WHEN s_acctbal / 16 >= 100 THEN 'cortex-S' WHEN s_acctbal / 16 >= 24 THEN 'workstation' ELSE 'edge' END AS tier, 127 AS addresses, s_acctbal / 16 >= 24 AS full_map, s_acctbal / 16 >= 100 AS frontier FROM supplier")
def size_tier(spark, sf_dir):
    """Model tiers by memory."""
    return costs.plan(read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 16).alias("ram")), "ram").drop("ram")


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9-]+', '-', 'g') AS slug, octet_length(encode(p_name))::BIGINT AS bytes, length(p_name)::BIGINT AS chars, substr(sha256(p_name), 1, 16) AS key FROM part")
def text_keys(spark, sf_dir):
    """Slugs, byte lengths and short digests."""
    return read(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat(F.col("p_name"), F.lit(" #"), F.col("p_brand"))).alias("slug"), F.octet_length("p_name").cast("long").alias("bytes"), F.length("p_name").cast("long").alias("chars"), F.substring(T.digest(F.col("p_name")), 1, 16).alias("key"))


@query("SELECT o_orderkey, CASE WHEN trim(x) = '' THEN 0.0 ELSE try_cast(x AS DOUBLE) END AS v FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN o_orderstatus WHEN 3 THEN '1.5' ELSE '' END AS x FROM orders)")
def loose_numbers(spark, sf_dir):
    """Text coerced to numbers, blanks as 0, other text as absent."""
    k = F.col("o_orderkey") % 5
    x = F.when(k == 0, " ").when(k == 1, F.col("o_orderkey").cast("string")).when(k == 2, F.col("o_orderstatus")).when(k == 3, "1.5").otherwise("")
    return read(spark, sf_dir, "orders").select("o_orderkey", N.number(x).alias("v"))


@query(f"SELECT event_id, {r6('value * -1.5')} AS six, {r6('value * -1.5', 2)} AS money FROM events")
def rounding(spark, sf_dir):
    """Half up at six and two places."""
    return read(spark, sf_dir, "events").select("event_id", N.round_up(F.col("value") * -1.5).alias("six"), N.round_up(F.col("value") * -1.5, 2).alias("money"))


_QUALITY = (Rule("bangs", "<=", 0.0, 1.0), Rule("n_chars", ">", 100.0, 0.5), Rule("bars", "<=", 2.0, 1.0), Rule("stars", "<=", 0.0, 0.5))
_QSQL = f"q AS (SELECT d.doc_id, (length(text) - length(replace(text, '!!', ''))) // 2 AS bangs, d.n_chars, length(text) - length(replace(text, '|', '')) AS bars, (length(text) - length(replace(text, '***', ''))) // 3 AS stars, quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id), s AS (SELECT {score_sql(_QUALITY)} AS score, y FROM q)"


@query(f"WITH {_QSQL}, {auc_sql('s')} SELECT * FROM a")
def label_quality_scorecard(spark, sf_dir):
    """A card over text features graded against labels (end to end)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.count_marker(F.col("text"), "!!").alias("bangs"), "n_chars", T.count_marker(F.col("text"), "|").alias("bars"), T.count_marker(F.col("text"), "***").alias("stars"))
    rows = docs.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return metrics.auc(metrics.histogram(rows, score(_QUALITY), F.col("y")))


@query(f"SELECT vec_id, label, {r6('list_dot_product(embedding::DOUBLE[], [1.0 / (i + 1) FOR i IN range(64)]::DOUBLE[])', 4)} AS dot FROM embeddings")
def embedding_dot(spark, sf_dir):
    """Dense vectors against a fixed direction, inside code generation (the dense kin of T2)."""
    dot = F.aggregate(F.zip_with(F.transform("embedding", lambda x: x.cast("double")), F.array(*[F.lit(1.0 / (i + 1)) for i in range(64)]), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", N.round_up(dot, 4).alias("dot"))


# ---- sealed comparisons and summaries -----------------------------------------------------------------------------------

_LINES = ["Session {Administrative} pages,", "value {PageValues}: 0 or 1?"]
_PROMPT_SQL = "concat('Session ', printf('%.0f', floor(value)), ' pages,', chr(10), 'value ', printf('%.2f', value), ': 0 or 1?')"


def _prompts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.floor("value").cast("double").alias("Administrative"), F.col("value").alias("PageValues"))
    return e.select("event_id", sealed.prompt(_LINES).alias("prompt"))


@query(f"SELECT event_id, {_PROMPT_SQL} AS prompt, sha256({_PROMPT_SQL}) AS prompt_sha256 FROM events")
def sealed_prompts(spark, sf_dir):
    """Prompts from a sealed template and their digests."""
    return _prompts(spark, sf_dir).withColumn("prompt_sha256", T.digest(F.col("prompt")))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'missing' WHEN event_id % 11 = 0 THEN 'changed' ELSE 'sealed' END AS state, count(*) AS n FROM events GROUP BY 1")
def check_prompts(spark, sf_dir):
    """Calls of every event: the sealed prompt, a changed one, or none logged."""
    made = _prompts(spark, sf_dir)
    logged = F.when(F.col("event_id") % 3 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, "changed").otherwise(T.digest(F.col("prompt")))
    calls = sealed.check_prompts(made.select("event_id", logged.alias("prompt_sha256")), made, ["event_id"])
    state = F.when(F.col("prompt_sha256").isNull(), "missing").when(F.col("sealed"), "sealed").otherwise("changed")
    return calls.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events) AS covers FROM events GROUP BY 1")
def arm_coverage(spark, sf_dir):
    """Whether each arm has a value for every sample row."""
    e = read(spark, sf_dir, "events")
    return sealed.covers(e, "event_type", "user_id", e.select("user_id").distinct().count())


@query("""WITH c AS (SELECT user_id, event_type, 'ask ' || user_id || ' ' || event_type AS prompt, value, event_id % 2 AS run FROM events),
    n AS (SELECT user_id, event_type, run, count(*) AS attempts, min(sha256(prompt)) AS prompt_sha256, min(CASE WHEN value >= 20 THEN floor(value)::BIGINT::VARCHAR END) AS reply FROM c GROUP BY 1, 2, 3)
    SELECT user_id, event_type, (coalesce(a.attempts, 0) + coalesce(b.attempts, 0))::BIGINT AS attempts, coalesce(a.prompt_sha256, b.prompt_sha256) AS prompt_sha256, coalesce(a.reply, b.reply) AS reply
    FROM (SELECT * FROM n WHERE run = 0) a FULL JOIN (SELECT * FROM n WHERE run = 1) b USING (user_id, event_type)""")
def reply_log(spark, sf_dir):
    """A log of replies after two runs of calls: attempts, prompt hashes, and replies that stay."""
    e = read(spark, sf_dir, "events")
    calls = e.select("user_id", "event_type", F.concat_ws(" ", F.lit("ask"), "user_id", "event_type").alias("prompt"), F.when(F.col("value") >= 20, F.floor("value").cast("string")).alias("reply"), (F.col("event_id") % 2).alias("run"))
    keys = ["user_id", "event_type"]
    return tables.log_replies(calls.where("run = 1"), tables.log_replies(calls.where("run = 0"), None, keys), keys)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 3)")
def open_replies(spark, sf_dir):
    """Prompts without a logged reply, where a stopped run goes on."""
    log = read(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.still_open(read(spark, sf_dir, "orders").select("o_orderkey"), log, ["o_orderkey"])


@query(f"WITH {ORDERS_SQL}, s AS (SELECT c_mktsegment AS segment, {score_sql(ORDER_RULES)} AS score, y FROM ord JOIN customer ON o_custkey = c_custkey), {auc_sql('s', 'segment')} SELECT count(*) AS patterns, {r6('avg(auc)')} AS mean_auc, sum(octet_length(encode(segment)))::BIGINT AS bytes FROM a")
def library_summary(spark, sf_dir):
    """Number, mean AUC and bytes of a library's patterns."""
    rows = orders(spark, sf_dir).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("segment", F.col("c_mktsegment"))
    a = metrics.auc(metrics.histogram(rows, score(ORDER_RULES), F.col("y"), ["segment"]), ["segment"])
    return a.agg(F.count("*").alias("patterns"), N.round_up(F.avg("auc")).alias("mean_auc"), F.sum(F.octet_length("segment")).cast("long").alias("bytes"))


@query("SELECT user_id, min(event_id) AS first_id FROM (SELECT user_id, event_id FROM events WHERE value >= 10 AND event_type = 'purchase') GROUP BY 1")
def first_verified(spark, sf_dir):
    """The first of each group that passes a gate."""
    return read(spark, sf_dir, "events").where("value >= 10 AND event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("first_id"))


@query("WITH a AS (SELECT DISTINCT user_id, event_type FROM events), s AS (SELECT user_id, string_agg(event_type, '|' ORDER BY event_type) AS key FROM a GROUP BY 1) SELECT key, count(*) AS users FROM s GROUP BY 1")
def feature_set_keys(spark, sf_dir):
    """Sets as sorted keys, counted."""
    sets = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("key"))
    return sets.groupBy("key").agg(F.count("*").alias("users"))


# ---- built-in domains and streams (no tables, or no SQL) ----------------------------------------------------------------

# Published cards of the built-in domains.
CARDS = {"fraud": "3f14143ee50fb696b020", "maintenance": "9f385cc1cb8fa56ab602", "credit": "7ffb03f64de739e18a3d", "churn": "bf690c3ea5963114eb38", "energy": "1f9844318bb426348c0a", "intrusion": "ff74afd0500e0addd62d", "inventory": "bf29bb5122813014c735", "marketing": "3fdcb208ce83be9a2c2c"}


_PUBLISHED = "('fraud', 0.768272, 0.8), ('maintenance', 0.781302, 0.904167), ('credit', 0.672461, 0.638889), ('churn', 0.795946, 0.723611), ('energy', 0.782707, 0.743056), ('intrusion', 0.756727, 0.702778), ('inventory', 0.820803, 0.759722), ('marketing', 0.645106, 0.615278)"


@query(f"SELECT domain, held_auc::DOUBLE AS held_auc, held_acc::DOUBLE AS held_acc, 720::BIGINT AS held, true AS verified FROM (VALUES {_PUBLISHED}) t(domain, held_auc, held_acc)")
def published_figures(spark, sf_dir):
    """Held-out figures of the built-in domains' published cards, fitted and graded anew; the SQL states the published ones."""
    return builtin_cards(spark, sf_dir).select("domain", "held_auc", "held_acc", "held", "verified")


def _told_domain(spark: SparkSession, sf_dir: str, y) -> tuple[DataFrame, list[str]]:
    """Parts as a domain of two features, odd (0 or 1) and retail, with the label given."""
    p = read(spark, sf_dir, "part")
    df = p.select(F.col("p_partkey").alias("row_id"), (F.col("p_size") % 2).cast("double").alias("odd"), F.col("p_retailprice").alias("retail"), y.cast("int").alias("y"), F.when(domains.held(F.col("p_partkey")), "held").otherwise("train").alias("split"))
    return df, ["odd", "retail"]


_SMALL = search.Effort(8, 2, 3)


@query("SELECT * FROM (VALUES ('noise', false, NULL, NULL), ('signal', true, 1.0::DOUBLE, true)) t(domain, kept, held_auc, monotone)")
def grown_library(spark, sf_dir):
    """A library and its next tier over a domain that one rule tells exactly and one that none does.

    The search must find the rule (AUC 1) and keep it in the next tier, and the gate must cut the other domain.
    """
    told = _told_domain(spark, sf_dir, F.col("p_size") % 2)
    noise = _told_domain(spark, sf_dir, F.crc32(F.encode(F.concat(F.lit("y"), F.col("p_partkey").cast("string")), "UTF-8")) % 2)
    first = search.build_library({"signal": told, "noise": noise}, effort=_SMALL)
    second = search.grow_tier(first, {"signal": told}, _SMALL)
    rows = [(n, n in first.patterns, first.patterns[n].held_auc if n in first.patterns else None, second.patterns[n].held_auc >= first.patterns[n].held_auc if n in first.patterns else None) for n in ("signal", "noise")]
    return spark.createDataFrame(rows, "domain string, kept boolean, held_auc double, monotone boolean")


@query("SELECT 'forge' AS search, 1.0::DOUBLE AS val_auc, 1.0::DOUBLE AS held_auc, 'two' AS dropped UNION ALL SELECT 'evolve', 1.0, 1.0, ''")
def forged_and_evolved(spark, sf_dir):
    """Proposals against bred cards with a member down, and evolved feature subsets, on a domain that one rule tells."""
    df, features = _told_domain(spark, sf_dir, F.col("p_size") % 2)
    out = search.forge(df, "signal", features, {"one": '[{"feature": "odd", "direction": "high"}]', "two": None}, effort=_SMALL)
    best = search.evolve(df, "signal", features, generations=1, population=2, effort=_SMALL)
    rows = [("forge", float(out["val_auc"]), out["pattern"].held_auc, ",".join(out["dropped"])), ("evolve", float(best["curve"][-1]), float(best["auc"]), "")]
    return spark.createDataFrame(rows, "search string, val_auc double, held_auc double, dropped string")


@query("SELECT 'p_size' AS feature, sum(p_size)::DOUBLE AS total, count(*) AS n, sum(CASE WHEN p_size > 40 THEN 1 ELSE 0 END)::BIGINT AS positives FROM part UNION ALL SELECT 'p_retailprice', sum(p_retailprice), count(*), sum(CASE WHEN p_size > 40 THEN 1 ELSE 0 END)::BIGINT FROM part".replace("sum(p_retailprice)", "floor(sum(p_retailprice) + 0.5)"))
def csv_dataset(spark, sf_dir):
    """A CSV folder read as a dataset: its numeric features and the rarer class of its last column."""
    import uuid

    path = f"{tables.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    read(spark, sf_dir, "part").select("p_size", "p_retailprice", F.when(F.col("p_size") > 40, "large").otherwise("small").alias("kind")).write.option("header", True).csv(path)
    loaded = tables.from_csv(spark, path)
    names = dict(zip(("p_size", "p_retailprice"), loaded.features, strict=True))
    out = None
    for name, column in names.items():
        total = F.sum(column) if name == "p_size" else F.floor(F.sum(column) + 0.5)
        part = loaded.df.agg(F.lit(name).alias("feature"), total.cast("double").alias("total"), F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))
        out = part if out is None else out.union(part)
    return out


@query()
def builtin_cards(spark, sf_dir):
    """Cards of all eight generated domains, fitted and graded anew (S2-S4, G1, G5; held-out AUCs are pinned in the tests)."""
    rows = []
    for name, card in CARDS.items():
        df = domains.load(spark, name).cache()  # 2,400 generated rows, read by several small jobs
        p = search.pattern(df, name, domains.DOMAINS[name].names, decode(card), 1)
        rows.append((name, card, p.threshold, p.held_auc, p.held_acc, p.held, p.verified))
        df.unpersist()
    return spark.createDataFrame(rows, "domain string, genome string, threshold double, held_auc double, held_acc double, held long, verified boolean")


@query()
def corpus_markers(spark, sf_dir):
    """Both text corpora as marker counts by class."""
    out = None
    for name in tables.CORPUS_SEEDS:
        part = tables.load_corpus(spark, name).groupBy("split", "y").agg(F.count("*").alias("n")).select(F.lit(name).alias("corpus"), "split", "y", "n")
        out = part if out is None else out.union(part)
    return out


@query()
def stream_answer(spark, sf_dir):
    """Answers over a stream of event files, run until all is answered (stateless streaming)."""
    import uuid

    base = f"{tables.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retail")).write.parquet(f"{base}/in")
    stream = answers.read_inputs(spark, f"{base}/in", spark.read.parquet(f"{base}/in").schema)
    answers.run_once(answers.answer_stream(stream, LIBRARY).select("p_partkey", "verdict", "route_domain", "route_score", "label"), f"{base}/out", f"{base}/log")
    return spark.read.parquet(f"{base}/out")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT p_partkey, p_name, p_size FROM part")
def state_round_trip(spark, sf_dir):
    """Tables written as state, in both formats, and read again."""
    import uuid

    base = f"{tables.shared_folder(spark)}/state-{uuid.uuid4().hex}"
    tables.write_state(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{base}/json")
    tables.write_state(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), f"{base}/parquet", "parquet")
    return tables.read_state(spark, f"{base}/json").select("n_nationkey", "n_name", "n_regionkey").union(spark.read.parquet(f"{base}/parquet").select("p_partkey", "p_name", "p_size"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN concat('is it ', p_name, '?|yes or no') END AS lines FROM part""")
def sealed_plans(spark, sf_dir):
    """Prompt lines of plans in texts: the named test's, and none of another test, of broken JSON or without a fence."""
    body = lambda test: F.concat(F.lit('{"test":"' + test + '","prompt":["is it '), F.col("p_name"), F.lit('?","yes or no"]}'))
    fenced = lambda x: F.concat(F.lit("# Plan\n```json\n"), x, F.lit("\n```\nafter"))
    kind = F.col("p_size") % 4
    text = F.when(kind == 0, fenced(body("SIZE"))).when(kind == 1, fenced(body("OTHER"))).when(kind == 2, fenced(F.lit('{"test":"SIZE","prompt":['))).otherwise(body("SIZE"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(sealed.sealed_lines(text, "SIZE"), "|").alias("lines"))


_REPLIES = (
    ("list", 'Sure: [{"feature":"QTY","direction":"low"},{"feature":"nope"},{"feature":"tax","direction":"high"},{"feature":"tax","direction":"low"}]'),
    ("prose", "Returns rise when qty is below normal; price matters, the larger the worse"),
    ("empty", ""),
    ("broken", "[{feature: disc}] and disc goes down"),
)


@query("SELECT * FROM (VALUES ('list', 0, 'qty', 'low', 'qty <= at cut 7'), ('list', 1, 'tax', 'high', 'tax > at cut 7'), ('prose', 0, 'qty', 'low', 'qty <= at cut 7'), ('prose', 1, 'price', 'high', 'price > at cut 7'), ('broken', 0, 'disc', 'low', 'disc <= at cut 7')) t(reply, place, feature, direction, gene)")
def read_hypotheses(spark, sf_dir):
    """Hypotheses read from replies, and the rules they become; replies are few, so the driver reads them."""
    rows = []
    for reply, text in _REPLIES:
        found = search.parse_hypotheses(text, list(LINE))
        genes = [g for g in search.genome_of(found, list(LINE)) if g.on] if found else []
        rows += [(reply, i, f, d, f"{LINE[g.f]} {'>' if g.d else '<='} at cut {g.q}") for i, ((f, d), g) in enumerate(zip(found, genes, strict=True))]
    return spark.createDataFrame(rows, "reply string, place int, feature string, direction string, gene string")


_BOOK_SQL = """concat('PATTERN BOOK — part (predicts: "kept")', chr(10), 'source: parts', chr(10), 'held-out AUC 0.7 · held-out accuracy 0.66 · 600 held-out cases', chr(10), chr(10),
    '  • when size is above 25  →  makes "kept" MORE likely  (weight +1)', chr(10), '  • when retail is at or below 1000  →  makes "kept" LESS likely  (weight -0.5)')"""


@query(f"""WITH b AS (SELECT {_BOOK_SQL} AS book) SELECT 'part' AS domain, book, sha256(concat('{{"domain":"part","rules":2,"heldAuc":0.7,"book":"', sha256(book), '"}}')) AS receipt_hash, true AS genuine, false AS altered FROM b""")
def pattern_books(spark, sf_dir):
    """A card as a book, its receipt's hash, and the check of the receipt as it is and altered."""
    import hashlib

    p = LIBRARY[2]
    text = book(p.domain, "kept", p.rules, p.held_auc, p.held_acc, p.held, "parts")
    receipt = sealed.hashed({"domain": p.domain, "rules": len(p.rules), "heldAuc": p.held_auc, "book": hashlib.sha256(text.encode()).hexdigest()})
    return spark.createDataFrame([(p.domain, text, receipt["receiptHash"], sealed.genuine(receipt), sealed.genuine({**receipt, "heldAuc": 0.9}))], "domain string, book string, receipt_hash string, genuine boolean, altered boolean")
