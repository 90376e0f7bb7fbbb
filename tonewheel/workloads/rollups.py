"""Statistics over runs, data sets and models on ``orders``, ``customer``, ``part``, ``events`` and ``supplier``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewheel.operators.metrics import hmean
from tonewheel.operators.skew import positions
from tonewheel.plans import rollup
from tonewheel.session import settle
from tonewheel.workloads import load, query
from tonewheel.workloads.scoring import r6, rounded

RUNS = list(range(10))


@query("hmean_values", """SELECT user_id, round(CASE WHEN min(v) = 0 THEN 0 ELSE count(v) / sum(1 / v) END, 6) AS hm FROM (SELECT user_id, round(abs(value), 1) AS v FROM events) GROUP BY user_id""".replace("sum(1 / v)", "sum(1 / nullif(v, 0))"))
def hmean_values(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events").select("user_id", F.round(F.abs("value"), 1).alias("v"))
    return ev.groupBy("user_id").agg(r6(hmean("v")).alias("hm"))


def order_runs(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset"), (F.col("o_custkey") % 10).alias("run"), "o_totalprice")
    return o.groupBy("dataset", "run").agg(F.avg("o_totalprice").alias("value"))


ORDER_RUNS = "r AS (SELECT o_orderpriority AS dataset, o_custkey % 10 AS run, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"


def pivot_sql(source: str, keys: str, runs: list[int], digits: int) -> str:
    columns = ", ".join(f"round(max(value) FILTER (run = {r}), {digits}) + 0.0 AS run{i}" for i, r in enumerate(runs))
    return f"SELECT {keys}, {columns}, round(avg(value), {digits}) + 0.0 AS mean, round(stddev_samp(value), {digits}) + 0.0 AS std FROM {source} GROUP BY {keys}"


def digits(df: DataFrame, n: int) -> DataFrame:
    for c in df.columns:
        if c.startswith("run") or c in ("mean", "std"):
            df = df.withColumn(c, F.round(c, n) + F.lit(0.0))
    return df


@query("run_stats_pivot", f"WITH {ORDER_RUNS} {pivot_sql('r', 'dataset', RUNS, 6)}")
def run_stats_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return digits(rollup.run_statistics(order_runs(spark, sf), ["dataset"], RUNS, decimals=None), 6)


def machine_runs(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events")
    setn = F.when(F.col("user_id") % 2 == 0, "dev").otherwise("eval")
    mt = F.concat(F.lit("m"), F.col("user_id") % 6)
    return ev.groupBy((F.col("event_id") % 4).alias("run"), setn.alias("setn"), mt.alias("mt")).agg(F.avg(F.abs("value")).alias("value"))


MACHINE_RUNS = "m AS (SELECT event_id % 4 AS run, CASE WHEN user_id % 2 = 0 THEN 'dev' ELSE 'eval' END AS setn, 'm' || CAST(user_id % 6 AS VARCHAR) AS mt, avg(abs(value)) AS value FROM events GROUP BY ALL)"
_H = "CASE WHEN min(value) = 0 THEN 0 ELSE count(value) / sum(1 / nullif(value, 0)) END"


def _anomaly_runs(year: int) -> None:
    fold, name = ("avg(value)", "mean") if year == 20 else (_H, "hmean")
    sub = f"SELECT run, setn, {fold} AS value FROM m GROUP BY ALL" if year < 23 else f"SELECT run, setn, value FROM (SELECT event_id % 4 AS run, CASE WHEN user_id % 2 = 0 THEN 'dev' ELSE 'eval' END AS setn, max(value) AS value FROM events GROUP BY ALL)"

    @query(
        f"anomaly_run_stats_20{year}",
        f"WITH {MACHINE_RUNS}, s AS ({sub}), a AS (SELECT run, setn, mt, value FROM m UNION ALL SELECT run, setn, 'subset', value FROM s UNION ALL SELECT run, 'all', '{name}', {fold} FROM s GROUP BY run) "
        + pivot_sql("a", "setn, mt", [0, 1, 2, 3], 6),
    )
    def run(spark: SparkSession, sf: str) -> DataFrame:
        machines = settle(machine_runs(spark, sf))
        subsets = None
        if year >= 23:
            setn = F.when(F.col("user_id") % 2 == 0, "dev").otherwise("eval")
            subsets = load(spark, sf, "events").groupBy((F.col("event_id") % 4).alias("run"), setn.alias("setn")).agg(F.max("value").alias("value"))
        rows = rollup.anomaly_run_rows(machines, year, subsets)
        return digits(rollup.run_statistics(rows, ["setn", "mt"], [0, 1, 2, 3], decimals=None), 6)


for _year in (20, 22, 23):
    _anomaly_runs(_year)


@query("dataset_run_stats", f"WITH {ORDER_RUNS}, a AS (SELECT run, dataset, value FROM r UNION ALL SELECT run, 'mean', avg(value) FROM r GROUP BY run) {pivot_sql('a', 'dataset', RUNS, 4)}")
def dataset_run_stats(spark: SparkSession, sf: str) -> DataFrame:
    return digits(rollup.across_datasets(settle(order_runs(spark, sf)), RUNS, decimals=None), 4)


@query("fault_run_stats", f"""WITH a AS (SELECT l_linenumber % 5 AS run, l_linestatus AS dataset, CAST(round_even(avg(l_quantity), 2) AS DOUBLE) AS value FROM lineitem GROUP BY ALL) {pivot_sql('a', 'dataset', [0, 1, 2, 3, 4], 6)}""")
def fault_run_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy lines of text reports, read back and folded over runs."""
    runs = load(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 5).alias("run"), F.col("l_linestatus").alias("dataset")).agg(F.avg("l_quantity").alias("v"))
    line = F.format_string("macro-acc: %.2f", F.bround("v", 2))
    texts = runs.select("run", "dataset", F.explode(F.array(F.lit("scene  pred"), line, F.lit("micro-acc: 1.00"))).alias("text"))
    found = rollup.accuracy_from_report(texts, "macro-acc", "text")
    return digits(rollup.run_statistics(found, ["dataset"], [0, 1, 2, 3, 4], decimals=None), 6)


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One score per nation (as model) and segment (as data set), in two tasks."""
    c = load(spark, sf, "customer")
    task = F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "ad").otherwise("fd")
    return c.groupBy(F.col("c_nationkey").alias("model"), task.alias("task"), F.col("c_mktsegment").alias("dataset")).agg(F.bround(F.avg("c_acctbal") / 100, 1).alias("score"))


MODELS = "s AS (SELECT c_nationkey AS model, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'ad' ELSE 'fd' END AS task, c_mktsegment AS dataset, round_even(avg(c_acctbal) / 100, 1) AS score FROM customer GROUP BY ALL)"


@query("benchmark_rollup", f"""WITH {MODELS}, t AS (SELECT model, task, avg(score) AS score FROM s GROUP BY ALL)
SELECT model, task, round(score, 6) AS score FROM t UNION ALL SELECT model, 'overall', round(avg(score), 6) FROM t GROUP BY model""")
def benchmark_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rollup.benchmark_score(model_scores(spark, sf), ["model"]), "score")


@query("mean_over_datasets", f"WITH {MODELS} SELECT model, round(avg(score), 6) AS score FROM s GROUP BY model")
def mean_over_datasets(spark: SparkSession, sf: str) -> DataFrame:
    return model_scores(spark, sf).groupBy("model").agg(r6(F.avg("score")).alias("score"))


@query("best_per_column", f"WITH {MODELS} SELECT model, task, dataset, score FROM (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) AS r FROM s) WHERE r = 1")
def best_per_column(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.best_per_column(settle(model_scores(spark, sf)))


@query("leaderboard_order", """WITH b AS (SELECT p_brand, CASE WHEN count(*) % 4 = 0 THEN '-' ELSE CAST(count(*) AS VARCHAR) || ' parts' END AS cell FROM part GROUP BY p_brand)
SELECT p_brand, cell, row_number() OVER (ORDER BY try_cast(regexp_replace(cell, '[^0-9.\\-]', '', 'g') AS DOUBLE) DESC NULLS LAST, cell DESC, p_brand) AS place FROM b""")
def leaderboard_order(spark: SparkSession, sf: str) -> DataFrame:
    """One row per brand; numbers first, cells without a number by their text."""
    n = F.count(F.lit(1))
    rows = load(spark, sf, "part").groupBy("p_brand").agg(F.when(n % 4 == 0, "-").otherwise(F.concat(n, F.lit(" parts"))).alias("cell"))
    order = Window.orderBy(*rollup.leaderboard_order(F.col("cell")), "p_brand")
    return rows.withColumn("place", F.row_number().over(order))


@query("numeric_suffix_order", """SELECT name, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM (SELECT s_suppkey, 'run' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier)""")
def numeric_suffix_order(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier").select(F.concat(F.lit("run"), "s_suppkey").alias("name"))
    placed = positions(s.withColumn("n", rollup.numeric_suffix(F.col("name"))), [], ["n", "name"], name="place")
    return placed.select("name", "place")


@query("machine_order", """WITH g AS (SELECT event_type AS mt, CASE WHEN user_id % 2 = 0 THEN 'dev' ELSE 'eval' END AS setn, count(*) AS n FROM events GROUP BY ALL)
SELECT mt, setn, n, row_number() OVER (ORDER BY list_position(['view', 'error', 'click'], mt) NULLS LAST, setn, mt) AS place FROM g""")
def machine_order(spark: SparkSession, sf: str) -> DataFrame:
    setn = F.when(F.col("user_id") % 2 == 0, "dev").otherwise("eval")
    g = load(spark, sf, "events").groupBy(F.col("event_type").alias("mt"), setn.alias("setn")).agg(F.count(F.lit(1)).alias("n"))
    order = rollup.machine_order(g, {"dev": ["view", "error"], "eval": ["view", "click"]})
    return g.withColumn("place", F.row_number().over(Window.orderBy(*order, "mt")))
