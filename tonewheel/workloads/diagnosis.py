"""Neighbour votes, splits and accuracy on ``embeddings``, ``conversations``, ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewheel.operators import labels, splits, votes
from tonewheel.operators.metrics import accuracy, class_report
from tonewheel.plans import diagnosis as fd
from tonewheel.session import settle
from tonewheel.workloads import load, query
from tonewheel.workloads.scoring import r6, rounded

CLASSES = 10
SEED = 111


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as segments of recordings of five, with the label as class."""
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("file"), F.col("embedding").alias("emb"),
        F.col("label").alias("cls"), F.floor(F.col("vec_id") / 5).alias("ori"),
    )


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    seg = segments(spark, sf)
    sided = splits.assign(seg, "ori", splits.sealed_splits(seg, "ori", "cls", (0.5,), 1, SEED))
    return tuple(sided.where(F.col("side") == s).drop("run", "test_size", "side") for s in ("test", "train"))


SEG = f"""seg AS (SELECT vec_id AS file, CAST(embedding AS DOUBLE[]) AS emb, label AS cls, vec_id // 5 AS ori FROM embeddings),
rec AS (SELECT ori, row_number() OVER (ORDER BY md5('{SEED}|' || CAST(ori AS VARCHAR))) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT ori FROM seg)),
e AS (SELECT seg.*, CASE WHEN rn <= ceil(0.5 * n) THEN 'test' ELSE 'train' END AS side FROM seg JOIN rec USING (ori))"""


def near_sql(k: int) -> str:
    return f"""near_p AS (SELECT t.file, t.cls, n.file AS neighbour, n.cls AS ncls, list_cosine_similarity(t.emb, n.emb) AS sim FROM e t JOIN e n ON t.side = 'test' AND n.side = 'train'),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(1 - sim, 9), neighbour) AS rank FROM near_p) WHERE rank <= {k})"""


def vote_sql(source: str, keys: str) -> str:
    """Dense vote: every class has a sum, absent ones 0."""
    return f"""dense AS (SELECT k.*, c.ncls, coalesce(s.logit, 0.0) AS logit FROM (SELECT DISTINCT {keys} FROM {source}) k
  JOIN (SELECT unnest(range({CLASSES})) AS ncls) c ON true
  LEFT JOIN (SELECT {keys}, ncls, sum(sim) AS logit FROM {source} GROUP BY {keys}, ncls) s USING ({keys}, ncls)),
vote AS (SELECT {keys}, CAST(ncls AS INTEGER) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(logit, 9) DESC, ncls) AS rn FROM dense) WHERE rn = 1)"""


def report_sql(keys: str = "") -> str:
    k = keys + ", " if keys else ""
    return f"""marks AS (SELECT {k}cls AS scene, 0 AS p, CAST(cls = pred AS INTEGER) AS c, 1 AS a FROM vote UNION ALL SELECT {k}pred, 1, 0, 0 FROM vote),
rep AS (SELECT {k}scene, CAST(sum(p) AS BIGINT) AS pred, CAST(sum(c) AS BIGINT) AS correct, CAST(sum(a) AS BIGINT) AS "all", sum(c) * 100.0 / nullif(sum(a), 0) AS acc FROM marks GROUP BY {k}scene)"""


def acc_sql(keys: str = "") -> str:
    return f"""round(avg(acc), 6) AS macro_acc, round(avg(CASE WHEN "all" > 0 OR pred > 0 THEN coalesce(acc, 0) END), 6) AS macro_acc_lib,
round(sum(correct) * 100.0 / sum("all"), 6) AS micro_acc FROM rep{' GROUP BY ' + keys if keys else ''}"""


@query("knn_neighbours", f"WITH {SEG}, {near_sql(5)} SELECT file, cls, CAST(rank AS INTEGER) AS rank, neighbour, round(sim, 6) + 0.0 AS sim FROM near")
def knn_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    test, train = halves(spark, sf)
    hits = fd.nearest(test, train, 5)
    lists = votes.neighbour_lists(hits, ["file", "cls"])
    rows = lists.select("file", "cls", F.posexplode("pred").alias("p", "n"))
    return rows.select("file", "cls", (F.col("p") + 1).alias("rank"), F.col("n.file").alias("neighbour"), r6("n.sim").alias("sim"))


@query("knn_vote", f"WITH {SEG}, {near_sql(5)}, {vote_sql('near', 'file, cls')} SELECT file, cls, pred, CAST(cls = pred AS INTEGER) AS eval FROM vote")
def knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    test, train = halves(spark, sf)
    return fd.diagnose(test, train, 5, CLASSES)


@query("knn_class_prob", f"WITH {SEG}, {near_sql(5)}, {vote_sql('near', 'file, cls')} SELECT file, CAST(ncls AS INTEGER) AS ncls, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY file), 6) AS prob FROM dense")
def knn_class_prob(spark: SparkSession, sf: str) -> DataFrame:
    test, train = halves(spark, sf)
    # neighbour lists kept without classes get them by a join
    hits = votes.neighbour_classes(fd.nearest(test, train, 5).drop("ncls"), train)
    prob = votes.class_probabilities(hits, ["file"], CLASSES)
    return prob.select("file", F.posexplode("prob").alias("ncls", "prob")).withColumn("prob", r6("prob"))


@query("knn_k_sweep", f"""WITH {SEG}, {near_sql(9)}, upto AS (SELECT near.*, k FROM near JOIN (SELECT unnest(range(1, 10)) AS k) ON rank <= k),
{vote_sql('upto', 'k, file, cls')}, {report_sql('k')} SELECT CAST(k AS INTEGER) AS k, {acc_sql('k')}""")
def knn_k_sweep(spark: SparkSession, sf: str) -> DataFrame:
    test, train = halves(spark, sf)
    return rounded(fd.k_sweep(test, train, 1, 9, CLASSES), "macro_acc", "macro_acc_lib", "micro_acc")


@query("class_report", f"""WITH {SEG}, {near_sql(5)}, {vote_sql('near', 'file, cls')}, {report_sql()} SELECT scene, pred, correct, "all", round(acc, 6) AS acc FROM rep""")
def report(spark: SparkSession, sf: str) -> DataFrame:
    test, train = halves(spark, sf)
    return rounded(class_report(fd.diagnose(test, train, 5, CLASSES)), "acc")


@query("event_class_report", """WITH g AS (SELECT event_type, mode_type AS guess FROM events JOIN (SELECT user_id, event_type AS mode_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1) USING (user_id)),
m AS (SELECT event_type AS scene, 0 AS p, CAST(event_type = guess AS INTEGER) AS c, 1 AS a FROM g UNION ALL SELECT guess, 1, 0, 0 FROM g),
rep AS (SELECT scene, sum(p) AS pred, sum(c) AS correct, sum(a) AS "all", sum(c) * 100.0 / nullif(sum(a), 0) AS acc FROM m GROUP BY scene)
SELECT round(avg(acc), 6) AS macro_acc, round(avg(CASE WHEN "all" > 0 OR pred > 0 THEN coalesce(acc, 0) END), 6) AS macro_acc_lib, round(sum(correct) * 100.0 / sum("all"), 6) AS micro_acc FROM rep""")
def event_class_report(spark: SparkSession, sf: str) -> DataFrame:
    """Macro and micro accuracy of guessing each user's most frequent event type."""
    ev = load(spark, sf, "events").select("user_id", "event_type")
    counts = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    guess = counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("pred"))
    pred = ev.join(guess, "user_id").withColumnRenamed("event_type", "cls")
    return rounded(accuracy(class_report(pred)), "macro_acc", "macro_acc_lib", "micro_acc")


@query("sealed_split", f"""WITH rec AS (SELECT conv_id, row_number() OVER (ORDER BY md5('{SEED}|' || CAST(conv_id AS VARCHAR))) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, turn, role, CASE WHEN rn <= ceil(0.5 * n) THEN 'test' ELSE 'train' END AS side FROM conversations JOIN rec USING (conv_id)""")
def sealed_split(spark: SparkSession, sf: str) -> DataFrame:
    conv = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    return splits.assign(conv, "conv_id", splits.sealed_splits(conv, "conv_id", "role", (0.5,), 1, SEED)).drop("run", "test_size")


def order_rank_sql(runs: int, sizes: str, unit: str = "l_orderkey") -> str:
    return f"""runs AS (SELECT unnest(range({runs})) AS run), sizes AS (SELECT unnest({sizes}) AS test_size),
rec AS (SELECT run, unit, row_number() OVER (PARTITION BY run ORDER BY md5(CAST({SEED} + run AS VARCHAR) || '|' || unit)) AS rn, count(*) OVER (PARTITION BY run) AS n
  FROM (SELECT DISTINCT CAST({unit} AS VARCHAR) AS unit FROM lineitem) JOIN runs ON true)"""


@query("sealed_split_runs", f"""WITH {order_rank_sql(10, '[0.2]')} SELECT CAST(run AS INTEGER) AS run, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS side, l_returnflag,
count(*) AS rows, count(DISTINCT l_orderkey) AS recordings FROM lineitem JOIN rec ON CAST(l_orderkey AS VARCHAR) = unit GROUP BY ALL""")
def sealed_split_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Ten runs over all order lines; lines of an order stay together."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    drawn = splits.sealed_splits(li, "l_orderkey", "l_returnflag", (0.2,), 10, SEED)
    # lines of an order share its side, so they are folded before they are repeated per run
    per = li.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("c"))
    sided = splits.assign(per, "l_orderkey", drawn)
    return sided.groupBy("run", "side", "l_returnflag").agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("recordings"))


@query("segment_split", f"""WITH {order_rank_sql(3, '[0.5]', "CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR)")}
SELECT CAST(run AS INTEGER) AS run, CASE WHEN rn <= ceil(0.5 * n) THEN 'test' ELSE 'train' END AS side, l_linestatus, count(*) AS rows
FROM lineitem JOIN rec ON CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) = unit GROUP BY ALL""")
def segment_split(spark: SparkSession, sf: str) -> DataFrame:
    """Each line drawn on its own: the split that lets an order part."""
    li = load(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("unit"), "l_linestatus")
    sided = splits.assign(li, "unit", splits.sealed_splits(li, "unit", None, (0.5,), 3, SEED))
    return sided.groupBy("run", "side", "l_linestatus").agg(F.count(F.lit(1)).alias("rows"))


@query("split_coverage", f"""WITH {order_rank_sql(4, '[0.1, 0.9]')} SELECT CAST(run AS INTEGER) AS run, test_size, count(DISTINCT l_returnflag) FILTER (rn > ceil(test_size * n - 1e-9)) AS train_classes,
count(DISTINCT l_returnflag) FILTER (rn <= ceil(test_size * n - 1e-9)) AS test_classes FROM lineitem JOIN rec ON CAST(l_orderkey AS VARCHAR) = unit JOIN sizes ON true GROUP BY ALL""")
def split_coverage(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    drawn = splits.sealed_splits(li, "l_orderkey", "l_returnflag", (0.1, 0.9), 4, SEED)
    return splits.coverage(li, "l_orderkey", "l_returnflag", drawn).drop("classes")


GRID = splits.ratio_grid()
RUNS = 10


def grid_sql(sizes: list[float], runs: int, k: int) -> str:
    """Every run and size with the first seed whose split holds every class on both sides."""
    return f"""seg AS (SELECT vec_id AS file, CAST(embedding AS DOUBLE[]) AS emb, label AS cls, vec_id // 5 AS ori FROM embeddings),
runs AS (SELECT unnest(range({runs})) AS run), sizes AS (SELECT unnest({sizes}) AS test_size), tries AS (SELECT unnest(range(20)) AS try),
rec AS (SELECT run, try, ori, row_number() OVER (PARTITION BY run, try ORDER BY md5(CAST({SEED} + run + 100 * try AS VARCHAR) || '|' || CAST(ori AS VARCHAR))) AS rn, count(*) OVER (PARTITION BY run, try) AS n
  FROM (SELECT DISTINCT ori FROM seg) JOIN runs ON true JOIN tries ON true),
kinds AS (SELECT DISTINCT ori, cls FROM seg), total AS (SELECT count(DISTINCT cls) AS c FROM seg),
good AS (SELECT run, test_size, min(try) AS try FROM (SELECT run, test_size, try, count(DISTINCT cls) FILTER (rn <= ceil(test_size * n - 1e-9)) AS te, count(DISTINCT cls) FILTER (rn > ceil(test_size * n - 1e-9)) AS tr
  FROM rec JOIN kinds USING (ori) JOIN sizes ON true GROUP BY ALL), total WHERE te = c AND tr = c GROUP BY ALL),
side AS (SELECT good.run, good.test_size, file, cls, rn <= ceil(test_size * n - 1e-9) AS test FROM good JOIN rec USING (run, try) JOIN seg USING (ori)),
pairs AS (SELECT t.file, n.file AS neighbour, n.cls AS ncls, list_cosine_similarity(t.emb, n.emb) AS sim FROM seg t JOIN seg n ON true),
near AS (SELECT * FROM (SELECT a.run, a.test_size, a.file, a.cls, ncls, sim, row_number() OVER (PARTITION BY a.run, a.test_size, a.file ORDER BY round(1 - sim, 9), neighbour) AS rank
  FROM side a JOIN pairs p ON a.test AND a.file = p.file JOIN side b ON NOT b.test AND b.run = a.run AND b.test_size = a.test_size AND b.file = p.neighbour) WHERE rank <= {k}),
{vote_sql('near', 'run, test_size, file, cls')}, {report_sql('run, test_size')}"""


@query("fault_runs", f"WITH {grid_sql([0.5], RUNS, 5)} SELECT CAST(run AS INTEGER) AS run, {acc_sql('run')}")
def fault_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Ten sealed runs of the five-neighbour vote, searched together."""
    out = fd.repeated(segments(spark, sf), "ori", 5, CLASSES, (0.5,), RUNS, SEED).drop("test_size")
    return rounded(out, "macro_acc", "macro_acc_lib", "micro_acc")


@query("ratio_grid", f"""WITH {grid_sql(GRID, RUNS, 5)}, acc AS (SELECT run, test_size, avg(acc) AS macro FROM rep GROUP BY ALL)
SELECT test_size, round(avg(macro), 6) AS mean, round(stddev_samp(macro), 6) AS std FROM acc GROUP BY test_size""")
def ratio_grid(spark: SparkSession, sf: str) -> DataFrame:
    acc = fd.repeated(segments(spark, sf), "ori", 5, CLASSES, GRID, RUNS, SEED)
    return rounded(fd.run_summary(acc, ["test_size"], "macro_acc"), "mean", "std")


def _majority_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy in percent of the commonest flag of the train orders on the test orders, per size and run."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    drawn = splits.sealed_splits(li, "l_orderkey", "l_returnflag", GRID, 2, SEED)
    folded = splits.side_sums(li, "l_orderkey", drawn, ["l_returnflag"], F.lit(1).cast("long"))
    folded = folded.withColumnsRenamed({"train": "tr", "test": "te"})
    return folded.groupBy("run", "test_size").agg(
        (F.max_by("te", F.struct("tr", "l_returnflag")) * 100.0 / F.sum("te")).alias("acc")
    )


@query("split_curve_area", f"""WITH {order_rank_sql(2, str(GRID))}, per AS (SELECT CAST(l_orderkey AS VARCHAR) AS unit, l_returnflag, count(*) AS c FROM lineitem GROUP BY ALL),
f AS (SELECT run, test_size, l_returnflag, sum(c) FILTER (rn > ceil(test_size * n - 1e-9)) AS tr, sum(c) FILTER (rn <= ceil(test_size * n - 1e-9)) AS te FROM per JOIN rec USING (unit) JOIN sizes ON true GROUP BY ALL),
g AS (SELECT run, test_size, arg_max(te, (tr, l_returnflag)) * 100.0 / sum(te) AS acc FROM f GROUP BY ALL),
y AS (SELECT 1 - test_size AS x, avg(acc) / 100 AS y FROM g GROUP BY test_size UNION ALL SELECT 0, 1 / 3.0 UNION ALL SELECT 1, 1),
i AS (SELECT *, row_number() OVER (ORDER BY x) - 1 AS i FROM y)
SELECT 'simpson' AS method, round(100 * sum(y * CASE WHEN i IN (0, 20) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 0.05 / 3, 6) AS area FROM i
UNION ALL SELECT 'trapezoid', round(100 * sum(y * CASE WHEN i IN (0, 20) THEN 0.5 ELSE 1 END) * 0.05, 6) FROM i""")
def split_curve_area(spark: SparkSession, sf: str) -> DataFrame:
    """Area under accuracy against train fraction, 19 sizes and both rules."""
    summary = settle(_majority_curve(spark, sf).groupBy("test_size").agg(F.avg("acc").alias("mean")))
    both = [fd.split_curve(summary, 3, method=m).withColumn("method", F.lit(m)) for m in ("simpson", "trapezoid")]
    return rounded(both[0].unionByName(both[1]), "area")


@query("label_first_seen", """SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS id, count(*) AS rows FROM events GROUP BY event_type""")
def label_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events").select("event_id", "event_type")
    half = F.col("event_id")
    cut = ev.select(F.max("event_id").alias("m")).scalar() / 2
    table = labels.by_first_appearance([ev.where(half <= cut), ev.where(half > cut)], "event_type", "event_id")
    return labels.with_ids(ev, table, "event_type").groupBy("event_type", "id").agg(F.count(F.lit(1)).alias("rows"))


@query("label_sorted", """WITH u AS (SELECT p_type AS label, dense_rank() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey, label AS p_type, id, label AS back FROM part JOIN u ON p_type = label""")
def label_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Ids over the union of train and test labels, and back again."""
    part = load(spark, sf, "part").select("p_partkey", "p_type")
    table = labels.by_sorted_union([part.where("p_partkey < 10"), part.where("p_partkey >= 10")], "p_type")
    return labels.with_labels(labels.with_ids(part, table, "p_type"), table, "id", "p_type", "back")


@query("label_fixed_list", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 END AS id FROM orders""")
def label_fixed_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    known = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    return labels.by_fixed_list(rows, "o_orderpriority", known).drop("o_orderpriority")


def u_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8) AS BIGINT) / 4294967296.0"


@query("mix_sources", f"""SELECT 0 AS source_id, l_returnflag, count(*) AS rows FROM lineitem WHERE l_linestatus = 'F' AND {u_sql("'7'", "'0'", "CAST(l_orderkey AS VARCHAR)")} < 0.5 GROUP BY ALL
UNION ALL SELECT 1, l_returnflag, count(*) FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL""")
def mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag")
    mixed = splits.mix_sources([li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'")], [1.0, 2.0], "l_orderkey", seed=7)
    return mixed.groupBy("source_id", "l_returnflag").agg(F.count(F.lit(1)).alias("rows"))


@query("seeded_shuffle", """SELECT event_id, row_number() OVER (ORDER BY md5('5|' || CAST(event_id AS VARCHAR)), event_id) - 1 AS pos FROM events""")
def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    from tonewheel.operators.skew import positions

    ev = load(spark, sf, "events").select("event_id", F.md5(F.concat_ws("|", F.lit("5"), F.col("event_id").cast("string"))).alias("h"))
    return positions(ev, [], ["h", "event_id"]).select("event_id", "pos")


@query("fixed_split_accuracy", """WITH s AS (SELECT o.*, CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'test' END AS sett FROM orders o),
m AS (SELECT c_mktsegment, arg_max(o_orderpriority, (n, o_orderpriority)) AS guess FROM (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM s JOIN customer ON o_custkey = c_custkey WHERE sett = 'train' GROUP BY ALL) GROUP BY 1)
SELECT c_mktsegment, count(*) AS "all", count(*) FILTER (o_orderpriority = guess) AS correct FROM s JOIN customer ON o_custkey = c_custkey JOIN m USING (c_mktsegment) WHERE sett = 'test' GROUP BY 1""")
def fixed_split_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """A given split: the train side names a priority per segment, the test side checks it."""
    o = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("c_mktsegment", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "train").otherwise("test").alias("sett"))
    train, test = splits.fixed_split(o)
    n = train.groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    guess = n.groupBy("c_mktsegment").agg(F.max_by("o_orderpriority", F.struct("n", "o_orderpriority")).alias("guess"))
    joined = test.join(guess, "c_mktsegment")
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("o_orderpriority") == F.col("guess"), 1)).alias("correct")
    )
