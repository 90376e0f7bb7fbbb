"""Anomaly scores and ROC metrics on ``embeddings``, ``events``, ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewheel.operators import knn
from tonewheel.operators.features import group_pca
from tonewheel.operators.metrics import median_decision, score_histogram
from tonewheel.operators.roc import roc_by_group, roc_points
from tonewheel.plans import anomaly
from tonewheel.session import settle
from tonewheel.sources.reports import submission_rows
from tonewheel.workloads import load, query


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, r6(c))
    return df


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``file, emb, label`` plus metadata derived from the label and hash digits of the id."""
    h = F.md5(F.col("vec_id").cast("string"))

    def low(i: int) -> Column:
        return F.substring(h, i, 1) < "8"

    status = (F.col("label") >= 8).cast("int")
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("file"), F.col("embedding").alias("emb"), "label",
        status.alias("status"),
        F.when((status == 0) & low(1), "train").otherwise("test").alias("sett"),
        F.when(low(2), "dev").otherwise("eval").alias("setn"),
        F.when(low(3), 0).otherwise(1).alias("domain"),
        F.when(low(4), 0).otherwise(1).alias("sec"),
        F.concat(F.lit("mt"), F.col("label") % 2).alias("mt"),
    )


VEC = """e AS (SELECT vec_id AS file, CAST(embedding AS DOUBLE[]) AS emb, label,
  CAST(label >= 8 AS INTEGER) AS status,
  CASE WHEN label < 8 AND substr(md5(CAST(vec_id AS VARCHAR)),1,1) < '8' THEN 'train' ELSE 'test' END AS sett,
  CASE WHEN substr(md5(CAST(vec_id AS VARCHAR)),2,1) < '8' THEN 'dev' ELSE 'eval' END AS setn,
  CASE WHEN substr(md5(CAST(vec_id AS VARCHAR)),3,1) < '8' THEN 0 ELSE 1 END AS domain,
  CASE WHEN substr(md5(CAST(vec_id AS VARCHAR)),4,1) < '8' THEN 0 ELSE 1 END AS sec,
  'mt' || CAST(label % 2 AS VARCHAR) AS mt FROM embeddings)"""


def knn_sql(name: str, on: str, extra_on: str = "", k: int = 1, test: str = "t.sett = 'test'") -> str:
    """CTE of the k nearest train rows per test row: pairs, then rank."""
    same = " AND ".join(f"t.{c} = n.{c}" for c in on.split(",") if c) or "true"
    return f"""{name}_p AS (SELECT t.file, n.file AS neighbour, n.label AS nlabel, n.domain AS ndom,
    greatest(1 - list_cosine_similarity(t.emb, n.emb), 0.0) AS dist
  FROM e t JOIN e n ON {same} AND n.sett = 'train' AND {test} {extra_on}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(dist, 9), neighbour) AS rank FROM {name}_p) WHERE rank <= {k})"""


def roc_sql(name: str, source: str, keys: str, f: float = 0.1) -> str:
    """CTE with ``auc`` and ``pauc`` per key; ``source`` needs the keys, ``y`` and ``score``."""
    low = 0.5 * f * f
    return f"""{name}_f AS (SELECT {keys}, score, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS p,
    CAST(sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS q FROM {source} WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY {keys}, score),
{name}_c AS (SELECT *, sum(p) OVER (PARTITION BY {keys} ORDER BY score DESC) AS tp, sum(q) OVER (PARTITION BY {keys} ORDER BY score DESC) AS fp,
    sum(p) OVER (PARTITION BY {keys}) AS pa, sum(q) OVER (PARTITION BY {keys}) AS qa FROM {name}_f),
{name} AS (SELECT {keys},
    CASE WHEN max(pa) > 0 AND max(qa) > 0 THEN sum(q * (tp - p + p / 2)) / (max(pa) * max(qa)) END AS auc,
    CASE WHEN max(pa) > 0 AND max(qa) > 0 THEN 0.5 * (1 + (sum(CASE WHEN fp - q >= {f} * qa THEN 0
        WHEN fp <= {f} * qa THEN q * (tp - p + p / 2)
        ELSE ({f} * qa - (fp - q)) * (tp - p + p * ({f} * qa - (fp - q)) / q / 2) END) / (max(pa) * max(qa)) - {low}) / ({f} - {low})) END AS pauc
  FROM {name}_c GROUP BY {keys})"""


def z_sql(value: str, over: str) -> str:
    return f"({value} - avg({value}) OVER ({over})) / nullif(stddev_pop({value}) OVER ({over}), 0)"


KEYS = ["setn", "mt", "sec"]


@query("knn_anomaly_score", f"""WITH {VEC}, {knn_sql('h', 'setn,mt,sec')}
SELECT e.setn, e.mt, e.sec, e.file, e.status, round({z_sql('h.dist', 'PARTITION BY e.setn, e.mt, e.sec')}, 6) + 0.0 AS score
FROM h JOIN e USING (file)""")
def knn_anomaly_score(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    raw = knn.anomaly_scores(v.where("sett = 'test'"), v.where("sett = 'train'"), KEYS, carry=["status"])
    return rounded(knn.znorm(settle(raw), KEYS), "score")


@query("knn_mean_of_k", f"""WITH {VEC}, {knn_sql('h', 'setn,mt', k=5)}
SELECT e.setn, e.mt, e.file, round(avg(h.dist), 6) + 0.0 AS score FROM h JOIN e USING (file) GROUP BY ALL""")
def knn_mean_of_k(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return rounded(knn.anomaly_scores(v.where("sett = 'test'"), v.where("sett = 'train'"), ["setn", "mt"], k=5), "score")


@query("knn_train_score", f"""WITH {VEC}, {knn_sql('h', 'setn,mt,sec', k=2, test="t.sett = 'train'")}
SELECT e.setn, e.mt, e.sec, e.file, round(avg(h.dist), 6) + 0.0 AS score FROM h JOIN e USING (file) GROUP BY ALL""")
def knn_train_score(spark: SparkSession, sf: str) -> DataFrame:
    train = vectors(spark, sf).where("sett = 'train'")
    return rounded(knn.anomaly_scores(train, train, KEYS, k=2), "score")


@query("knn_euclidean", f"""WITH {VEC}, p AS (SELECT t.file, t.mt, n.file AS neighbour, list_distance(t.emb, n.emb) AS dist FROM e t JOIN e n ON t.mt = n.mt AND t.sett = 'test' AND n.sett = 'train')
SELECT mt, file, neighbour, CAST(rank AS INTEGER) AS rank, round(dist, 6) + 0.0 AS dist FROM (SELECT *, row_number() OVER (PARTITION BY mt, file ORDER BY round(dist, 9), neighbour) AS rank FROM p) WHERE rank <= 3""")
def knn_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return rounded(knn.knn_join(v.where("sett = 'test'"), v.where("sett = 'train'"), ["mt"], 3, "euclidean"), "dist")


FUSED = f"""{VEC}, {knn_sql('h0', 'setn,mt,sec', 'AND n.domain = 0')}, {knn_sql('h1', 'setn,mt,sec', 'AND n.domain = 1')},
z0 AS (SELECT e.*, {z_sql('h0.dist', 'PARTITION BY e.setn, e.mt, e.sec')} AS s FROM h0 JOIN e USING (file)),
z1 AS (SELECT e.*, {z_sql('h1.dist', 'PARTITION BY e.setn, e.mt, e.sec')} AS s FROM h1 JOIN e USING (file)),
fused AS (SELECT e.*, z0.s AS score_sou, z1.s AS score_tar, least(z0.s, z1.s) AS score, e.status AS y
  FROM e LEFT JOIN z0 ON e.file = z0.file LEFT JOIN z1 ON e.file = z1.file WHERE e.sett = 'test' AND (z0.file IS NOT NULL OR z1.file IS NOT NULL))"""


def fused(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return anomaly.score(v.drop("emb", "label"), v, domains="min")


@query("knn_min_fusion", f"""WITH {FUSED} SELECT setn, mt, sec, file, domain, status, round(score_sou, 6) + 0.0 AS score_sou,
round(score_tar, 6) + 0.0 AS score_tar, round(score, 6) + 0.0 AS score FROM fused""")
def knn_min_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fused(spark, sf), "score_sou", "score_tar", "score").drop("detector", "sett")


def hmean_sql(*c: str) -> str:
    return f"(CASE WHEN least({', '.join(c)}) = 0 THEN 0 ELSE {len(c)} / ({' + '.join(f'1 / nullif({x}, 0)' for x in c)}) END)"


def hmean_agg(c: str) -> str:
    return f"(CASE WHEN min({c}) = 0 THEN 0 ELSE count({c}) / sum(1 / nullif({c}, 0)) END)"


def subsets_sql(source: str, with_shared: bool) -> str:
    if not with_shared:
        return f"tagged AS (SELECT *, CASE WHEN domain = 0 THEN 'sou' ELSE 'tar' END AS tag FROM {source})"
    return f"""tagged AS (SELECT *, 'all' AS tag FROM {source}
    UNION ALL SELECT *, 'sou' AS tag FROM {source} WHERE domain = 0 OR y = 1
    UNION ALL SELECT *, 'tar' AS tag FROM {source} WHERE domain = 1 OR y = 1
    UNION ALL SELECT *, 'dom_sou' AS tag FROM {source} WHERE domain = 0
    UNION ALL SELECT *, 'dom_tar' AS tag FROM {source} WHERE domain = 1)"""


def report_sql(ctes: str, source: str, year: int) -> str:
    """The yearly report in plain SQL: sections, machines, subsets, total."""
    keys = "setn, mt, sec"

    def tag(t: str, m: str) -> str:
        return f"max(CASE WHEN tag = '{t}' THEN {m} * 100 END)"

    if year == 20:
        sec = f"{roc_sql('r', source, keys)}, s AS (SELECT {keys}, auc * 100 AS auc, pauc * 100 AS pauc, (auc * 100 + pauc * 100) / 2 AS mean FROM r)"
        metrics, last = ["auc", "pauc", "mean"], "mean"
    elif year == 21:
        sec = f"""{subsets_sql(source, False)}, {roc_sql('r', 'tagged', keys + ', tag')}, s0 AS (SELECT {keys}, {tag('sou', 'auc')} AS auc_s, {tag('sou', 'pauc')} AS pauc_s,
          {tag('tar', 'auc')} AS auc_t, {tag('tar', 'pauc')} AS pauc_t FROM r GROUP BY {keys}), s AS (SELECT *, {hmean_sql('auc_s', 'pauc_s', 'auc_t', 'pauc_t')} AS hmean FROM s0)"""
        metrics, last = ["auc_s", "pauc_s", "auc_t", "pauc_t", "hmean"], "hmean"
    else:
        sec = f"""{subsets_sql(source, True)}, {roc_sql('r', 'tagged', keys + ', tag')}, s0 AS (SELECT {keys}, {tag('sou', 'auc')} AS auc_s, {tag('tar', 'auc')} AS auc_t,
          {tag('all', 'pauc')} AS pauc, {tag('dom_sou', 'auc')} AS auc_dom_s, {tag('dom_tar', 'auc')} AS auc_dom_t FROM r GROUP BY {keys}),
          s AS (SELECT *, {hmean_sql('auc_s', 'auc_t', 'pauc')} AS hmean FROM s0)"""
        metrics, last = ["auc_s", "auc_t", "pauc", "auc_dom_s", "auc_dom_t", "hmean"], "hmean"
    fold = (lambda c: f"avg({c})") if year == 20 else hmean_agg
    m = "m AS (SELECT setn, mt, " + ", ".join(f"round_even({fold(x)}, 2) AS {x}" for x in metrics) + " FROM s GROUP BY setn, mt)"
    sub = (
        f"sub AS (SELECT setn, round_even({hmean_agg('hmean')}, 2) AS value FROM s GROUP BY setn)"
        if year >= 23 else f"sub AS (SELECT setn, {fold(last)} AS value FROM m GROUP BY setn)"
    )
    parts = [f"SELECT 'section' AS level, setn, mt, sec, '{x}' AS metric, round_even({x}, 2) AS value FROM s" for x in metrics]
    parts += [f"SELECT 'machine', setn, mt, NULL, '{x}', {x} FROM m" for x in metrics]
    parts += [f"SELECT 'subset', setn, NULL, NULL, '{last}', value FROM sub", f"SELECT 'total', NULL, NULL, NULL, '{last}', {fold('value')} FROM sub"]
    return f"WITH {ctes}, {sec}, {m}, {sub}, lines AS ({' UNION ALL '.join(parts)}) SELECT level, setn, mt, CAST(sec AS INTEGER) AS sec, metric, round(value, 6) AS value FROM lines"


@query("anomaly_report", report_sql(FUSED, "fused", 23))
def anomaly_report(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to the yearly report in one go: search, z-score, fusion, metrics, roll-up."""
    return rounded(anomaly.report(settle(fused(spark, sf)).drop("detector"), 23), "value")


def event_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scored test rows: an error is an anomaly, the value its score."""
    h = F.md5(F.col("event_id").cast("string"))
    return load(spark, sf, "events").select(
        F.when(F.substring(h, 1, 1) < "8", "dev").otherwise("eval").alias("setn"),
        F.concat(F.lit("mt"), F.col("user_id") % 7).alias("mt"),
        (F.col("user_id") % 3).cast("int").alias("sec"),
        F.when(F.substring(h, 2, 1) < "8", 0).otherwise(1).alias("domain"),
        (F.col("event_type") == "error").cast("int").alias("status"),
        F.col("value").alias("score"),
        "event_id", "user_id",
    )


EVENTS = """ev AS (SELECT CASE WHEN substr(md5(CAST(event_id AS VARCHAR)),1,1) < '8' THEN 'dev' ELSE 'eval' END AS setn,
  'mt' || CAST(user_id % 7 AS VARCHAR) AS mt, CAST(user_id % 3 AS INTEGER) AS sec,
  CASE WHEN substr(md5(CAST(event_id AS VARCHAR)),2,1) < '8' THEN 0 ELSE 1 END AS domain,
  CAST(event_type = 'error' AS INTEGER) AS y, value AS score, event_id, user_id FROM events)"""


def _year_report(year: int):
    @query(f"metric_report_20{year}", report_sql(EVENTS, "ev", year))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(anomaly.report(event_scores(spark, sf).drop("event_id", "user_id"), year), "value")

    return run


for _year in (20, 21, 22, 23):
    _year_report(_year)


@query("roc_auc_by_group", f"""WITH {EVENTS}, {roc_sql('r', 'ev', 'user_id')} SELECT user_id, round(auc, 6) AS auc, round(pauc, 6) AS pauc FROM r""")
def roc_auc_by_group(spark: SparkSession, sf: str) -> DataFrame:
    out = roc_by_group(event_scores(spark, sf), ["user_id"], F.col("status"), F.col("score"))
    return rounded(out, "auc", "pauc")


@query("roc_auc_global", f"""WITH {EVENTS}, o AS (SELECT 1 AS one, * FROM ev), {roc_sql('r', 'o', 'one', 0.25)} SELECT round(auc, 6) AS auc, round(pauc, 6) AS pauc FROM r""")
def roc_auc_global(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(roc_by_group(event_scores(spark, sf), [], F.col("status"), F.col("score"), 0.25), "auc", "pauc")


@query("domain_auc", f"""WITH {EVENTS}, {roc_sql('r', 'ev', 'mt, domain')} SELECT mt, domain, round(auc, 6) AS auc FROM r""")
def domain_auc(spark: SparkSession, sf: str) -> DataFrame:
    out = roc_by_group(event_scores(spark, sf), ["mt", "domain"], F.col("status"), F.col("score"))
    return rounded(out.drop("pauc"), "auc")


@query("roc_points", f"""WITH {EVENTS}, f AS (SELECT mt, score, sum(y) AS p, sum(1 - y) AS q FROM ev GROUP BY mt, score)
SELECT mt, score, round(sum(q) OVER (PARTITION BY mt ORDER BY score DESC) / sum(q) OVER (PARTITION BY mt), 6) AS fpr,
round(sum(p) OVER (PARTITION BY mt ORDER BY score DESC) / sum(p) OVER (PARTITION BY mt), 6) AS tpr FROM f""")
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(roc_points(event_scores(spark, sf), ["mt"], F.col("status"), F.col("score")), "fpr", "tpr")


@query("doc_quality_auc", f"""WITH d AS (SELECT lang, quality AS y, CAST(n_chars AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id)), {roc_sql('r', 'd', 'lang')}
SELECT lang, round(auc, 6) AS auc, round(pauc, 6) AS pauc FROM r""")
def doc_quality_auc(spark: SparkSession, sf: str) -> DataFrame:
    joined = load(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(load(spark, sf, "labels"), "doc_id")
    return rounded(roc_by_group(joined, ["lang"], F.col("quality"), F.col("n_chars")), "auc", "pauc")


@query("median_decision", """SELECT user_id, event_id, CAST(value > quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS INTEGER) AS decision FROM events""")
def median_of_user(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("score"))
    return median_decision(ev, ["user_id"]).drop("score")


@query("submission_rows", f"""WITH {FUSED} SELECT mt, sec, 'clip_' || CAST(file AS VARCHAR) || '.wav' AS name, round(score, 6) + 0.0 AS score,
CAST(score > quantile_cont(score, 0.5) OVER (PARTITION BY mt, sec) AS INTEGER) AS decision FROM fused""")
def submission(spark: SparkSession, sf: str) -> DataFrame:
    scores = settle(fused(spark, sf)).withColumn("file", F.concat(F.lit("data/"), "mt", F.lit("/clip_"), "file", F.lit(".wav")))
    return rounded(submission_rows(scores), "score")


@query("score_histogram", f"""WITH {EVENTS}, b AS (SELECT mt, y, score, min(score) OVER (PARTITION BY mt) AS lo, max(score) OVER (PARTITION BY mt) AS hi FROM ev)
SELECT mt, CAST(least(floor((score - lo) * 49 / nullif(hi - lo, 0)), 48) AS INTEGER) AS bin, count(*) FILTER (y = 0) AS normal, count(*) FILTER (y = 1) AS anomaly FROM b GROUP BY 1, 2""")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return score_histogram(event_scores(spark, sf), ["mt"])


@query("score_pool", """SELECT user_id, round(avg(value), 6) AS mean_score, min(value) AS min_score, max(value) AS max_score FROM events GROUP BY user_id""")
def score_pool(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events").select("user_id", F.col("value").alias("score"))
    out = None
    for how in ("mean", "min", "max"):
        one = knn.pool_scores(ev, ["user_id"], how).withColumnRenamed("score", f"{how}_score")
        out = one if out is None else out.join(one, "user_id")
    return rounded(out, "mean_score")


@query("multi_vector_scores", f"""WITH {VEC}, {knn_sql('h', 'mt')} SELECT mt, label, round(max(z), 6) + 0.0 AS score FROM (
SELECT e.mt, e.label, {z_sql('h.dist', 'PARTITION BY e.mt')} AS z FROM h JOIN e USING (file)) GROUP BY mt, label""")
def multi_vector_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One file with many vectors: the label stands for the file, its test vectors are pooled by max."""
    v = vectors(spark, sf).select("file", "emb", "label", "mt", "sett")
    raw = knn.anomaly_scores(v.where("sett = 'test'"), v.where("sett = 'train'"), ["mt"], carry=["label"])
    return rounded(knn.pool_scores(knn.znorm(settle(raw), ["mt"]), ["mt", "label"], "max"), "score")


@query("znorm_events", f"""SELECT event_id, round({z_sql('value', 'PARTITION BY user_id')}, 6) + 0.0 AS score FROM events""")
def znorm_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("score"))
    return rounded(knn.znorm(ev, ["user_id"]), "score").drop("user_id")


@query("group_pca")
def pca(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select("file", "emb", "mt", "sett")
    out = group_pca(v, v.where("sett = 'train'"), "mt", 8)
    return out.select("file", "mt", F.posexplode("emb").alias("pos", "v")).withColumn("v", r6("v"))


@query("section_coverage", f"""WITH {VEC} SELECT setn, label, count(*) AS n FROM e t WHERE sett = 'test' AND NOT EXISTS (SELECT 1 FROM e n WHERE n.sett = 'train' AND n.setn = t.setn AND n.label = t.label) GROUP BY ALL""")
def section_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Test groups no train row speaks for, with the number of rows they hold."""
    v = vectors(spark, sf)
    test = v.where("sett = 'test'")
    lost = anomaly.missing_groups(test, v.where("sett = 'train'"), ["setn", "label"])
    return test.groupBy("setn", "label").agg(F.count(F.lit(1)).alias("n")).join(lost, ["setn", "label"], "left_semi")


@query("vector_lookup", """SELECT d.lang, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""")
def vector_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("file"), "lang")
    stored = load(spark, sf, "labels").select(F.col("doc_id").alias("file"))
    lost = anomaly.missing_vectors(docs, stored).groupBy("lang").agg(F.count(F.lit(1)).alias("missing"))
    found = docs.join(stored, "file").groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
    return found.join(lost, "lang", "full").na.fill(0)


@query("scale_variants", f"""WITH {VEC}, {knn_sql('h', 'setn,mt')}, {knn_sql('g', 'mt')}
SELECT 'mt' AS scale, e.file, round({z_sql('h.dist', 'PARTITION BY e.setn, e.mt')}, 6) + 0.0 AS score FROM h JOIN e USING (file)
UNION ALL SELECT 'mt2set', e.file, round({z_sql('g.dist', 'PARTITION BY e.mt')}, 6) + 0.0 FROM g JOIN e USING (file)""")
def scale_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows scored per machine, and per machine over both subsets."""
    v = vectors(spark, sf)
    parts = [
        anomaly.score(v.drop("emb", "label"), v, scale=s).select(F.lit(s).alias("scale"), "file", "score") for s in ("mt", "mt2set")
    ]
    return rounded(parts[0].unionByName(parts[1]), "score")
