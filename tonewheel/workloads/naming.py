"""File-name facts, lists, manifests and links on names built from the tables' own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewheel.functions import names
from tonewheel.operators.skew import forward_fill
from tonewheel.plans import catalog
from tonewheel.sources import links, manifest, metadata
from tonewheel.workloads import load, query

# A wav name of the yearly layouts, from one event.
_NAME = """concat('section_0', cast(user_id % 3 as string), '_', case when event_id % 2 = 0 then 'source' else 'target' end,
 '_', case when event_id % 5 < 3 then 'train' else 'test' end, '_', case when event_type = 'error' then 'anomaly' else 'normal' end,
 '_', lpad(cast(event_id as string), 8, '0'), case when event_id % 4 = 0 then '' else concat('_vel_', cast(user_id as string), '_', event_type) end, '.wav')"""
NAME_SQL = _NAME.replace("as string", "AS VARCHAR")
_ROOT = "/data/x"


def named(spark: SparkSession, sf: str) -> DataFrame:
    """``event_id, path`` below a root, one folder per subset, machine and side."""
    ev = load(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr(_NAME).alias("name"))
    setn = F.when(F.col("event_id") % 7 < 4, "dev").otherwise("eval")
    sett = F.when(F.col("event_id") % 5 < 3, "train").otherwise("test")
    mt = F.concat(F.lit("m"), F.col("user_id") % 5)
    return ev.select("event_id", "event_type", "user_id", "name", F.concat(F.lit(_ROOT + "/"), setn, F.lit("_data/"), mt, F.lit("/"), sett, F.lit("/"), "name").alias("path"))


NAMED = f"""n AS (SELECT event_id, event_type, user_id, {NAME_SQL} AS name, CASE WHEN event_id % 7 < 4 THEN 'dev' ELSE 'eval' END AS setn,
 CASE WHEN event_id % 5 < 3 THEN 'train' ELSE 'test' END AS sett, 'm' || CAST(user_id % 5 AS VARCHAR) AS mt FROM events)"""
_FACTS = "CAST(user_id % 3 AS INTEGER) AS sec, CAST(event_id % 2 AS INTEGER) AS domain, CAST(event_type = 'error' AS INTEGER) AS status"
_TAIL = "'vel_' || CAST(user_id AS VARCHAR) || '_' || event_type"


def year_rows(df: DataFrame, dataset: str, name: str = "name") -> DataFrame:
    return names.derive(df, **names.yearly_layout(dataset, F.col(name)))


@query("names_by_id", """SELECT event_id, CAST(user_id % 8 AS INTEGER) AS sec, 0 AS domain, CAST(event_type = 'error' AS INTEGER) AS status, 'noAttribute_dcase20' AS attri FROM events""")
def names_by_id(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "anomaly").otherwise("normal")
    name = F.format_string("%s_id_%02d_%08d.wav", status, F.col("user_id") % 8, F.col("event_id"))
    return year_rows(load(spark, sf, "events").select("event_id", name.alias("name")), "dcase20").drop("name")


@query("names_optional_attributes", f"""WITH {NAMED} SELECT event_id, {_FACTS}, CASE WHEN event_id % 4 = 0 THEN 'noAttribute' ELSE {_TAIL} END || '_dcase21' AS attri FROM n""")
def names_optional(spark: SparkSession, sf: str) -> DataFrame:
    return year_rows(named(spark, sf).select("event_id", "name"), "dcase21").drop("name")


@query("names_attributes", f"""WITH {NAMED} SELECT event_id, {_FACTS}, CASE WHEN event_id % 4 = 0 THEN '' ELSE {_TAIL} END || '_dcase23' AS attri FROM n""")
def names_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return year_rows(named(spark, sf).select("event_id", "name"), "dcase23").drop("name")


@query("names_by_membership", f"""WITH {NAMED} SELECT event_id, {_FACTS}, CASE WHEN event_id % 4 = 0 THEN 'noAttribute' ELSE {_TAIL} END || '_dcase25' AS attri FROM n""")
def names_membership(spark: SparkSession, sf: str) -> DataFrame:
    return year_rows(named(spark, sf).select("event_id", "name"), "dcase25").drop("name")


@query("names_supplementary", """SELECT event_id, event_type AS type, 0 AS sec, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'car_A' || CAST(user_id AS VARCHAR) END || '_sup_dcase25' AS attri FROM events""")
def names_supplementary(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("_car_A"), "user_id"))
    name = F.concat(F.lit("section_00_"), "event_type", F.lit("_"), F.lpad(F.col("event_id").cast("string"), 6, "0"), extra, F.lit(".wav"))
    rows = load(spark, sf, "events").select("event_id", name.alias("name"))
    return names.derive(rows, **names.layout_supplementary(F.col("name"))).drop("name")


@query("names_compressed_air", """SELECT o_orderkey, o_orderpriority AS leak, 'n' || o_orderstatus AS noise, 's' || CAST(year(o_orderdate) AS VARCHAR) AS session, CAST(o_custkey % 9 AS VARCHAR) AS knob, CAST(o_orderkey % 4 AS VARCHAR) AS mic,
CASE WHEN o_orderkey % 3 = 0 THEN 'leak' ELSE 'noleak' END AS status, o_orderpriority || '_' || CASE WHEN o_orderkey % 3 = 0 THEN 'leak' ELSE 'noleak' END AS scene,
o_orderpriority || '/n' || o_orderstatus || '/s' || CAST(year(o_orderdate) AS VARCHAR) || '/' || CAST(o_custkey AS VARCHAR) || '_' || CASE WHEN o_orderkey % 3 = 0 THEN 'niO' ELSE 'iO' END || '_' || CAST(o_custkey % 9 AS VARCHAR) || '_' || CAST(o_orderkey % 4 AS VARCHAR) || '.wav' AS ori FROM orders""")
def names_compressed_air(spark: SparkSession, sf: str) -> DataFrame:
    path = F.expr("""concat('/d/', o_orderpriority, '/n', o_orderstatus, '/s', year(o_orderdate), '/', o_custkey, '_',
        case when o_orderkey % 3 = 0 then 'niO' else 'iO' end, '_', o_custkey % 9, '_', o_orderkey % 4, '_', o_orderkey, '.wav')""")
    rows = load(spark, sf, "orders").select("o_orderkey", path.alias("path"))
    return catalog.compressed_air(rows, "/d").drop("path", "file")


@query("names_engine", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'test' END AS sett, lower(o_orderstatus) AS scene FROM orders WHERE o_orderstatus <> 'P'""")
def names_engine(spark: SparkSession, sf: str) -> DataFrame:
    top = F.when(F.col("o_orderstatus") == "F", "train_cut").when(F.col("o_orderstatus") == "P", "notes").otherwise("test_cut")
    path = F.concat(F.lit("/d/"), top, F.lit("/engine1_"), F.lower("o_orderstatus"), F.lit("/pure_"), "o_orderkey", F.lit(".wav"))
    return catalog.engine(load(spark, sf, "orders").select("o_orderkey", path.alias("path")), "/d").drop("path", "file")


@query("fault_gearbox", """WITH c AS (SELECT *, ['broken', 'healthy', 'missing_tooth', 'root_crack', 'wear', 'other'][CAST(p_size % 6 AS INTEGER) + 1] AS k FROM part)
SELECT p_partkey, k AS scene, CASE WHEN k = 'healthy' THEN 'normal' ELSE 'anomaly' END AS status, k || '_' || replace(p_name, ' ', '-') || '.flac' AS ori FROM c WHERE k <> 'other' AND p_partkey % 11 <> 0""")
def fault_gearbox(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("element_at(array('broken', 'healthy', 'missing_tooth', 'root_crack', 'wear', 'other'), cast(p_size % 6 as int) + 1)")
    key = F.when(F.col("p_partkey") % 11 == 0, "keyphase").otherwise("ch1")
    path = F.concat(F.lit("/g/"), kind, F.lit("_"), F.regexp_replace("p_name", " ", "-"), F.lit("_"), key, F.lit("_"), "p_partkey", F.lit(".flac"))
    good, _ = catalog.fault_by_prefix(load(spark, sf, "part").select("p_partkey", path.alias("path")), "gearbox")
    return good.drop("path", "file")


@query("fault_prefix_rejects", """SELECT p_partkey, p_name || '_a_b.wav' AS file FROM part WHERE p_size % 4 = 3""")
def fault_prefix_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Names of no known class are set apart, whatever row came before them."""
    start = F.expr("element_at(array('NC', 'IF0.2', 'RF0.6', ''), cast(p_size % 4 as int) + 1)")
    path = F.concat(F.lit("/b/"), start, "p_name", F.lit("_a_b.wav"))
    _, bad = catalog.fault_by_prefix(load(spark, sf, "part").select("p_partkey", path.alias("path")), "bearing")
    return bad.select("p_partkey", "file")


@query("fault_substring", """SELECT p_partkey, ['normal', 'planetraywear', 'sunpitting'][CAST(p_size % 3 AS INTEGER) + 1] AS scene, CASE WHEN p_size % 3 = 0 THEN 'normal' ELSE 'anomaly' END AS status,
'r' || p_brand || ['normal', 'planetraywear', 'sunpitting'][CAST(p_size % 3 AS INTEGER) + 1] AS ori FROM part""")
def fault_substring(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("element_at(array('normal', 'planetraywear', 'sunpitting'), cast(p_size % 3 as int) + 1)")
    path = F.concat(F.lit("/p/r"), "p_brand", kind, F.lit("_1_"), "p_partkey", F.lit(".wav"))
    good, _ = catalog.fault_by_substring(load(spark, sf, "part").select("p_partkey", path.alias("path")))
    return good.drop("path", "file")


@query("fault_two_labels", """SELECT s_suppkey, 'G' || CAST(s_nationkey % 2 + 1 AS VARCHAR) AS scene_G, 'E' || lpad(CAST(s_suppkey % 11 * 2 AS VARCHAR), 2, '0') AS scene_E,
CASE WHEN s_nationkey % 2 = 0 AND s_suppkey % 11 = 0 THEN 'normal' ELSE 'anomaly' END AS status, 'x_G' || CAST(s_nationkey % 2 + 1 AS VARCHAR) || '-E' || lpad(CAST(s_suppkey % 11 * 2 AS VARCHAR), 2, '0') AS ori FROM supplier""")
def fault_two_labels(spark: SparkSession, sf: str) -> DataFrame:
    path = F.expr("concat('/u/x_G', s_nationkey % 2 + 1, '-E', lpad(cast(s_suppkey % 11 * 2 as string), 2, '0'), '_ch0_', s_suppkey, '.wav')")
    good, _ = catalog.eccentric_gear(load(spark, sf, "supplier").select("s_suppkey", path.alias("path")))
    return good.drop("path", "file")


@query("name_parts", """SELECT c_custkey, 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS stem, c_mktsegment || '/' || c_name || '.wav' AS rel, c_mktsegment || '/' || c_name || '.wav' AS tail FROM customer""")
def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/root/a/"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".wav"))
    c = load(spark, sf, "customer").select("c_custkey", path.alias("path"))
    return c.select("c_custkey", names.stem(F.col("path")).alias("stem"), names.relative_to(F.col("path"), "/root/a").alias("rel"), names.last_parts(F.col("path"), 2).alias("tail"))


@query("utf8_round_trip", """SELECT doc_id, text, strlen(text) AS bytes FROM documents""")
def utf8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts to bytes, zero-padded, and back."""
    d = load(spark, sf, "documents").select("doc_id", names.to_bytes(F.col("text")).alias("b"))
    padded = F.concat(F.col("b"), F.unhex(F.lit("000000")))
    return d.select("doc_id", names.from_bytes(padded).alias("text"), F.octet_length("b").cast("bigint").alias("bytes"))


@query("durations", """SELECT doc_id, n_chars / CAST(16000 AS DOUBLE) AS dur, round_even(n_chars / CAST(16000 AS DOUBLE), 1) AS dur_short FROM documents""")
def durations(spark: SparkSession, sf: str) -> DataFrame:
    rate = F.lit(16000)
    d = load(spark, sf, "documents")
    return d.select("doc_id", names.duration(F.col("n_chars"), rate).alias("dur"), names.duration(F.col("n_chars"), rate, 1).alias("dur_short"))


@query("conjunction", """SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS matched FROM lineitem GROUP BY ALL""")
def conjunction(spark: SparkSession, sf: str) -> DataFrame:
    hit = names.all_equal({"l_returnflag": "A", "l_linestatus": "F"})
    li = load(spark, sf, "lineitem").where(names.all_equal({}))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("matched"))


@query("path_conditions", f"""WITH {NAMED} SELECT event_id FROM n WHERE setn = 'dev' AND mt = 'm1' AND sett IN ('train', 'test') AND name NOT LIKE '%anomaly%'""")
def path_conditions(spark: SparkSession, sf: str) -> DataFrame:
    n = named(spark, sf)
    return n.where(names.path_holds(F.col("path"), ["dev_data", "/m1/"]) & names.kept_names(F.col("path"), [".wav"], ["anomaly"])).select("event_id")


@query("yearly_metadata", f"""WITH {NAMED}, t AS (SELECT mt, name, event_id FROM n WHERE setn = 'eval' AND sett = 'test' AND event_id % 10 <> 3)
SELECT n.event_id, n.setn, n.sett, n.mt, {_FACTS.replace('user_id', 'n.user_id').replace('event_id', 'n.event_id').replace('event_type', 'n.event_type')} FROM n LEFT JOIN t USING (event_id) WHERE NOT (n.setn = 'eval' AND n.sett = 'test') OR t.event_id IS NOT NULL""")
def yearly_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows to metadata; eval test names are hidden and come back from the truth list."""
    n = named(spark, sf)
    hidden = F.contains("path", F.lit("eval_data")) & F.contains("path", F.lit("/test/"))
    secret = F.concat(F.lit("clip_"), "event_id", F.lit(".wav"))
    truth = n.where(hidden & (F.col("event_id") % 10 != 3)).select(
        F.element_at(F.split("path", "/"), -3).alias("mt"), secret.alias("file"), F.col("name").alias("orig")
    )
    files = n.withColumn("path", F.when(hidden, F.concat(F.regexp_replace("path", "[^/]*$", ""), secret)).otherwise(F.col("path")))
    good, _ = catalog.yearly(files.select("event_id", "path"), _ROOT, "dcase23", truth)
    return good.select("event_id", "setn", "sett", "mt", "sec", "domain", "status")


@query("forward_fill", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last_user FROM conversations""")
def fill(spark: SparkSession, sf: str) -> DataFrame:
    conv = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    return forward_fill(conv, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "last_user").drop("role")


@query("truth_list", """WITH o AS (SELECT c_mktsegment AS mt, c_custkey FROM customer WHERE c_custkey % 20 <> 0)
SELECT mt, 'c' || CAST(c_custkey AS VARCHAR) || '.wav' AS file, 'section_00_' || CAST(c_custkey AS VARCHAR) || '.wav' AS orig FROM o""")
def truth_list(spark: SparkSession, sf: str) -> DataFrame:
    """A sectioned list made from the customers: a heading opens each segment's block, every twentieth row is malformed."""
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    order = F.dense_rank().over(Window.orderBy("c_mktsegment"))
    kinds = c.select("c_mktsegment").distinct().withColumn("block", order)
    rows = c.join(kinds, "c_mktsegment")
    text = F.when(F.col("c_custkey") % 20 == 0, F.concat_ws(",", "c_custkey", F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(
        F.concat(F.lit("c"), "c_custkey", F.lit(".wav,section_00_"), "c_custkey", F.lit(".wav"))
    )
    body = rows.select((F.col("block") * (1 << 40) + F.col("c_custkey") + 1).alias("line"), text.alias("value"))
    heads = kinds.select((F.col("block") * (1 << 40)).alias("line"), F.col("c_mktsegment").alias("value"))
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    good, _ = metadata.parse_truth(heads.unionByName(body).withColumn("path", F.lit("list")), "dcase23", segments)
    return good


MANIFEST = """CASE doc_id % 5 WHEN 0 THEN 'MD5 (d/' || CAST(doc_id AS VARCHAR) || '.txt) = ' || md5(text) WHEN 1 THEN '  ' || upper(md5(text)) || '  *d/' || CAST(doc_id AS VARCHAR) || '.txt '
 WHEN 2 THEN md5('other' || text) || ' d/' || CAST(doc_id AS VARCHAR) || '.txt' WHEN 3 THEN '# ' || CAST(doc_id AS VARCHAR) ELSE md5(text) || ' gone/' || CAST(doc_id AS VARCHAR) || '.txt' END"""


def manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.expr(MANIFEST.replace("AS VARCHAR", "AS STRING")).alias("value"))


@query("manifest_entries", """SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN upper(md5(text)) WHEN doc_id % 5 = 2 THEN md5('other' || text) ELSE md5(text) END AS checksum, CASE WHEN doc_id % 5 = 4 THEN 'gone/' ELSE 'd/' END || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents WHERE doc_id % 5 <> 3""")
def manifest_entries(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.parse_manifest(manifest_lines(spark, sf)).drop("value")


@query("integrity_audit", """SELECT CASE doc_id % 5 WHEN 2 THEN 'mismatch' WHEN 4 THEN 'missing' ELSE 'verified' END AS status, count(*) AS n FROM documents WHERE doc_id % 5 <> 3 GROUP BY 1""")
def integrity_audit(spark: SparkSession, sf: str) -> DataFrame:
    files = load(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("path"), F.md5("text").alias("actual"))
    return manifest.audit_summary(manifest.audit(manifest.parse_manifest(manifest_lines(spark, sf)), files))


@query("extract_links", r"""SELECT DISTINCT url AS page, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link, regexp_matches(lower(href), '\.(zip|rar|tar|gz|bz2|7z)$') AS archive
FROM (SELECT url, unnest(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1, 'is')) AS href FROM pages)""")
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of every page as absolute addresses."""
    found = links.page_links(load(spark, sf, "pages").select("url", "html"))
    return found.withColumn("archive", links.is_archive(F.col("link")))


@query("discover_files", """WITH RECURSIVE k AS (SELECT o_orderkey AS k FROM orders), r(k) AS (SELECT 1::BIGINT UNION SELECT c.k FROM r JOIN k c ON c.k // 16 = r.k AND c.k > 1)
SELECT 'http://store.example/o/' || CAST(k AS VARCHAR) || '.zip' AS link FROM r""")
def discover_files(spark: SparkSession, sf: str) -> DataFrame:
    """A site with one page per order, sixteen sub-pages each; all archives reachable from the first."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    children = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.concat(F.lit('<a class="d" href="../'), F.col("k") * 16 + i, F.lit('/">next</a>')))
    html = F.concat(F.lit('<html><a href="../'), "k", F.lit('.zip">file</a>'), F.array_join(children, ""), F.lit('<a href="mailto:x@example.com">x</a></html>'))
    pages = o.select(F.concat(F.lit("http://store.example/o/"), "k", F.lit("/")).alias("url"), html.alias("html"))
    start = pages.where(F.col("url") == "http://store.example/o/1/")
    return links.discover(pages, start, "http://store.example/o/")


@query("plan_reconcile", """WITH p AS (SELECT o_custkey AS c, 'u' || CAST(o_orderkey AS VARCHAR) AS url, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'not_started' END AS status, o_orderkey AS size FROM orders WHERE o_custkey % 3 <> 0)
SELECT CAST(c AS VARCHAR) AS dataset_name, url, status, size AS total_size FROM p WHERE status <> 'completed' UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'u' || CAST(o_orderkey AS VARCHAR), 'not_started', 0 FROM orders WHERE o_custkey % 3 = 0""")
def plan_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the customers are in the plan; the others are new."""
    o = load(spark, sf, "orders").withColumn("dataset_name", F.col("o_custkey").cast("string")).withColumn("url", F.concat(F.lit("u"), "o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("not_started")
    plan = o.where("o_custkey % 3 <> 0").select("dataset_name", "url", status.alias("status"), F.col("o_orderkey").alias("total_size"))
    return manifest.reconcile_plan(o.select("dataset_name", "url"), plan)
