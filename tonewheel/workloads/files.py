"""Sources under the oracle: files written from the tables, read back, and compared with SQL on the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewheel.operators import segments
from tonewheel.operators.skew import forward_fill
from tonewheel.plans import anomaly
from tonewheel.session import settle, shared_folder
from tonewheel.sources import files, store
from tonewheel.workloads import load, query
from tonewheel.workloads.scoring import r6
from tonewheel.workloads.signals import spread


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


_RATE = "CASE lang WHEN 'en' THEN 16000 WHEN 'de' THEN 48000 WHEN 'fr' THEN 0 END"
_WHY = "CASE WHEN n IS NULL THEN 'unknown length' WHEN n <= 0 THEN 'no samples' WHEN sr IS NULL THEN 'unknown rate' WHEN sr <= 0 THEN 'no rate' END"


@query("clip_rejects", f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 0 ELSE n_chars END AS n, {_RATE} AS sr FROM documents), w AS (SELECT *, {_WHY} AS reason FROM f)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS clips, min(doc_id) AS first_id FROM w GROUP BY 1""")
def clip_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Clips planned from header facts: those that can be cut, and all others with the reason."""
    rate = F.when(F.col("lang") == "en", 16000).when(F.col("lang") == "de", 48000).when(F.col("lang") == "fr", 0)
    frames = F.when(F.col("doc_id") % 50 == 7, 0).otherwise(F.col("n_chars"))
    kept, rejected = segments.split_empty(load(spark, sf, "documents").select("doc_id", frames.alias("num_frames"), rate.alias("sample_rate")))
    both = kept.withColumn("reason", F.lit("kept")).unionByName(rejected)
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("clips"), F.min("doc_id").alias("first_id"))


@query("csv_channels", """WITH e AS (SELECT user_id % 4 AS g, event_id, value, user_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS pos FROM events)
SELECT g, 'level' AS ch, 8000 AS sr, pos, round(value, 4) + 0.0 AS value FROM e WHERE g < 3
UNION ALL SELECT g, '2', 4000, pos, CAST(user_id AS DOUBLE) FROM e WHERE g > 0""")
def csv_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Four signal files in text, written from the events; their channels by name or place, one rate for each."""
    e = load(spark, sf, "events").select((F.col("user_id") % 4).alias("g"), "event_id", "value", "user_id")
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.format_string("%.4f", "value"), F.col("user_id").cast("string"))
    rows = e.select("g", F.lit(1).alias("o"), "event_id", line.alias("line"))
    head = spark.range(4).select(F.col("id").alias("g"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("event_id"), F.lit("id,level,who").alias("line"))
    path = scratch(spark)
    rows.unionByName(head).repartition(4, "g").sortWithinPartitions("g", "o", "event_id").select("g", "line").write.partitionBy("g").text(path)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    group = F.regexp_extract("path", "/g=([0-9]+)/", 1).cast("long")
    listed = there.select(files.local_path(F.col("path")).alias("path"), group.alias("g"))
    level = listed.where("g < 3").select("path", "g", F.lit("level").alias("ch"), F.lit(8000).alias("sr"))
    who = listed.where("g > 0").select("path", "g", F.lit("2").alias("ch"), F.lit(4000).alias("sr"))
    got = files.csv_channels(spark, path, level.unionByName(who))
    return got.select("g", "ch", "sr", "pos", (F.round("value", 4) + 0.0).alias("value"))


@query("wav_header_facts", """WITH f AS (SELECT event_id, 1 + event_id % 2 AS channels, [8000, 16000, 44100, 48000][event_id % 4 + 1] AS sample_rate, [8, 16, 24, 32][event_id // 4 % 4 + 1] AS bits, 44 + event_id * 10 AS length FROM events)
SELECT event_id, channels::INTEGER AS channels, sample_rate, (length - 44) // (channels * bits // 8) AS num_frames, ((length - 44) // (channels * bits // 8)) / sample_rate AS dur FROM f""")
def wav_header_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Rate, channels, frames and duration from 44 header bytes made from every event."""
    def little(c, size: int):
        return F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)])

    e = load(spark, sf, "events").select("event_id", (44 + F.col("event_id") * 10).alias("length"))
    rate = F.element_at(F.array(*[F.lit(r) for r in (8000, 16000, 44100, 48000)]), (F.col("event_id") % 4 + 1).cast("int"))
    bits = F.element_at(F.array(*[F.lit(b) for b in (8, 16, 24, 32)]), (F.floor(F.col("event_id") / 4) % 4 + 1).cast("int"))
    parts = F.concat(F.lit("00" * 22), little((1 + F.col("event_id") % 2).cast("int"), 2), little(rate, 4), F.lit("00" * 6), little(bits, 2), F.lit("00" * 8))
    facts = files.with_header_facts(e.withColumn("header", F.unhex(parts)))
    return facts.select("event_id", "channels", "sample_rate", "num_frames", "dur")


@query("shard_cache", """WITH p AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings)
SELECT pos * 8 // n AS shard, count(*) AS rows, min(vec_id) AS first_id, max(vec_id) AS last_id, sum(label) AS labels FROM p GROUP BY 1""")
def shard_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Eight shards of the vectors, written, checked against their manifest and read back."""
    e, path = load(spark, sf, "embeddings"), scratch(spark)
    store.write_shards(e, path, 8, "vec_id")
    store.read_shards(spark, path, 8, e.count())
    back = spark.read.parquet(path)
    return back.groupBy(F.col("shard").cast("long").alias("shard")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.sum("label").alias("labels"))


@query("vector_store", """SELECT vec_id, i - 1 AS i, round(CAST(embedding[i] AS DOUBLE), 6) + 0.0 AS v FROM embeddings, unnest(range(1, 65)) AS r(i)""")
def vector_store(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors by file name, written and read back; the second call finds them there."""
    e, path = load(spark, sf, "embeddings"), scratch(spark)
    named = e.select(F.col("vec_id").cast("string").alias("file"), F.col("embedding").alias("emb"))
    for _ in range(2):
        back = store.stored(spark, path, lambda: named)
    return spread(back.select(F.col("file").cast("long").alias("vec_id"), F.transform("emb", lambda v: v.cast("double")).alias("emb")), "vec_id", column="emb")


@query("forward_fill_null_group", """SELECT event_id, g, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY g ORDER BY event_id) AS last_error
FROM (SELECT event_id, event_type, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS g FROM events)""")
def forward_fill_null_group(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the rows has no group: they are one like the others; blocks of 64 places."""
    group = F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 3)
    ev = load(spark, sf, "events").select("event_id", "event_type", group.alias("g"))
    return forward_fill(ev, ["g"], "event_id", F.when(F.col("event_type") == "error", F.col("event_id")), "last_error", block=64).drop("event_type")


_COS = "1 - list_cosine_similarity(CAST(t.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[]))"


@query("fused_vectors_of_files", f"""WITH v AS (SELECT vec_id, vec_id // 4 AS file, label % 2 AS mt, CASE WHEN vec_id // 4 % 2 = 0 THEN 'train' ELSE 'test' END AS sett, vec_id // 8 % 2 AS domain, embedding FROM embeddings),
d AS (SELECT t.vec_id, t.file, t.mt, n.domain, min({_COS}) AS score FROM v t JOIN v n ON t.sett = 'test' AND n.sett = 'train' AND t.mt = n.mt GROUP BY ALL)
SELECT CAST(file AS VARCHAR) AS file, mt, round(min(score) FILTER (domain = 0), 6) + 0.0 AS score_sou, round(min(score) FILTER (domain = 1), 6) + 0.0 AS score_tar, round(min(score), 6) + 0.0 AS score FROM d GROUP BY vec_id, file, mt""")
def fused_vectors_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """Several vectors of a file under fused domains: each keeps a score of its own."""
    e = load(spark, sf, "embeddings")
    owner = F.floor(F.col("vec_id") / 4)
    rows = e.select(
        owner.cast("string").alias("file"), F.lit("dev").alias("setn"), (F.col("label") % 2).alias("mt"), F.lit(0).alias("sec"),
        (F.floor(F.col("vec_id") / 8) % 2).cast("int").alias("domain"), F.when(owner % 2 == 0, "train").otherwise("test").alias("sett"),
        F.col("embedding").alias("emb"), "vec_id",
    )
    # vectors of a file may differ in machine here, so a file's name takes the machine along
    named = settle(rows.withColumn("file", F.concat_ws("/", "file", "mt")))
    meta = named.select("file", "setn", "mt", "sec", "domain", "sett").distinct()
    got = anomaly.score(meta, named.select("file", "emb"), domains="min", normalise=False)
    return got.select(F.split("file", "/")[0].alias("file"), "mt", r6("score_sou").alias("score_sou"), r6("score_tar").alias("score_tar"), r6("score").alias("score"))
