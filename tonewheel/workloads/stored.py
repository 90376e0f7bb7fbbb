"""Stored blocks and the whole embedding job on ``events``: a user's events in time order are one signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewheel.functions.chain import Chain
from tonewheel.functions.spectral import FbankConfig
from tonewheel.operators import blocks
from tonewheel.operators.pooling import pool_vectors
from tonewheel.plans.embedding import block_vectors
from tonewheel.session import settle
from tonewheel.workloads import query
from tonewheel.workloads.scoring import r6
from tonewheel.workloads.signals import HOP, SAMPLES, WIN, WINDOWS, samples, spread

RATES = [1000, 2000, 1500, 3000]
TARGET = 1000


def stored_blocks(spark: SparkSession, sf: str, size: int) -> DataFrame:
    """Written once, as an archive of signals would be; one of four rates for each user."""
    rate = F.element_at(F.array(*[F.lit(r) for r in RATES]), (F.col("user_id") % 4 + 1).cast("int"))
    return settle(blocks.blocks_of_samples(samples(spark, sf), ["user_id"], rate, size=size))


@query("block_segment_stats", f"""WITH {WINDOWS} SELECT user_id, seg, off AS "offset", count(*) AS valid_len, round(sum(v * v), 6) + 0.0 AS energy, round(max(v), 6) + 0.0 AS top FROM c GROUP BY ALL""")
def block_segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of sixteen cut from blocks of ten, so that most take their samples from two or three."""
    w = blocks.windows_of_blocks(stored_blocks(spark, sf, 10), ["user_id"], WIN, HOP)
    w = w.withColumn("m", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")).withColumn("x", F.transform("x", lambda v: v - F.col("m")))
    energy = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    return w.select("user_id", "seg", "offset", F.size("x").cast("long").alias("valid_len"), r6(energy).alias("energy"), r6(F.array_max("x")).alias("top"))


# rates 2000 and 3000 lose samples; 1500 to 1000 goes through the filter, three samples to two
RESAMPLED = f"""{SAMPLES}, h AS (SELECT user_id, pos, value, n, CASE user_id % 4 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS step, user_id % 4 = 2 AS filtered FROM s),
o AS (SELECT user_id, j, n, CAST(ceil(n * 2 / 3.0) AS BIGINT) AS m FROM (SELECT DISTINCT user_id, n FROM h WHERE filtered), unnest(range(0, CAST(ceil(n * 2 / 3.0) AS BIGINT))) AS r(j)),
y AS (SELECT user_id, pos // step AS pos, value, CAST(ceil(n / CAST(step AS DOUBLE)) AS BIGINT) AS n FROM h WHERE NOT filtered AND pos % step = 0
  UNION ALL SELECT user_id, j, sum(CASE WHEN abs(x) >= 6 THEN 0 ELSE value * (CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x) / (pi() * x) END) * pow(cos(pi() * x / 12), 2) * 1.98 / 3 END), any_value(m)
  FROM (SELECT o.user_id, j, m, value, (pos / 3.0 - j / 2.0) * 1.98 AS x FROM o JOIN h ON o.user_id = h.user_id AND pos BETWEEN j * 3 // 2 - 12 AND j * 3 // 2 + 12) GROUP BY user_id, j)"""


@query("block_resample", f"""WITH {RESAMPLED} SELECT user_id, pos, n, round(value, 6) + 0.0 AS v FROM y""")
def block_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Every signal at one rate, from blocks of 32: decimated where its rate divides, filtered where not."""
    made = blocks.resampled_blocks(stored_blocks(spark, sf, 32), ["user_id"], TARGET, decimate=True)
    rows = made.select("user_id", "start", "n", F.posexplode("x").alias("i", "v"))
    return rows.select("user_id", (F.col("start") + F.col("i")).alias("pos"), "n", r6("v").alias("v"))


_EDGE = "(2595 * log10(1 + 500 / 700.0) * j / 5)"
JOB = f"""WITH {RESAMPLED}, u AS (SELECT DISTINCT user_id, n FROM y),
w0 AS (SELECT user_id, n, i AS seg, i * {HOP} AS off FROM u, unnest(range(0, greatest(CAST(floor((n - {WIN}) / {HOP}.0) AS BIGINT), 0) + 1)) AS r(i)
  UNION ALL SELECT user_id, n, CAST(floor((n - {WIN}) / {HOP}.0) AS BIGINT) + 1, n - {WIN} FROM u WHERE n > {WIN} AND (floor((n - {WIN}) / {HOP}.0) + 1) * {HOP} + 0.05 * {WIN} <= n),
c AS (SELECT w0.user_id, seg, pos - off AS i, value - avg(value) OVER (PARTITION BY w0.user_id, seg) AS v FROM w0 JOIN y ON w0.user_id = y.user_id AND pos >= off AND pos < off + {WIN}),
fr AS (SELECT user_id, seg, t, i - t * 4 AS j, v FROM c, unnest(range(0, 3)) AS a(t) WHERE i - t * 4 BETWEEN 0 AND 7),
d AS (SELECT g.user_id, g.seg, t, k, coalesce(sum(v * (0.5 - 0.5 * cos(2 * pi() * j / 8)) * cos(2 * pi() * k * j / 8)), 0) AS re, coalesce(sum(v * (0.5 - 0.5 * cos(2 * pi() * j / 8)) * sin(2 * pi() * k * j / 8)), 0) AS im
  FROM (SELECT DISTINCT user_id, seg FROM c) g JOIN unnest(range(0, 3)) AS a(t) ON true JOIN unnest(range(0, 5)) AS q(k) ON true LEFT JOIN fr USING (user_id, seg, t) GROUP BY ALL),
e AS (SELECT j, 700 * (pow(10, {_EDGE} / 2595) - 1) AS x FROM unnest(range(0, 6)) AS r(j)),
bank AS (SELECT b, k, greatest(0, least((k * 125.0 - l.x) / (m.x - l.x), (r.x - k * 125.0) / (r.x - m.x))) AS w FROM unnest(range(0, 4)) AS q(b) JOIN e l ON l.j = b JOIN e m ON m.j = b + 1 JOIN e r ON r.j = b + 2, unnest(range(0, 5)) AS z(k)),
mel AS (SELECT user_id, seg, t, b, 10 * log10(greatest(sum((re * re + im * im) * w), 1e-10)) AS v FROM d JOIN bank USING (k) GROUP BY ALL),
nm AS (SELECT user_id, seg, t, b, (v - avg(v) OVER p) / (stddev_samp(v) OVER p + 1e-10) AS v FROM mel WINDOW p AS (PARTITION BY user_id, seg, b)),
four AS (SELECT user_id, seg, b, v FROM nm UNION ALL SELECT DISTINCT user_id, seg, b, 0.0 FROM nm),
st AS (SELECT user_id, seg, b, avg(v) AS a0, stddev_pop(v) AS a1, min(v) AS a2, max(v) AS a3 FROM four GROUP BY ALL),
emb AS (SELECT user_id, seg, b // 2 * 8 + s * 2 + b % 2 AS i, [a0, a1, a2, a3][s + 1] AS v FROM st, unnest(range(0, 4)) AS q(s))
SELECT user_id, i, round(avg(v), 6) + 0.0 AS v FROM emb GROUP BY ALL"""


@query("embedding_job", JOB)
def embedding_job(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of four rates to one vector a user: decimate or filter, cut, centre, pad, three frames of four mel bands,
    normalise each band over time, fill to four frames, encode two bands at a time, join, pool by mean."""
    mel = FbankConfig(sample_rate=TARGET, frame_length=8, frame_shift=4, impl="torchaudio", num_mel_bins=4, center=False)
    chain = Chain(WIN, feature=mel, norm="temporal", frames=4, band=2, encoder="frame_statistics")
    vectors = block_vectors(stored_blocks(spark, sf, 32), ["user_id"], chain, HOP, (TARGET,), decimate=True)
    pooled = pool_vectors(vectors.select("user_id", "emb"), ["user_id"], "mean", dim=16)
    return spread(pooled, "user_id", column="emb")
