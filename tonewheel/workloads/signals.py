"""Windows, channels, array work, pooling and spectra on ``events``, ``embeddings``, ``documents`` and ``lineitem``.

A user's events in time order are one signal. A user may own any share of the table, so a signal is
kept as one row per sample and only windows of bounded length become arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewheel.functions import arrays
from tonewheel.functions.spectral import FbankConfig, StftConfig
from tonewheel.operators import channels, features, pooling, segments
from tonewheel.operators.skew import positions
from tonewheel.workloads import load, query
from tonewheel.workloads.diagnosis import u_sql
from tonewheel.workloads.scoring import r6, rounded

WIN, HOP = 16, 8


def samples(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events").select("user_id", "event_id", F.col("ts").alias("t"), "value")
    return positions(ev, ["user_id"], ["t", "event_id"]).select("user_id", "pos", "pos_n", "value")


SAMPLES = """s AS (SELECT user_id, value, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
WINDOWS = f"""{SAMPLES}, u AS (SELECT DISTINCT user_id, n FROM s),
o AS (SELECT user_id, n, i AS seg, i * {HOP} AS off FROM u, unnest(range(0, greatest(CAST(floor((n - {WIN}) / {HOP}.0) AS BIGINT), 0) + 1)) AS r(i)
  UNION ALL SELECT user_id, n, CAST(floor((n - {WIN}) / {HOP}.0) AS BIGINT) + 1, n - {WIN} FROM u WHERE n > {WIN} AND (floor((n - {WIN}) / {HOP}.0) + 1) * {HOP} + 0.05 * {WIN} <= n),
w AS (SELECT o.user_id, seg, off, pos - off AS i, value AS v FROM o JOIN s ON o.user_id = s.user_id AND pos >= off AND pos < off + {WIN}),
c AS (SELECT user_id, seg, off, i, v - avg(v) OVER (PARTITION BY user_id, seg) AS v FROM w)"""


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """``(user_id, seg, offset, valid_len, x)``: centred, zero-padded windows."""
    members = segments.window_members(samples(spark, sf), WIN, HOP)
    cut = segments.collect_windows(members, ["user_id"], "value")
    x = arrays.centered(F.col("x"))
    return cut.withColumn("valid_len", arrays.valid_length(F.col("x"), WIN)).withColumn("x", arrays.padded(x, WIN))


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, *keys: str, column: str = "x", name: str = "v") -> DataFrame:
    """Array column to rows with 6 decimals, for comparison."""
    return df.select(*keys, F.posexplode(column).alias("i", name)).withColumn(name, r6(name))


@query("segment_index", f"WITH {WINDOWS} SELECT user_id, seg, off AS \"offset\" FROM o")
def segment_index(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.segment_index(lengths(spark, sf), segments.sliding_offsets(F.col("n"), WIN, HOP))
    return out.select("user_id", F.col("seg").cast("bigint").alias("seg"), "offset")


@query("segment_stats", f"""WITH {WINDOWS} SELECT user_id, seg, count(*) AS valid_len, round(sum(v * v), 6) + 0.0 AS energy, round(max(v), 6) + 0.0 AS top FROM c GROUP BY user_id, seg""")
def segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    w = windows(spark, sf)
    valid = F.slice("x", F.lit(1), F.col("valid_len"))
    energy = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    return w.select("user_id", "seg", F.col("valid_len").cast("bigint").alias("valid_len"), r6(energy).alias("energy"), r6(F.array_max(valid)).alias("top"))


@query("chunk_half", f"""WITH {SAMPLES}, u AS (SELECT DISTINCT user_id, n FROM s), o AS (SELECT user_id, i AS seg, i * {WIN} AS off FROM u, unnest(range(0, n // {WIN})) AS r(i)
UNION ALL SELECT user_id, n // {WIN}, greatest(n - {WIN}, 0) FROM u WHERE n % {WIN} > {WIN} / 2.0)
SELECT o.user_id, seg, off AS "offset", count(*) AS n, round(sum(value), 6) AS total FROM o JOIN s ON o.user_id = s.user_id AND pos >= off AND pos < off + {WIN} GROUP BY ALL""")
def chunk_half(spark: SparkSession, sf: str) -> DataFrame:
    """Storage chunks of every signal; the rest only if it is above half a chunk."""
    members = segments.chunk_members(samples(spark, sf), WIN)
    return members.groupBy("user_id", "seg", "offset").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query("sequential_crops", f"""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), v AS (SELECT * FROM (VALUES (false, false), (true, false), (false, true)) AS t(pad, drop_)),
o AS (SELECT user_id, pad, drop_, i * 30 AS start FROM u JOIN v ON NOT (drop_ AND n < 24), unnest(range(0, n // 30)) AS r(i)
UNION ALL SELECT user_id, pad, drop_, n // 30 * 30 FROM u JOIN v ON NOT (drop_ AND n < 24) WHERE pad OR n // 30 = 0)
SELECT user_id, pad, drop_ AS "drop", start FROM o""")
def sequential_crops(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for pad, drop in ((False, False), (True, False), (False, True)):
        one = lengths(spark, sf).select(
            "user_id", F.lit(pad).alias("pad"), F.lit(drop).alias("drop"),
            F.explode(segments.sequential_crops(F.col("n"), 30, pad, drop)).alias("start"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("random_crops", f"""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, CAST(i AS INTEGER) AS seg, CAST(floor({u_sql("'3'", "CAST(user_id AS VARCHAR)", "CAST(i AS VARCHAR)")} * greatest(n - 12, 0)) AS BIGINT) AS "offset" FROM u, unnest(range(0, greatest(n // 12, 1))) AS r(i)""")
def random_crops(spark: SparkSession, sf: str) -> DataFrame:
    return segments.random_crops(lengths(spark, sf), ["user_id"], F.col("n"), 12, seed=3).drop("n")


@query("rescaled_segments", """WITH f AS (SELECT doc_id, n_chars AS n, CASE WHEN lang = 'en' THEN 16000 WHEN lang = 'de' THEN 48000 ELSE 0 END AS sr FROM documents),
g AS (SELECT doc_id, CAST(floor(24000.0 / sr * n) AS BIGINT) AS m FROM f WHERE sr > 0 AND n > 0)
SELECT doc_id, m AS frames, CASE WHEN m <= 800 THEN 1 ELSE (m - 800) // 400 + 1 + CASE WHEN ((m - 800) // 400 + 1) * 400 + 40 <= m THEN 1 ELSE 0 END END AS segs FROM g""")
def rescaled_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Windows planned from header facts alone: empty clips skipped, frame counts rescaled."""
    rate = F.when(F.col("lang") == "en", 16000).when(F.col("lang") == "de", 48000).otherwise(0)
    clips = load(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("num_frames"), rate.alias("sample_rate"))
    used = segments.without_empty(clips)
    m = segments.rescaled_frames(F.col("num_frames"), F.col("sample_rate"), 24000)
    counted = used.select("doc_id", m.alias("frames"))
    return counted.withColumn("segs", F.size(segments.sliding_offsets(F.col("frames"), 800, 400)).cast("bigint"))


@query("cycle_pad", """SELECT vec_id, i, round(CAST(embedding[i % 64 + 1] AS DOUBLE), 6) + 0.0 AS v FROM embeddings, unnest(range(0, 100)) AS r(i)""")
def cycle_pad(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return spread(e.withColumn("x", arrays.cycled(F.col("x"), 100)), "vec_id")


@query("channel_unpivot", """SELECT l_orderkey, l_linenumber, channel, v FROM (SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS channel, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem)""")
def channel_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return channels.unpivot_channels(li, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("channel_renumber", """SELECT event_id, 7 - CAST(user_id % 8 AS INTEGER) AS channel FROM events""")
def channel_renumber(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events")
    return ev.select("event_id", channels.renumbered((F.col("user_id") % 8).cast("int")).alias("channel"))


@query("mono_mixdown", """SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3, 6) AS v FROM lineitem""")
def mono_mixdown(spark: SparkSession, sf: str) -> DataFrame:
    """Three channels of one sample each, averaged inside the row."""
    li = load(spark, sf, "lineitem")
    stacked = F.array(F.array("l_quantity"), F.array("l_discount"), F.array("l_tax"))
    return li.select("l_orderkey", "l_linenumber", r6(arrays.mono(stacked)[0]).alias("v"))


@query("mixdown_by_time", """SELECT ts_hour, round(avg(value), 6) AS v FROM (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS ts_hour, value FROM events) GROUP BY 1""")
def mixdown_by_time(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events").select(F.unix_seconds(F.date_trunc("hour", "ts")).alias("ts_hour"), F.col("value").alias("v"))
    return rounded(channels.mixdown(ev, ["ts_hour"]), "v")


@query("peak_normalize", """WITH e AS (SELECT * FROM events WHERE event_type IN ('error', 'click', 'view')), p AS (SELECT max(abs(value)) AS m FROM e)
SELECT event_id, event_type, round(CASE WHEN m > 1 THEN value / m ELSE value END, 6) AS v FROM e, p""")
def peak_normalize(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events").select("event_id", "event_type", F.col("value").alias("v"))
    return rounded(channels.peak_normalised(ev, "v", "event_type", ["error", "click", "view"]), "v")


@query("peak_normalize_arrays", """WITH p AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE) * 20)))) AS m FROM embeddings)
SELECT vec_id, i - 1 AS i, round(CASE WHEN m > 1 THEN CAST(embedding[i] AS DOUBLE) * 20 / m ELSE CAST(embedding[i] AS DOUBLE) * 20 END, 6) + 0.0 AS v FROM embeddings, p, unnest(range(1, 65)) AS r(i)""")
def peak_normalize_arrays(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 20).alias("x"))
    return spread(channels.peak_normalised_arrays(e), "vec_id")


@query("decimate", """SELECT vec_id, i // 4 AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, unnest(range(0, 64, 4)) AS r(i)""")
def decimate(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select("vec_id", arrays.decimated(F.transform("embedding", lambda v: v.cast("double")), 64000, 16000).alias("x"))
    return e.select("vec_id", F.posexplode("x").alias("i", "v"))


@query("gain", f"""SELECT vec_id, i - 1 AS i, round(CAST(embedding[i] AS DOUBLE) * pow(10, (-6 + 16 * ({u_sql("'9'", "CAST(vec_id AS VARCHAR)")})) / 20), 6) + 0.0 AS v FROM embeddings, unnest(range(1, 65)) AS r(i)""")
def gain(spark: SparkSession, sf: str) -> DataFrame:
    """A gain between -6 and 10 dB, drawn per row by its id."""
    decibel = F.lit(-6.0) + 16 * arrays.hash_uniform(F.lit(9), F.col("vec_id"))
    e = load(spark, sf, "embeddings").select("vec_id", arrays.gained(F.transform("embedding", lambda v: v.cast("double")), decibel).alias("x"))
    return spread(e, "vec_id")


@query("l2_norm", """SELECT vec_id, i - 1 AS i, round(CAST(embedding[i] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) + 0.0 AS v FROM embeddings, unnest(range(1, 65)) AS r(i)""")
def l2_norm(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "embeddings").select("vec_id", arrays.unit(F.col("embedding")).alias("x")), "vec_id")


@query("cosine_from_squared", """WITH c AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), f AS (SELECT label, arg_min(x, vec_id) AS y FROM c GROUP BY label)
SELECT vec_id, round(1 - pow(list_distance(x, y), 2) / 2, 6) + 0.0 AS sim FROM c JOIN f USING (label)""")
def cosine_from_squared(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector against the first of its label."""
    e = load(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("y"))
    d = arrays.squared_distance(F.col("embedding"), F.col("y"))
    return e.join(first, "label").select("vec_id", r6(arrays.cosine_from_squared(d)).alias("sim"))


@query("softmax", """SELECT vec_id, i - 1 AS i, round(exp(CAST(embedding[i] AS DOUBLE)) / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))), 6) AS v FROM embeddings, unnest(range(1, 65)) AS r(i)""")
def softmax(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return spread(load(spark, sf, "embeddings").select("vec_id", arrays.softmax(x).alias("x")), "vec_id")


@query("band_split", """WITH b AS (SELECT vec_id, b, list_sum(list_transform(embedding[b * 10 + 1 : b * 10 + 10], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS e, max(list_max(embedding[b * 10 + 1 : b * 10 + 10])) OVER (PARTITION BY vec_id, b) AS m FROM embeddings, unnest(range(0, 6)) AS r(b))
SELECT vec_id, 2 * b + j AS i, round(CASE WHEN j = 0 THEN e ELSE CAST(m AS DOUBLE) END, 6) + 0.0 AS v FROM b, unnest([0, 1]) AS q(j)""")
def band_split(spark: SparkSession, sf: str) -> DataFrame:
    """Six bands of ten, a two-number vector per band, joined again in band order; four values are left over."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    per_band = F.transform(arrays.bands(x, 10), lambda b: F.array(F.aggregate(b, F.lit(0.0), lambda a, v: a + v * v), F.array_max(b)))
    return spread(load(spark, sf, "embeddings").select("vec_id", arrays.rejoined(per_band).alias("x")), "vec_id")


@query("standardise_vector", """WITH x AS (SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) AS r(i))
SELECT vec_id, i, round((v - avg(v) OVER w) / (stddev_samp(v) OVER w * 2 + 1e-10), 6) + 0.0 AS own, round((v - 0.01) / (0.5 * 2), 6) + 0.0 AS given FROM x WINDOW w AS (PARTITION BY vec_id)""")
def standardise_vector(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    both = F.arrays_zip(arrays.standardised(x, coeff=2.0).alias("own"), arrays.standardised(x, 0.01, 0.5, 2.0).alias("given"))
    e = load(spark, sf, "embeddings").select("vec_id", F.posexplode(both).alias("i", "p"))
    return e.select("vec_id", "i", r6("p.own").alias("own"), r6("p.given").alias("given"))


def matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as eight frames of eight bands."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return load(spark, sf, "embeddings").select("vec_id", arrays.bands(x, 8).alias("m"))


MATRIX = "x AS (SELECT vec_id, (i - 1) // 8 AS t, (i - 1) % 8 AS f, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) AS r(i))"


def matrix_rows(df: DataFrame, column: str = "m") -> DataFrame:
    rows = df.select("vec_id", F.posexplode(column).alias("t", "_r"))
    return rows.select("vec_id", "t", F.posexplode("_r").alias("f", "v")).withColumn("v", r6("v"))


@query("standardise_per_band", f"""WITH {MATRIX} SELECT vec_id, t, f, round((v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-10), 6) + 0.0 AS v FROM x WINDOW w AS (PARTITION BY vec_id, f)""")
def standardise_per_band(spark: SparkSession, sf: str) -> DataFrame:
    return matrix_rows(matrices(spark, sf).withColumn("m", arrays.standardised_matrix(F.col("m"), True)))


@query("standardise_matrix", f"""WITH {MATRIX} SELECT vec_id, t, f, round((v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-10), 6) + 0.0 AS v FROM x WINDOW w AS (PARTITION BY vec_id)""")
def standardise_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrix_rows(matrices(spark, sf).withColumn("m", arrays.standardised_matrix(F.col("m"), False)))


@query("fixed_frames", f"""WITH {MATRIX} SELECT vec_id, t, f, round(CASE WHEN t < 8 AND f < 8 THEN CAST(embedding[t * 8 + f + 1] AS DOUBLE) ELSE 0 END, 6) + 0.0 AS v
FROM embeddings, unnest(range(0, 10)) AS a(t), unnest(range(0, 9)) AS b(f)""")
def fixed_frames(spark: SparkSession, sf: str) -> DataFrame:
    return matrix_rows(matrices(spark, sf).withColumn("m", arrays.fixed_frames(F.col("m"), 10, 9)))


@query("valid_frames", """SELECT doc_id, least((n_chars - 400) // 160 + 1, 500) AS frames FROM documents WHERE n_chars >= 400
UNION ALL SELECT doc_id, least(CAST(floor((n_chars - 400) / 160.0) AS BIGINT) + 1, 500) FROM documents WHERE n_chars < 400""")
def valid_frames(spark: SparkSession, sf: str) -> DataFrame:
    frames = arrays.valid_frames(F.col("n_chars"), 400, 160, F.lit(500).cast("bigint"))
    return load(spark, sf, "documents").select("doc_id", frames.alias("frames"))


_POOL_SQL = {
    "sum": ["sum(v)"], "mean": ["avg(v)"], "std": ["stddev_pop(v)"], "mean_std": ["avg(v)", "stddev_pop(v)"],
    "max": ["max(v)"], "min": ["min(v)"],
}


def _pool(how: str, folds: list[str]) -> None:
    parts = " UNION ALL ".join(
        f"SELECT label, i + {64 * j} AS i, round({f}, 6) + 0.0 AS v FROM x GROUP BY label, i" for j, f in enumerate(folds)
    )

    @query(f"vector_pool_{how}", f"WITH x AS (SELECT label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) AS r(i)) {parts}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = load(spark, sf, "embeddings").select("label", F.col("embedding").alias("emb"))
        return spread(pooling.pool_vectors(e, ["label"], how), "label", column="emb")


for _how, _folds in _POOL_SQL.items():
    _pool(_how, _folds)


@query("vector_pool_raw", """SELECT label, vec_id, i - 1 AS i, round(CAST(embedding[i] AS DOUBLE), 6) + 0.0 AS v FROM embeddings, unnest(range(1, 65)) AS r(i)""")
def pool_raw(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("emb"))
    return spread(pooling.pool_vectors(e, ["label"], "raw"), "label", "vec_id", column="emb")


@query("vector_pool_hard", """WITH a AS (SELECT label, list_position(embedding, list_max(embedding)) - 1 AS c FROM embeddings)
SELECT label, CAST(c AS DOUBLE) AS cls FROM (SELECT label, c, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, c) AS rn FROM a GROUP BY label, c) WHERE rn = 1""")
def pool_hard(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select("label", F.col("embedding").alias("emb"))
    return pooling.pool_vectors(e, ["label"], "hard").select("label", F.col("emb")[0].alias("cls"))


@query("vector_pool_soft", """WITH x AS (SELECT label, i - 1 AS i, sum(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY ALL)
SELECT label, CAST(arg_max(i, v) AS DOUBLE) AS cls FROM x GROUP BY label""")
def pool_soft(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select("label", F.col("embedding").alias("emb"))
    return pooling.pool_vectors(e, ["label"], "soft").select("label", F.col("emb")[0].alias("cls"))


FFT = 16
SPECTRUM = f"""{WINDOWS}, bins AS (SELECT unnest(range(0, {FFT // 2 + 1})) AS k),
m AS (SELECT user_id, seg, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / {FFT})) * cos(2 * pi() * k * i / {FFT})) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / {FFT})) * sin(2 * pi() * k * i / {FFT})) AS im FROM c JOIN bins ON true GROUP BY ALL)"""


@query("stft_magnitude", f"WITH {SPECTRUM} SELECT user_id, seg, k AS i, round(sqrt(re * re + im * im), 6) + 0.0 AS v FROM m")
def stft_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    """One frame per window, so that the spectrum can be written out as sums."""
    conf = StftConfig(sample_rate=1000, frame_length=FFT, frame_shift=HOP, log=False)
    w = features.with_stft(windows(spark, sf).select("user_id", "seg", "x"), conf)
    return spread(w.select("user_id", "seg", F.col("spec")[0].alias("x")), "user_id", "seg")


# every window in full, and its frames of eight samples, four apart; ``pad`` samples are reflected at both ends
FULL = f"""f AS (SELECT g.user_id, g.seg, i, coalesce(c.v, 0.0) AS v FROM (SELECT DISTINCT user_id, seg FROM c) g JOIN unnest(range(0, {WIN})) AS r(i) ON true LEFT JOIN c USING (user_id, seg, i))"""
HANN = "(0.5 - 0.5 * cos(2 * pi() * j / 8))"


def framed_sql(name: str, frames: int, pad: int) -> str:
    p = f"(t * 4 + j - {pad})"
    return f"""{name} AS (SELECT user_id, seg, t, j, v FROM f JOIN (SELECT t, j, CASE WHEN {p} < 0 THEN -{p} WHEN {p} > {WIN - 1} THEN {2 * WIN - 2} - {p} ELSE {p} END AS i FROM unnest(range(0, {frames})) AS a(t), unnest(range(0, 8)) AS b(j)) USING (i))"""


def dft_sql(name: str, source: str, taper: str) -> str:
    parts = ", ".join(f"sum(v * {taper} * {fn}(2 * pi() * k * j / 8)) AS {to}" for fn, to in (("cos", "re"), ("sin", "im")))
    return f"{name} AS (SELECT user_id, seg, t, k, {parts} FROM {source}, unnest(range(0, 5)) AS q(k) GROUP BY ALL)"


def bank_sql(name: str, to_mel: str, from_mel: str, low: float, high: float, in_mel: bool, area: bool) -> str:
    """Three triangles over five bins; ``to_mel`` and ``from_mel`` hold a ``?`` for the value."""
    at = to_mel.replace("?", "(k * 125.0)") if in_mel else "(k * 125.0)"
    edge, whole = "(lo + (hi - lo) * j / 4)", "(m.lo + (m.hi - m.lo) * {} / 4)"
    x = edge if in_mel else from_mel.replace("?", edge)
    upper, lower = (from_mel.replace("?", whole.format(j)) for j in ("(b + 2)", "b"))
    scale = f"2.0 / ({upper} - {lower})" if area else "1.0"
    return f"""{name}_e AS (SELECT j, {x} AS x, lo, hi FROM (SELECT {to_mel.replace("?", str(low))} AS lo, {to_mel.replace("?", str(high))} AS hi), unnest(range(0, 5)) AS r(j)),
{name} AS (SELECT b, k, {scale} * greatest(0, least(({at} - l.x) / (m.x - l.x), (r.x - {at}) / (r.x - m.x))) AS w FROM unnest(range(0, 3)) AS q(b) JOIN {name}_e l ON l.j = b JOIN {name}_e m ON m.j = b + 1 JOIN {name}_e r ON r.j = b + 2, unnest(range(0, 5)) AS s(k))"""


_KALDI = ("(1127 * ln(1 + ? / 700.0))", "(700 * (exp(? / 1127) - 1))")
_HTK = ("(2595 * log10(1 + ? / 700.0))", "(700 * (pow(10, ? / 2595) - 1))")
_SLANEY = ("(CASE WHEN ? < 1000 THEN ? * 3 / 200.0 ELSE 15 + 27 * ln(greatest(?, 1000) / 1000.0) / ln(6.4) END)", "(CASE WHEN ? < 15 THEN ? * 200 / 3.0 ELSE 1000 * exp((? - 15) * ln(6.4) / 27) END)")
_EPS = 1.1920928955078125e-07
MEL_RECIPES = f"""WITH {WINDOWS}, {FULL}, {framed_sql("fr", 3, 0)}, {framed_sql("fc", 5, 4)},
dcless AS (SELECT user_id, seg, t, j, v - avg(v) OVER (PARTITION BY user_id, seg, t) AS v FROM fr),
emph AS (SELECT user_id, seg, t, j, v - 0.97 * coalesce(lag(v) OVER (PARTITION BY user_id, seg, t ORDER BY j), v) AS v FROM dcless),
{dft_sql("dk", "emph", "(0.5 - 0.5 * cos(2 * pi() * j / 7))")}, {dft_sql("dc", "fc", HANN)},
{bank_sql("bk", *_KALDI, 20.0, 500.0, True, False)}, {bank_sql("bn", *_SLANEY, 0.0, 500.0, False, True)}, {bank_sql("bh", *_HTK, 0.0, 500.0, False, False)}
SELECT 'kaldi' AS recipe, user_id, seg, t, b AS i, round(ln(greatest(sum((re * re + im * im) * w), {_EPS})), 4) + 0.0 AS v FROM dk JOIN bk USING (k) WHERE k < 4 GROUP BY ALL
UNION ALL SELECT 'nnaudio', user_id, seg, t, b, round(ln(sum((re * re + im * im) * w) + {_EPS}), 4) + 0.0 FROM dc JOIN bn USING (k) GROUP BY ALL
UNION ALL SELECT 'huggingface', user_id, seg, t, b, round(10 * log10(greatest(sum((re * re + im * im) * w), 1e-10)), 4) + 0.0 FROM dc JOIN bh USING (k) GROUP BY ALL"""


@query("mel_energies", f"""WITH {SPECTRUM}, top AS (SELECT 2595 * log10(1 + 500 / 700.0) AS mel),
edge AS (SELECT j, 700 * (pow(10, mel * j / 5 / 2595) - 1) AS hz FROM top, unnest(range(0, 6)) AS r(j)),
bank AS (SELECT b.j - 1 AS f, k, greatest(0, least((k * 62.5 - a.hz) / (b.hz - a.hz), (c.hz - k * 62.5) / (c.hz - b.hz))) AS w FROM edge a JOIN edge b ON b.j = a.j + 1 JOIN edge c ON c.j = b.j + 1 JOIN bins ON true)
SELECT user_id, seg, f AS i, round(10 * log10(greatest(sum((re * re + im * im) * w), 1e-10)), 4) + 0.0 AS v FROM m JOIN bank USING (k) GROUP BY ALL""")
def mel_energies(spark: SparkSession, sf: str) -> DataFrame:
    """Four mel bands in decibel of every window, without centring."""
    conf = FbankConfig(sample_rate=1000, frame_length=FFT, frame_shift=HOP, impl="torchaudio", num_mel_bins=4, center=False)
    w = features.with_fbank(windows(spark, sf).select("user_id", "seg", "x"), conf)
    rows = w.select("user_id", "seg", F.posexplode(F.col("spec")[0]).alias("i", "v"))
    return rows.withColumn("v", F.round("v", 4))


@query("mel_recipes", MEL_RECIPES)
def mel_recipes(spark: SparkSession, sf: str) -> DataFrame:
    """The three other recipes on windows of every signal, all frames and bands."""
    base = windows(spark, sf).select("user_id", "seg", "x")
    out = None
    for impl in ("kaldi", "nnaudio", "huggingface"):
        conf = FbankConfig(sample_rate=1000, frame_length=8, frame_shift=4, impl=impl, num_mel_bins=3, f_max=500.0 if impl != "kaldi" else None)
        one = features.with_fbank(base, conf).select(F.lit(impl).alias("recipe"), "user_id", "seg", F.posexplode("spec").alias("t", "row"))
        out = one if out is None else out.unionByName(one)
    rows = out.select("recipe", "user_id", "seg", "t", F.posexplode("row").alias("i", "v"))
    return rows.withColumn("v", F.round("v", 4))


@query("stft_variants", f"""WITH {WINDOWS}, {FULL}, {framed_sql("fr", 3, 0)}, {framed_sql("fc", 5, 4)}, {dft_sql("d", "fr", HANN)}, {dft_sql("dc", "fc", HANN)}
SELECT 'log' AS kind, user_id, seg, t, 0 AS channel, k AS i, round(ln(sqrt(re * re + im * im) + 1e-10), 3) + 0.0 AS v FROM dc
UNION ALL SELECT 'complex', user_id, seg, t, 0, k, round(re, 3) + 0.0 FROM d UNION ALL SELECT 'complex', user_id, seg, t, 1, k, round(-im, 3) + 0.0 FROM d""")
def stft_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Five centred frames of log magnitudes, and three frames of a complex spectrum as two channels."""
    base = windows(spark, sf).select("user_id", "seg", "x")
    log = features.with_stft(base, StftConfig(1000, 8, 4, center=True)).select(
        F.lit("log").alias("kind"), "user_id", "seg", F.array("spec").alias("spec"))
    both = features.with_stft(base, StftConfig(1000, 8, 4, data_type="complex", channels=True)).select(
        F.lit("complex").alias("kind"), "user_id", "seg", "spec")
    rows = log.unionByName(both).select("kind", "user_id", "seg", F.posexplode("spec").alias("channel", "m"))
    rows = rows.select("kind", "user_id", "seg", "channel", F.posexplode("m").alias("t", "row"))
    rows = rows.select("kind", "user_id", "seg", "t", "channel", F.posexplode("row").alias("i", "v"))
    return rows.withColumn("v", F.round("v", 3) + 0.0)


@query("resample", f"""WITH {WINDOWS}, p AS (SELECT user_id, seg, off, i, v FROM c), g AS (SELECT DISTINCT user_id, seg FROM c), out AS (SELECT unnest(range(0, {WIN // 2})) AS m),
d AS (SELECT g.user_id, g.seg, m, p.v, (p.i / 2.0 - m) * 0.99 AS t FROM g JOIN out ON true JOIN p ON p.user_id = g.user_id AND p.seg = g.seg)
SELECT user_id, seg, m AS i, round(sum(CASE WHEN abs(t) >= 6 THEN 0 ELSE v * (CASE WHEN t = 0 THEN 1 ELSE sin(pi() * t) / (pi() * t) END) * pow(cos(pi() * t / 12), 2) * 0.99 / 2 END), 6) + 0.0 AS v FROM d GROUP BY ALL""")
def resample(spark: SparkSession, sf: str) -> DataFrame:
    """Every window at half its rate, band-limited."""
    w = windows(spark, sf).select("user_id", "seg", "x")
    return spread(features.with_resampled(w, 2000, 1000), "user_id", "seg")


@query("encode_and_pool", f"""WITH {WINDOWS}, z AS (SELECT user_id, seg, sum(v) / {WIN} AS m, sum(v * v) / {WIN} AS e, least(min(v), CASE WHEN count(*) < {WIN} THEN 0 ELSE min(v) END) AS lo, greatest(max(v), CASE WHEN count(*) < {WIN} THEN 0 ELSE max(v) END) AS hi FROM c GROUP BY ALL),
b AS (SELECT user_id, seg, k, (pow(sum(v * cos(2 * pi() * k * i / {WIN})), 2) + pow(sum(v * sin(2 * pi() * k * i / {WIN})), 2)) / {WIN} AS p FROM c, unnest(range(0, {WIN // 2 + 1})) AS q(k) GROUP BY ALL),
l AS (SELECT user_id, seg, unnest([0, 1, 2, 3, 4]) AS i, unnest([m, sqrt(greatest(e - m * m, 0)), lo, hi, e]) AS v FROM z
  UNION ALL SELECT user_id, seg, 5 + greatest(k - 1, 0), sum(p) FROM b GROUP BY ALL),
p AS (SELECT user_id, i, avg(v) AS v FROM l GROUP BY ALL)
SELECT user_id, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY user_id)), 6) + 0.0 AS v FROM p""")
def encode_and_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Windows through the default encoder, file vectors by mean; all thirteen dimensions, at unit length."""
    enc = features.encode(windows(spark, sf).select("user_id", "x"))
    pooled = pooling.pool_vectors(enc.select("user_id", "emb"), ["user_id"], "mean", dim=13)
    return spread(pooled.withColumn("x", arrays.unit(F.col("emb"))), "user_id")
