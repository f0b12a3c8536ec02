"""Named queries over the given tables and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import layout, scoring
from tessera.functions import vectors as V
from tessera.operators import clustering, matching, sessions, tracking
from tessera.plans import pipeline
from tessera.sources import tables as S

CFG = Config(dim=64, similarity=0.25)
GAP_US = 6 * 3600 * 1_000_000
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(x) -> F.Column:
    return F.round(x, 6)


# ---- SQL of the observation table and its scores, for the comparison ----
OBS = """
obs0 AS (SELECT vec_id AS obs_id, (vec_id // 3000) * 5 + vec_id % 5 AS stream_id, (vec_id % 3000) // 15 + 1 AS frame_index,
  ((vec_id % 3000) // 15) * 200 + ((vec_id % 3000) // 105) * 1000 + ((vec_id % 3000) // 315) * 1500 AS ts_ms,
  CAST((vec_id * 37) % 950 AS DOUBLE) AS box_left, CAST((vec_id * 53) % 1800 AS DOUBLE) AS box_top,
  CAST(20 + (vec_id * 29) % 180 AS DOUBLE) AS face_w, CAST(20 + (vec_id * 31) % 180 AS DOUBLE) AS face_h,
  1080 AS frame_w, 1920 AS frame_h, CAST((vec_id * 13) % 91 - 45 AS DOUBLE) AS pitch, CAST((vec_id * 17) % 121 - 60 AS DOUBLE) AS yaw,
  CAST((vec_id * 7) % 61 - 30 AS DOUBLE) AS roll, ((vec_id * 11) % 101) / 100.0::DOUBLE AS left_eye, ((vec_id * 23) % 101) / 100.0::DOUBLE AS right_eye,
  CASE WHEN vec_id % 13 = 0 THEN -1.0::DOUBLE ELSE ((vec_id * 41) % 101) / 100.0::DOUBLE END AS smile,
  ((vec_id * 19) % 1000) / 10.0::DOUBLE AS sharpness, embedding::DOUBLE[] AS v, label FROM embeddings),
obs1 AS (SELECT *, box_left + face_w AS box_right, box_top + face_h AS box_bottom FROM obs0),
obs2 AS (SELECT *, (box_left <= 4 OR box_top <= 4 OR box_right >= 1076 OR box_bottom >= 1916) AS is_clipped,
  least(1.0, greatest(0.0, greatest(0.0, least(box_right, 1080.0) - greatest(box_left, 0.0)) * greatest(0.0, least(box_bottom, 1920.0) - greatest(box_top, 0.0)) / greatest(1.0, face_w * face_h))) AS visibility,
  greatest(0.0, least(1.0, 1 - (0.4::DOUBLE * least(1.0, abs(pitch) / 30) + 0.4::DOUBLE * least(1.0, abs(yaw) / 35) + 0.2::DOUBLE * least(1.0, abs(roll) / 25)))) AS frontality,
  least(1.0, greatest(0.0, (left_eye + right_eye) / 2)) AS eyes, least(1.0, sharpness / 80) AS sharp,
  CASE WHEN smile >= 0 THEN least(1.0, smile) ELSE 0.5 END AS expression, greatest(0.1, least(1.0, face_w / 1080 / 0.35::DOUBLE)) AS size_score FROM obs1),
obs3 AS (SELECT *, CASE WHEN is_clipped THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS whole,
  (face_w >= 38 AND face_h >= 38) AS pre, (face_w >= 38 AND face_h >= 38 AND sharpness >= 1.5) AS usable,
  (face_w >= 48 AND NOT is_clipped AND sharpness >= 5 AND abs(yaw) <= 50 AND abs(pitch) <= 40) AS visible FROM obs2),
obs AS (SELECT *, CASE WHEN visible THEN least(1.0, greatest(0.0, 0.25::DOUBLE * frontality + 0.25::DOUBLE * sharp + 0.2::DOUBLE * eyes + 0.15::DOUBLE * expression + 0.1::DOUBLE * size_score + 0.05::DOUBLE * whole)) ELSE 0.0::DOUBLE END AS rep_score,
  (usable AND sharpness >= 5 AND face_w >= 48 AND face_h >= 48 AND NOT is_clipped AND visibility >= 0.9 AND abs(yaw) <= 50 AND abs(pitch) <= 40 AND (left_eye + right_eye) / 2 >= 0.2) AS is_rep FROM obs3)
"""
SESSIONS = f"""
e1 AS (SELECT user_id, event_id, ts, value, epoch_us(ts) AS us FROM events),
e2 AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > {GAP_US} THEN 1 ELSE 0 END AS brk FROM e1 WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session_index FROM e2)
"""
COS = "CASE WHEN list_dot_product({a}, {a}) <= 0 OR list_dot_product({b}, {b}) <= 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END"
CENTROIDS = """
parts AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos, {w} AS w FROM obs),
means AS (SELECT label, pos, sum(w * x) / sum(w) AS x FROM parts GROUP BY label, pos),
cent0 AS (SELECT label, list(x ORDER BY pos) AS m FROM means GROUP BY label),
cent AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS centroid FROM cent0)
"""


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.observations(spark, sf_dir, CFG)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.unix_micros(c("ts").cast("timestamp")).alias("us"))
    return sessions.sessionize(e, ["user_id"], "us", GAP_US, "event_id")


# ---- sessions and choice of rows ----
@query(f"WITH {SESSIONS}, per AS (SELECT user_id, session_index, count(*) AS n, min(us) AS a, max(us) AS b, max(value) AS best FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events, round(sum((b - a) / 1000000.0::DOUBLE), 6) AS total_s, max(best) AS best_value FROM per GROUP BY user_id")
def user_summary(spark, sf_dir):
    per = _events(spark, sf_dir).groupBy("user_id", "session_index").agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"), F.max("value").alias("best"))
    return per.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"), r6(F.sum((c("b") - c("a")) / 1_000_000)).alias("total_s"), F.max("best").alias("best_value"))


@query(f"WITH {SESSIONS} SELECT user_id, session_index::BIGINT AS session_index, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY user_id, session_index")
def sessions_lag(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", "session_index").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"))


@query(f"WITH {SESSIONS} SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY user_id, session_index")
def sessions_window(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select("user_id", c("ts").cast("timestamp").alias("ts"))
    w = sessions.session_windows(e, ["user_id"], "ts", "6 hours")
    return w.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "n")


@query(f"WITH {SESSIONS} SELECT event_id, user_id, session_index::BIGINT AS session_index FROM s")
def session_index(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "user_id", "session_index")


@query(f"WITH {SESSIONS} SELECT event_id, user_id, session_index::BIGINT AS session_index FROM s")
def session_index_spread(spark, sf_dir):
    """The same by a prefix scan in two levels: a user who holds most events is spread over tasks."""
    e = S.table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(c("ts").cast("timestamp")).alias("us"))
    return sessions.sessionize_spread(e, ["user_id"], "us", GAP_US, "event_id").select("event_id", "user_id", "session_index")


@query(f"WITH {SESSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_index ORDER BY value DESC, event_id) AS k FROM s) SELECT user_id, session_index::BIGINT AS session_index, event_id AS best_event, value AS best_value FROM r WHERE k = 1")
def session_best(spark, sf_dir):
    best = F.max_by(F.struct("event_id", "value"), F.struct(c("value"), -c("event_id"))).alias("b")
    return _events(spark, sf_dir).groupBy("user_id", "session_index").agg(best).select("user_id", "session_index", c("b.event_id").alias("best_event"), c("b.value").alias("best_value"))


@query(f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, label ORDER BY is_rep DESC, rep_score DESC, obs_id) AS k FROM obs) SELECT stream_id, label, obs_id AS best_obs FROM r WHERE k = 1")
def best_tiered(spark, sf_dir):
    return _obs(spark, sf_dir).groupBy("stream_id", "label").agg(F.max_by("obs_id", sessions.tiered_key(c("is_rep"), c("rep_score"), c("obs_id"))).alias("best_obs"))


@query(f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, label ORDER BY is_rep DESC, CASE WHEN is_rep THEN rep_score ELSE sharpness END DESC, obs_id) AS k FROM obs) SELECT stream_id, label, obs_id AS peak_obs FROM r WHERE k = 1")
def peak_fallback(spark, sf_dir):
    return _obs(spark, sf_dir).groupBy("stream_id", "label").agg(F.max_by("obs_id", sessions.peak_key(c("is_rep"), c("rep_score"), c("sharpness"), c("obs_id"))).alias("peak_obs"))


# ---- sampling ----
_STREAMS = "st AS (SELECT conv_id AS stream_id, (sum(length(text)) * 10)::BIGINT AS duration_ms FROM conversations GROUP BY conv_id)"


def _streams(spark, sf_dir):
    return S.table(spark, sf_dir, "conversations").groupBy(c("conv_id").alias("stream_id")).agg((F.sum(F.length("text")) * 10).alias("duration_ms"))


@query(f"WITH {_STREAMS}, g AS (SELECT stream_id, unnest(range(0, duration_ms + 1, 200)) AS ts_ms FROM st WHERE duration_ms > 0) SELECT stream_id, ts_ms, ts_ms // 200 + 1 AS frame_index FROM g")
def sample_grid(spark, sf_dir):
    return S.sample_grid(_streams(spark, sf_dir), CFG).select("stream_id", "ts_ms", c("frame_index").cast("long").alias("frame_index"))


@query(f"WITH {_STREAMS}, g AS (SELECT stream_id, unnest(range(0, duration_ms + 1, 200)) AS ts_ms FROM st WHERE duration_ms > 0) SELECT stream_id, count(*) AS n, max(ts_ms // 200 + 1) AS last_index FROM g WHERE ts_ms % 600 <> 0 GROUP BY stream_id")
def sample_skipped(spark, sf_dir):
    return S.sample_grid(_streams(spark, sf_dir), CFG, c("ts_ms") % 600 != 0).groupBy("stream_id").agg(F.count("*").alias("n"), F.max(c("frame_index").cast("long")).alias("last_index"))


@query(f"WITH {_STREAMS} SELECT stream_id, greatest(1, duration_ms // 200 + 1) AS estimate FROM st")
def sample_estimate(spark, sf_dir):
    return _streams(spark, sf_dir).select("stream_id", S.frame_estimate(CFG).alias("estimate"))


# ---- scores and gates ----
@query(f"WITH {OBS} SELECT obs_id, round(visibility, 6) AS visibility, is_clipped, round(frontality, 6) AS frontality, round(eyes, 6) AS eyes, round(sharp, 6) AS sharp, round(expression, 6) AS expression, round(size_score, 6) AS size_score, whole, round(ts_ms / 1000.0::DOUBLE, 6) AS ts_s FROM obs")
def component_scores(spark, sf_dir):
    return _obs(spark, sf_dir).select("obs_id", r6(scoring.visibility()).alias("visibility"), "is_clipped", r6(scoring.frontality()).alias("frontality"), r6(scoring.eyes()).alias("eyes"), r6(scoring.sharpness()).alias("sharp"), r6(scoring.expression()).alias("expression"), r6(scoring.size()).alias("size_score"), scoring.whole().alias("whole"), r6(scoring.timestamp_seconds()).alias("ts_s"))


@query(f"WITH {OBS} SELECT obs_id, round(rep_score, 6) AS rep_score, CASE WHEN visible THEN round(rep_score, 6) END AS rep_score_or_null FROM obs")
def rep_scores(spark, sf_dir):
    return _obs(spark, sf_dir).select("obs_id", r6("rep_score").alias("rep_score"), r6(scoring.representative_score_or_null(CFG)).alias("rep_score_or_null"))


@query(f"WITH {OBS} SELECT obs_id, pre, usable, visible, is_rep FROM obs")
def gates(spark, sf_dir):
    return _obs(spark, sf_dir).select("obs_id", scoring.prefilter(CFG).alias("pre"), scoring.identity_gate(CFG).alias("usable"), scoring.clearly_visible(CFG).alias("visible"), "is_rep")


@query(f"WITH {OBS} SELECT stream_id, count(*) AS n, count(*) FILTER (pre) AS n_pre, count(*) FILTER (usable) AS n_usable, count(*) FILTER (visible) AS n_visible, count(*) FILTER (is_rep) AS n_rep FROM obs GROUP BY stream_id")
def gate_funnel(spark, sf_dir):
    return _obs(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if(scoring.prefilter(CFG)).alias("n_pre"), F.count_if(scoring.identity_gate(CFG)).alias("n_usable"), F.count_if(scoring.clearly_visible(CFG)).alias("n_visible"), F.count_if(c("is_rep")).alias("n_rep"))


@query(f"WITH {OBS} SELECT stream_id, count(DISTINCT ts_ms) AS n_frames, count(*) AS n_obs, count(*) FILTER (usable) AS n_usable, round((max(ts_ms) - min(ts_ms)) / 1000.0::DOUBLE, 6) AS duration_s FROM obs GROUP BY stream_id")
def run_summary(spark, sf_dir):
    return pipeline.run_summary(_obs(spark, sf_dir), CFG)


@query(f"WITH {OBS} SELECT obs_id, round(greatest(0.05, least(0.85, 0.05 + 0.8 * frame_index / greatest(1, max(frame_index) OVER (PARTITION BY stream_id)))), 6)::DOUBLE AS progress FROM obs")
def progress(spark, sf_dir):
    total = F.max("frame_index").over(Window.partitionBy("stream_id"))
    return _obs(spark, sf_dir).withColumn("total", total).select("obs_id", r6(scoring.progress(c("frame_index"), c("total"))).alias("progress"))


# ---- vectors ----
@query(f"WITH {OBS} SELECT obs_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, (len(v) = 64 AND list_dot_product(v, v) > 1e-12) AS valid FROM obs")
def normalized_vectors(spark, sf_dir):
    v = c("embedding")
    return _obs(spark, sf_dir).select("obs_id", r6(F.sqrt(V.raw_dot(v, v))).alias("norm"), r6(V.normalized(v)[0]).alias("first"), V.valid(v, 64).alias("valid"))


_PAIR = f"WITH {OBS} SELECT a.obs_id AS obs_a, b.obs_id AS obs_b, round({COS.format(a='a.v', b='b.v')}, 6) AS sim FROM obs a JOIN obs b ON a.stream_id = b.stream_id AND a.label = b.label AND a.obs_id < b.obs_id WHERE {COS.format(a='a.v', b='b.v')} >= 0.25"


@query(_PAIR)
def similarity_join(spark, sf_dir):
    o = _obs(spark, sf_dir).select("stream_id", "label", "obs_id", "embedding")
    b = o.select("stream_id", "label", c("obs_id").alias("obs_b"), c("embedding").alias("vec_b"))
    out = matching.similarity_join(o.withColumnRenamed("obs_id", "obs_a"), b, ["stream_id", "label"], 0.25, "embedding", "vec_b", c("obs_a") < c("obs_b"))
    return out.select("obs_a", "obs_b", r6("sim").alias("sim"))


@query(f"WITH {OBS} SELECT a.obs_id AS id_a, b.obs_id AS id_b, round({COS.format(a='a.v', b='b.v')}, 6) AS sim FROM obs a JOIN obs b ON a.obs_id < b.obs_id WHERE {COS.format(a='a.v', b='b.v')} >= 0.35")
def theta_join(spark, sf_dir):
    """All pairs of observations, of whatever stream or label, whose cosine reaches a threshold."""
    v = _obs(spark, sf_dir).select(c("obs_id").alias("id"), c("embedding").alias("vec"))
    return matching.similar_pairs(v, 0.35).withColumn("sim", r6("sim"))


def _centroids(spark, sf_dir, weight=None):
    return V.centroid(_obs(spark, sf_dir), ["label"], "embedding", CFG.dim, weight)


_CENTROID_OUT = "SELECT label, round(c[1], 6) AS c1, round(c[64], 6) AS c64, round(list_sum(c), 6) AS total FROM (SELECT label, centroid AS c FROM cent)"


def _centroid_out(df):
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return df.select("label", r6(c("centroid")[0]).alias("c1"), r6(c("centroid")[63]).alias("c64"), r6(total).alias("total"))


@query(f"WITH {OBS}, {CENTROIDS.format(w='1.0::DOUBLE')} {_CENTROID_OUT}")
def centroid_by_label(spark, sf_dir):
    return _centroid_out(_centroids(spark, sf_dir))


@query(f"WITH {OBS}, {CENTROIDS.format(w='greatest(0.01::DOUBLE, rep_score)')} {_CENTROID_OUT}")
def weighted_centroid(spark, sf_dir):
    return _centroid_out(_centroids(spark, sf_dir, c("rep_score")))


@query(f"WITH {OBS}, {CENTROIDS.format(w='1.0::DOUBLE')}, p AS (SELECT o.obs_id, k.label AS centroid_id, {COS.format(a='o.v', b='k.centroid')} AS sim FROM obs o, cent k), r AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY sim DESC, centroid_id) AS k FROM p) SELECT obs_id, centroid_id, round(sim, 6) AS sim FROM r WHERE k = 1")
def nearest_centroid(spark, sf_dir):
    cs = _centroids(spark, sf_dir).withColumnRenamed("label", "centroid_id")
    return matching.nearest_centroid(_obs(spark, sf_dir).select("obs_id", "embedding"), cs, "embedding").select("obs_id", "centroid_id", r6("sim").alias("sim"))


@query(f"WITH {OBS}, {CENTROIDS.format(w='1.0::DOUBLE')} SELECT a.label AS id_a, b.label AS id_b, round({COS.format(a='a.centroid', b='b.centroid')}, 6) AS sim FROM cent a JOIN cent b ON a.label < b.label WHERE {COS.format(a='a.centroid', b='b.centroid')} >= -0.05")
def close_centroids(spark, sf_dir):
    pairs = matching.similar_pairs(_centroids(spark, sf_dir).select(c("label").alias("id"), c("centroid").alias("vec")), -0.05)
    return pairs.select(c("id_a").cast("int").alias("id_a"), c("id_b").cast("int").alias("id_b"), r6("sim").alias("sim"))


@query(f"WITH {OBS}, cells AS (SELECT obs_id, v, unnest(range(9, 55)) AS i FROM obs) SELECT obs_id, round(var_pop(4 * v[i + 1] - v[i] - v[i + 2] - v[i - 7] - v[i + 9]), 6) AS variance FROM cells WHERE i % 8 BETWEEN 1 AND 6 AND i // 8 BETWEEN 1 AND 6 GROUP BY obs_id")
def laplacian_variance(spark, sf_dir):
    """Sharpness kernel, each vector read as an 8 x 8 grid: variance of the four-neighbour stencil."""
    v = V.doubles(c("embedding"))
    inner = [8 * y + x for y in range(1, 7) for x in range(1, 7)]
    lap = F.transform(F.array(*[F.lit(i) for i in inner]), lambda i: 4 * F.get(v, i) - F.get(v, i - 1) - F.get(v, i + 1) - F.get(v, i - 8) - F.get(v, i + 8))
    return _obs(spark, sf_dir).select("obs_id", lap.alias("lap")).select("obs_id", r6(V.variance(c("lap"))).alias("variance"))


# ---- frames, joins, order ----
@query(f"WITH {OBS} SELECT stream_id, ts_ms, count(*) AS n, string_agg(obs_id::VARCHAR, ',' ORDER BY obs_id) AS ids FROM obs GROUP BY stream_id, ts_ms")
def group_frames(spark, sf_dir):
    g = sessions.group_rows(_obs(spark, sf_dir), ["stream_id", "ts_ms"], "obs_id")
    return g.select("stream_id", "ts_ms", F.size("rows").cast("long").alias("n"), F.array_join(c("rows.obs_id").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {OBS} SELECT obs_id FROM obs a WHERE usable AND NOT EXISTS (SELECT 1 FROM obs b WHERE b.stream_id = a.stream_id AND b.frame_index = a.frame_index - 1 AND b.usable AND {COS.format(a='a.v', b='b.v')} >= 0.1)")
def unmatched_obs(spark, sf_dir):
    o = _obs(spark, sf_dir).where(scoring.identity_gate(CFG)).select("stream_id", "frame_index", "obs_id", "embedding")
    before = o.select("stream_id", (c("frame_index") + 1).alias("frame_index"), c("embedding").alias("vec_b"))
    hit = matching.similarity_join(o, before, ["stream_id", "frame_index"], 0.1, "embedding", "vec_b").select("obs_id")
    return o.select("obs_id").join(hit, "obs_id", "left_anti")


@query(f"WITH {OBS}, b AS (SELECT stream_id, label, ts_ms, obs_id, row_number() OVER (PARTITION BY stream_id, label ORDER BY is_rep DESC, rep_score DESC, obs_id) AS k FROM obs), f AS (SELECT stream_id, ts_ms, min(frame_index) AS frame_index FROM obs WHERE usable GROUP BY stream_id, ts_ms) SELECT b.stream_id, b.label, b.obs_id, f.frame_index FROM b LEFT JOIN f ON f.stream_id = b.stream_id AND f.ts_ms = b.ts_ms WHERE k = 1")
def frame_lookup(spark, sf_dir):
    o = _obs(spark, sf_dir)
    best = o.groupBy("stream_id", "label").agg(F.max_by(F.struct("ts_ms", "obs_id"), sessions.tiered_key(c("is_rep"), c("rep_score"), c("obs_id"))).alias("b")).select("stream_id", "label", "b.ts_ms", "b.obs_id")
    frames = o.where(scoring.identity_gate(CFG)).groupBy("stream_id", "ts_ms").agg(F.min("frame_index").alias("frame_index"))
    return best.join(frames, ["stream_id", "ts_ms"], "left").select("stream_id", "label", "obs_id", "frame_index")


_CLOSING = f"WITH {OBS}, seg AS (SELECT stream_id, label::BIGINT AS segment_id, max(ts_ms) AS last_ms FROM obs GROUP BY ALL), f AS (SELECT DISTINCT stream_id, ts_ms FROM obs), j AS (SELECT s.*, (SELECT min(f.ts_ms) FROM f WHERE f.stream_id = s.stream_id AND f.ts_ms > s.last_ms + 1200) AS close_ms FROM seg s) SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY close_ms NULLS LAST, segment_id) AS close_rank FROM j"


def _closing(spark, sf_dir, **how):
    o = _obs(spark, sf_dir)
    seg = o.groupBy("stream_id", c("label").cast("long").alias("segment_id")).agg(F.max("ts_ms").alias("last_ms"))
    return sessions.closing_frames(seg, o.select("stream_id", "ts_ms").distinct(), CFG.gap_ms, **how).withColumn("close_rank", c("close_rank").cast("long"))


@query(_CLOSING)
def closing_frame_order(spark, sf_dir):
    return _closing(spark, sf_dir)


@query(_CLOSING)
def closing_frames_spread(spark, sf_dir):
    """Small buckets, and ranks in two levels: no window holds a stream's frames or segments."""
    return _closing(spark, sf_dir, bucket=2000, spread=True)


# ---- layout ----
@query(f"WITH {OBS} SELECT obs_id, least(greatest(trunc(box_left - face_w * 0.2::DOUBLE)::INT, 0), 1079) AS ex0, least(greatest(trunc(box_top - face_h * 0.4::DOUBLE)::INT, 0), 1919) AS by0, round(greatest(0.0, (box_left + box_right) / 2 - face_w * 2.2::DOUBLE), 6) AS cx0, round(least(1920.0, (box_top + box_bottom) / 2 + face_h * 3.5::DOUBLE), 6) AS cy1, round(greatest(0.0, (box_left + box_right) / 2 - (face_w / 2 + face_w)), 6) AS tx0, round(least(1920.0, (box_top + box_bottom) / 2 + (face_h / 2 + face_h * 3.0)), 6) AS ty1 FROM obs")
def crops(spark, sf_dir):
    o = _obs(spark, sf_dir).select("obs_id", layout.crop_embed().alias("e"), layout.crop_best().alias("b"), layout.crop_context().alias("k"), layout.crop_thumbnail().alias("t"))
    return o.select("obs_id", c("e.x0").alias("ex0"), c("b.y0").alias("by0"), r6("k.x0").alias("cx0"), r6("k.y1").alias("cy1"), r6("t.x0").alias("tx0"), r6("t.y1").alias("ty1"))


@query(f"WITH {OBS}, f AS (SELECT obs_id, face_w, face_h, greatest(400.0 / face_w, 300.0 / face_h) AS scale FROM obs) SELECT obs_id, round(scale, 6) AS scale, round((400.0 - face_w * scale) / 2, 6) + 0.0::DOUBLE AS dx, round((300.0 - face_h * scale) * 0.1, 6) + 0.0::DOUBLE AS dy FROM f")
def fit_transform(spark, sf_dir):
    f = _obs(spark, sf_dir).select("obs_id", layout.fit(F.lit(400.0), F.lit(300.0), c("face_w"), c("face_h")).alias("f"))
    return f.select("obs_id", r6("f.scale").alias("scale"), (r6("f.dx") + 0.0).alias("dx"), (r6("f.dy") + 0.0).alias("dy"))  # no negative zeros


@query(f"WITH {OBS}, g AS (SELECT stream_id, label, count(*) AS n FROM obs GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY label) - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS m FROM g), q AS (SELECT *, CASE WHEN m = 1 THEN 1 ELSE 2 END AS k FROM p) SELECT stream_id, label, (i % k)::INT AS grid_col, (i // k)::INT AS grid_row, round(40 + (i % k) * ((1080 - 40 * (k + 1)) / k + 40), 6)::DOUBLE AS cell_x, 'Person ' || (i + 1) AS name, n || CASE WHEN n = 1 THEN ' Appearance' ELSE ' Appearances' END AS badge FROM q")
def grid_layout(spark, sf_dir):
    g = _obs(spark, sf_dir).groupBy("stream_id", "label").agg(F.count("*").alias("n")).withColumnRenamed("label", "grp")
    placed = layout.relabel(layout.grid(g, "stream_id", "grp"), "stream_id", "grp")
    return placed.select("stream_id", c("grp").alias("label"), "grid_col", "grid_row", r6("cell_x").alias("cell_x"), c("label").alias("name"), layout.counted(c("n"), "Appearance", "Appearances").alias("badge"))


@query(f"WITH {OBS}, f AS (SELECT obs_id, (box_left + box_right) / 2 * 0.5::DOUBLE AS x, (box_top + box_bottom) / 2 * 0.75::DOUBLE AS y, face_w * 0.5::DOUBLE AS w, face_h * 0.75::DOUBLE AS h FROM obs) SELECT obs_id, round(greatest(0.0, x - w * 2.2::DOUBLE), 6) AS x0, round(greatest(0.0, y - h * 2.8::DOUBLE), 6) AS y0, round(least(540.0, x + w * 2.2::DOUBLE), 6) AS x1, round(least(1440.0, y + h * 3.5::DOUBLE), 6) AS y1 FROM f")
def context_crops_scaled(spark, sf_dir):
    """Context crops in an image of another size than the frame."""
    box = layout.crop_context(F.lit(540), F.lit(1440)).alias("k")
    return _obs(spark, sf_dir).select("obs_id", box).select("obs_id", *[r6(f"k.{e}").alias(e) for e in ("x0", "y0", "x1", "y1")])


@query(f"WITH {OBS} SELECT obs_id, least(greatest(trunc(box_top - face_h * 0.2::DOUBLE)::INT, 0), 1919) AS ey0, greatest(least(greatest(trunc(box_left - face_w * 0.2::DOUBLE)::INT, 0), 1079) + 1, least(trunc(box_right + face_w * 0.2::DOUBLE)::INT, 1080)) AS ex1, least(greatest(trunc(box_left - face_w * 0.4::DOUBLE)::INT, 0), 1079) AS bx0, round(greatest(0.0, (box_top + box_bottom) / 2 - face_h * 2.8::DOUBLE), 6) AS cy0, round(least(1080.0, (box_left + box_right) / 2 + face_w * 2.2::DOUBLE), 6) AS cx1, round(greatest(0.0, (box_top + box_bottom) / 2 - (face_h / 2 + face_h * 1.5)), 6) AS ty0, round(least(1080.0, (box_left + box_right) / 2 + (face_w / 2 + face_w)), 6) AS tx1 FROM obs")
def crops_other_sides(spark, sf_dir):
    o = _obs(spark, sf_dir).select("obs_id", layout.crop_embed().alias("e"), layout.crop_best().alias("b"), layout.crop_context().alias("k"), layout.crop_thumbnail().alias("t"))
    return o.select("obs_id", c("e.y0").alias("ey0"), c("e.x1").alias("ex1"), c("b.x0").alias("bx0"), r6("k.y0").alias("cy0"), r6("k.x1").alias("cx1"), r6("t.y0").alias("ty0"), r6("t.x1").alias("tx1"))


# ---- sources and nulls ----
@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS duration_ms, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) > 0 AS valid FROM events")
def metadata_scan(spark, sf_dir):
    """A duration from a metadata string; 0 where it can't be read, and then the source is invalid."""
    d = S.duration(F.get_json_object("props", "$.k"))
    return S.table(spark, sf_dir, "events").select("event_id", d.alias("duration_ms"), (d > 0).alias("valid"))


@query(f"WITH {OBS} SELECT obs_id, round(coalesce(CASE WHEN smile >= 0 THEN smile END, 0.5), 6)::DOUBLE AS smile, round(coalesce(CASE WHEN left_eye > 0 THEN left_eye END, 1.0), 6)::DOUBLE AS left_eye FROM obs")
def filled_outputs(spark, sf_dir):
    """Outputs that a model did not give take their defaults."""
    o = _obs(spark, sf_dir).select("obs_id", F.when(c("smile") >= 0, c("smile")).alias("smile"), F.when(c("left_eye") > 0, c("left_eye")).alias("left_eye"))
    return o.select("obs_id", r6(scoring.filled("smile", 0.5)).alias("smile"), r6(scoring.filled("left_eye", 1.0)).alias("left_eye"))


@query(f"WITH {OBS}, {CENTROIDS.format(w='1.0::DOUBLE')} SELECT obs_id, round(least(1.0, greatest(-1.0, list_dot_product(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), centroid))), 6) AS sim FROM obs JOIN cent USING (label)")
def unit_similarity(spark, sf_dir):
    """Each observation to the centroid of its label, both of unit length, so the dot product is the cosine."""
    o = _obs(spark, sf_dir).select("obs_id", "label", V.normalized_or_zero(c("embedding")).alias("unit"))
    return o.join(_centroids(spark, sf_dir), "label").select("obs_id", r6(V.unit_dot(c("unit"), c("centroid"))).alias("sim"))


# ---- folds ----
_EDGES = f"""e AS (SELECT b.stream_id, b.frame_index, a.obs_id AS obs_a, b.obs_id AS obs_b, {COS.format(a='a.v', b='b.v')} AS sim FROM obs a JOIN obs b ON a.stream_id = b.stream_id AND b.frame_index = a.frame_index + 1 WHERE a.usable AND b.usable),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_index ORDER BY sim DESC, obs_b, obs_a) AS k FROM e WHERE sim >= 0),
g AS (SELECT DISTINCT stream_id, frame_index, 0::BIGINT AS k, []::BIGINT[] AS xs, []::BIGINT[] AS ys FROM r
  UNION ALL SELECT g.stream_id, g.frame_index, r.k, CASE WHEN list_contains(xs, obs_a) OR list_contains(ys, obs_b) THEN xs ELSE list_append(xs, obs_a) END, CASE WHEN list_contains(xs, obs_a) OR list_contains(ys, obs_b) THEN ys ELSE list_append(ys, obs_b) END
  FROM g JOIN r ON r.stream_id = g.stream_id AND r.frame_index = g.frame_index AND r.k = g.k + 1),
t AS (SELECT stream_id, frame_index, arg_max(xs, k) AS xs, arg_max(ys, k) AS ys FROM g GROUP BY stream_id, frame_index)"""


@query(f"WITH RECURSIVE {OBS}, {_EDGES} SELECT stream_id, frame_index, obs_a, obs_b, round(sim, 6) AS sim FROM (SELECT unnest(xs) AS obs_a, unnest(ys) AS obs_b FROM t) JOIN e USING (obs_a, obs_b)")
def greedy_assignment(spark, sf_dir):
    o = _obs(spark, sf_dir).where(scoring.identity_gate(CFG)).select("stream_id", "frame_index", c("obs_id").alias("obs_b"), c("embedding").alias("vec_b"))
    before = o.select("stream_id", (c("frame_index") + 1).alias("frame_index"), c("obs_b").alias("obs_a"), c("vec_b").alias("vec_a"))
    edges = matching.similarity_join(before, o, ["stream_id", "frame_index"], 0.0, "vec_a", "vec_b").select("stream_id", "frame_index", "obs_a", "obs_b", "sim")
    return matching.greedy_assignment(edges, ["stream_id", "frame_index"], "obs_b", "obs_a").withColumn("sim", r6("sim"))


_LEADERS = f"""ln AS (SELECT stream_id, obs_id, v, list_transform(v, lambda x: x * greatest(0.1, rep_score)) AS wv, row_number() OVER (PARTITION BY stream_id ORDER BY obs_id) AS k FROM obs WHERE usable),
lf AS (SELECT DISTINCT stream_id, 0::BIGINT AS k, []::DOUBLE[][] AS dirs, []::DOUBLE[][] AS plains, []::BIGINT[] AS asg FROM ln
  UNION ALL SELECT stream_id, k, CASE WHEN pick IS NULL THEN list_append(dirs, wv) ELSE list_transform(range(1, len(dirs) + 1), lambda i: CASE WHEN i = pick THEN list_transform(range(1, 65), lambda d: dirs[i][d] + wv[d]) ELSE dirs[i] END) END,
    CASE WHEN pick IS NULL THEN list_append(plains, v) ELSE list_transform(range(1, len(plains) + 1), lambda i: CASE WHEN i = pick THEN list_transform(range(1, 65), lambda d: plains[i][d] + v[d]) ELSE plains[i] END) END,
    list_append(asg, coalesce(pick, len(dirs) + 1)) FROM (SELECT *, CASE WHEN list_max(sims) >= 0.25 THEN list_position(sims, list_max(sims)) END AS pick FROM (
      SELECT lf.stream_id, ln.k, dirs, plains, asg, v, wv, list_transform(dirs, lambda m: {COS.format(a='m', b='v')}) AS sims FROM lf JOIN ln ON ln.stream_id = lf.stream_id AND ln.k = lf.k + 1))),
le AS (SELECT * FROM lf QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY k DESC) = 1)"""
_MERGES = f"""me AS (SELECT stream_id, 0 AS step, dirs, plains, range(1, len(dirs) + 1) AS alive, range(1, len(dirs) + 1) AS roots FROM le
  UNION ALL SELECT stream_id, step + 1, list_transform(range(1, len(dirs) + 1), lambda i: CASE WHEN i = p[1] THEN list_transform(range(1, 65), lambda d: plains[p[1]][d] + plains[p[2]][d]) ELSE dirs[i] END),
    list_transform(range(1, len(dirs) + 1), lambda i: CASE WHEN i = p[1] THEN list_transform(range(1, 65), lambda d: plains[p[1]][d] + plains[p[2]][d]) ELSE plains[i] END),
    list_filter(alive, lambda i: i <> p[2]), list_transform(roots, lambda i: CASE WHEN i = p[2] THEN p[1] ELSE i END)
  FROM (SELECT *, flatten(list_transform(alive, lambda i: list_transform(list_filter(alive, lambda j: j > i AND {COS.format(a='dirs[i]', b='dirs[j]')} >= 0.25), lambda j: [i, j])))[1] AS p FROM me) WHERE p IS NOT NULL),
mr AS (SELECT * FROM me QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY step DESC) = 1)"""


def _ordered(spark, sf_dir):
    o = _obs(spark, sf_dir).where(scoring.identity_gate(CFG))
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy("obs_id"))
    return o.select("obs_id", "stream_id", rank.alias("rank"), c("embedding").alias("vec"), c("rep_score").alias("weight"))


@query(f"WITH RECURSIVE {OBS}, {_LEADERS} SELECT obs_id, ln.stream_id, asg[ln.k] AS cluster FROM ln JOIN le ON le.stream_id = ln.stream_id")
def leaders_in_epochs(spark, sf_dir):
    """Ordered leader clustering of all usable observations of a stream, in epochs of frozen clusters."""
    return clustering.leaders(_ordered(spark, sf_dir), CFG.similarity, CFG.weight_floor, block=64).select("obs_id", "stream_id", "cluster")


@query(f"WITH RECURSIVE {OBS}, {_LEADERS}, {_MERGES} SELECT obs_id, ln.stream_id, roots[asg[ln.k]] AS root, dense_rank() OVER (PARTITION BY ln.stream_id ORDER BY roots[asg[ln.k]]) AS entity FROM ln JOIN le ON le.stream_id = ln.stream_id JOIN mr ON mr.stream_id = ln.stream_id")
def merged_leaders(spark, sf_dir):
    """The same, then the first close pair of clusters merged until none is left. root: the first cluster of the entity."""
    found = clustering.leaders(_ordered(spark, sf_dir), CFG.similarity, CFG.weight_floor)
    out = clustering.merged(found, CFG.similarity, CFG.weight_floor)
    return out.select("obs_id", "stream_id", F.min("cluster").over(Window.partitionBy("stream_id", "entity")).alias("root"), "entity")


@query()
def track_appearances(spark, sf_dir):
    t = tracking.track(_obs(spark, sf_dir), CFG)
    return t.drop("embedding").withColumn("best_score", r6("best_score")).withColumn("peak_value", r6("peak_value"))


@query()
def leader_clusters(spark, sf_dir):
    o = _obs(spark, sf_dir)
    return tracking.entities(tracking.track(o, CFG), pipeline.frame_line(o, CFG), CFG, merge=False)


@query()
def entity_clusters(spark, sf_dir):
    return pipeline.cluster_entities(_obs(spark, sf_dir), CFG)


@query()
def shown_identities(spark, sf_dir):
    """Identities with observations, or all of a stream that has none such; a stream without identities is an error."""
    o = _obs(spark, sf_dir)
    found = pipeline.shown(pipeline.cluster_entities(o, CFG))
    report = pipeline.required(pipeline.run_report(o, found, CFG))
    return found.join(report.select("stream_id", "n_identities"), "stream_id").select("stream_id", "entity_id", "n_obs", "best_obs", "n_identities")


@query()
def run_report(spark, sf_dir):
    """The run summary with the number of identities."""
    o = _obs(spark, sf_dir)
    return pipeline.run_report(o, pipeline.cluster_entities(o, CFG), CFG)
