"""Queries on routes, walks and corridors."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import corridor as C
from fieldspark.operators import routes as W
from fieldspark.operators import runs as R
from fieldspark.operators import terrain as T
from fieldspark.plans import bindings as B
from fieldspark.plans.bindings import HEIGHT, RASTER, WIDTH, even, sql
from fieldspark.plans.catalog import query
from fieldspark.plans.q_pixels import GRADE
from fieldspark.plans.q_masks import runs_sql

ROUTE = """SELECT video_id, frame_index AS idx, 48 + (event_id * 37 % 1000) / 10000.0::DOUBLE AS lat, 8 + (event_id * 91 % 1000) / 10000.0::DOUBLE AS lng FROM frames"""


def route(spark, sf):
    e = F.col("event_id")
    return B.frames(spark, sf).select(
        "video_id", F.col("frame_index").alias("idx"), (48 + (e * 37 % 1000) / F.lit(10000.0)).alias("lat"), (8 + (e * 91 % 1000) / F.lit(10000.0)).alias("lng")
    )


LEGS = """SELECT video_id, idx, lat0, lng0, lat AS lat1, lng AS lng1, length, sum(length) OVER (PARTITION BY video_id ORDER BY idx) AS "end" FROM (
    SELECT *, 2 * 6371000 * asin(sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lng - lng0) / 2), 2))) AS length FROM (
      SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM route WINDOW w AS (PARTITION BY video_id ORDER BY idx)) WHERE lat0 IS NOT NULL)"""


@query("w1_route_length", sql("SELECT video_id, round_even(sum(length), 3) AS length_m, count(*) + 1 AS points FROM legs GROUP BY video_id", "frames", route=ROUTE, legs=LEGS))
def w1(spark, sf):
    return W.route_length(route(spark, sf), ["video_id"], huge=B.huge_videos(spark, sf)).withColumn("length_m", F.bround("length_m", 3))


@query(
    "w1_locate_on_route",
    sql(
        # A leg without length holds no position; beyond the last leg stands the last point.
        """SELECT a.video_id, a.event_id, round_even(coalesce(l.lat0 + (l.lat1 - l.lat0) * (a.at - (l."end" - l.length)) / l.length, a.lat), 6) AS lat,
          round_even(coalesce(l.lng0 + (l.lng1 - l.lng0) * (a.at - (l."end" - l.length)) / l.length, a.lng), 6) AS lng,
          CAST(least(greatest(0, coalesce(n, 1) - 2), floor(fraction * greatest(1, coalesce(n, 1) - 1))) AS BIGINT) AS segment_index
        FROM (SELECT f.video_id, f.event_id, f.value / 500 AS fraction, t.total * (f.value / 500) AS at, t.n + 1 AS n, t.lat, t.lng
          FROM frames f LEFT JOIN (SELECT video_id, sum(length) AS total, count(*) AS n, arg_max(lat1, idx) AS lat, arg_max(lng1, idx) AS lng FROM legs GROUP BY ALL) t USING (video_id)) a
        ASOF LEFT JOIN (SELECT * FROM legs WHERE length > 0) l ON a.video_id = l.video_id AND a.at <= l."end" """,
        "frames",
        route=ROUTE,
        legs=LEGS,
    ),
)
def w1_locate(spark, sf):
    asked = B.frames(spark, sf).select("video_id", "event_id", (F.col("value") / 500).alias("fraction"))
    found = W.locate_on_route(asked, route(spark, sf), ["video_id"], "fraction", "event_id", huge=B.huge_videos(spark, sf))
    return found.select("video_id", "event_id", F.bround("lat", 6).alias("lat"), F.bround("lng", 6).alias("lng"), "segment_index")


@query(
    "w1_playback_point",
    sql(
        """SELECT f.event_id, CAST(least(n - 1, floor((CASE WHEN video_id % 2 = 0 THEN p ELSE 1 - p END) * (n - 1) + 0.5)) AS BIGINT) AS idx
        FROM (SELECT *, value / 500 AS p FROM frames) f JOIN (SELECT video_id, count(*) AS n FROM frames GROUP BY ALL) USING (video_id)""",
        "frames",
    ),
)
def w1_playback(spark, sf):
    videos = B.videos(spark, sf).select("video_id", "direction", F.col("rows").alias("n"))
    joined = B.frames(spark, sf).join(videos, "video_id")
    return joined.select("event_id", W.playback_index(F.col("value") / 500, F.col("n"), F.col("direction")).alias("idx"))


PAIRS = """SELECT video_id, video_id // 4 AS mission_id, frame_index + 1 AS step, ((event_id * 17 % 1000) / 1000.0::DOUBLE - 0.5::DOUBLE) * 0.8::DOUBLE AS yaw_delta, value / 50 AS flow, event_id % 120 AS matches, event_id % 40 AS inliers FROM frames"""


def pairs(spark, sf):
    e = F.col("event_id")
    return B.frames(spark, sf).select(
        "video_id", F.expr("video_id div 4").alias("mission_id"), (F.col("frame_index") + 1).alias("step"),
        (((e * 17 % 1000) / F.lit(1000.0) - 0.5) * 0.8).alias("yaw_delta"), (F.col("value") / 50).alias("flow"), (e % 120).alias("matches"), (e % 40).alias("inliers"),
    )


WALK = {
    "pairs": PAIRS,
    "turned": """SELECT *, matches >= 12 AND flow >= 0.35 AND inliers >= 10 AS seen, sum(CASE WHEN matches >= 12 AND flow >= 0.35 AND inliers >= 10 THEN greatest(-0.28::DOUBLE, least(0.28::DOUBLE, yaw_delta)) ELSE 0 END) OVER (PARTITION BY video_id ORDER BY step) AS yaw FROM pairs""",
    "steps": """SELECT video_id, step, sum(CASE WHEN seen THEN sin(yaw) ELSE 0 END) OVER w AS x, sum(CASE WHEN seen THEN cos(yaw) ELSE 0 END) OVER w AS y FROM turned WINDOW w AS (PARTITION BY video_id ORDER BY step)
        UNION ALL SELECT DISTINCT video_id, 0, 0.0, 0.0 FROM pairs""",
    "walk": """SELECT video_id, video_id // 4 AS mission_id, CASE WHEN video_id % 2 = 1 THEN max(step) OVER (PARTITION BY video_id) - step ELSE step END AS idx, x, y FROM steps""",
}


def walk(spark, sf):
    directions = B.walks(spark, sf)
    return W.integrate_motion(pairs(spark, sf), directions, huge=B.huge_videos(spark, sf)).withColumn("mission_id", F.expr("video_id div 4"))


@query("w12_integrate_motion", sql("SELECT video_id, idx, round_even(x, 6) + 0.0 AS x, round_even(y, 6) + 0.0 AS y FROM walk", "frames", **WALK))
def w12(spark, sf):
    return walk(spark, sf).select("video_id", "idx", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"))


QUALITY = """SELECT video_id, mission_id, count(*) FILTER (matches >= 12 AND flow >= 0.35 AND inliers >= 10) / count(*) AS tracked_fraction,
    avg(CASE WHEN matches >= 12 THEN least(1, inliers / 45) * least(1, matches / 80) ELSE 0 END) AS mean_pair_quality, quantile_cont(matches, 0.5) AS median_matches, quantile_cont(inliers, 0.5) AS median_inliers FROM pairs GROUP BY ALL"""


@query("a33_traversal_quality", sql("SELECT video_id, round_even(tracked_fraction, 6) AS tracked_fraction, round_even(mean_pair_quality, 6) AS mean_pair_quality, median_matches, median_inliers FROM q", "frames", pairs=PAIRS, q=QUALITY))
def a33(spark, sf):
    q = W.traversal_quality(pairs(spark, sf))
    return q.select("video_id", F.bround("tracked_fraction", 6).alias("tracked_fraction"), F.bround("mean_pair_quality", 6).alias("mean_pair_quality"), "median_matches", "median_inliers")


@query(
    "a33_mission_quality",
    sql(
        """SELECT mission_id, count(*) AS traversals_aligned, round_even(avg(tracked_fraction), 3) AS tracked_frame_fraction, round_even(quantile_cont(median_matches, 0.5), 1) AS median_stable_matches,
        round_even(quantile_cont(median_inliers, 0.5), 1) AS median_pose_inliers, round_even(avg(mean_pair_quality), 6) AS mean_pair_quality FROM q GROUP BY ALL""",
        "frames",
        pairs=PAIRS,
        q=QUALITY,
    ),
)
def a33_mission(spark, sf):
    q = W.traversal_quality(pairs(spark, sf)).withColumn("mission_id", F.expr("video_id div 4"))
    return W.mission_quality(q).withColumn("mean_pair_quality", F.bround("mean_pair_quality", 6))


ANCHOR = WALK | {
    "ends": """SELECT video_id, arg_min(x, idx) AS ax, arg_min(y, idx) AS ay, arg_max(x, idx) - arg_min(x, idx) AS dx, arg_max(y, idx) - arg_min(y, idx) AS dy, count(*) AS n FROM walk GROUP BY ALL""",
    "turn": """SELECT *, sqrt(dx * dx + dy * dy) < greatest(2, n * 0.03) AS weak, CASE WHEN sqrt(dx * dx + dy * dy) < greatest(2, n * 0.03) THEN dy + n - 1 ELSE dy END AS vy FROM ends""",
    "anchored": """SELECT w.video_id, w.mission_id, w.idx, ((x - ax) * cos(atan2(dx, vy)) - (y - ay + CASE WHEN weak THEN idx ELSE 0 END) * sin(atan2(dx, vy))) * (100 + w.mission_id) / greatest(1e-6, dx * sin(atan2(dx, vy)) + vy * cos(atan2(dx, vy))) AS x,
        ((x - ax) * sin(atan2(dx, vy)) + (y - ay + CASE WHEN weak THEN idx ELSE 0 END) * cos(atan2(dx, vy))) * (100 + w.mission_id) / greatest(1e-6, dx * sin(atan2(dx, vy)) + vy * cos(atan2(dx, vy))) AS y
        FROM walk w JOIN turn USING (video_id)""",
}


def anchored(spark, sf):
    lengths = B.walks(spark, sf).select("video_id", (100.0 + F.expr("video_id div 4")).alias("target_length"))
    return W.anchor(walk(spark, sf).drop("mission_id"), lengths, huge=B.huge_videos(spark, sf)).withColumn("mission_id", F.expr("video_id div 4"))


GEO = """lat AS lat, lng AS lng FROM (SELECT *, 48 + m / 1000.0 AS slat, 8.0 AS slng, 48.01 + m / 1000.0 AS elat, 8.02 AS elng FROM src)"""


def missions(spark, sf):
    m = F.expr("video_id div 4")
    return B.walks(spark, sf).select(m.alias("mission_id")).distinct().select(
        "mission_id", (48.0 + F.col("mission_id") / F.lit(1000.0)).alias("start_lat"), F.lit(8.0).alias("start_lng"),
        (48.01 + F.col("mission_id") / F.lit(1000.0)).alias("end_lat"), F.lit(8.02).alias("end_lng"),
    )


@query(
    "m17_anchor_and_georeference",
    sql(
        """SELECT video_id, idx, round_even(x, 4) + 0.0 AS x, round_even(y, 4) + 0.0 AS y,
          round_even(slat + (y * cos(b) - x * sin(b)) / 110540, 7) AS lat, round_even(8.0 + (y * sin(b) + x * cos(b)) / (111320 * mid), 7) AS lng FROM (
          SELECT *, atan2((8.02::DOUBLE - 8.0::DOUBLE) * 111320 * mid, (elat - slat) * 110540) AS b FROM (
            SELECT *, cos(radians((slat + elat) / 2)) AS mid FROM (SELECT *, 48.0::DOUBLE + mission_id / 1000.0::DOUBLE AS slat, 48.01::DOUBLE + mission_id / 1000.0::DOUBLE AS elat FROM anchored)))""",
        "frames",
        **ANCHOR,
    ),
)
def m17(spark, sf):
    geo = W.to_geo(anchored(spark, sf), missions(spark, sf))
    return geo.select("video_id", "idx", F.bround("x", 4).alias("x"), F.bround("y", 4).alias("y"), F.bround("lat", 7).alias("lat"), F.bround("lng", 7).alias("lng"))


RESAMPLED = ANCHOR | {
    # Sums of a window are no running sums there: their roundings may go back by a bit, positions must not.
    "along": """SELECT *, max(s) OVER (PARTITION BY video_id ORDER BY idx) AS pos FROM (SELECT *, sum(d) OVER (PARTITION BY video_id ORDER BY idx) AS s FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM anchored WINDOW w AS (PARTITION BY video_id ORDER BY idx)))""",
    "targets": "SELECT video_id, mission_id, unnest(range(64)) AS i, total, total * unnest(range(64)) / 63 AS pos FROM (SELECT video_id, mission_id, max(pos) AS total FROM along GROUP BY ALL)",
    "knots": "SELECT *, lead(pos) OVER w AS at2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM along WINDOW w AS (PARTITION BY video_id ORDER BY idx)",
    "lines": """SELECT t.video_id, t.mission_id, t.i AS idx, CASE WHEN t.total < 1e-6 THEN t.i / 63 ELSE k.x + coalesce((k.x2 - k.x) * CASE WHEN k.at2 > k.pos THEN least(1, (t.pos - k.pos) / (k.at2 - k.pos)) ELSE 0 END, 0) END AS x,
        CASE WHEN t.total < 1e-6 THEN 0.0 ELSE k.y + coalesce((k.y2 - k.y) * CASE WHEN k.at2 > k.pos THEN least(1, (t.pos - k.pos) / (k.at2 - k.pos)) ELSE 0 END, 0) END AS y FROM targets t ASOF JOIN (SELECT * FROM knots WHERE at2 > pos OR at2 IS NULL) k ON t.video_id = k.video_id AND t.pos >= k.pos""",
}


def lines(spark, sf):
    return W.resample(anchored(spark, sf), ["video_id"], huge=B.huge_videos(spark, sf)).withColumn("mission_id", F.expr("video_id div 4"))


@query("w13_resample", sql("SELECT video_id, idx, round_even(x, 4) + 0.0 AS x, round_even(y, 4) + 0.0 AS y FROM lines", "frames", **RESAMPLED))
def w13(spark, sf):
    return lines(spark, sf).select("video_id", "idx", F.bround("x", 4).alias("x"), F.bround("y", 4).alias("y"))


FUSED = RESAMPLED | {
    "middle": "SELECT mission_id, idx, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM lines GROUP BY ALL",
    "fused": "SELECT m.mission_id, m.idx, m.x, m.y, sqrt(avg(pow(l.x - m.x, 2) + pow(l.y - m.y, 2))) AS spread FROM lines l JOIN middle m USING (mission_id, idx) GROUP BY ALL",
}


def fused(spark, sf):
    return W.fuse_traversals(lines(spark, sf))


@query("a25_fuse_traversals", sql("SELECT mission_id, idx, round_even(x, 4) + 0.0 AS x, round_even(y, 4) + 0.0 AS y, round_even(spread, 4) AS spread FROM fused", "frames", **FUSED))
def a25(spark, sf):
    return fused(spark, sf).select("mission_id", "idx", *[F.bround(c, 4).alias(c) for c in ("x", "y", "spread")])


@query(
    "w14_abrupt_turns",
    sql(
        """SELECT video_id, count(*) FILTER (abs(c - 2 * pi() * floor((c + pi()) / (2 * pi()))) > radians(50)) AS abrupt_turns FROM (
          SELECT video_id, h - lag(h) OVER (PARTITION BY video_id ORDER BY idx) AS c FROM (
            SELECT video_id, idx, atan2(x - lag(x) OVER w, y - lag(y) OVER w) AS h FROM (SELECT video_id, idx, lat AS x, lng AS y FROM route) WINDOW w AS (PARTITION BY video_id ORDER BY idx)) WHERE h IS NOT NULL) GROUP BY ALL""",
        "frames",
        route=ROUTE,
    ),
)
def w14(spark, sf):
    points = route(spark, sf).select("video_id", "idx", F.col("lat").alias("x"), F.col("lng").alias("y"))
    return W.abrupt_turns(points, ["video_id"], huge=B.huge_videos(spark, sf))


@query(
    "w15_monotonic_evidence",
    sql(
        """SELECT mission_id, bool_and(coalesce(CASE WHEN video_id % 2 = 1 THEN b >= rf ELSE b <= rf END, true)) AS monotonic FROM (
          SELECT *, video_id // 4 AS mission_id, lag(rf) OVER (PARTITION BY video_id ORDER BY timestamp_ms, event_id) AS b FROM (
            SELECT *, CASE WHEN video_id % 2 = 0 THEN frame_index WHEN (video_id // 4) % 3 = 0 THEN 1000 - frame_index ELSE frame_index END / 1000.0::DOUBLE AS rf FROM frames)) GROUP BY ALL""",
        "frames",
    ),
)
def w15(spark, sf):
    v, i = F.col("video_id"), F.col("frame_index")
    fraction = F.when(v % 2 == 0, i).when(F.expr("video_id div 4") % 3 == 0, 1000 - i).otherwise(i) / F.lit(1000.0)
    keyframes = B.frames(spark, sf).select("video_id", "timestamp_ms", F.col("event_id").alias("keyframe_id"), fraction.alias("route_fraction"))
    videos = B.videos(spark, sf).withColumn("mission_id", F.expr("video_id div 4"))
    return W.monotonic_evidence(keyframes, videos, huge=B.huge_videos(spark, sf))


@query(
    "j14_traversal_pair_rmse",
    sql("SELECT a.mission_id, a.video_id AS a, b.video_id AS b, round_even(sqrt(avg(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 3) AS rmse FROM lines a JOIN lines b ON a.mission_id = b.mission_id AND a.idx = b.idx AND a.video_id < b.video_id GROUP BY ALL", "frames", **RESAMPLED),
)
def j14(spark, sf):
    return W.traversal_pair_rmse(lines(spark, sf)).withColumn("rmse", F.bround("rmse", 3))


@query(
    "a34_fused_route_metrics",
    sql(
        """SELECT mission_id, round_even(sum(d), 2) AS route_length_m, round_even(max(abs(x - (x0 + (x1 - x0) * idx / 63))), 3) AS max_curve_deviation_m, 0.0 AS start_anchor_error_m, 0.0 AS end_anchor_error_m FROM (
          SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d, first_value(x) OVER w AS x0, last_value(x) OVER (PARTITION BY mission_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x1
          FROM fused WINDOW w AS (PARTITION BY mission_id ORDER BY idx)) GROUP BY ALL""",
        "frames",
        **FUSED,
    ),
)
def a34(spark, sf):
    return W.fused_route_metrics(fused(spark, sf))


@query(
    "m16_segment_confidence",
    sql(
        """SELECT mission_id, idx AS segment, round_even(c, 3) AS confidence, CASE WHEN c >= 0.7 THEN 'secure' WHEN c >= 0.42 THEN 'uncertain' ELSE 'not_reconstructed' END AS status, round_even(spread, 3) AS spread_m FROM (
          SELECT *, greatest(0, least(1, 0.25 + 0.45 * mpq + 0.3 * greatest(0, 1 - spread / greatest(1, (100 + mission_id) * 0.08)))) AS c
          FROM fused JOIN (SELECT mission_id, avg(mean_pair_quality) AS mpq FROM q GROUP BY ALL) USING (mission_id) WHERE idx < 63)""",
        "frames",
        **FUSED,
        q=QUALITY,
    ),
)
def m16(spark, sf):
    quality = W.traversal_quality(pairs(spark, sf)).withColumn("mission_id", F.expr("video_id div 4"))
    lengths = missions(spark, sf).select("mission_id", (100.0 + F.col("mission_id")).alias("target_length"))
    return W.segment_confidence(fused(spark, sf), W.mission_quality(quality), lengths)


@query(
    "j13_nearest_evidence",
    sql(
        f"""SELECT mission_id, segment, keyframe_id, CAST(rank AS INTEGER) AS rank FROM (
          SELECT k.mission_id, s.segment, k.event_id AS keyframe_id, row_number() OVER (PARTITION BY k.mission_id, s.segment ORDER BY abs(k.rf - s.fraction), k.event_id) AS rank
          FROM (SELECT video_id // 4 AS mission_id, event_id, {even('value / 500', 2)} AS rf FROM frames) k, (SELECT i AS segment, (i + 0.5::DOUBLE) / 63 AS fraction FROM range(63) t(i)) s) WHERE rank <= 2""",
        "frames",
    ),
)
def j13(spark, sf):
    keyframes = B.frames(spark, sf).select(
        F.expr("video_id div 4").alias("mission_id"), F.col("event_id").alias("keyframe_id"), F.col("event_id").alias("seq"), F.bround(F.col("value") / 500, 2).alias("route_fraction")
    )
    segments = missions(spark, sf).select("mission_id", F.explode(F.expr("sequence(0L, 62L)")).alias("segment")).withColumn("fraction", (F.col("segment") + 0.5) / 63)
    return W.nearest_evidence(segments, keyframes, huge=B.huge_videos(spark, sf))


CORRIDOR_ROWS = {
    "lanes": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c!r}::DOUBLE, {need})" for n, a, b, c, need in C.strips(WIDTH, HEIGHT, 1.2, 0.1, 4.0)) + ") t(corridor, a, b, clip, need)",
    "rows_": """SELECT g.video_id, g.frame_index, l.corridor, g.y, l.clip, l.need, max(CASE WHEN f.x0 IS NOT NULL AND least(f.x1, l.b) > greatest(f.x0, l.a) THEN {'len': least(f.x1, l.b) - greatest(f.x0, l.a), 'neg': -greatest(f.x0, l.a)} END) AS f
        FROM (SELECT DISTINCT video_id, frame_index, y FROM grid WHERE y >= 7) g CROSS JOIN lanes l LEFT JOIN free f ON f.video_id = g.video_id AND f.frame_index = g.frame_index AND f.y = g.y GROUP BY ALL""",
    "states": """SELECT *, CASE WHEN clip > 0.2 THEN 'uncertain' WHEN f.len >= need THEN 'free' ELSE 'blocked' END AS st FROM rows_""",
    "corr": """SELECT video_id, frame_index, corridor, count(*) AS evaluated, count(*) FILTER (st = 'free') AS free, count(*) FILTER (st = 'uncertain') AS uncertain, count(*) FILTER (st = 'blocked') AS blocked, 0 AS undecided,
        count(*) FILTER (st <> 'blocked' AND f IS NOT NULL) AS drivable_rows, CASE WHEN count(*) FILTER (st = 'blocked') > 0.05 * count(*) THEN 'blocked' WHEN count(*) FILTER (st = 'blocked') > 0 OR count(*) FILTER (st = 'uncertain') > 0 THEN 'uncertain' ELSE 'free' END AS status
        FROM states GROUP BY ALL""",
}


def open_ground(spark, sf):
    """The clean-up of the dense mask: wide enough for a vehicle in places."""
    return R.clean_mask(B.mask_blob(spark, sf), WIDTH, HEIGHT, RASTER)


def corridors(spark, sf):
    return C.evaluate_corridors(open_ground(spark, sf), B.raster_frames(spark, sf), WIDTH, HEIGHT, key=RASTER)


def _clean(mask: str = "mb"):
    from fieldspark.plans.q_masks import clean_sql

    return clean_sql(mask)


@query("g7_evaluate_corridors", sql("SELECT * FROM corr", "mb", **_clean(), free=runs_sql("cleaned"), **CORRIDOR_ROWS))
def g7(spark, sf):
    return corridors(spark, sf).drop("points")


GRADED_ROWS = {
    "lanes": CORRIDOR_ROWS["lanes"],
    "fr": runs_sql("(SELECT *, CASE WHEN v IN (1, 2) THEN 1 ELSE 0 END AS w FROM graded)", "w", "w = 1"),
    "us": runs_sql("(SELECT *, CASE WHEN v IN (1, 2, 3, 4) THEN 1 ELSE 0 END AS w FROM graded)", "w", "w = 1"),
    "cut": """SELECT kind, r.video_id, r.frame_index, r.y, l.corridor, least(r.x1, l.b) - greatest(r.x0, l.a) AS len, greatest(r.x0, l.a) AS x0
        FROM (SELECT 0 AS kind, video_id, frame_index, y, x0, x1 FROM fr UNION ALL SELECT 1, video_id, frame_index, y, x0, x1 FROM us UNION ALL SELECT 2, video_id, frame_index, y, x, x + 1 FROM graded WHERE v <> 0) r
        JOIN lanes l ON least(r.x1, l.b) > greatest(r.x0, l.a)""",
    "rows_": """SELECT g.video_id, g.frame_index, l.corridor, g.y, l.clip, l.need, max(len) FILTER (kind = 0) AS f, max(len) FILTER (kind = 1) AS u, count(*) FILTER (kind = 2) AS d
        FROM (SELECT DISTINCT video_id, frame_index, y FROM grid WHERE y >= 7) g CROSS JOIN lanes l LEFT JOIN cut c ON c.video_id = g.video_id AND c.frame_index = g.frame_index AND c.y = g.y AND c.corridor = l.corridor GROUP BY ALL""",
    "states": "SELECT *, CASE WHEN d = 0 THEN NULL WHEN clip > 0.2 THEN 'uncertain' WHEN f >= need THEN 'free' WHEN u >= need THEN 'uncertain' ELSE 'blocked' END AS st FROM rows_",
    "counted": """SELECT video_id, frame_index, corridor, count(st) AS evaluated, count(*) FILTER (st = 'free') AS free, count(*) FILTER (st = 'uncertain') AS uncertain, count(*) FILTER (st = 'blocked') AS blocked,
        count(*) FILTER (st IS NULL) AS undecided, count(*) FILTER ((st = 'free' AND f IS NOT NULL) OR (st = 'uncertain' AND u IS NOT NULL)) AS drivable_rows FROM states GROUP BY ALL""",
}


@query(
    "g7_graded_corridors",
    sql(
        f"""SELECT *, CASE WHEN evaluated < {C.MIN_ROWS} THEN 'uncertain' WHEN blocked > {C.MAX_BLOCKED} * evaluated THEN 'blocked' WHEN blocked > 0 OR uncertain > 0 THEN 'uncertain' ELSE 'free' END AS status FROM counted""",
        "mp", **_clean("mp"), marg="SELECT video_id, frame_index, y, x, s / 1.0 * 4 AS m FROM pix", **GRADE, **GRADED_ROWS,
    ),
)
def g7_graded(spark, sf):
    """Corridors over the six grades instead of a plain mask."""
    scores = B.pix(spark, sf).withColumn("score", F.col("s") * 4)
    grades = T.grade(scores, R.clean_mask(B.mask_p(spark, sf), WIDTH, HEIGHT, RASTER), 0.0, WIDTH, HEIGHT, RASTER)
    return C.evaluate_corridors(grades, B.raster_frames(spark, sf), WIDTH, HEIGHT, True, key=RASTER).drop("points")


SMOOTH = {
    "drv": "SELECT *, -f.neg + (f.len - 1) / 2 AS c, row_number() OVER (PARTITION BY video_id, frame_index, corridor ORDER BY y) - 1 AS i, count(*) OVER (PARTITION BY video_id, frame_index, corridor) AS n FROM states WHERE st <> 'blocked' AND f IS NOT NULL",
    "smooth": """SELECT a.video_id, a.frame_index, a.corridor, a.y, CASE WHEN any_value(a.n) < 3 THEN any_value(a.c) ELSE sum(b.c) / 9 END AS c FROM (SELECT *, unnest(range(-4, 5)) AS o FROM drv) a
        JOIN drv b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND a.corridor = b.corridor AND b.i = greatest(0, least(a.n - 1, a.i + a.o)) GROUP BY ALL""",
}


@query(
    "w6_moving_average",
    sql("SELECT video_id, frame_index, corridor, CAST(y AS INTEGER) AS y, round_even(c, 5) AS centre FROM smooth", "mb", **_clean(), free=runs_sql("cleaned"), **CORRIDOR_ROWS, **SMOOTH),
)
def w6(spark, sf):
    rows = C.evaluate_rows(open_ground(spark, sf), B.raster_frames(spark, sf), WIDTH, HEIGHT, False, 1.2, 0.1, 4.0, RASTER)
    by = [*RASTER, "corridor"]
    smooth = C.moving_average(rows.where(F.col("centre").isNotNull()), by, "y", "centre")
    return smooth.select(*by, "y", F.bround("centre", 5).alias("centre"))


@query(
    "t6_propose_corridor",
    sql(
        """SELECT video_id, frame_index, corridor, status FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY list_position(['free', 'uncertain', 'blocked'], status), list_position(['mitte', 'rechts', 'links'], corridor)) AS k
        FROM corr WHERE drivable_rows > 0) WHERE k = 1""",
        "mb",
        **_clean(),
        free=runs_sql("cleaned"),
        **CORRIDOR_ROWS,
    ),
)
def t6(spark, sf):
    return C.propose_corridor(corridors(spark, sf), RASTER).drop("points")


@query(
    "w19_thin_points",
    sql(
        """SELECT video_id, frame_index FROM (SELECT *, count(*) OVER (PARTITION BY video_id, frame_index // 400) AS n FROM frames) WHERE n <= 9 OR list_contains([CAST(floor(k * (n - 1) / 8 + 0.5) AS BIGINT) FOR k IN range(9)], frame_index % 400)""",
        "frames",
    ),
)
def w19(spark, sf):
    # A planned line has at most 400 points: every 400 frames of a video form one.
    lines_ = B.frames(spark, sf).select(*RASTER, F.expr("frame_index div 400").alias("line"))
    return C.thin_points(lines_, ["video_id", "line"], "frame_index", 9).drop("line")


@query(
    "k5_geojson_lines",
    sql(
        """SELECT video_id, part, '{"type":"Feature","properties":{"video_id":' || video_id || ',"part":' || part || '},"geometry":{"type":"LineString","coordinates":[' || string_agg('[' || x || ',' || y || ']', ',' ORDER BY idx) || ']}}' AS feature FROM (
        SELECT video_id, frame_index // 64 AS part, frame_index AS idx, event_id * 37 % 1000 AS x, event_id * 91 % 1000 AS y FROM frames) GROUP BY video_id, part""",
        "frames",
    ),
)
def k5(spark, sf):
    e = F.col("event_id")
    points = B.frames(spark, sf).select("video_id", F.expr("frame_index div 64").alias("part"), F.col("frame_index").alias("idx"), (e * 37 % 1000).alias("lng"), (e * 91 % 1000).alias("lat"))
    return W.geojson_lines(points, ["video_id", "part"])
