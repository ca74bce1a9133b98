"""Queries on pixel features, grades and terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import colour
from fieldspark.operators import pixels as X
from fieldspark.operators import runs as R
from fieldspark.operators import terrain as T
from fieldspark.plans import bindings as B
from fieldspark.plans.bindings import HEIGHT, RASTER, WIDTH, sql
from fieldspark.plans.catalog import query
from fieldspark.session import cut_lineage
from fieldspark.plans.q_masks import COMPONENTS, clean_sql, runs_sql, window_sql

L8, A8, B8 = colour.lab()
COLOUR = {
    "col0": f"SELECT *, {colour.GRAY} AS gray, {colour.HUE} AS hue, {colour.SATURATION} AS sat, {colour.VALUE} AS val, {colour.XYZ['lx']} AS lx, {colour.XYZ['ly']} AS ly, {colour.XYZ['lz']} AS lz FROM rgb",
    "col": f"SELECT *, {L8} AS lab_l8, {A8} AS lab_a8, {B8} AS lab_b8 FROM col0",
}
FRAME = "PARTITION BY video_id, frame_index"


def box_sql(source: str, column: str, k: int, out: str) -> dict[str, str]:
    """k × k mean with mirrored borders, dense form."""
    r = k // 2
    mirror = lambda axis, n: f"[{axis}] || CASE WHEN {axis} BETWEEN 1 AND {r} THEN [-{axis}] ELSE [] END || CASE WHEN {axis} BETWEEN {n - 1 - r} AND {n - 2} THEN [2 * {n - 1} - {axis}] ELSE [] END"
    return {
        f"{out}_h": f"""SELECT * FROM (SELECT video_id, frame_index, y, x, avg(v) OVER ({FRAME}, y ORDER BY x RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v
            FROM (SELECT video_id, frame_index, y, unnest({mirror('x', WIDTH)}) AS x, {column} AS v FROM {source})) WHERE x BETWEEN 0 AND {WIDTH - 1}""",
        out: f"""SELECT * FROM (SELECT video_id, frame_index, y, x, avg(v) OVER ({FRAME}, x ORDER BY y RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {out}
            FROM (SELECT video_id, frame_index, x, unnest({mirror('y', HEIGHT)}) AS y, v FROM {out}_h)) WHERE y BETWEEN 0 AND {HEIGHT - 1}""",
    }


@query("w7_box_mean", sql("SELECT video_id, frame_index, y, x, round_even(bm, 9) + 0.0 AS local_mean FROM bm", "pix", **box_sql("pix", "s", 9, "bm")))
def w7(spark, sf):
    return X.box_mean(B.pix(spark, sf), {"s": "local_mean"}, 9, WIDTH, HEIGHT, RASTER).select(*RASTER, "y", "x", F.bround("local_mean", 9).alias("local_mean"))


@query(
    "w7_local_std",
    sql(
        "SELECT video_id, frame_index, y, x, round_even(sqrt(greatest(0, q - m * m)), 6) AS local_std FROM m JOIN q USING (video_id, frame_index, y, x)",
        "pix",
        sq="SELECT *, s * s AS s2 FROM pix",
        **box_sql("pix", "s", 9, "m"),
        **box_sql("sq", "s2", 9, "q"),
    ),
)
def w7_std(spark, sf):
    return X.local_std(B.pix(spark, sf), "s", 9, WIDTH, HEIGHT, RASTER).select(*RASTER, "y", "x", F.bround("local_std", 6).alias("local_std"))


def sobel_sql(source: str, column: str) -> dict[str, str]:
    return {
        "sv": f"""SELECT *, coalesce(lag({column}) OVER d, lead({column}) OVER d) AS up, coalesce(lead({column}) OVER d, lag({column}) OVER d) AS low FROM {source} WINDOW d AS ({FRAME}, x ORDER BY y)""",
        "sw": f"SELECT *, up + 2 * {column} + low AS sm, low - up AS df FROM sv",
        "sob": f"""SELECT * EXCLUDE (up, low, sm, df), coalesce(lead(sm) OVER a, lag(sm) OVER a) - coalesce(lag(sm) OVER a, lead(sm) OVER a) AS gx,
            coalesce(lag(df) OVER a, lead(df) OVER a) + 2 * df + coalesce(lead(df) OVER a, lag(df) OVER a) AS gy FROM sw WINDOW a AS ({FRAME}, y ORDER BY x)""",
    }


@query(
    "w8_gradient",
    sql("SELECT video_id, frame_index, y, x, round_even(least(1, sqrt(gx * gx + gy * gy)), 6) AS gradient FROM sob", "pix", **sobel_sql("pix", "s")),
)
def w8(spark, sf):
    return X.gradient(B.pix(spark, sf), "s", RASTER).select(*RASTER, "y", "x", F.bround("gradient", 6).alias("gradient"))


LAPLACE = """SELECT *, coalesce(lag({c}) OVER a, lead({c}) OVER a) + coalesce(lead({c}) OVER a, lag({c}) OVER a) + coalesce(lag({c}) OVER d, lead({c}) OVER d) + coalesce(lead({c}) OVER d, lag({c}) OVER d) - 4 * {c} AS lap
    FROM {t} WINDOW a AS (PARTITION BY video_id, frame_index, y ORDER BY x), d AS (PARTITION BY video_id, frame_index, x ORDER BY y)"""


@query("a21_sharpness", sql("SELECT video_id, frame_index, round_even(var_pop(lap), 4) AS sharpness FROM lp GROUP BY ALL", "rgb", **COLOUR, lp=LAPLACE.format(c="gray", t="col")))
def a21(spark, sf):
    return X.sharpness(X.add_colour(B.rgb(spark, sf)), "gray", RASTER).withColumn("sharpness", F.bround("sharpness", 4))


FEATURES = COLOUR | {"gr": "SELECT *, gray / 255 AS g1, gray / 255 * (gray / 255) AS g2 FROM col"} | sobel_sql("gr", "g1") | box_sql("gr", "g1", 9, "bm") | box_sql("gr", "g2", 9, "bq") | {
    "feat": """SELECT s.video_id, s.frame_index, s.y, s.x, b / 255 AS blue, g / 255 AS green, r / 255 AS red, sin(hue * (2 * pi() / 180)) AS sin_hue, cos(hue * (2 * pi() / 180)) AS cos_hue,
        sat / 255 AS saturation, val / 255 AS value, lab_l8 / 255 AS lab_l, lab_a8 / 255 AS lab_a, lab_b8 / 255 AS lab_b, least(1, greatest(-1, (2 * g - r - b) / 255)) AS excess_green,
        least(1, sqrt(gx * gx + gy * gy)) AS gradient, bm AS local_mean, sqrt(greatest(0, bq - bm * bm)) AS local_std, s.x / 63 AS px, s.y / 15 AS py, (s.x / 63) * (s.x / 63) AS px2, (s.y / 15) * (s.y / 15) AS py2,
        abs(s.x / 63 - 0.5::DOUBLE) AS centre_distance, g / 255 * (s.y / 15) AS green_y, sat / 255 * (s.y / 15) AS saturation_y, val / 255 * (s.y / 15) AS value_y
        FROM sob s JOIN bm USING (video_id, frame_index, y, x) JOIN bq USING (video_id, frame_index, y, x)"""
}


@query("m1_pixel_features", sql("SELECT video_id, frame_index, y, x, " + ", ".join(f"round_even({c}, 5) + 0.0 AS {c}" for c in X.FEATURES) + " FROM feat", "rgb", **FEATURES))
def m1(spark, sf):
    named = X.feature_columns(B.rgb(spark, sf), WIDTH, HEIGHT, RASTER)
    return named.select(*RASTER, "y", "x", *[F.bround(c, 5).alias(c) for c in X.FEATURES])


CELL = "CASE WHEN y < 6 THEN 0 WHEN y < 11 THEN 1 ELSE 2 END * 3 + CASE WHEN x < 22 THEN 0 WHEN x < 43 THEN 1 ELSE 2 END"


@query(
    "a19_grid_descriptor",
    sql(
        f"SELECT video_id, frame_index, CAST({CELL} AS INTEGER) AS cell, " + ", ".join(f"round_even(avg({c}), 5) + 0.0 AS mean_{c}, round_even(stddev_pop({c}), 5) + 0.0 AS std_{c}" for c in X.DESCRIPTOR) + " FROM feat GROUP BY ALL",
        "rgb",
        **FEATURES,
    ),
)
def a19(spark, sf):
    cells = X.grid_statistics(B.rgb(spark, sf), WIDTH, HEIGHT, 3, RASTER)
    return cells.select(*RASTER, "cell", *[F.bround(f"{k}_{c}", 5).alias(f"{k}_{c}") for c in X.DESCRIPTOR for k in ("mean", "std")])


@query(
    "a20_colour_ratios",
    sql(
        f"""SELECT video_id, frame_index, round_even(avg(CASE WHEN {colour.in_box(colour.VEGETATION_HSV)} THEN 1 ELSE 0 END), 4) AS vegetation_ratio,
        round_even(avg(CASE WHEN y >= 8 THEN CASE WHEN {colour.in_box(colour.GROUND_HSV)} THEN 1 ELSE 0 END END), 4) AS ground_ratio_lower, round_even(avg(val) / 255, 4) AS brightness FROM col GROUP BY ALL""",
        "rgb",
        **COLOUR,
    ),
)
def a20(spark, sf):
    return X.colour_ratios(B.rgb(spark, sf), HEIGHT, RASTER)


@query(
    "a17_feature_moments",
    sql("UNPIVOT_PLACEHOLDER", "rgb", **FEATURES).replace(
        "UNPIVOT_PLACEHOLDER", " UNION ALL ".join(f"SELECT '{c}' AS feature, round_even(avg({c}), 6) + 0.0 AS mean, round_even(CASE WHEN stddev_pop({c}) < 1e-5 THEN 1 ELSE stddev_pop({c}) END, 6) AS scale FROM feat" for c in X.FEATURES)
    ),
)
def a17(spark, sf):
    from fieldspark.operators.kernel import feature_moments

    moments = feature_moments(X.feature_columns(B.rgb(spark, sf), WIDTH, HEIGHT, RASTER), X.FEATURES)
    return moments.select("feature", F.bround("mean", 6).alias("mean"), F.bround("scale", 6).alias("scale"))


def _zone(name: str) -> str:
    spec = {"roi": (0.34, 0.98, 0.42, 0.58, 0.08, 0.92), "prior": (0.40, 1.0, 0.46, 0.54, 0.24, 0.76)}[name]
    top, bottom, tl, tr, bl, br = (int(f * n) for f, n in zip(spec, (16, 16, 64, 64, 64, 64)))
    part = f"((y - {top}) / {bottom - top})"
    return f"(y BETWEEN {top} AND {bottom} AND x >= floor({tl} + ({bl} - {tl}) * {part} + 0.5) AND x <= floor({tr} + ({br} - {tr}) * {part} + 0.5))"


FLAGS = COLOUR | sobel_sql("col", "gray") | {
    "flg": f"""SELECT *, least(255, abs(gx)) AS vg, {_zone('roi')} AS roi, {_zone('prior')} AS centre, (gray < 16 OR gray > 248 OR (gray >= 170 AND sat <= 28)) AS extreme,
        {_zone('prior')} AND y >= 11 AND y < 15 AND NOT (gray < 16 OR gray > 248 OR (gray >= 170 AND sat <= 28)) AS seed, sat BETWEEN 60 AND 200 AS vegetation FROM sob"""
}


def flagged(spark, sf):
    """Pixels with colour, vertical gradient and the area flags."""
    frames = B.raster_frames(spark, sf)
    tasks = X.tasks_for(frames)
    px = X.vertical_gradient(X.add_colour(B.rgb(spark, sf).repartition(tasks, *RASTER)), RASTER, True)
    px = X.flag_pixels(X.flag_pixels(px, R.roi_runs(frames, RASTER), "roi", RASTER, tasks), R.centre_prior_runs(frames, RASTER), "centre", RASTER, tasks)
    y, h = F.col("y"), HEIGHT
    return px.withColumn("extreme", X.extreme(F.col("gray"), F.col("sat"))).withColumn("vegetation", F.col("sat").between(60, 200)).withColumn(
        "seed", F.col("centre") & (y >= round(h * 0.69)) & (y < round(h * 0.96)) & ~F.col("extreme")
    )


@query("a30_gradient_percentiles", sql("SELECT video_id, frame_index, greatest(45, floor(quantile_cont(vg, 0.88))) AS p88, round_even(greatest(55, quantile_cont(vg, 0.95)), 6) AS p95 FROM flg GROUP BY ALL", "rgb", **FLAGS))
def a30(spark, sf):
    return X.gradient_percentiles(X.vertical_gradient(X.add_colour(B.rgb(spark, sf)), RASTER), key=RASTER).withColumn("p95", F.bround("p95", 6))


PROTO = FLAGS | {
    "zones": """SELECT video_id, frame_index, CASE WHEN y > 12.8 THEN 'bottom' ELSE 'middle' END AS zone, median(lab_l8) AS l, median(lab_a8) AS a, median(lab_b8) AS b, count(*) AS n FROM flg WHERE seed GROUP BY ALL""",
    "proto": """SELECT video_id, frame_index, zone, l AS lab_l8, a AS lab_a8, b AS lab_b8 FROM zones WHERE n >= 30 UNION ALL
        SELECT video_id, frame_index, 'roi', coalesce(median(lab_l8) FILTER (roi), 128), coalesce(median(lab_a8) FILTER (roi), 128), coalesce(median(lab_b8) FILTER (roi), 128) FROM flg
        WHERE (video_id, frame_index) NOT IN (SELECT (video_id, frame_index) FROM zones WHERE n >= 30) GROUP BY ALL""",
}


@query("a29_prototype_colours", sql("SELECT * FROM proto", "rgb", **PROTO))
def a29(spark, sf):
    return X.prototype_colours(flagged(spark, sf), HEIGHT, 30, RASTER)


@query(
    "a35_visibility_score",
    sql(
        """SELECT video_id, frame_index, round_even(blur, 5) AS blur_score, round_even(1 - bad, 5) AS exposure_score, round_even(least(1, greatest(0, 0.78 * (1 - least(1, bad * 2.4)) + 0.22 * (1 - blur))), 5) AS visibility FROM (
        SELECT video_id, frame_index, least(1, greatest(0, (1800 - var_pop(lap)) / 1350)) AS blur, count(*) FILTER (extreme AND roi) / greatest(1, count(*) FILTER (roi)) AS bad FROM lp GROUP BY ALL)""",
        "rgb",
        **FLAGS,
        lp=LAPLACE.format(c="gray", t="flg"),
    ),
)
def a35(spark, sf):
    v = X.visibility_score(flagged(spark, sf), RASTER)
    return v.select(*RASTER, *[F.bround(c, 5).alias(c) for c in ("blur_score", "exposure_score", "visibility")])


GROUND = PROTO | {
    "pct": "SELECT video_id, frame_index, greatest(55, quantile_cont(vg, 0.95)) AS p95 FROM flg GROUP BY ALL",
    "near_": """SELECT f.*, p95, d FROM flg f JOIN pct USING (video_id, frame_index) JOIN (
        SELECT f.video_id, f.frame_index, f.y, f.x, min(sqrt(pow((f.lab_l8 - p.lab_l8) / 1.45, 2) + pow(f.lab_a8 - p.lab_a8, 2) + pow(f.lab_b8 - p.lab_b8, 2))) AS d
        FROM flg f JOIN proto p USING (video_id, frame_index) GROUP BY ALL) USING (video_id, frame_index, y, x)""",
    "gs": """SELECT *, 0.47 * exp(-pow(d / 58.0, 2)) + 0.2 * (1 - least(1, vg / p95)) + 0.17 * CASE WHEN centre THEN 1.0 ELSE 0.52 END + 0.1 * CASE WHEN extreme THEN 0 ELSE 1 END + 0.06 * CASE WHEN vegetation THEN 0.72 ELSE 1 END AS score FROM near_""",
}


def grounded(spark, sf):
    px = cut_lineage(flagged(spark, sf))
    return T.ground_score(px, X.prototype_colours(px, HEIGHT, 30, RASTER), X.gradient_percentiles(px, key=RASTER), RASTER)


@query("g11_ground_score", sql("SELECT video_id, frame_index, y, x, round_even(score, 6) AS ground_score FROM gs", "rgb", **GROUND))
def g11(spark, sf):
    return grounded(spark, sf).select(*RASTER, "y", "x", F.bround("ground_score", 6).alias("ground_score"))


GREEN = COLOUR | {
    "grn": f"""SELECT g.video_id, g.frame_index, g.y, g.x, CASE WHEN ({colour.in_box(colour.GREEN_HSV)}) OR (2 * c.g - c.r - c.b > 10 AND lab_a8 < 133) THEN 1 ELSE 0 END AS v
        FROM grid g LEFT JOIN col c USING (video_id, frame_index, y, x)""",
    "v1": window_sql("grn", "min", 3, 3),
    "v2": window_sql("v1", "max", 3, 3),
    "v3": window_sql("v2", "max", 5, 5),
    "veg": window_sql("v3", "min", 5, 5),
}


@query("g19_vegetation_runs", sql(runs_sql("veg"), "grid", "rgb", **GREEN))
def g19(spark, sf):
    return T.vegetation_runs(B.rgb(spark, sf), WIDTH, HEIGHT, RASTER)


def _road() -> str:
    top, bottom, tl, tr, bl, br = 7, 16, 28, 35, 12, 51
    part = f"((y - {top}) / {bottom - top})"
    return f"(y BETWEEN {top} AND {bottom} AND x >= floor({tl} + ({bl} - {tl}) * {part} + 0.5) AND x <= floor({tr} + ({br} - {tr}) * {part} + 0.5))"


@query(
    "g20_vegetation_regions",
    sql(
        """SELECT video_id, frame_index, class_id, x1, y1, x2, y2, area_ratio, round_even(greatest(0.34, least(0.76, 0.34 + 0.24 * least(1, area_ratio / greatest(1e-6, (x2 - x1) * (y2 - y1))))), 3) AS confidence FROM (
          SELECT *, CASE WHEN x2 - x1 <= 0.34 AND y2 - y1 <= 0.4 AND (y1 + y2) / 2 >= 0.58 AND y2 >= 0.69 AND area_ratio <= 0.095 THEN 'shrub' ELSE 'vegetation_cluster' END AS class_id,
            row_number() OVER (PARTITION BY video_id, frame_index, x2 - x1 <= 0.34 AND y2 - y1 <= 0.4 AND (y1 + y2) / 2 >= 0.58 AND y2 >= 0.69 AND area_ratio <= 0.095 ORDER BY area_ratio DESC, component) AS k FROM (
            SELECT video_id, frame_index, component, round_even(min(x0) / 64, 5) AS x1, round_even(min(y) / 16, 5) AS y1, round_even(max(x1) / 64, 5) AS x2, round_even((max(y) + 1) / 16, 5) AS y2,
              round_even(sum(x1 - x0) / 1024, 5) AS area_ratio FROM comp GROUP BY ALL HAVING sum(x1 - x0) >= 1024 * 0.004)) WHERE class_id = 'shrub' OR k <= 3""",
        "grid",
        "rgb",
        **GREEN,
        off=f"SELECT video_id, frame_index, y, x, CASE WHEN y >= 6 AND NOT {_road()} THEN v ELSE 0 END AS v FROM veg",
        rr=runs_sql("off"),
        **COMPONENTS,
    ),
)
def g20(spark, sf):
    found = T.vegetation_regions(T.vegetation_runs(B.rgb(spark, sf), WIDTH, HEIGHT, RASTER), B.raster_frames(spark, sf), WIDTH, HEIGHT, key=RASTER)
    return found.drop("component", "rank")


GRADE = box_sql("marg", "m", 3, "sm") | {
    "inn": "SELECT s.*, coalesce(c.v, 0) AS inside FROM sm s LEFT JOIN cleaned c USING (video_id, frame_index, y, x)",
    "neg": "SELECT g.video_id, g.frame_index, g.y, g.x, CASE WHEN i.inside = 0 AND i.sm < -0.2 THEN 1 ELSE 0 END AS v FROM grid g LEFT JOIN inn i USING (video_id, frame_index, y, x)",
    "n1": window_sql("neg", "min", 3, 3),
    "n2": window_sql("n1", "max", 3, 3),
    "near9": window_sql("cleaned", "max", 9, 9),
    "band": window_sql("cleaned", "max", 25, 25),
    "rr": runs_sql("n2"),
    **COMPONENTS,
    "cells": "SELECT video_id, frame_index, y, unnest(range(x0, x1)) AS x, component FROM comp",
    "pick": """SELECT c.video_id, c.frame_index, c.component FROM cells c JOIN near9 n USING (video_id, frame_index, y, x) GROUP BY ALL HAVING count(*) >= 2 AND max(n.v) = 1""",
    "graded": """SELECT g.video_id, g.frame_index, g.y, g.x, CASE WHEN p.x IS NOT NULL AND b.v = 1 THEN 5 WHEN i.inside = 1 AND i.sm >= 0.6 THEN 1 WHEN i.inside = 1 AND i.sm >= 0.25 THEN 2 WHEN i.inside = 1 THEN 3 WHEN i.sm >= -0.2 THEN 4 ELSE 0 END AS v
        FROM grid g LEFT JOIN inn i USING (video_id, frame_index, y, x) JOIN band b USING (video_id, frame_index, y, x)
        LEFT JOIN (SELECT * FROM cells SEMI JOIN pick USING (video_id, frame_index, component)) p USING (video_id, frame_index, y, x)""",
}


@query("g4_grade", sql(runs_sql("graded", where="v > 0"), "mp", **clean_sql("mp"), marg="SELECT video_id, frame_index, y, x, s / 1.0 * 4 AS m FROM pix", **GRADE))
def g4(spark, sf):
    scores = B.pix(spark, sf).withColumn("score", F.col("s") * 4)
    predicted = R.clean_mask(B.mask_p(spark, sf), WIDTH, HEIGHT, RASTER)
    return T.grade(scores, predicted, 0.0, WIDTH, HEIGHT, RASTER)


@query(
    "a16_class_coverage",
    sql(
        """SELECT video_id, frame_index, class_id, round_even(count(*) FILTER (v = value) / count(*), 4) AS fraction FROM area, (VALUES ('likely_traversable', 1), ('limited', 2), ('not_traversable', 3), ('unknown', 0)) t(class_id, value) GROUP BY ALL""",
        "mp",
        "mt",
        area=f"""SELECT t.video_id, t.frame_index, CASE WHEN t.v=1 AND p.v=1 THEN 1 WHEN t.v=1 THEN 2 WHEN p.v=1 THEN 3 ELSE 0 END AS v
        FROM mt t JOIN mp p USING (video_id, frame_index, y, x) WHERE {_zone('roi')}""",
    ),
)
def a16(spark, sf):
    classes = R.comparison_mask(B.mask_t(spark, sf), B.mask_p(spark, sf), RASTER)
    return T.class_coverage(classes, R.roi_runs(B.raster_frames(spark, sf), RASTER), RASTER)


CLASS = GROUND | clean_sql("mb") | {
    "seedr": f"SELECT video_id, frame_index, y, x FROM grid WHERE y BETWEEN 8 AND 12 AND x BETWEEN 20 AND 43",
    "drv": runs_sql("k2"),
    "cl": "SELECT video_id, frame_index, y, unnest(range(x0, x1)) AS x, least(unnest(range(x0, x1)) - x0 + 1, x1 - unnest(range(x0, x1))) AS c FROM drv",
    "cand": """SELECT g.video_id, g.frame_index, g.y, g.x, CASE WHEN c.c / greatest(1, 0.75 * 20 * (0.24 + 0.76 * least(1, greatest(0, (g.y / 16 - 0.34) / 0.64))) / 2) >= 1 AND s.score >= 0.5 AND NOT s.extreme AND s.sat / 255 <= 0.7 AND s.val / 255 <= 0.95 AND g.frame_index % 5 <> 4 THEN 1 ELSE 0 END AS v
        FROM grid g LEFT JOIN gs s USING (video_id, frame_index, y, x) LEFT JOIN cl c USING (video_id, frame_index, y, x)""",
    "rr": runs_sql("cand"),
    **COMPONENTS,
    "scored_": """SELECT video_id, frame_index, component, count(*) AS area, count(s.x) AS hits, avg(p.x) AS mx FROM (SELECT video_id, frame_index, y, unnest(range(x0, x1)) AS x, component FROM comp) p LEFT JOIN seedr s USING (video_id, frame_index, y, x) GROUP BY ALL""",
    "best": """SELECT video_id, frame_index, component FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY area + hits * 24 - abs(mx / 64 - 0.5) * area * 0.45 DESC, component) AS k FROM scored_ WHERE hits > 0) WHERE k = 1""",
    "green_": "SELECT video_id, frame_index, y, unnest(range(x0, x1)) AS x FROM comp SEMI JOIN best USING (video_id, frame_index, component)",
    "cmap": """SELECT k2.video_id, k2.frame_index, k2.y, k2.x, CASE WHEN mt.v = 0 AND k2.v = 1 AND k2.x % 3 = 0 THEN 3 WHEN g.x IS NOT NULL THEN 1 WHEN k2.v = 1 THEN 2 ELSE 0 END AS v
        FROM k2 JOIN mt USING (video_id, frame_index, y, x) LEFT JOIN green_ g USING (video_id, frame_index, y, x)""",
}


def class_map(spark, sf):
    from fieldspark.plans.q_masks import seed

    scored = grounded(spark, sf).withColumn("roughness", F.col("sat") / 255).withColumn("density", (F.col("val") / 255) * (0.60 / 0.95))
    drive = R.morph(B.mask_blob(spark, sf), "open", 3, 3, WIDTH, HEIGHT, RASTER)
    columns = B.raster_frames(spark, sf).select(*RASTER, F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y"))
    columns = columns.select(*RASTER, "y", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1), F.lit(3))).alias("x0")).withColumn("x1", F.col("x0") + 1)
    red = R.subtract(R.intersect(columns, drive, RASTER), B.mask_t(spark, sf), RASTER)
    gates = B.raster_frames(spark, sf).select(
        *RASTER, F.when(F.col("frame_index") % 5 == 4, 0.3).otherwise(0.6).alias("ground_confidence"), F.lit(0.8).alias("visibility"), F.lit(0.1).alias("blur_score")
    )
    return T.traversability_class(scored, drive, red, seed(spark, sf), gates, WIDTH, HEIGHT, RASTER)


@query("g12_traversability_class", sql(runs_sql("cmap", where="v > 0"), "mb", "mt", "rgb", **CLASS))
def g12(spark, sf):
    return class_map(spark, sf)


@query(
    "g15_terrain_gates",
    sql(
        """SELECT video_id, frame_index, CASE WHEN st = 'available' AND (g < 0.7 OR frame_index % 3 = 0) THEN 'uncertain' ELSE st END AS status, round_even(g, 3) AS green_support_fraction,
          CASE WHEN st = 'available' AND g < 0.7 THEN 'insufficient_green_surface_support' WHEN st = 'available' AND frame_index % 3 = 0 THEN 'confidence_gate' END AS gate_reason FROM (
          SELECT r.video_id, r.frame_index, CASE WHEN r.frame_index % 4 = 3 THEN 'unavailable' ELSE 'available' END AS st, avg(CASE WHEN m.v = 1 THEN 1 ELSE 0 END) AS g
          FROM raster_frames r, range(10) AS t(k), mb m WHERE m.video_id = r.video_id AND m.frame_index = r.frame_index AND m.x = least(63, round_even((20 + k * 3) / 64.0::DOUBLE * 64, 0)) AND m.y = least(15, round_even((5 + k) / 16.0::DOUBLE * 16, 0)) GROUP BY ALL)""",
        "mb",
    ),
)
def g15(spark, sf):
    frames = B.raster_frames(spark, sf)
    line = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct(((20 + k * 3) / F.lit(64.0)).alias("x"), ((5 + k) / F.lit(16.0)).alias("y")))
    corridor = frames.select(*RASTER, F.when(F.col("frame_index") % 4 == 3, "unavailable").otherwise("available").alias("status"), line.alias("centreline"))
    confidence = frames.select(*RASTER, F.when(F.col("frame_index") % 3 == 0, 0.4).otherwise(0.9).alias("ground_confidence"), F.lit(0.9).alias("visibility"))
    return T.terrain_gates(corridor, B.mask_blob(spark, sf), confidence, WIDTH, HEIGHT, RASTER).drop("centreline")


@query("g14_centreline")
def g14(spark, sf):
    confidence = B.raster_frames(spark, sf).select(*RASTER, F.lit(0.9).alias("visibility"), F.lit(0.8).alias("ground_confidence"))
    drive = R.clean_mask(B.mask_blob(spark, sf), WIDTH, HEIGHT, RASTER)
    line = T.centreline(drive, confidence, WIDTH, HEIGHT, key=RASTER)
    return line.select(*RASTER, "status", F.size("centreline").alias("points"), "confidence", "minimum_width_ratio")


FACTOR = """SELECT *, value / 100 AS mr, (event_id % 40) / 100.0::DOUBLE AS ob, (event_id % 9) / 100.0::DOUBLE AS li, (event_id % 17) / 16.0::DOUBLE AS co, (event_id % 13) / 12.0::DOUBLE AS ro, (event_id % 23) / 22.0::DOUBLE AS vi,
    ['available', 'uncertain', 'unavailable'][event_id % 3 + 1] AS st, (event_id % 19) / 18.0::DOUBLE AS gc FROM frames"""


@query(
    "a31_frame_factors",
    sql(
        """SELECT event_id, free_width_score, obstacle_clearance_score, connectivity_score, overall_class, CAST(round_even(CAST(CAST(least(1, greatest(0, (gc + vi + connectivity_score + obstacle_clearance_score) / 4)) AS VARCHAR) AS DECIMAL(30, 20)), 3) AS DOUBLE) AS overall_confidence, temporal_stability_score FROM (
        SELECT *, round_even(least(1, mr / 1.15), 3) AS free_width_score, round_even(greatest(0, 1 - ob * 3.0), 3) AS obstacle_clearance_score, round_even(CASE WHEN event_id % 5 > 0 THEN co ELSE 0 END, 3) AS connectivity_score,
          round_even(least(1, greatest(0, 1 - (event_id % 7) / 5.12::DOUBLE)), 3) AS temporal_stability_score,
          CASE WHEN st = 'available' THEN 'likely_traversable' WHEN st = 'uncertain' OR li >= 0.035 THEN 'limited' WHEN ob >= 0.08 THEN 'not_traversable' ELSE 'unknown' END AS overall_class FROM x)""",
        "frames",
        x=FACTOR,
    ),
)
def a31(spark, sf):
    e = F.col("event_id")
    part = lambda n, d: (e % n) / F.lit(float(d))
    names = F.array(F.lit("available"), F.lit("uncertain"), F.lit("unavailable"))
    inputs = B.frames(spark, sf).select(
        "event_id", (F.col("value") / 100).alias("minimum_ratio"), part(40, 100).alias("obstacle_ratio"), part(9, 100).alias("limited_ratio"), part(17, 16).alias("connectivity"),
        (e % 5 > 0).alias("anchored"), part(13, 12).alias("roughness"), part(23, 22).alias("visibility"), F.lit(False).alias("calibrated"), (e % 7).alias("stability_px"),
        F.element_at(names, (e % 3 + 1).cast("int")).alias("corridor_status"), part(19, 18).alias("ground_confidence"),
    )
    out = T.frame_factors(inputs, WIDTH)
    return out.select("event_id", "free_width_score", "obstacle_clearance_score", "connectivity_score", "overall_class", "overall_confidence", "temporal_stability_score")


@query(
    "w18_stable_run_length",
    sql(
        """SELECT event_id, row_number() OVER (PARTITION BY video_id, grp ORDER BY frame_index) + CASE WHEN grp = 0 THEN 0 ELSE 0 END AS stable_frames FROM (
        SELECT *, sum(CASE WHEN value <= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY frame_index) AS grp FROM frames)""",
        "frames",
    ),
)
def w18(spark, sf):
    f = B.frames(spark, sf).select(*RASTER, "event_id", "value")
    return T.stable_run_length(f, ["video_id"], "frame_index", F.col("value"), 40, B.huge_videos(spark, sf)).select("event_id", "stable_frames")


@query(
    "w10_change_fraction",
    sql(
        """SELECT video_id, round_even(count(*) FILTER (b IS NOT NULL AND b <> event_type) / greatest(1, count(*) - 1), 4) AS fraction FROM (
        SELECT *, lag(event_type) OVER (PARTITION BY video_id ORDER BY frame_index) AS b FROM frames) GROUP BY ALL""",
        "frames",
    ),
)
def w10(spark, sf):
    f = T.change_fraction(B.frames(spark, sf), ["video_id"], "frame_index", "event_type", B.huge_videos(spark, sf))
    return f.withColumn("fraction", F.bround("fraction", 4))


CAND = """SELECT video_id, timestamp_ms, 'overall-' || event_type AS reason_key, 'representative_' || event_type AS reason, value / (10 + value) AS evidence FROM frames
    UNION ALL SELECT video_id, timestamp_ms, 'stable-corridor', 'temporally_stable_corridor', (event_id % 31) / 30.0::DOUBLE FROM frames WHERE event_id % 4 = 0
    UNION ALL SELECT video_id, timestamp_ms, 'visible-obstacle', 'visible_obstacle_evidence', (event_id % 37) / 36.0::DOUBLE FROM frames WHERE event_id % 4 = 0"""


@query(
    "t4_evidence_frames",
    sql(
        """SELECT video_id, timestamp_ms, round_even(evidence, 6) AS evidence, reasons, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY evidence DESC, timestamp_ms) AS rank FROM (
            SELECT video_id, timestamp_ms, max(evidence) AS evidence, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (
              SELECT *, row_number() OVER (PARTITION BY video_id, reason_key ORDER BY evidence DESC, timestamp_ms) AS k FROM cand) WHERE k = 1 GROUP BY ALL)) WHERE rank <= 6""",
        "frames",
        cand=CAND,
    ),
)
def t4(spark, sf):
    f, e = B.frames(spark, sf), F.col("event_id")
    row = lambda k, r, v: F.struct(k.alias("reason_key"), r.alias("reason"), v.alias("evidence"))
    some = e % 4 == 0
    rows = F.array_compact(
        F.array(
            row(F.concat(F.lit("overall-"), "event_type"), F.concat(F.lit("representative_"), "event_type"), F.col("value") / (10 + F.col("value"))),
            F.when(some, row(F.lit("stable-corridor"), F.lit("temporally_stable_corridor"), (e % 31) / F.lit(30.0))),
            F.when(some, row(F.lit("visible-obstacle"), F.lit("visible_obstacle_evidence"), (e % 37) / F.lit(36.0))),
        )
    )
    candidates = f.select("video_id", "timestamp_ms", F.inline(rows))
    return T.evidence_frames(candidates).withColumn("evidence", F.bround("evidence", 6))


JUDGED = """SELECT video_id, timestamp_ms, ['likely_traversable', 'limited', 'not_traversable', 'unknown'][event_id % 4 + 1] AS oc, (event_id % 23) / 22.0::DOUBLE AS conf, (event_id % 31) / 300.0::DOUBLE AS nt, (event_id % 37) / 60.0::DOUBLE AS un,
    event_id % 9 AS stable, (event_id % 41) / 40.0::DOUBLE AS cc, (event_id % 13) / 12.0::DOUBLE AS vis FROM frames"""
RULED = """SELECT video_id, timestamp_ms, 'overall-' || oc AS reason_key, 'representative_' || oc AS reason, conf + CASE oc WHEN 'not_traversable' THEN nt WHEN 'unknown' THEN un WHEN 'limited' THEN 0.25::DOUBLE ELSE 0 END AS evidence FROM jf
    UNION ALL SELECT video_id, timestamp_ms, 'stable-corridor', 'temporally_stable_corridor', cc + least(0.3, stable / 20) FROM jf WHERE stable >= 3
    UNION ALL SELECT video_id, timestamp_ms, 'visible-obstacle', 'visible_obstacle_evidence', nt + conf FROM jf WHERE nt >= 0.015
    UNION ALL SELECT video_id, timestamp_ms, 'low-visibility', 'substantial_non_assessable_area', un + (1 - vis) FROM jf WHERE un >= 0.35"""


@query(
    "t4_evidence_rules",
    sql(
        """SELECT video_id, timestamp_ms, round_even(evidence, 6) AS evidence, reasons, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY evidence DESC, timestamp_ms) AS rank FROM (
            SELECT video_id, timestamp_ms, max(evidence) AS evidence, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (
              SELECT *, row_number() OVER (PARTITION BY video_id, reason_key ORDER BY evidence DESC, timestamp_ms) AS k FROM cand) WHERE k = 1 GROUP BY ALL)) WHERE rank <= 6""",
        "frames",
        jf=JUDGED,
        cand=RULED,
    ),
)
def t4_rules(spark, sf):
    """Evidence frames by the reason rules: class, stable corridor, obstacle, low visibility."""
    e = F.col("event_id")
    part = lambda n, d: (e % n) / F.lit(float(d))
    coverage = F.create_map(F.lit("limited"), F.lit(0.25), F.lit("not_traversable"), part(31, 300), F.lit("unknown"), part(37, 60))
    frames = B.frames(spark, sf).select(
        "video_id", "timestamp_ms", F.element_at(F.array(*[F.lit(c) for c in T.TERRAIN_VALUES]), (e % 4 + 1).cast("int")).alias("overall_class"), part(23, 22).alias("overall_confidence"), coverage.alias("coverage"),
        (e % 9).alias("stable_frames"), part(41, 40).alias("corridor_confidence"), part(13, 12).alias("visibility"),
    )
    return T.evidence_frames(T.evidence_candidates(frames)).withColumn("evidence", F.bround("evidence", 6))
