"""Queries on run-length masks: counts, metrics, geometry, morphology, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.operators import metrics as M
from fieldspark.operators import runs as R
from fieldspark.plans import bindings as B
from fieldspark.plans.bindings import HEIGHT, RASTER, WIDTH, sql
from fieldspark.plans.catalog import query

PER_FRAME = """
    SELECT video_id, frame_index, CAST(sum(CASE WHEN t.v=1 AND p.v=1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
      CAST(sum(CASE WHEN t.v=0 AND p.v=0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
      CAST(sum(CASE WHEN t.v=0 AND p.v=1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
      CAST(sum(CASE WHEN t.v=1 AND p.v=0 THEN 1 ELSE 0 END) AS BIGINT) AS fn
    FROM mt t JOIN mp p USING (video_id, frame_index, y, x) GROUP BY ALL"""
METRICS = """
    round_even(fn / greatest(1, tp + fn), 5) AS missed_label_fraction,
    round_even(fp / greatest(1, tn + fp), 5) AS invented_path_fraction,
    round_even(100 * (0.5 * (fn / greatest(1, tp + fn) + fp / greatest(1, tn + fp))), 2) AS symmetric_penalty_points,
    round_even(100 * (1 - 0.5 * (fn / greatest(1, tp + fn) + fp / greatest(1, tn + fp))), 2) AS symmetric_score,
    round_even(tp / greatest(1, tp + fp + fn), 5) AS iou, round_even(2 * tp / greatest(1, 2 * tp + fp + fn), 5) AS dice,
    round_even(tp / greatest(1, tp + fp), 5) AS precision, round_even(tp / greatest(1, tp + fn), 5) AS recall"""


def counts(spark, sf):
    return M.confusion_counts(B.mask_t(spark, sf), B.mask_p(spark, sf), B.raster_frames(spark, sf), RASTER)


def runs_sql(mask: str, value: str = "v", where: str = "v = 1") -> str:
    """Maximal runs of a dense mask."""
    return f"""
    SELECT video_id, frame_index, y, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) + 1 AS INTEGER) AS x1, CAST({value} AS INTEGER) AS value FROM (
      SELECT *, x - row_number() OVER (PARTITION BY video_id, frame_index, y, {value} ORDER BY x) AS island FROM {mask} WHERE {where})
    GROUP BY video_id, frame_index, y, {value}, island"""


@query("w4_encode_runs", sql(runs_sql("mp"), "mp"))
def w4(spark, sf):
    pixels = B.pix(spark, sf).withColumn("value", F.when(F.col("s") > 0, 1))
    return R.encode_runs(pixels, "value", RASTER)


@query("w4_encode_lines", sql(runs_sql("mt"), "mt"))
def w4_lines(spark, sf):
    return B.mask_t(spark, sf)


RLE = """SELECT video_id, frame_index, string_agg(v || ',' || n, ',' ORDER BY s) AS rle FROM (
    SELECT video_id, frame_index, v, island, min(pos) AS s, count(*) AS n FROM (
      SELECT *, pos - row_number() OVER (PARTITION BY video_id, frame_index, v ORDER BY pos) AS island
      FROM (SELECT *, y * 64 + x AS pos FROM mp)) GROUP BY ALL) GROUP BY video_id, frame_index"""


@query("w4_to_rle", sql(RLE, "mp"))
def w4_rle(spark, sf):
    rle = R.to_rle(B.mask_p(spark, sf), B.raster_frames(spark, sf), RASTER)
    return rle.select(*RASTER, F.array_join(F.transform("rle", lambda v: v.cast("string")), ",").alias("rle"))


@query("w4_decode_rle", sql(runs_sql("mp"), "mp"))
def w4_decode(spark, sf):
    rle = R.to_rle(B.mask_p(spark, sf), B.raster_frames(spark, sf), RASTER).withColumn("width", F.lit(WIDTH))
    return R.decode_rle(rle, "rle", "width", RASTER)


@query(
    "j1_attach_truth",
    sql(
        """SELECT p.video_id, p.frame_index, p.event_type AS predicted, t.event_type AS truth
        FROM frames p LEFT JOIN frames t ON t.video_id = p.video_id AND t.frame_index = p.frame_index AND t.value > 20""",
        "frames",
    ),
)
def j1(spark, sf):
    f = B.frames(spark, sf)
    truth = f.where(F.col("value") > 20).select(*RASTER, F.col("event_type").alias("truth"))
    return M.attach_truth(f.select(*RASTER, F.col("event_type").alias("predicted")), truth, RASTER)


@query(
    "j2_mask_overlap",
    sql(
        """SELECT p.video_id, p.frame_index, p.y, CAST(count(*) AS BIGINT) AS pixels FROM mp p JOIN mt t USING (video_id, frame_index, y, x)
        WHERE p.v = 1 AND t.v = 1 GROUP BY ALL""",
        "mp",
        "mt",
    ),
)
def j2(spark, sf):
    both = R.mask_overlap(B.mask_p(spark, sf), B.mask_t(spark, sf), RASTER)
    return both.groupBy(*RASTER, "y").agg(F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("pixels"))


@query("a1_confusion_counts", sql("SELECT * FROM c", "mp", "mt", c=PER_FRAME))
def a1(spark, sf):
    return counts(spark, sf)


@query(
    "a1_confusion_rollup",
    sql(
        """SELECT video_id, frame_index, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn,
        CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY ROLLUP (video_id, frame_index)""",
        "mp",
        "mt",
        c=PER_FRAME,
    ),
)
def a1_rollup(spark, sf):
    return counts(spark, sf).rollup(*RASTER).agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])


@query("a2_symmetric_metrics", sql(f"SELECT *, {METRICS} FROM c", "mp", "mt", c=PER_FRAME))
def a2(spark, sf):
    return M.symmetric_metrics(counts(spark, sf))


@query(
    "g5_comparison_mask",
    sql(
        runs_sql("cm", where="v > 0"),
        "mp",
        "mt",
        cm="""SELECT t.video_id, t.frame_index, t.y, t.x, CASE WHEN t.v=1 AND p.v=1 THEN 1 WHEN t.v=1 THEN 2 WHEN p.v=1 THEN 3 ELSE 0 END AS v
        FROM mt t JOIN mp p USING (video_id, frame_index, y, x)""",
    ),
)
def g5(spark, sf):
    return R.comparison_mask(B.mask_t(spark, sf), B.mask_p(spark, sf), RASTER)


@query(
    "a7_mask_shares",
    sql(
        """SELECT video_id, frame_index, CAST(1 AS INTEGER) AS value, CAST(sum(v) AS BIGINT) AS pixels,
        round_even(sum(v) / 1024, 5) AS fraction, round_even(sum(v) / 1024, 5) AS labelled_fraction FROM mt GROUP BY ALL HAVING sum(v) > 0""",
        "mt",
    ),
)
def a7(spark, sf):
    return R.mask_shares(B.mask_t(spark, sf), B.raster_frames(spark, sf), RASTER)


@query(
    "a28_prediction_stats",
    sql(
        """SELECT s.video_id, s.frame_index, round_even(coalesce(a.n, 0) / s.n, 5) AS path_fraction, round_even(s.m, 5) AS mean_separation
        FROM (SELECT video_id, frame_index, count(*) AS n, avg(abs(s - 0.1)) AS m FROM pix GROUP BY ALL) s
        LEFT JOIN (SELECT video_id, frame_index, count(*) AS n FROM pix WHERE s > 0 GROUP BY ALL) a USING (video_id, frame_index)""",
        "pix",
    ),
)
def a28(spark, sf):
    return M.prediction_stats(B.pix(spark, sf).withColumnRenamed("s", "score"), B.mask_p(spark, sf), 0.1, RASTER)


EVIDENCE = f"SELECT *, {METRICS} FROM c"


@query(
    "w16_pick_evidence_penalty",
    sql(
        """SELECT video_id, frame_index, symmetric_penalty_points, kind FROM (
          SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY pick) AS k FROM (
            SELECT *, CASE WHEN r = 0 THEN 'best' ELSE 'median' END AS kind, CASE WHEN r = 0 THEN 0 ELSE 1 END AS pick FROM ranked WHERE r = 0 OR r = n // 2
            UNION ALL SELECT *, 'worst', 2 FROM ranked WHERE r = n - 1)) WHERE k = 1""",
        "mp",
        "mt",
        c=PER_FRAME,
        m=EVIDENCE,
        ranked="SELECT *, row_number() OVER (ORDER BY symmetric_penalty_points, video_id, frame_index) - 1 AS r, count(*) OVER () AS n FROM m",
    ),
)
def w16_penalty(spark, sf):
    picked = M.pick_evidence(M.symmetric_metrics(counts(spark, sf)), "penalty", RASTER)
    return picked.select(*RASTER, "symmetric_penalty_points", "kind")


@query(
    "w16_pick_evidence_iou",
    sql(
        """SELECT video_id, frame_index, iou, CASE WHEN r < 3 THEN 'worst' ELSE 'best' END AS kind FROM ranked WHERE r < 3 OR r >= greatest(3, n - 2)""",
        "mp",
        "mt",
        c=PER_FRAME,
        m=EVIDENCE,
        ranked="SELECT *, row_number() OVER (ORDER BY iou, video_id, frame_index) - 1 AS r, count(*) OVER () AS n FROM m",
    ),
)
def w16_iou(spark, sf):
    return M.pick_evidence(M.symmetric_metrics(counts(spark, sf)), "iou", RASTER).select(*RASTER, "iou", "kind")


@query(
    "w5_widest_run",
    sql(
        f"SELECT video_id, frame_index, y, -max(s).neg AS x0, max(s).length AS length FROM (SELECT video_id, frame_index, y, {{'length': x1 - x0, 'neg': -x0}} AS s FROM r) GROUP BY ALL",
        "mp",
        r=runs_sql("mp"),
    ),
)
def w5(spark, sf):
    return R.widest_run(B.mask_p(spark, sf), [*RASTER, "y"])


@query(
    "w11_horizontal_clearance",
    sql(
        "SELECT video_id, frame_index, y, CAST(unnest(range(x0, x1)) AS INTEGER) AS x, CAST(least(unnest(range(x0, x1)) - x0 + 1, x1 - unnest(range(x0, x1))) AS INTEGER) AS clearance FROM r",
        "mp",
        r=runs_sql("mp"),
    ),
)
def w11(spark, sf):
    return R.horizontal_clearance(B.mask_p(spark, sf), RASTER)


@query(
    "g8_resize_nearest",
    sql(
        """SELECT video_id, frame_index, CAST(sum(v) AS BIGINT) AS pixels, CAST(sum(v * (ty * 96 + tx)) AS BIGINT) AS checksum FROM (
        SELECT m.video_id, m.frame_index, a.ty, b.tx, m.v FROM range(24) AS a(ty), range(96) AS b(tx), mp m
        WHERE m.y = (a.ty * 16) // 24 AND m.x = (b.tx * 64) // 96 AND m.v = 1) GROUP BY ALL""",
        "mp",
    ),
)
def g8(spark, sf):
    big = R.resize_nearest(B.mask_p(spark, sf), (WIDTH, HEIGHT), (96, 24), RASTER)
    n = (F.col("x1") - F.col("x0")).cast("long")
    weight = n * F.col("y") * 96 + (F.col("x0") + F.col("x1") - 1) * n / 2
    return big.groupBy(*RASTER).agg(F.sum(n).alias("pixels"), F.sum(weight).cast("long").alias("checksum"))


@query(
    "g9_value_at",
    sql(
        """SELECT f.video_id, f.frame_index, f.point_id, f.px, f.py, CAST(coalesce(m.v, 0) AS INTEGER) AS value FROM (
            SELECT video_id, frame_index, k AS point_id, ((k * 37 + frame_index) % 101) / 100.0::DOUBLE AS px, ((k * 53 + video_id) % 97) / 96.0::DOUBLE AS py
            FROM raster_frames, range(20) AS t(k)) f
        LEFT JOIN mp m ON m.video_id = f.video_id AND m.frame_index = f.frame_index AND m.v = 1
          AND m.y = least(15, greatest(0, floor(f.py * 16))) AND m.x = least(63, greatest(0, floor(f.px * 64)))""",
        "mp",
    ),
)
def g9(spark, sf):
    k = F.col("point_id")
    points = (
        B.raster_frames(spark, sf)
        .select(*RASTER, F.explode(F.expr("sequence(0L, 19L)")).alias("point_id"))
        .withColumn("px", ((k * 37 + F.col("frame_index")) % 101) / F.lit(100.0))
        .withColumn("py", ((k * 53 + F.col("video_id")) % 97) / F.lit(96.0))
    )
    return R.value_at(B.mask_p(spark, sf), points, WIDTH, HEIGHT, RASTER)


@query(
    "g16_clip_to_mask",
    sql(
        runs_sql("cm", where="v IN (1, 2)"),
        "mp",
        "mt",
        cm="""SELECT t.video_id, t.frame_index, t.y, t.x, CASE WHEN t.v=1 AND p.v=1 THEN 1 WHEN t.v=1 THEN 2 WHEN p.v=1 THEN 3 ELSE 0 END AS v
        FROM mt t JOIN mp p USING (video_id, frame_index, y, x)""",
    ),
)
def g16(spark, sf):
    return R.clip_to_mask(R.comparison_mask(B.mask_t(spark, sf), B.mask_p(spark, sf), RASTER))


def _trapezoid(top: float, bottom: float, tl: float, tr: float, bl: float, br: float) -> str:
    t, b = int(16 * top), int(16 * bottom)
    a, c, d, e = int(64 * tl), int(64 * tr), int(64 * bl), int(64 * br)
    return f"""SELECT video_id, frame_index, CAST(y AS INTEGER) AS y, CAST(floor({a} + ({d} - {a}) * ((y - {t}) / {b - t}) + 0.5) AS INTEGER) AS x0,
      CAST(least(64, floor({c} + ({e} - {c}) * ((y - {t}) / {b - t}) + 0.5) + 1) AS INTEGER) AS x1, CAST(1 AS INTEGER) AS value
      FROM raster_frames, range({t}, {min(b, 15) + 1}) AS t(y)"""


@query("g17_roi_runs", sql(_trapezoid(0.34, 0.98, 0.42, 0.58, 0.08, 0.92), "raster_frames"))
def g17(spark, sf):
    return R.roi_runs(B.raster_frames(spark, sf), RASTER)


@query("g17_centre_prior_runs", sql(_trapezoid(0.40, 1.0, 0.46, 0.54, 0.24, 0.76), "raster_frames"))
def g17_prior(spark, sf):
    return R.centre_prior_runs(B.raster_frames(spark, sf), RASTER)


def window_sql(mask: str, fn: str, kx: int, ky: int) -> str:
    """Dense min/max filter; pixels outside the image have no effect."""
    rx, ry = kx // 2, ky // 2
    return f"""SELECT video_id, frame_index, y, x, {fn}(h) OVER (PARTITION BY video_id, frame_index, x ORDER BY y ROWS BETWEEN {ry} PRECEDING AND {ry} FOLLOWING) AS v
      FROM (SELECT *, {fn}(v) OVER (PARTITION BY video_id, frame_index, y ORDER BY x ROWS BETWEEN {rx} PRECEDING AND {rx} FOLLOWING) AS h FROM {mask})"""


def clean_sql(mask: str) -> dict[str, str]:
    return {
        "k1": window_sql(mask, "min", 3, 3),
        "k2": window_sql("k1", "max", 3, 3),
        "k3": window_sql("k2", "max", 7, 7),
        "cleaned": window_sql("k3", "min", 7, 7),
    }


for _op, _fn in (("dilate", "max"), ("erode", "min")):

    @query(f"g2_{_op}", sql(runs_sql("k"), "mb", k=window_sql("mb", _fn, 3, 5)))
    def g2(spark, sf, op=_op):
        return R.morph(B.mask_blob(spark, sf), op, 3, 5, WIDTH, HEIGHT, RASTER)


@query("g2_open", sql(runs_sql("k2"), "mb", k1=window_sql("mb", "min", 3, 3), k2=window_sql("k1", "max", 3, 3)))
def g2_open(spark, sf):
    return R.morph(B.mask_blob(spark, sf), "open", 3, 3, WIDTH, HEIGHT, RASTER)


@query("g2_clean_mask", sql(runs_sql("cleaned"), "mb", **clean_sql("mb")))
def g2_clean(spark, sf):
    return R.clean_mask(B.mask_blob(spark, sf), WIDTH, HEIGHT, RASTER)


COMPONENTS = {
    "lab": """SELECT video_id, frame_index, y, x0, x1, y * 64 + x0 AS id FROM rr""",
    "edges": """SELECT a.video_id, a.frame_index, a.id AS a, b.id AS b FROM lab a JOIN lab b ON a.video_id = b.video_id AND a.frame_index = b.frame_index
        AND abs(a.y - b.y) = 1 AND a.x0 < b.x1 + 1 AND b.x0 < a.x1 + 1""",
    "reach": """SELECT video_id, frame_index, id AS a, id AS b FROM lab UNION
        SELECT r.video_id, r.frame_index, r.a, e.b FROM reach r JOIN edges e ON r.video_id = e.video_id AND r.frame_index = e.frame_index AND r.b = e.a""",
    "comp": """SELECT l.video_id, l.frame_index, l.y, l.x0, l.x1, c.component FROM lab l JOIN (
        SELECT video_id, frame_index, a AS id, min(b) AS component FROM reach GROUP BY ALL) c USING (video_id, frame_index, id)""",
}


@query(
    "g3_components",
    sql(
        """SELECT video_id, frame_index, component AS first_pixel, CAST(sum(x1 - x0) AS BIGINT) AS area, CAST(min(x0) AS INTEGER) AS "left",
        CAST(min(y) AS INTEGER) AS top, CAST(max(x1) AS INTEGER) AS "right", CAST(max(y) + 1 AS INTEGER) AS bottom FROM comp GROUP BY ALL""",
        "mb",
        **clean_sql("mb"),
        rr=runs_sql("k2"),
        **COMPONENTS,
    ),
)
def g3(spark, sf):
    labelled = R.components(R.morph(B.mask_blob(spark, sf), "open", 3, 3, WIDTH, HEIGHT, RASTER), 8, RASTER)
    return labelled.groupBy(*RASTER, "component").agg(
        F.min(F.col("y").cast("long") * 64 + F.col("x0")).alias("first_pixel"),
        F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("area"),
        F.min("x0").alias("left"),
        F.min("y").alias("top"),
        F.max("x1").alias("right"),
        (F.max("y") + 1).alias("bottom"),
    ).drop("component")


@query(
    "g13_region_table",
    sql(
        """SELECT video_id, frame_index, area, area_ratio, CAST(rank AS INTEGER) AS rank, class_id || '-' || lpad(CAST(rank AS VARCHAR), 2, '0') AS region_id, class_id, round_even(((video_id * 7 + frame_index * 3) % 11) / 10.5::DOUBLE, 3) AS confidence,
          CASE class_id WHEN 'likely_traversable' THEN 'connected_ground,clearance_above_required,current_frame_support' ELSE 'limited_clearance_or_surface_uncertainty' END AS reasons FROM (
          SELECT *, row_number() OVER (PARTITION BY video_id, frame_index, class_id ORDER BY area DESC, component) AS rank, round_even(area / 1024, 5) AS area_ratio FROM (
            SELECT video_id, frame_index, CASE WHEN video_id % 2 = 0 THEN 'likely_traversable' ELSE 'limited' END AS class_id, component, CAST(sum(x1 - x0) AS BIGINT) AS area FROM comp GROUP BY ALL HAVING sum(x1 - x0) >= 0.0015 * 1024)) WHERE rank <= 18""",
        "mb",
        **clean_sql("mb"),
        rr=runs_sql("k2"),
        **COMPONENTS,
    ),
)
def g13(spark, sf):
    from fieldspark.operators import terrain as T

    opened = R.morph(B.mask_blob(spark, sf), "open", 3, 3, WIDTH, HEIGHT, RASTER).withColumn("value", (F.col("video_id") % 2 + 1).cast("int"))
    sure = B.raster_frames(spark, sf).withColumn("overall_confidence", (F.col("video_id") * 7 + F.col("frame_index") * 3) % 11 / F.lit(10.5))
    described = T.describe_regions(R.region_table(opened, WIDTH, HEIGHT, key=RASTER), sure, RASTER)
    return described.select(*RASTER, "area", "area_ratio", "rank", "region_id", "class_id", "confidence", F.array_join("reasons", ",").alias("reasons"))


@query(
    "t3_top_regions",
    sql(
        """SELECT video_id, frame_index, area, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY area DESC, component) AS rank FROM (
            SELECT video_id, frame_index, component, CAST(sum(x1 - x0) AS BIGINT) AS area FROM comp GROUP BY ALL HAVING sum(x1 - x0) >= 0.01 * 1024)) WHERE rank <= 3""",
        "mb",
        **clean_sql("mb"),
        rr=runs_sql("k2"),
        **COMPONENTS,
    ),
)
def t3(spark, sf):
    opened = R.morph(B.mask_blob(spark, sf), "open", 3, 3, WIDTH, HEIGHT, RASTER)
    regions = R.components(opened, 8, RASTER).groupBy(*RASTER, "component").agg(F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("area"))
    top = R.top_regions(regions.withColumn("value", F.lit(1)), WIDTH * HEIGHT, 0.01, 3, RASTER)
    return top.select(*RASTER, "area", "rank")


SEED = "SELECT video_id, frame_index, y, x FROM grid WHERE y BETWEEN 8 AND 12 AND x BETWEEN 20 AND 43"


def seed(spark, sf):
    rows = F.explode(F.sequence(F.lit(8), F.lit(12)))
    return B.raster_frames(spark, sf).select(*RASTER, rows.alias("y"), F.lit(20).alias("x0"), F.lit(44).alias("x1"), F.lit(1).alias("value"))


@query(
    "g10_seed_component",
    sql(
        """SELECT video_id, frame_index, component AS first_pixel, area, seed_overlap FROM (
          SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY area + seed_overlap * 24 - abs(mx / 64 - 0.5) * area * 0.45 DESC, component) AS k FROM (
            SELECT video_id, frame_index, component, CAST(count(*) AS BIGINT) AS area, CAST(count(s.x) AS BIGINT) AS seed_overlap, avg(p.x) AS mx FROM (
              SELECT video_id, frame_index, y, unnest(range(x0, x1)) AS x, component FROM comp) p LEFT JOIN seeds s USING (video_id, frame_index, y, x) GROUP BY ALL)
          WHERE seed_overlap > 0) WHERE k = 1""",
        "mb",
        **clean_sql("mb"),
        rr=runs_sql("k2"),
        **COMPONENTS,
        seeds=SEED,
    ),
)
def g10(spark, sf):
    opened = R.morph(B.mask_blob(spark, sf), "open", 3, 3, WIDTH, HEIGHT, RASTER)
    chosen = R.seed_component(opened, seed(spark, sf), WIDTH, RASTER)
    area = chosen.groupBy(*RASTER).agg(
        F.min(F.col("y").cast("long") * 64 + F.col("x0")).alias("first_pixel"), F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("area")
    )
    touched = R.mask_overlap(chosen, seed(spark, sf), RASTER).groupBy(*RASTER).agg(F.sum((F.col("x1") - F.col("x0")).cast("long")).alias("seed_overlap"))
    return area.join(touched, list(RASTER))


REFINE = """SELECT video_id, frame_index, k AS pos, k * 2 AS y_lo, k * 2 + 4 AS y_hi, (k * 11 + frame_index) % 40 AS x_lo, (k * 11 + frame_index) % 40 + 16 AS x_hi, k % 2 AS val
    FROM raster_frames, range(5) AS t(k)"""


@query(
    "j3_apply_refinements",
    sql(
        runs_sql("done"),
        "mp",
        ref=REFINE,
        done="""SELECT m.video_id, m.frame_index, m.y, m.x, coalesce(max(struct_pack(pos := r.pos, val := r.val)).val, any_value(m.v)) AS v FROM mp m LEFT JOIN ref r
          ON r.video_id = m.video_id AND r.frame_index = m.frame_index AND m.y >= r.y_lo AND m.y < r.y_hi AND m.x >= r.x_lo AND m.x < r.x_hi
          GROUP BY m.video_id, m.frame_index, m.y, m.x""",
    ),
)
def j3(spark, sf):
    k = F.col("pos")
    regions = (
        B.raster_frames(spark, sf)
        .select(*RASTER, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
        .withColumn("y", F.explode(F.sequence(k * 2, k * 2 + 3)))
        .withColumn("x0", ((k * 11 + F.col("frame_index")) % 40).cast("int"))
        .withColumn("x1", F.col("x0") + 16)
        .withColumn("value", k % 2)
    )
    return R.apply_refinements(B.mask_p(spark, sf), regions, RASTER)


@query(
    "g6_refine_region",
    sql(
        """SELECT k.video_id, k.frame_index, k.click_id, CAST(k.v AS INTEGER) AS kind_value, CAST(a.area AS BIGINT) AS pixel_count, CASE WHEN k.v = 2 THEN 0 ELSE 1 END AS correct_value
        FROM clicks k JOIN (SELECT video_id, frame_index, v, y, unnest(range(x0, x1)) AS x, component FROM comp) c USING (video_id, frame_index, v, y, x)
        JOIN (SELECT video_id, frame_index, v, component, sum(x1 - x0) AS area FROM comp GROUP BY ALL) a USING (video_id, frame_index, v, component)""",
        "mp",
        "mt",
        cm="""SELECT t.video_id, t.frame_index, t.y, t.x, CASE WHEN t.v=1 AND p.v=1 THEN 1 WHEN t.v=1 THEN 2 WHEN p.v=1 THEN 3 ELSE 0 END AS v
        FROM mt t JOIN mp p USING (video_id, frame_index, y, x)""",
        lab=f"SELECT video_id, frame_index, value AS v, y, x0, x1, y * 64 + x0 AS id FROM ({runs_sql('cm', where='v IN (2, 3)')})",
        edges="""SELECT a.video_id, a.frame_index, a.v, a.id AS a, b.id AS b FROM lab a JOIN lab b ON a.video_id = b.video_id AND a.frame_index = b.frame_index AND a.v = b.v
        AND abs(a.y - b.y) = 1 AND a.x0 < b.x1 + 1 AND b.x0 < a.x1 + 1""",
        reach="""SELECT video_id, frame_index, v, id AS a, id AS b FROM lab UNION
        SELECT r.video_id, r.frame_index, r.v, r.a, e.b FROM reach r JOIN edges e ON r.video_id = e.video_id AND r.frame_index = e.frame_index AND r.v = e.v AND r.b = e.a""",
        comp="""SELECT l.video_id, l.frame_index, l.v, l.y, l.x0, l.x1, c.component FROM lab l JOIN (
        SELECT video_id, frame_index, v, a AS id, min(b) AS component FROM reach GROUP BY ALL) c USING (video_id, frame_index, v, id)""",
        clicks="""SELECT video_id, frame_index, k AS click_id, 2 + k % 2 AS v, CAST(round_even(((k * 17 + frame_index * 3) % 50) / 49.0::DOUBLE * 63, 0) AS INTEGER) AS x,
        CAST(round_even(((k * 29 + video_id) % 31) / 30.0::DOUBLE * 15, 0) AS INTEGER) AS y FROM raster_frames, range(12) AS t(k)""",
    ),
)
def g6(spark, sf):
    k = F.col("click_id")
    clicks = (
        B.raster_frames(spark, sf)
        .select(*RASTER, F.explode(F.expr("sequence(0L, 11L)")).alias("click_id"))
        .withColumn("px", ((k * 17 + F.col("frame_index") * 3) % 50) / F.lit(49.0))
        .withColumn("py", ((k * 29 + F.col("video_id")) % 31) / F.lit(30.0))
        .withColumn("expected_kind", F.when(k % 2 == 0, "missed_label").otherwise("invented_path"))
    )
    compared = R.comparison_mask(B.mask_t(spark, sf), B.mask_p(spark, sf), RASTER)
    accepted, _ = R.refine_region(clicks, compared, WIDTH, HEIGHT, RASTER)
    return accepted.select(
        *RASTER, "click_id", F.when(F.col("expected_kind") == "missed_label", 2).otherwise(3).alias("kind_value"), "pixel_count", "correct_value"
    ).distinct()


def polygons(spark, sf):
    """A rectangle and a triangle per raster frame, sized from the frame key."""
    f, v = F.col("frame_index"), F.col("video_id")
    point = lambda x, y: F.struct((x / F.lit(63.0)).alias("x"), (y / F.lit(15.0)).alias("y"))
    x, y = (f * 5 + v * 7) % 40, (f * 3 + v) % 8
    return B.raster_frames(spark, sf).select(
        *RASTER,
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("polygon_id"), F.lit("traversable").alias("class_id"), F.array(point(x, y), point(x + 13, y), point(x + 13, y + 5), point(x, y + 5)).alias("points")),
                F.struct(F.lit(1).alias("polygon_id"), F.lit("traversable").alias("class_id"), F.array(point(x + 3, y + 7), point(x + 22, y + 2), point(x + 17, y)).alias("points")),
            )
        ),
    )


RASTERIZE = {
    "pts": """SELECT video_id, frame_index, 0 AS pid, unnest([[x, y, x + 13, y], [x + 13, y, x + 13, y + 5], [x + 13, y + 5, x, y + 5], [x, y + 5, x, y]]) AS e
        FROM (SELECT *, (frame_index * 5 + video_id * 7) % 40 AS x, (frame_index * 3 + video_id) % 8 AS y FROM raster_frames)
        UNION ALL SELECT video_id, frame_index, 1, unnest([[x + 3, y + 7, x + 22, y + 2], [x + 22, y + 2, x + 17, y], [x + 17, y, x + 3, y + 7]])
        FROM (SELECT *, (frame_index * 5 + video_id * 7) % 40 AS x, (frame_index * 3 + video_id) % 8 AS y FROM raster_frames)""",
    "seg": "SELECT video_id, frame_index, pid, e[1] AS ax, e[2] AS ay, e[3] AS bx, e[4] AS by_ FROM pts",
    "crossing": """SELECT g.video_id, g.frame_index, g.y, g.x, s.pid,
          CAST(sum(CASE WHEN ay <> by_ AND g.y >= least(ay, by_) AND g.y < greatest(ay, by_) AND ax + (g.y - ay) * (bx - ax) / (by_ - ay) <= g.x THEN 1 ELSE 0 END) AS INTEGER) AS below,
          CAST(sum(CASE WHEN ay <> by_ AND g.y >= least(ay, by_) AND g.y < greatest(ay, by_) AND ax + (g.y - ay) * (bx - ax) / (by_ - ay) = g.x THEN 1 ELSE 0 END) AS INTEGER) AS hit
        FROM grid g JOIN seg s USING (video_id, frame_index) GROUP BY ALL""",
    "line": """SELECT DISTINCT video_id, frame_index,
          CAST(CASE WHEN abs(by_ - ay) >= abs(bx - ax) THEN ay + sign(by_ - ay) * t ELSE floor(ay + (by_ - ay) * (t / greatest(1, abs(bx - ax))) + 0.5) END AS INTEGER) AS y,
          CAST(CASE WHEN abs(by_ - ay) >= abs(bx - ax) THEN floor(ax + (bx - ax) * (t / greatest(1, abs(by_ - ay))) + 0.5) ELSE ax + sign(bx - ax) * t END AS INTEGER) AS x
        FROM (SELECT *, unnest(range(greatest(abs(by_ - ay), abs(bx - ax)) + 1)) AS t FROM seg)""",
    "filled": """SELECT g.video_id, g.frame_index, g.y, g.x, CASE WHEN l.x IS NOT NULL OR coalesce(c.inside, false) THEN 1 ELSE 0 END AS v
        FROM grid g LEFT JOIN line l USING (video_id, frame_index, y, x)
        LEFT JOIN (SELECT video_id, frame_index, y, x, bool_or(below % 2 = 1 OR hit > 0) AS inside FROM crossing GROUP BY ALL) c USING (video_id, frame_index, y, x)""",
}


@query("g1_rasterize", sql(runs_sql("filled"), "grid", **RASTERIZE))
def g1(spark, sf):
    return R.rasterize(polygons(spark, sf), WIDTH, HEIGHT, ["traversable"], RASTER)


_HALF = R.ellipse_half_widths(9)


@query(
    "g18_obstacle_runs",
    sql(
        runs_sql("wide"),
        "grid",
        **RASTERIZE,
        wide=f"""SELECT g.video_id, g.frame_index, g.y, g.x, max(coalesce(f.v, 0)) AS v FROM grid g
          CROSS JOIN (SELECT unnest(range(-4, 5)) AS dy, unnest({_HALF}) AS half) o
          LEFT JOIN filled f ON f.video_id = g.video_id AND f.frame_index = g.frame_index AND f.y = g.y + o.dy AND f.x BETWEEN g.x - o.half AND g.x + o.half
          GROUP BY g.video_id, g.frame_index, g.y, g.x""",
    ),
)
def g18(spark, sf):
    from fieldspark.operators.terrain import obstacle_runs

    dets = polygons(spark, sf).withColumn("class_id", F.lit("tree"))
    return obstacle_runs(dets, WIDTH, HEIGHT, RASTER)
