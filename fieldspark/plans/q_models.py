"""Queries on models: sampling, Gram sums, scoring, thresholds, classes, training runs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from fieldspark.operators import kernel as N
from fieldspark.operators import labels as L
from fieldspark.operators import metrics as M
from fieldspark.operators import pixels as X
from fieldspark.plans import bindings as B
from fieldspark.plans import training as T
from fieldspark.plans.bindings import HEIGHT, RASTER, WIDTH, sql, table
from fieldspark.plans.catalog import query
from fieldspark.plans.q_masks import METRICS, clean_sql, runs_sql, window_sql
from fieldspark.session import batches_by_rows, cut_lineage, run_dir

CLASSES = [f"class-{i}" for i in range(10)]


@query(
    "m2_balanced_sample",
    sql(
        """SELECT c.video_id, c.frame_index, t.label, CASE WHEN pos = 0 AND t.label = 0 THEN least(40, neg) ELSE least(40, pos, neg) END AS drawn
        FROM (SELECT video_id, frame_index, sum(v) AS pos, sum(1 - v) AS neg FROM mt JOIN pix USING (video_id, frame_index, y, x) GROUP BY ALL) c, (VALUES (0), (1)) t(label)
        WHERE least(40, CASE WHEN pos = 0 AND t.label = 0 THEN neg ELSE least(pos, neg) END) > 0""",
        "mt",
    ),
)
def m2(spark, sf):
    labelled = T.label_features(B.pix(spark, sf), B.mask_t(spark, sf), RASTER)
    drawn = N.balanced_sample(labelled, "label", 40, key=RASTER)
    return drawn.groupBy(*RASTER, "label").agg(F.count(F.lit(1)).alias("drawn"))


@query(
    "a18_gram",
    """WITH e AS (SELECT vec_id, label::DOUBLE AS y, 1.0 + vec_id % 3 AS w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round_even(sum(a.w * a.v * b.v), 6) + 0.0 AS value FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL
    UNION ALL SELECT CAST(i AS INTEGER), -1, round_even(sum(w * v * y), 6) + 0.0 FROM e GROUP BY ALL""",
)
def a18(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.array(F.col("label").cast("double")).alias("y"), (1.0 + F.col("vec_id") % 3).alias("w")
    )
    upper, moment = N.gram(rows, "x", "y", "w")
    both = upper.unionByName(moment.select("i", F.lit(-1).alias("j"), "value"))
    return both.withColumn("value", F.bround("value", 6))


def _toy() -> N.Model:
    """A small model with parameters from a rule, so that SQL can hold them as numbers."""
    d, k = 64, 4
    grid = np.fromfunction(lambda i, j: np.sin(i * 7 + j * 3 + 1), (d, k))
    return N.Model(np.arange(d) / 50, 0.1 + np.arange(d) / 20, grid, np.arange(k) / 3, np.array([0.5, -1.0, 0.75, 0.25, 0.1]))


def _toy_text() -> str:
    m = _toy()
    num = lambda v: f"{float(v)!r}::DOUBLE"
    terms = []
    for j in range(4):
        dot = " + ".join(f"((embedding[{i + 1}]::DOUBLE - {num(m.mean[i])}) / {num(m.scale[i])}) * {num(m.projection[i, j])}" for i in range(len(m.mean)))
        terms.append(f"{num(m.weights[j])} * {num(math.sqrt(0.5))} * cos({dot} + {num(m.phase[j])})")
    return f"SELECT vec_id, round_even({' + '.join(terms)} + {num(m.weights[4])}, 6) + 0.0 AS score FROM embeddings"


@query("m4_score", _toy_text())
def m4(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    return N.score(rows, _toy()).withColumn("score", F.bround("score", 6))


@query("m5_predict_mask", sql(runs_sql("cleaned"), "mb", **clean_sql("mb")))
def m5(spark, sf):
    # Same threshold as the dense mask: strictly above -0.15 equals "at least the next double".
    return N.predict_mask(B.pix(spark, sf).withColumnRenamed("s", "score"), float(np.nextafter(-0.15, 1)), WIDTH, HEIGHT, RASTER)


STEPS = ", ".join(f"{(M.THRESHOLD_LOW + (M.THRESHOLD_HIGH - M.THRESHOLD_LOW) * i / 32)!r}" for i in range(33))


@query("a22_threshold_candidates", sql(f"SELECT DISTINCT round_even(unnest(quantile_cont(s, [{STEPS}])), 9) + 0.0 AS t FROM pix", "pix"))
def a22(spark, sf):
    t = M.threshold_candidates(B.pix(spark, sf), "s")
    return t.select(F.bround("t", 9).alias("t"))


def threshold_rows(spark, sf):
    scores = B.pix(spark, sf).withColumnRenamed("s", "score")
    candidates = M.threshold_candidates(scores)
    return M.threshold_table(scores, B.mask_t(spark, sf), candidates, WIDTH, HEIGHT, key=RASTER)


def _by_t(text: str) -> str:
    return text.replace("SELECT video_id,", "SELECT t, video_id,").replace("PARTITION BY video_id", "PARTITION BY t, video_id")


THRESHOLDS = {
    "cand": f"SELECT DISTINCT unnest(quantile_cont(s, [{STEPS}])) AS t FROM pix",
    "dense": "SELECT c.t, g.video_id, g.frame_index, g.y, g.x, CASE WHEN p.s >= c.t THEN 1 ELSE 0 END AS v FROM grid g CROSS JOIN cand c LEFT JOIN pix p USING (video_id, frame_index, y, x)",
    "k1": _by_t(window_sql("dense", "min", 3, 3)),
    "k2": _by_t(window_sql("k1", "max", 3, 3)),
    "k3": _by_t(window_sql("k2", "max", 7, 7)),
    "k4": _by_t(window_sql("k3", "min", 7, 7)),
    "c": """SELECT k.t, CAST(sum(m.v * k.v) AS BIGINT) AS tp, CAST(sum((1 - m.v) * (1 - k.v)) AS BIGINT) AS tn, CAST(sum((1 - m.v) * k.v) AS BIGINT) AS fp, CAST(sum(m.v * (1 - k.v)) AS BIGINT) AS fn
        FROM k4 k JOIN mt m USING (video_id, frame_index, y, x) GROUP BY k.t""",
}


@query("a23_threshold_table", sql(f"SELECT round_even(t, 9) + 0.0 AS t, tp, tn, fp, fn, {METRICS} FROM c", "mt", **THRESHOLDS))
def a23_table(spark, sf):
    return threshold_rows(spark, sf).withColumn("t", F.bround("t", 9))


@query(
    "a23_choose_threshold",
    sql(f"SELECT round_even(t, 9) + 0.0 AS t, symmetric_penalty_points FROM (SELECT t, {METRICS} FROM c) ORDER BY symmetric_penalty_points, t LIMIT 1", "mt", **THRESHOLDS),
)
def a23(spark, sf):
    return M.choose_threshold(threshold_rows(spark, sf)).select(F.bround("t", 9).alias("t"), "symmetric_penalty_points")


def class_scores(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", (F.col("vec_id") % 40).alias("video_id"), F.expr("vec_id div 40").alias("frame_index"), F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double")).alias("scores")
    )


@query(
    "a24_choose_softmax_scale",
    """WITH e AS (SELECT label, [v::DOUBLE FOR v IN embedding[1:10]] AS s FROM embeddings)
    SELECT k::DOUBLE AS scale, round_even(avg(-ln(least(1, greatest(1e-9, exp((s[label + 1] - list_max(s)) * k) / list_sum([exp((v - list_max(s)) * k) FOR v IN s]))))), 6) AS nll
    FROM e, (VALUES (0.5::DOUBLE), (1), (2), (4), (8), (16), (32)) t(k) GROUP BY k""",
)
def a24(spark, sf):
    return M.choose_softmax_scale(class_scores(spark, sf), "label")


JUDGED = """SELECT vec_id, label, video_id, frame_index, 'class-' || (list_position(p, list_max(p)) - 1) AS top_category, round_even(list_max(p), 5) AS confidence, list_max(p) < 0.2 AS uncertain, p FROM (
    SELECT vec_id, label, vec_id % 40 AS video_id, vec_id // 40 AS frame_index, [x / list_sum(e) FOR x IN e] AS p FROM (SELECT vec_id, label, [exp((v::DOUBLE - list_max(embedding[1:10])::DOUBLE) * 8.0::DOUBLE) FOR v IN embedding[1:10]] AS e FROM embeddings))"""


def judged(spark, sf):
    p = N.terrain_probabilities(class_scores(spark, sf).withColumnRenamed("scores", "score"), 8.0)
    return N.verdict(p, CLASSES, 0.2)


@query("m10_terrain_probabilities", sql("SELECT vec_id, CAST(unnest(range(10)) AS INTEGER) AS class_index, round_even(unnest(p), 6) AS probability FROM j", j=JUDGED))
def m10(spark, sf):
    p = N.terrain_probabilities(class_scores(spark, sf).withColumnRenamed("scores", "score"), 8.0)
    return p.select("vec_id", F.posexplode("probabilities").alias("class_index", "p")).select("vec_id", "class_index", F.bround("p", 6).alias("probability"))


@query("m11_verdict", sql("SELECT vec_id, top_category, confidence, uncertain, CASE WHEN NOT uncertain THEN top_category END AS predicted_category FROM j", j=JUDGED))
def m11(spark, sf):
    return judged(spark, sf).select("vec_id", "top_category", "confidence", "uncertain", "predicted_category")


@query("p17_uncertain_frames", sql("SELECT vec_id FROM j WHERE uncertain", j=JUDGED))
def p17(spark, sf):
    from fieldspark.functions.rules import uncertain_frames

    return uncertain_frames(judged(spark, sf)).select("vec_id")


def class_metrics(spark, sf):
    named = judged(spark, sf).withColumn("truth_name", F.concat(F.lit("class-"), F.col("label").cast("string")))
    return M.multiclass_metrics(named, "truth_name", "top_category", "confidence", 0.2)


CLASS_SQL = {"j": JUDGED, "n": "SELECT 'class-' || label AS truth, top_category AS predicted, confidence FROM j"}


@query(
    "a3_multiclass_overall",
    sql(
        """SELECT count(*) AS frames, round_even(count(*) FILTER (truth = predicted) / count(*), 5) AS accuracy, round_even((SELECT avg(r) FROM (SELECT count(*) FILTER (truth = predicted) / count(*) AS r FROM n GROUP BY truth)), 5) AS balanced_accuracy,
        round_even(avg(confidence), 5) AS mean_confidence, count(*) FILTER (confidence < 0.2) AS uncertain_frames, round_even(count(*) FILTER (confidence < 0.2) / count(*), 5) AS uncertain_fraction,
        round_even(count(*) FILTER (confidence >= 0.2 AND truth = predicted) / count(*) FILTER (confidence >= 0.2), 5) AS accuracy_on_confident FROM n""",
        **CLASS_SQL,
    ),
)
def a3(spark, sf):
    return class_metrics(spark, sf)[0]


@query(
    "a3_multiclass_per_class",
    sql(
        """SELECT class, support, round_even(p, 5) AS precision, round_even(r, 5) AS recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 5) AS f1 FROM (
        SELECT k.class, count(*) FILTER (truth = k.class) AS support, coalesce(count(*) FILTER (truth = k.class AND predicted = k.class) / nullif(count(*) FILTER (predicted = k.class), 0), 0) AS p,
          coalesce(count(*) FILTER (truth = k.class AND predicted = k.class) / nullif(count(*) FILTER (truth = k.class), 0), 0) AS r
        FROM n, (SELECT truth AS class FROM n UNION SELECT predicted FROM n) k GROUP BY k.class)""",
        **CLASS_SQL,
    ),
)
def a3_classes(spark, sf):
    return class_metrics(spark, sf)[1]


@query("a3_confusion_matrix", sql("SELECT truth, predicted, count(*) AS frames FROM n GROUP BY ALL", **CLASS_SQL))
def a3_matrix(spark, sf):
    return class_metrics(spark, sf)[2]


@query(
    "a15_prediction_summary",
    sql(
        """SELECT j.video_id, count(*) AS frames, count(*) FILTER (uncertain) AS uncertain_frames, round_even(count(*) FILTER (uncertain) / count(*), 5) AS uncertain_fraction, round_even(avg(confidence), 5) AS mean_confidence,
        any_value(d.top_category) AS dominant_category, CASE WHEN j.video_id % 4 <> 3 THEN round_even(count(*) FILTER (j.top_category = 'class-' || (j.video_id % 10)) / count(*), 5) END AS matches_video_category
        FROM j JOIN (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, f) AS k FROM (SELECT video_id, top_category, count(*) AS n, min(frame_index) AS f FROM j GROUP BY ALL)) d ON d.video_id = j.video_id AND d.k = 1 GROUP BY j.video_id""",
        j=JUDGED,
    ),
)
def a15(spark, sf):
    v = F.col("video_id")
    videos = class_scores(spark, sf).select("video_id").distinct().withColumn("terrain_category", F.when(v % 4 != 3, F.concat(F.lit("class-"), (v % 10).cast("string"))))
    return M.prediction_summary(judged(spark, sf), videos, ["video_id"])


def path_inputs(spark, sf):
    """Features with labels, truth runs and split, materialised once for several fits."""
    features = X.pixel_features(B.rgb(spark, sf), WIDTH, HEIGHT, key=RASTER)
    labelled = T.label_features(features, B.mask_t(spark, sf), RASTER).withColumn("mission_id", F.col("video_id") % 2)
    labelled = cut_lineage(labelled.repartition(*RASTER))
    parts = cut_lineage(L.frame_split(labelled.select(*RASTER, "mission_id").distinct(), ["video_id"], huge=False, scope=["mission_id"]))
    return labelled, parts


@query("m3_fit_rff_ridge")
def m3(spark, sf):
    labelled, _ = path_inputs(spark, sf)
    model = N.fit_rff_ridge(N.balanced_sample(labelled, "label", key=RASTER), "label", 22, 64)
    return spark.createDataFrame([(n, i, j, round(v, 6)) for n, i, j, v in model.rows() if n in ("mean", "scale", "weights")], "name string, i int, j int, value double")


def negative_frames(spark, sf):
    """Hard negatives of the score images: a video without any path, and an off-path interval in another one."""
    frames = B.raster_frames(spark, sf).withColumn("mission_id", F.col("video_id") % 2)
    videos = frames.groupBy("mission_id", "video_id").agg((F.max("frame_index") + 1).alias("total_frames")).withColumns({"fps": F.lit(25.0), "fully_not_traversable": F.col("video_id") == 3})
    intervals = videos.where("video_id = 2").select("mission_id", "video_id", F.lit("i").alias("id"), F.lit(40).cast("long").alias("start_ms"), (F.col("total_frames") * 10).cast("long").alias("end_ms"))
    found = L.hard_negatives(intervals, videos, 2, 3)
    return frames.join(found.select("mission_id", *RASTER).distinct(), ["mission_id", *RASTER], "left_semi")


def training_inputs(spark, sf):
    """Labelled features and split of confirmed frames and hard negatives, each written once."""
    negatives = cut_lineage(negative_frames(spark, sf))
    confirmed = B.raster_frames(spark, sf).where("video_id <> 3").withColumn("mission_id", F.col("video_id") % 2).join(negatives.select(*RASTER), list(RASTER), "left_anti")
    parts = cut_lineage(T.split_with_negatives(confirmed, negatives, key=RASTER))
    features = X.pixel_features(B.rgb(spark, sf), WIDTH, HEIGHT, key=RASTER)
    return cut_lineage(T.with_negatives(features, B.mask_t(spark, sf), parts, RASTER).repartition(*RASTER)), parts


@query("m6_train_path_model")
def m6(spark, sf):
    """Training with hard negatives; the figures are read back from the stored run."""
    labelled, parts = training_inputs(spark, sf)
    path = run_dir(spark, "path-runs")
    T.train_and_store(labelled, parts, WIDTH, HEIGHT, path, "path-1", RASTER)
    columns = ("tp", "tn", "fp", "fn", "symmetric_score", "iou", "precision", "recall")
    stored = spark.read.parquet(f"{path}/figures").where("run_id = 'path-1' AND part <> 'sizes'")
    wide = stored.groupBy("part").pivot("name", list(columns)).agg(F.first("value"))
    return wide.select("part", *[F.col(c).cast("long") if c in ("tp", "tn", "fp", "fn") else c for c in columns])


@query("m7_cross_mission_matrix")
def m7(spark, sf):
    labelled, _ = path_inputs(spark, sf)
    rows = T.cross_mission_matrix(labelled, 0, 1, WIDTH, HEIGHT, key=RASTER)
    return spark.createDataFrame([tuple(r[c] for c in ("key", "train_mission", "eval_mission", "feature_count", "eval_frames", "iou", "precision", "recall")) for r in rows],
                                 "key string, train_mission string, eval_mission string, feature_count int, eval_frames long, iou double, precision double, recall double")


@query("m8_sweep")
def m8(spark, sf):
    """All points of the grid, the frames resampled to each input width."""
    truth, inputs = B.mask_t(spark, sf), {}
    frames = B.raster_frames(spark, sf).withColumn("mission_id", F.col("video_id") % 2)
    parts = cut_lineage(L.frame_split(frames.select(*RASTER, "mission_id"), ["video_id"], huge=False, scope=["mission_id"]))
    largest = dict(zip(("width", "height"), map(F.lit, T.input_size(max(T.SWEEP["width"]), (WIDTH, HEIGHT))), strict=True))
    tasks = X.tasks_for(frames.withColumns(largest))
    source = T.source_frames(B.rgb(spark, sf), truth, parts, RASTER)
    for width in T.SWEEP["width"]:
        inputs[width] = T.resampled_pixels(source, (WIDTH, HEIGHT), width, RASTER, tasks)
    with batches_by_rows(spark):  # rows of few numbers
        rows, best = T.sweep(inputs, key=RASTER)
    return spark.createDataFrame([(r["candidate"], r["width"], r["random_features"], r["samples"], r["ridge_lambda"], r["symmetric_score"], r["iou"], r["candidate"] == best["candidate"]) for r in rows],
                                 "candidate int, width int, random_features int, samples int, ridge_lambda double, symmetric_score double, iou double, best boolean")


@query("m9_fit_terrain_model")
def m9(spark, sf):
    e = table(spark, sf, "embeddings")
    descriptors = e.select((F.col("label") % 3).alias("mission_id"), (F.col("vec_id") % 40).alias("video_id"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    videos = descriptors.select("mission_id", "video_id").distinct().withColumn("terrain_category", F.concat(F.lit("kind-"), F.col("mission_id").cast("string")))
    return T.train_terrain_model(descriptors, videos, 64)["overall"]


@query("k6_evaluation_report", sql(
    """SELECT 'run' AS section, 'v' || video_id AS label, 'all' AS train, CAST(video_id AS VARCHAR) AS evaluation, CAST(count(*) AS BIGINT) AS frames, round_even(avg(iou), 3) AS iou, round_even(avg(precision), 3) AS precision, round_even(avg(recall), 3) AS recall FROM m GROUP BY video_id
    UNION ALL SELECT 'baseline', 'all', 'all', 'all', NULL, round_even(avg(iou), 3), round_even(avg(precision), 3), round_even(avg(recall), 3) FROM m
    UNION ALL SELECT 'data', 'v' || video_id, CASE WHEN video_id < 2 THEN 'selected' ELSE 'available' END, NULL, CAST(count(*) AS BIGINT), NULL, NULL, NULL FROM m GROUP BY video_id""",
    "mp", "mt", c="""SELECT video_id, frame_index, CAST(sum(t.v * p.v) AS BIGINT) AS tp, CAST(sum((1 - t.v) * (1 - p.v)) AS BIGINT) AS tn, CAST(sum((1 - t.v) * p.v) AS BIGINT) AS fp, CAST(sum(t.v * (1 - p.v)) AS BIGINT) AS fn
    FROM mt t JOIN mp p USING (video_id, frame_index, y, x) GROUP BY ALL""", m=f"SELECT *, {METRICS} FROM c"))
def k6(spark, sf):
    from fieldspark.plans.q_masks import counts

    m = M.symmetric_metrics(counts(spark, sf))
    figures = [F.avg(c).alias(c) for c in ("iou", "precision", "recall")]
    v = F.col("video_id")
    runs = m.groupBy("video_id").agg(F.count(F.lit(1)).alias("eval_frames"), *figures).select(
        F.concat(F.lit("v"), v.cast("string")).alias("key"), F.lit("all").alias("train_mission"), v.alias("eval_mission"), "eval_frames", "iou", "precision", "recall"
    )
    missions = m.groupBy("video_id").agg(F.count(F.lit(1)).alias("confirmed_frames")).select(F.concat(F.lit("v"), v.cast("string")).alias("name"), (v < 2).alias("selected"), "confirmed_frames")
    baseline = m.agg(*figures).select(F.lit("all").alias("label"), F.lit("all").alias("train"), F.lit("all").alias("validation"), "iou", "precision", "recall")
    return M.evaluation_report(runs, baseline, missions)
