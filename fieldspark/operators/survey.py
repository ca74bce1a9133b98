"""Survey analysis: keyframes, observations, wrap-up and configuration comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.joins import top_k

# Sampling configurations and observation rules.
CONFIGURATIONS = (("Baseline", 10.0, 1, False), ("Iteration 1", 6.0, 3, False), ("Iteration 2", 6.0, 3, True))
VEGETATION_MIN, GROUND_MIN, EDGE_MIN = 0.12, 0.12, 0.16
MAX_EVIDENCE = 4
# Observation labels.
LABELS = {
    "vegetation": "deutliche Vegetationspräsenz",
    "tree_species": "Baumart unklar",
    "ground": "möglicher unbefestigter Untergrund",
    "obstacle_candidate": "visuell komplexes Wegsegment – manuell prüfen",
}


def targets(videos: DataFrame, interval: float, endpoints: bool, by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Target times per video in seconds: every ``interval``, optionally from 0 with a closing one."""
    start = 0.0 if endpoints else interval / 2
    duration = F.col("duration_seconds")
    n = F.greatest(F.lit(0), F.ceil((duration - start) / interval)).cast("long")
    timed = videos.withColumn("_n", n).withColumn(
        "_times", F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: start + i * interval)).otherwise(F.array().cast("array<double>"))
    )
    if endpoints:
        last = F.element_at("_times", -1)
        close = (F.size("_times") == 0) | (duration - 1 - last > interval / 2)
        timed = timed.withColumn("_times", F.when(close, F.concat("_times", F.array(F.greatest(F.lit(0.0), duration - 1)))).otherwise(F.col("_times")))
    return timed.select(*by, F.posexplode("_times").alias("seq", "target"))


def sharpest_candidate(targets: DataFrame, frames: DataFrame, offsets: Sequence[float] = (-0.6, 0.0, 0.6), by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Per target the sharpest of the frames shown at target + offset; the earlier offset wins ties.

    ``frames(by…, second_start, second_end, sharpness, …)`` are disjoint display spans. Frame and
    candidate meet on whole seconds, so the join stays an equi-join with a residual test.
    """
    candidates = targets.select("*", F.posexplode(F.array(*[F.lit(float(o)) for o in offsets])).alias("_k", "_o")).withColumn(
        "second", F.greatest(F.lit(0.0), F.col("target") + F.col("_o"))
    ).withColumn("_s", F.floor("second"))
    spans = frames.withColumn("_s", F.explode(F.sequence(F.floor("second_start"), F.floor("second_end"))))
    hits = candidates.join(spans, [*by, "_s"]).where((F.col("second_start") <= F.col("second")) & (F.col("second") < F.col("second_end")))
    carried = [c for c in frames.columns if c not in (*by, "second_start", "second_end")]
    best = F.max_by(F.struct("second", *carried), F.struct("sharpness", (-F.col("_k")).alias("k")))
    return hits.groupBy(*by, "seq", "target").agg(best.alias("_b")).select(*by, "seq", "target", "_b.*")


def keyframes(videos: DataFrame, frames: DataFrame, interval: float = 6.0, samples: int = 3, endpoints: bool = True, by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Keyframes with their direction-aware share of the route."""
    step = [-0.6 + 1.2 * i / (samples - 1) for i in range(samples)] if samples > 1 else [0.0]
    found = sharpest_candidate(targets(videos, interval, endpoints, by), frames, step, by)
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("second") / F.col("duration_seconds")))
    share = F.when(F.col("direction") == "A_TO_B", progress).otherwise(1 - progress)
    frame_id = F.concat(F.col(by[-1]).cast("string"), F.lit("-"), F.when(F.col("seq") < 1000, F.lpad(F.col("seq").cast("string"), 3, "0")).otherwise(F.col("seq").cast("string")))
    return found.join(videos.select(*by, "duration_seconds", "direction"), list(by)).select(
        *found.columns, frame_id.alias("keyframe_id"), F.bround("second", 3).alias("timestamp_seconds"), F.bround(share, 5).alias("route_fraction")
    )


def observations(keyframes: DataFrame) -> DataFrame:
    """Up to four observations per keyframe from colour and edge shares."""
    c = F.col
    row = lambda cat, conf, status: F.struct(
        F.lit(cat).alias("category"), F.lit(LABELS[cat]).alias("label"), conf.alias("confidence"), F.lit(status).alias("value_status")
    )
    green, bare, busy = c("vegetation_ratio") >= VEGETATION_MIN, c("ground_ratio_lower") >= GROUND_MIN, c("edge_ratio_lower") >= EDGE_MIN
    rows = F.array_compact(
        F.array(
            F.when(green, row("vegetation", F.bround(F.least(F.lit(0.88), 0.42 + c("vegetation_ratio")), 2), "calculated")),
            F.when(green, row("tree_species", F.lit(0.1), "estimated")),
            F.when(bare, row("ground", F.bround(F.least(F.lit(0.76), 0.35 + c("ground_ratio_lower")), 2), "estimated")),
            F.when(busy, row("obstacle_candidate", F.lit(0.3), "estimated")),
        )
    )
    return keyframes.select("*", F.inline(rows))


def merge_observations(df: DataFrame, by: Sequence[str], order: Sequence[str], video: str = "video_id", evidence: str = "keyframe_id", k: int = MAX_EVIDENCE) -> DataFrame:
    """Per group: the most confident row, count, its videos and the first evidences.

    ``order`` is the walking order and breaks ties (earlier wins). The evidences are a
    top-k that Spark prunes before the shuffle; videos are reduced to distinct ones first
    (a mission has at most four).
    """
    leading = F.struct((-F.col("confidence")).alias("c"), *order)
    best = df.groupBy(*by).agg(
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("raw_detection_count"), F.min_by(evidence, leading).alias("representative")
    )
    videos = df.select(*by, video).distinct().groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(video)), ",").alias("source_videos"))
    first = top_k(df.select(*by, evidence, *[o for o in order if o not in (*by, evidence)]), by, [F.col(o) for o in order], k)
    shown = first.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(evidence).cast("string").alias("e")))), lambda r: r["e"]), ",").alias("evidence"))
    keys = list(by)
    return best.join(videos, keys).join(shown, keys)


def survey_wrapup(merged: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Topic statuses of a mission from the categories that occur."""
    has = lambda c: F.bool_or(F.col("category") == c)
    seen = merged.groupBy(mission).agg(has("vegetation").alias("_v"), has("ground").alias("_g"), has("obstacle_candidate").alias("_o"))
    row = lambda topic, status: F.struct(F.lit(topic).alias("topic"), status.alias("status"))
    pick = lambda flag, yes, no: F.when(F.col(flag), yes).otherwise(no)
    topics = F.array(
        row("vegetation", pick("_v", "observed", "not_observed")),
        row("tree_species", F.lit("unclear")),
        row("shrub_groups", F.lit("not_reliably_assessed")),
        row("regeneration", F.lit("not_reliably_assessed")),
        row("ground", pick("_g", "candidate_observed", "not_observed")),
        row("obstacles", pick("_o", "manual_review_candidates", "none_detected")),
        row("drivability", F.lit("manual_review_required")),
    )
    return seen.select(mission, F.inline(topics))


def survey_metrics(videos: DataFrame, keyframes: DataFrame, raw: DataFrame, merged: DataFrame, routes: DataFrame, mission: str = "mission_id") -> DataFrame:
    """Headline figures per mission. ``routes(mission, length_m)`` is missing where no route exists."""
    v = videos.groupBy(mission).agg(F.count(F.lit(1)).alias("traversals"), F.sum("duration_seconds").alias("_sec"))
    k = keyframes.groupBy(mission).agg(
        F.count(F.lit(1)).alias("keyframes"), F.bround(F.avg("sharpness"), 2).alias("mean_sharpness"), F.sum(F.col("segment_index").isNull().cast("long")).alias("unassigned_keyframes")
    )
    r = raw.groupBy(mission).agg(F.count(F.lit(1)).alias("raw_observations"))
    m = merged.groupBy(mission).agg(F.count(F.lit(1)).alias("merged_observations"), F.sum((F.coalesce("evidence", F.lit("")) == "").cast("long")).alias("without_evidence"))
    walked = F.coalesce("length_m", F.lit(0.0)) * F.col("traversals")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = v.join(k, mission, "left").join(r, mission, "left").join(m, mission, "left").join(routes.select(mission, "length_m"), mission, "left")
    return joined.select(
        mission, "traversals", F.bround("_sec", 2).alias("media_duration_seconds"), F.bround(walked, 2).alias("walked_total_m"),
        F.when(F.col("_sec") > 0, F.bround(walked / F.col("_sec"), 3)).alias("mean_speed_mps"),
        *[zero(c) for c in ("keyframes", "raw_observations", "merged_observations", "unassigned_keyframes", "without_evidence")],
        F.coalesce("mean_sharpness", F.lit(0.0)).alias("mean_sharpness"),
    )


def compare_configs(runs: DataFrame, by: Sequence[str] = (), order: str = "position") -> DataFrame:
    """Accept a configuration with more keyframes or sharper ones than the last accepted one.

    Three configurations per mission: the fold over them is an array expression.
    """
    row = F.struct(order, "name", "keyframes", "mean_sharpness")
    runs_ = F.sort_array(F.collect_list(row))
    grouped = runs.groupBy(*by).agg(runs_.alias("_r"))
    start = F.struct(F.lit(None).cast("long").alias("k"), F.lit(None).cast("double").alias("s"), F.array().cast("array<boolean>").alias("d"))

    def step(state: Column, run: Column) -> Column:
        better = state["k"].isNull() | (run["keyframes"] > state["k"]) | (run["mean_sharpness"] > state["s"])
        return F.struct(
            F.when(better, run["keyframes"]).otherwise(state["k"]).alias("k"),
            F.when(better, run["mean_sharpness"]).otherwise(state["s"]).alias("s"),
            F.concat(state["d"], F.array(better)).alias("d"),
        )

    decided = grouped.withColumn("_d", F.aggregate("_r", start, step)["d"])
    return decided.select(*by, F.posexplode("_r").alias("_i", "_run"), "_d").select(
        *by, "_run.*", F.when(F.element_at("_d", F.col("_i") + 1), "accepted").otherwise("rejected").alias("decision")
    )
