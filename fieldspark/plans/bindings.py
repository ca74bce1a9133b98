"""Views that let the survey operators run on the driver's tables.

Each view exists twice with the same meaning: as a DataFrame here and as SQL text
in ``VIEWS`` for the comparison engine.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.operators import runs as R
from fieldspark.operators.ordered import HUGE_GROUP, balanced_chunks, largest_group, ordered_scan, row_index, whole_min

RASTER = ("video_id", "frame_index")
WIDTH, HEIGHT = 64, 16


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Score image, one array per image line: 16 consecutive vectors are one 64×16 frame."""
    f = F.expr("vec_id div 16")
    return table(spark, sf, "embeddings").select(
        (f % 4).alias("video_id"),
        F.expr("(vec_id div 16) div 4").alias("frame_index"),
        (F.col("vec_id") % 16).cast("int").alias("y"),
        F.transform("embedding", lambda v: v.cast("double")).alias("s"),
    )


def pix(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select(*RASTER, "y", F.posexplode("s").alias("x", "s"))


def raster_frames(spark: SparkSession, sf: str) -> DataFrame:
    return (
        lines(spark, sf).select(*RASTER).distinct().withColumn("width", F.lit(WIDTH)).withColumn("height", F.lit(HEIGHT))
    )


def mask_p(spark: SparkSession, sf: str) -> DataFrame:
    return R.encode_lines(lines(spark, sf), F.transform("s", lambda v: (v > 0).cast("int")), RASTER)


def mask_t(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.transform("s", lambda v, x: ((v > -0.02) & (x >= 8) & (x <= 55)).cast("int"))
    return R.encode_lines(lines(spark, sf), marked, RASTER)


def mask_blob(spark: SparkSession, sf: str) -> DataFrame:
    """A denser mask with larger connected areas."""
    return R.encode_lines(lines(spark, sf), F.transform("s", lambda v: (v > -0.15).cast("int")), RASTER)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Video frames: one video per user, frames in time order, media time in ms since the video's first row."""
    events = table(spark, sf, "events").withColumn(
        "ms", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    )
    numbered = ordered_scan(
        events, ["user_id"], ["ms", "event_id"], lambda t: balanced_chunks(t, "ms"), huge_videos(spark, sf), frame_index=row_index(), _begin=whole_min(F.col("ms"))
    )
    return numbered.select(
        F.col("user_id").alias("video_id"),
        "frame_index",
        (F.col("ms") - F.col("_begin")).alias("timestamp_ms"),
        "event_id",
        "event_type",
        "value",
    )


@functools.lru_cache(maxsize=32)
def huge_videos(spark: SparkSession, sf: str) -> bool:
    """Does any video have more rows than one task should order? Measured once per table."""
    return largest_group(table(spark, sf, "events"), ["user_id"]) > HUGE_GROUP


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """One label record per document; the label table gives its status."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "skipped").otherwise("draft")
    name = (
        F.when(F.col("lang") == "en", "traversable").when(F.col("lang") == "de", "tree").when(F.col("lang") == "fr", "shadow").otherwise("restricted")
    )
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    polygon = F.struct(name.alias("class_id"), F.array(point(0.1, 0.2), point(0.8, 0.2), point(0.5, 0.9)).alias("points"))
    n = (F.col("n_chars") % 3).cast("int")
    return joined.select(
        F.col("source").alias("mission_id"),
        (F.col("doc_id") % 7).alias("video_id"),
        F.col("doc_id").alias("frame_index"),
        status.alias("status"),
        name.alias("class_id"),
        F.array_repeat(polygon, n).alias("polygons"),
        n.alias("n_poly"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
        "n_chars",
        F.concat(F.lit("annotator-"), F.col("lang")).alias("annotator"),
    )


def videos(spark: SparkSession, sf: str) -> DataFrame:
    """One video per user of the event table."""
    v = F.col("video_id")
    return (
        frames(spark, sf)
        .groupBy("video_id")
        .agg(F.max("timestamp_ms").alias("_end"), F.count(F.lit(1)).alias("rows"))
        .select(
            "video_id",
            (v % 9).alias("mission_id"),
            (F.lit(10) + v % 6).cast("double").alias("fps"),
            (F.floor(F.col("_end") / 1000 * (10 + v % 6)) + 1).alias("total_frames"),
            F.sha2(v.cast("string"), 256).alias("sha256"),
            F.when(v % 4 != 3, F.element_at(F.array(F.lit("gravel"), F.lit("forest"), F.lit("meadow")), (v % 3 + 1).cast("int"))).alias("terrain_category"),
            (v % 25 == 7).alias("fully_not_traversable"),
            F.when(v % 2 == 0, "A_TO_B").otherwise("B_TO_A").alias("direction"),
            F.concat(F.lit("walk-"), v.cast("string")).alias("original_name"),
            "rows",
            F.lit(64).alias("width"),
            F.lit(16).alias("height"),
        )
    )


def walks(spark: SparkSession, sf: str) -> DataFrame:
    """The walk of each user and its direction."""
    users = table(spark, sf, "events").select(F.col("user_id").alias("video_id")).distinct()
    return users.withColumn("direction", F.when(F.col("video_id") % 2 == 0, "A_TO_B").otherwise("B_TO_A"))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Error events as off-path intervals."""
    return (
        frames(spark, sf)
        .where(F.col("event_type") == "error")
        .select(
            "video_id",
            F.col("event_id").alias("id"),
            F.col("timestamp_ms").alias("start_ms"),
            (F.col("timestamp_ms") + F.greatest(F.lit(200), F.floor(F.col("value") * 1000))).alias("end_ms"),
        )
    )


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Three event rows share a frame; boxes come from event arithmetic."""
    e = F.col("event_id")
    cx, cy = (e * 37 % 1000) / F.lit(1000.0), (e * 91 % 1000) / F.lit(1000.0)
    w, h = 0.05 + (e % 7) / F.lit(50.0), 0.08 + (e % 5) / F.lit(40.0)
    kind = (
        F.when(F.col("event_type") == "click", "tree").when(F.col("event_type") == "view", "shrub")
        .when(F.col("event_type") == "purchase", "vegetation_cluster").otherwise("unknown_obstacle")
    )
    return frames(spark, sf).select(
        "video_id",
        F.expr("frame_index div 3").alias("frame_index"),
        F.col("event_id").alias("detection_id"),
        kind.alias("class_id"),
        (F.col("value") / (1 + F.col("value"))).alias("confidence"),
        F.greatest(F.lit(0.0), cx - w / 2).alias("x1"),
        F.greatest(F.lit(0.0), cy - h / 2).alias("y1"),
        F.least(F.lit(1.0), cx + w / 2).alias("x2"),
        F.least(F.lit(1.0), cy + h / 2).alias("y2"),
        "timestamp_ms",
    )


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as sightings of labelled objects."""
    edits = F.array(F.lit("new"), F.lit("carried_unchanged"), F.lit("carried_adjusted"), F.lit("corrected"))
    c = table(spark, sf, "conversations")
    return c.select(
        (F.col("conv_id") % 10).alias("video_id"),
        F.when(F.col("conv_id") % 13 != 5, F.col("conv_id")).alias("tracking_id"),
        F.col("turn").alias("frame_index"),
        F.col("role").alias("class_id"),
        F.element_at(edits, (F.length("text") % 4 + 1).cast("int")).alias("edit"),
    )


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as videos found on disk, customers as missions."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return o.select(
        F.concat_ws("/", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_custkey").alias("mission_id"),
        F.col("o_orderkey").alias("video_id"),
        F.col("c_name").alias("mission_name"),
        F.concat(F.lit("video-"), F.col("o_orderkey").cast("string")).alias("original_name"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("/v/"), F.col("o_orderkey").cast("string"))).alias("source_path"),
        F.floor("o_totalprice").alias("size_bytes"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("terrain_category"),
    )


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Six of seven inventory rows are known already; some known runs have lost their video."""
    statuses = F.array(F.lit("unlabeled"), F.lit("queued_for_labeling"), F.lit("labeled"), F.lit("training_ready"))
    k = F.col("video_id")
    known = inventory(spark, sf).where(k % 7 != 0)
    lost = (
        inventory(spark, sf).where(k % 50 == 0)
        .withColumn("run_id", F.concat(F.lit("gone/"), k.cast("string")))
    )
    return known.unionByName(lost).select(
        "run_id", "mission_id", "video_id", F.lit("old").alias("mission_name"), "original_name", "source_path",
        F.lit(0).cast("long").alias("size_bytes"), F.lit("old").alias("terrain_category"),
        F.element_at(statuses, (k % 4 + 1).cast("int")).alias("status"),
        F.concat(F.lit("note "), (k % 3).cast("string")).alias("note"),
        k.alias("discovered_at"), (k + 1).alias("updated_at"),
    )


VIEWS = {
    "ann": """
        SELECT d.source AS mission_id, d.doc_id % 7 AS video_id, d.doc_id AS frame_index,
          CASE WHEN l.quality = 1 THEN 'confirmed' WHEN l.quality = 0 THEN 'skipped' ELSE 'draft' END AS status,
          CASE d.lang WHEN 'en' THEN 'traversable' WHEN 'de' THEN 'tree' WHEN 'fr' THEN 'shadow' ELSE 'restricted' END AS class_id,
          CAST(d.n_chars % 3 AS INTEGER) AS n_poly, coalesce(l.toxic, 0) AS toxic, d.n_chars, 'annotator-' || d.lang AS annotator
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "videos": """
        SELECT video_id, video_id % 9 AS mission_id, CAST(10 + video_id % 6 AS DOUBLE) AS fps,
          CAST(floor(max(timestamp_ms) / 1000 * (10 + video_id % 6)) AS BIGINT) + 1 AS total_frames, sha256(CAST(video_id AS VARCHAR)) AS sha256,
          CASE WHEN video_id % 4 <> 3 THEN ['gravel', 'forest', 'meadow'][video_id % 3 + 1] END AS terrain_category,
          video_id % 25 = 7 AS fully_not_traversable, CASE WHEN video_id % 2 = 0 THEN 'A_TO_B' ELSE 'B_TO_A' END AS direction,
          'walk-' || video_id AS original_name, count(*) AS "rows"
        FROM frames GROUP BY video_id""",
    "intervals": """
        SELECT video_id, event_id AS id, timestamp_ms AS start_ms, timestamp_ms + greatest(200, CAST(floor(value * 1000) AS BIGINT)) AS end_ms
        FROM frames WHERE event_type = 'error'""",
    "dets": """
        SELECT video_id, frame_index // 3 AS frame_index, event_id AS detection_id,
          CASE event_type WHEN 'click' THEN 'tree' WHEN 'view' THEN 'shrub' WHEN 'purchase' THEN 'vegetation_cluster' ELSE 'unknown_obstacle' END AS class_id,
          value / (1 + value) AS confidence,
          greatest(0, (event_id * 37 % 1000) / 1000.0::DOUBLE - (0.05::DOUBLE + (event_id % 7) / 50.0::DOUBLE) / 2) AS x1,
          greatest(0, (event_id * 91 % 1000) / 1000.0::DOUBLE - (0.08::DOUBLE + (event_id % 5) / 40.0::DOUBLE) / 2) AS y1,
          least(1, (event_id * 37 % 1000) / 1000.0::DOUBLE + (0.05::DOUBLE + (event_id % 7) / 50.0::DOUBLE) / 2) AS x2,
          least(1, (event_id * 91 % 1000) / 1000.0::DOUBLE + (0.08::DOUBLE + (event_id % 5) / 40.0::DOUBLE) / 2) AS y2, timestamp_ms
        FROM frames""",
    "trk": """
        SELECT conv_id % 10 AS video_id, CASE WHEN conv_id % 13 <> 5 THEN conv_id END AS tracking_id, turn AS frame_index, role AS class_id,
          ['new', 'carried_unchanged', 'carried_adjusted', 'corrected'][length(text) % 4 + 1] AS edit FROM conversations""",
    "inv": """
        SELECT o_custkey || '/' || o_orderkey AS run_id, o_custkey AS mission_id, o_orderkey AS video_id, c_name AS mission_name,
          'video-' || o_orderkey AS original_name, CASE WHEN o_orderstatus = 'P' THEN '' ELSE '/v/' || o_orderkey END AS source_path,
          CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS terrain_category
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "reg": """
        SELECT run_id, video_id, ['unlabeled', 'queued_for_labeling', 'labeled', 'training_ready'][video_id % 4 + 1] AS status, 'note ' || (video_id % 3) AS note,
          video_id AS discovered_at, video_id + 1 AS updated_at
        FROM (SELECT * FROM inv WHERE video_id % 7 <> 0 UNION ALL SELECT * REPLACE ('gone/' || video_id AS run_id) FROM inv WHERE video_id % 50 = 0)""",
    "pix": """
        SELECT (vec_id // 16) % 4 AS video_id, (vec_id // 16) // 4 AS frame_index, CAST(vec_id % 16 AS INTEGER) AS y,
               CAST(unnest(range(64)) AS INTEGER) AS x, CAST(unnest(embedding) AS DOUBLE) AS s FROM embeddings""",
    "raster_frames": "SELECT DISTINCT video_id, frame_index FROM pix",
    "grid": """
        SELECT video_id, frame_index, CAST(yy.y AS INTEGER) AS y, CAST(xx.x AS INTEGER) AS x
        FROM raster_frames, range(16) AS yy(y), range(64) AS xx(x)""",
    "mp": """
        SELECT g.video_id, g.frame_index, g.y, g.x, CASE WHEN p.s > 0 THEN 1 ELSE 0 END AS v
        FROM grid g LEFT JOIN pix p USING (video_id, frame_index, y, x)""",
    "mt": """
        SELECT g.video_id, g.frame_index, g.y, g.x, CASE WHEN p.s > -0.02 AND g.x BETWEEN 8 AND 55 THEN 1 ELSE 0 END AS v
        FROM grid g LEFT JOIN pix p USING (video_id, frame_index, y, x)""",
    "mb": """
        SELECT g.video_id, g.frame_index, g.y, g.x, CASE WHEN p.s > -0.15 THEN 1 ELSE 0 END AS v
        FROM grid g LEFT JOIN pix p USING (video_id, frame_index, y, x)""",
    "frames": """
        SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
               epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS timestamp_ms, event_id, event_type, value
        FROM events""",
}
NEEDS = {
    "videos": ["frames"],
    "intervals": ["frames"],
    "dets": ["frames"],
    "reg": ["inv"],
    "raster_frames": ["pix"],
    "grid": ["pix", "raster_frames"],
    "mp": ["pix", "raster_frames", "grid"],
    "mt": ["pix", "raster_frames", "grid"],
    "mb": ["pix", "raster_frames", "grid"],
}


def even(value: str, digits: int) -> str:
    """Half-even rounding of the printed decimal, which is what Spark's bround rounds."""
    return f"CAST(round_even(CAST(CAST({value} AS VARCHAR) AS DECIMAL(30, 20)), {digits}) AS DOUBLE)"


def sql(body: str, *names: str, **extra: str) -> str:
    """A complete statement: the named views (and what they need), extra views, then the body."""
    ordered: list[str] = []
    for name in names:
        for part in [*NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in ordered]
    parts += [f"{name} AS ({text.strip()})" for name, text in extra.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def rgb(spark: SparkSession, sf: str) -> DataFrame:
    """Three 8-bit channels derived from the score image."""
    channel = lambda f: F.abs(F.floor(F.col("s") * f)) % 256
    return pix(spark, sf).select(*RASTER, "y", "x", channel(1000).alias("b"), channel(1700).alias("g"), channel(2900).alias("r"))


VIEWS["rgb"] = """SELECT video_id, frame_index, y, x, CAST(abs(floor(s * 1000)) % 256 AS DOUBLE) AS b, CAST(abs(floor(s * 1700)) % 256 AS DOUBLE) AS g, CAST(abs(floor(s * 2900)) % 256 AS DOUBLE) AS r FROM pix"""
NEEDS["rgb"] = ["pix"]
