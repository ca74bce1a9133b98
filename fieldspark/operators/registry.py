"""The run registry as a merge, not as a database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Registry statuses in workflow order.
RUN_STATUSES = ("unlabeled", "queued_for_labeling", "labeled", "training_ready")

OWNED_BY_INVENTORY = ("mission_name", "original_name", "source_path", "size_bytes", "terrain_category")


def upsert_runs(registry: DataFrame, inventory: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Merge the scanned inventory into the registry.

    New runs start as 'unlabeled', known ones refresh the columns the files own and
    keep status and note, runs without a video disappear. ``changes`` names each key
    as added, kept or removed.
    """
    seen = inventory.withColumn("_seen", F.lit(True))
    known = registry.withColumn("_known", F.lit(True))
    merged = known.alias("k").join(seen.alias("s"), F.col("k.run_id") == F.col("s.run_id"), "full_outer")
    change = (
        F.when(F.col("_known").isNull(), "added").when(F.col("_seen").isNull(), "removed").otherwise("kept")
    )
    changes = merged.select(F.coalesce("k.run_id", "s.run_id").alias("run_id"), change.alias("change"))
    kept = merged.where(F.col("_seen"))
    registry_out = kept.select(
        F.col("s.run_id").alias("run_id"),
        F.col("s.mission_id").alias("mission_id"),
        F.col("s.video_id").alias("video_id"),
        *[F.col(f"s.{c}").alias(c) for c in OWNED_BY_INVENTORY],
        F.coalesce("k.status", F.lit("unlabeled")).alias("status"),
        F.coalesce("k.note", F.lit("")).alias("note"),
        F.coalesce(F.col("k.discovered_at"), now).alias("discovered_at"),
        F.coalesce(F.col("k.updated_at"), now).alias("updated_at"),
    )
    return registry_out, changes


def workflow_rank(status: Column) -> Column:
    rank = F.lit(99)
    for i, name in enumerate(RUN_STATUSES):
        rank = F.when(status == name, i).otherwise(rank)
    return rank


def order_registry(registry: DataFrame) -> DataFrame:
    """By workflow step, mission and file name."""
    return registry.orderBy(workflow_rank(F.col("status")), "mission_name", "original_name")


def registry_totals(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count(F.nullif("terrain_category", F.lit(""))).alias("with_terrain_category"),
        F.sum((F.coalesce("source_path", F.lit("")) == "").cast("long")).alias("missing_video_file"),
    )
