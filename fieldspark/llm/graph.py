"""Connected components by star contraction, with DataFrame joins and aggregates only.

Every round writes its edges to the shared folder, so lineage stays short and nothing is collected but two numbers.
A node with very many neighbours is safe: its minimum is combined before the shuffle, and adaptive execution splits the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.store import keep


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction. Large: each node's larger neighbours go to its smallest one. Small: its smaller neighbours do."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(low, "u")
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")) if small else moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each linked node reaches. Nodes without a link get no row.

    Null ids and self links are ignored; repeated links count once; no links give no rows.
    """
    edges = pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, seen = keep(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = tuple(state)
        edges = keep(_stars(_stars(edges, small=False), small=True), "edges")
