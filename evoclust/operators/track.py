"""Macro-clusters followed over time: a stable id, and for how many maps.

Consecutive macro maps name their macro-clusters anew.  A macro-cluster
continues the earlier one with which it shares the most weight of
micro-clusters (``mc_id`` is stable); of several that would continue the same
one the one that shares the most does, the others are new.  Ties go to the
smaller id.  Everything is joins and sums over micro-clusters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoclust.session import cut


def follow(current: DataFrame, earlier: DataFrame | None, batch: int) -> DataFrame:
    """``mc_id, macro_id, total_batches`` of the map ``current`` (``mc_id,
    comp, weight``), given that of the batch before (None: the first one).
    A new macro-cluster is named ``<batch>-<comp>``."""
    now = current.select("mc_id", "comp", "weight")
    if earlier is None:
        return now.select("mc_id", F.concat(F.lit(f"{batch}-"), F.col("comp")).alias("macro_id"), F.lit(1).alias("total_batches"))
    now = cut(now, "macro-now")
    shared = (now.join(earlier, "mc_id").groupBy("comp", "macro_id")
              .agg(F.sum("weight").alias("w"), F.max("total_batches").alias("total_batches")))
    parent = shared.withColumn("_k", F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("w"), "macro_id"))).filter("_k = 1")
    heir = (parent.withColumn("_k", F.row_number().over(Window.partitionBy("macro_id").orderBy(F.desc("w"), "comp"))).filter("_k = 1")
            .select("comp", "macro_id", (F.col("total_batches") + 1).alias("total_batches")))
    return now.join(heir, "comp", "left").select(
        "mc_id", F.coalesce("macro_id", F.concat(F.lit(f"{batch}-"), F.col("comp"))).alias("macro_id"),
        F.coalesce("total_batches", F.lit(1)).alias("total_batches"))
