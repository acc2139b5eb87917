"""Quality metrics and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoclust.functions import cf


def with_purity(mcs: DataFrame, lbl_col: str = "lbl_counts") -> DataFrame:
    """A4: dominant label, its count and the purity of each cluster."""
    return mcs.select(
        "*",
        cf.correct_pts(lbl_col).alias("correct_pts"),
        cf.dominant_label(lbl_col).alias("dominant"),
        cf.purity(lbl_col).alias("purity"),
    )


def avg_purity(mcs: DataFrame, lbl_col: str = "lbl_counts") -> DataFrame:
    """A5: unweighted mean purity (null when there is no cluster)."""
    return mcs.agg(F.avg(cf.purity(lbl_col)).alias("avg_purity"),
                   F.count(F.lit(1)).alias("n_clusters"))


def points_per_batch(df: DataFrame, batch_col: str = "batch_id", pts_col: str | None = None) -> DataFrame:
    """A8 + W1: points per batch with the running total before and after.

    The window runs over the per-batch aggregate (one row per batch)."""
    val = F.sum(pts_col) if pts_col else F.count(F.lit(1))
    agg = df.groupBy(batch_col).agg(val.cast("long").alias("pts"))
    w = Window.orderBy(batch_col)
    return agg.select(
        batch_col, "pts",
        F.coalesce(F.sum("pts").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"),
        F.sum("pts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("after"),
    )


def homogeneity_completeness(df: DataFrame, cluster_col: str, label_col: str, by: str | None = None,
                             n_col: str | None = None) -> DataFrame:
    """A10: homogeneity, completeness and V-measure, a row for each value of
    ``by`` (or one row).

    With N points, ``H(label | cluster)`` and the other entropies are sums of
    ``n ln n`` over the contingency table, its rows, its columns and N; one
    aggregation over these four grouping sets gives them all.  ``n_col``: how
    many points a row stands for (a contingency table instead of points)."""
    group = [by] if by else []
    n = F.sum(n_col) if n_col else F.count(F.lit(1))
    cells = df.groupBy(*group, F.col(cluster_col).alias("_k"), F.col(label_col).alias("_c")).agg(n.cast("double").alias("_n"))
    cells = cells.filter("_n > 0")
    sums = cells.groupingSets([[*group, "_k", "_c"], [*group, "_k"], [*group, "_c"], group], *group, "_k", "_c").agg(
        F.sum("_n").alias("_n"), F.grouping("_k").alias("_gk"), F.grouping("_c").alias("_gc"))

    def over(k: int, c: int, value):  # over the sets with or without cluster and label
        return F.sum(F.when((F.col("_gk") == k) & (F.col("_gc") == c), value))

    nln = F.col("_n") * F.ln("_n")
    t = sums.groupBy(*group).agg(over(0, 0, nln).alias("kc"), over(0, 1, nln).alias("k"), over(1, 0, nln).alias("c"),
                                 over(1, 1, nln).alias("t"), over(0, 1, F.lit(1)).alias("nk"), over(1, 0, F.lit(1)).alias("nc"))
    one = F.lit(1.0)
    # H(c|k) N = k - kc and H(c) N = t - c; a single class or cluster scores 1
    t = t.select(*group, F.when(F.coalesce("nc", F.lit(0)) > 1, one - (F.col("k") - F.col("kc")) / (F.col("t") - F.col("c"))).otherwise(one).alias("homogeneity"),
                 F.when(F.coalesce("nk", F.lit(0)) > 1, one - (F.col("c") - F.col("kc")) / (F.col("t") - F.col("k"))).otherwise(one).alias("completeness"))
    both = F.col("homogeneity") + F.col("completeness")
    return t.withColumn("v_measure", F.when(both == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / F.when(both != 0, both)))


def cluster_counts(state: DataFrame) -> DataFrame:
    """Micro-clusters per kind."""
    return state.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def untagged_points(sample: DataFrame, absorbed: DataFrame, id_col: str = "seq") -> int:
    """Sample rows never absorbed (left anti join)."""
    return sample.join(absorbed, id_col, "left_anti").count()
