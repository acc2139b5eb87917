"""A1-A3: decayed per-cluster deltas of one batch.

The reference folds the points of a cluster in time order,
``s = s * 2^(-lam*(t - t_prev)) + x``.  With ``T = max(t)`` this is the
order-free sum ``sum(2^(-lam*(T - t)) * x)``.  ``T`` need not be known while
the points are read: each point is decayed to the end of its time bucket,
sums are taken per (cluster, bucket) with map-side combine, and the few
bucket rows of a cluster are then moved to its ``T`` and added up.  One pass
over the points; every map task ships at most one row per (cluster, bucket),
whatever the skew of the assignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoclust.functions import cf


#: a bucket spans this many halvings; decay factors stay normal doubles
_BUCKET_HALVINGS = 256.0


def _label_counts(label: Column, num_labels: int) -> list[Column]:
    bad = F.raise_error(F.concat(F.lit(f"label not in 0..{num_labels - 1}: "), label.cast("string"))).cast("int")
    checked = F.when((label < 0) | (label >= num_labels), bad)
    return [F.sum(checked.when(label == k, 1).otherwise(0)).cast("long") for k in range(num_labels)]


def label_histogram(label: Column, num_labels: int) -> Column:
    """A2: ARRAY<LONG> of per-label counts (an aggregate expression).  A label
    outside ``0 .. num_labels - 1`` fails the job, as it has no place in the
    counts; a null label is counted nowhere."""
    return F.array(*_label_counts(label, num_labels))


def decayed_delta(assigned: DataFrame, lam: float, num_dims: int, num_labels: int,
                  keys=("kind", "ord"), first: str | None = None) -> DataFrame:
    """One row per cluster key: ``dcf1, dcf2 ARRAY<DOUBLE>, dn DOUBLE,
    tmax LONG, dpts LONG, lbl_counts ARRAY<LONG>, tmin LONG``.  Needs
    ``time >= 0``.  ``first`` names a column whose smallest value per key is
    returned under the same name."""
    keys = list(keys)
    x = F.col("features")
    if lam > 0:
        span = max(1, int(_BUCKET_HALVINGS / lam))
        end = (F.floor(F.col("time") / F.lit(span)) + 1) * F.lit(span)
        pts = assigned.withColumn("_end", end.cast("long"))
        w, per = cf.decay(lam, F.col("_end") - F.col("time")), [*keys, "_end"]
    else:  # nothing decays: plain sums, one aggregation
        pts, w, per = assigned, F.lit(1.0), keys
    sums = {"_n": w}
    for k in range(num_dims):
        sums[f"_a{k}"] = w * x[k]
        sums[f"_b{k}"] = w * x[k] * x[k]
    labels = [f"_l{k}" for k in range(num_labels)]
    least = [first] if first else []
    part = pts.groupBy(*per).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[c.alias(n) for n, c in zip(labels, _label_counts(F.col("label"), num_labels))],
        F.max("time").alias("_hi"), F.min("time").alias("_lo"), F.count(F.lit(1)).alias("_c"),
        *[F.min(c).alias(c) for c in least])
    if lam > 0:
        # a cluster has one row per bucket here: the window and the sum share
        # one shuffle by the cluster's key
        tmax = F.max("_hi").over(Window.partitionBy(*keys))
        moved = part.withColumn("_t", tmax).withColumn("_f", cf.decay(lam, F.col("_t") - F.col("_end")))
        g = moved.groupBy(*keys).agg(
            *[F.sum(F.col("_f") * F.col(n)).alias(n) for n in sums],
            *[F.sum(n).alias(n) for n in labels],
            F.max("_t").alias("_t"), F.min("_lo").alias("_lo"), F.sum("_c").alias("_c"),
            *[F.min(c).alias(c) for c in least])
    else:
        g = part.withColumnRenamed("_hi", "_t")
    return g.select(
        *keys,
        F.array(*[F.col(f"_a{k}") for k in range(num_dims)]).alias("dcf1"),
        F.array(*[F.col(f"_b{k}") for k in range(num_dims)]).alias("dcf2"),
        F.round("_n", 12).alias("dn"),  # two points of one time weigh 2, not 2 - 2e-16, in the promotion test
        F.greatest(F.col("_t"), F.lit(0)).cast("long").alias("tmax"),
        F.col("_c").alias("dpts"),
        F.array(*[F.col(n) for n in labels]).alias("lbl_counts"),
        F.col("_lo").alias("tmin"), *least,
    )


def batch_count(points: DataFrame) -> int:
    """A3: rows in a batch (one action)."""
    return points.count()
