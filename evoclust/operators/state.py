"""The cluster state table and its per-batch transitions.

State: ``kind STRING ('p'/'o'), ord LONG, mc_id STRING, cf1, cf2
ARRAY<DOUBLE>, weight DOUBLE, t0 LONG, last_edit LONG, pts LONG, lbl_counts
ARRAY<LONG>``.  ``ord`` is monotone per kind; ordering by it gives list order
(lowest index wins ties).  The table holds K rows, K being the number of
micro-clusters, so the transitions are small DataFrame jobs.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evoclust.functions import cf
from evoclust.params import ClusterParams

STATE_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("mc_id", T.StringType()),
    T.StructField("cf1", T.ArrayType(T.DoubleType())),
    T.StructField("cf2", T.ArrayType(T.DoubleType())),
    T.StructField("weight", T.DoubleType()),
    T.StructField("t0", T.LongType()),
    T.StructField("last_edit", T.LongType()),
    T.StructField("pts", T.LongType()),
    T.StructField("lbl_counts", T.ArrayType(T.LongType())),
])
STATE_COLS = [f.name for f in STATE_SCHEMA.fields]


@dataclass
class ModelMeta:
    """Scalars of the model next to the state table."""

    version: int = -1  # batch id of the state (-1: after init)
    clock: int = 0  # model lastEdit: running max of update times
    period: int = 0  # non-empty batches processed (prune period counter)
    max_p_ord: int = -1
    max_o_ord: int = -1
    n_p: int = 0
    n_o: int = 0
    rows: int = 0  # points in the batch of this version
    base: int = -1  # version whose folder holds a whole state; later ones hold changes

    def as_row(self) -> dict:
        return asdict(self)


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def conform(df: DataFrame) -> DataFrame:
    """Project/cast to the state schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE_SCHEMA.fields])


# ------------------------------------------------------------ J5 + F9

def apply_deltas(state: DataFrame, deltas: DataFrame, params: ClusterParams,
                 broadcast: bool = False) -> DataFrame:
    """Fold each delta into its MC; untouched MCs keep all but ``pts = 0``.

    Adds a transient ``promote`` flag: an o-MC touched by a delta whose new
    weight reaches beta*mu.  ``deltas`` has at most K rows; ``broadcast``
    is set by callers that know K is within the broadcast budget."""
    lam = params.lam
    d = deltas.withColumnRenamed("lbl_counts", "dl")
    j = state.join(F.broadcast(d) if broadcast else d, ["kind", "ord"], "left")
    has = F.col("dn").isNotNull()
    dt = F.col("tmax") - F.col("last_edit")
    if params.q_clamp_late:
        f, g = cf.decay_clamped(lam, dt), cf.decay_clamped(lam, -dt)
        le = F.greatest(F.col("last_edit"), F.col("tmax"))
    else:
        f, g = cf.decay(lam, dt), F.lit(1.0)
        le = F.col("tmax")
    new_w = F.col("weight") * f + F.col("dn") * g
    if params.q_accumulate_labels:
        lbl = F.zip_with("lbl_counts", "dl", lambda a, b: a + b)
    else:
        lbl = F.col("dl")
    out = (j.select(
               "kind", "ord", "mc_id",
               F.when(has, F.zip_with("cf1", "dcf1", lambda a, b: a * f + b * g)).otherwise(F.col("cf1")).alias("cf1"),
               F.when(has, F.zip_with("cf2", "dcf2", lambda a, b: a * f + b * g)).otherwise(F.col("cf2")).alias("cf2"),
               F.when(has, new_w).otherwise(F.col("weight")).alias("weight"),
               "t0",
               F.when(has, le).otherwise(F.col("last_edit")).cast("long").alias("last_edit"),
               F.coalesce(F.col("dpts"), F.lit(0)).cast("long").alias("pts"),
               F.when(has, lbl).otherwise(F.col("lbl_counts")).alias("lbl_counts"),
               (has & (F.col("kind") == "o") & cf.promotable(new_w, params.beta, params.mu)).alias("promote"),
           ))
    return out


# ---------------------------------------------------------------- C4

def promote(state: DataFrame, max_p_ord: int, small: bool = True) -> DataFrame:
    """Flagged o-MCs become p-MCs, appended in descending o-list order.

    ``small`` (state within the broadcast budget) numbers them with one
    global window; otherwise with the distributed row index."""
    flagged = state.filter(F.col("promote"))
    if small:
        w = Window.orderBy(F.col("ord").desc())
        moved = flagged.withColumn("ord", (F.lit(max_p_ord) + F.row_number().over(w)).cast("long"))
    else:
        from evoclust.sources.points import with_row_index
        moved = (with_row_index(flagged, [F.col("ord").desc()], "_k")
                 .withColumn("ord", (F.lit(max_p_ord + 1) + F.col("_k")).cast("long")).drop("_k"))
    moved = moved.withColumn("kind", F.lit("p"))
    kept = state.filter(~F.col("promote"))
    return kept.unionByName(moved).drop("promote")


# ---------------------------------------------------------------- C5

def decay_to(state: DataFrame, clock: int, lam: float) -> DataFrame:
    """decay weight and CFs of every MC to ``clock`` and set last_edit."""
    f = cf.decay(lam, F.lit(clock) - F.col("last_edit"))
    return (state.withColumn("weight", F.col("weight") * f)
            .withColumn("cf1", cf.scale("cf1", f))
            .withColumn("cf2", cf.scale("cf2", f))
            .withColumn("last_edit", F.lit(clock).cast("long")))


def prune(state: DataFrame, clock: int, params: ClusterParams) -> DataFrame:
    """p-MCs whose weight at the clock is below beta*mu are deleted;
    o-MCs below the outlier threshold (Q8) are deleted."""
    s = decay_to(state, clock, params.lam)
    thr = cf.prune_threshold(params.lam, F.lit(clock), F.col("t0"), params.tp, params.q_prune_fix)
    keep = F.when(F.col("kind") == "p", F.col("weight") >= F.lit(params.promote_weight)) \
        .otherwise(F.col("weight") >= thr)
    return s.filter(keep)


# --------------------------------------------------------------- A11

def snapshot(state: DataFrame, batch_id: int, points_in_batch: int,
             params: ClusterParams) -> DataFrame:
    """One row per MC, as in the micro_clusters result table."""
    return state.select(
        F.lit(batch_id).cast("long").alias("batch_id"),
        F.when(F.col("kind") == "p", F.lit("primary")).otherwise(F.lit("outlier")).alias("type"),
        "ord", "mc_id",
        cf.centroid("cf1", "weight").alias("centroid"),
        "cf1", "cf2", "weight", "t0", "last_edit", "pts", "lbl_counts",
        cf.correct_pts("lbl_counts").alias("correct_pts"),
        cf.dominant_label("lbl_counts").alias("label"),
        cf.purity("lbl_counts").alias("purity"),
        F.lit(points_in_batch).cast("long").alias("points_in_batch"),
        cf.radius("cf1", "cf2", "weight", params.q_radius_sum).alias("radius"),
    )


def micro_clusters(state: DataFrame) -> DataFrame:
    """The current p-MCs."""
    return state.filter(F.col("kind") == "p")
