"""Admission of the points no micro-cluster accepted.

``mode="cells"`` (the default, at every size): space is cut into half-open
cells of side ``2 * epsilon`` over all dimensions (``2 * epsilon / sqrt(d)``
where the radius sums the dimensions).  The deviation within a cell is at
most half its side, so the points of a cell pass the radius test of one
cluster in any order: a cell opens one o-MC, and its features are the
decayed sums of A1.  One aggregation with map-side combine; a cell holding a
third of all points is one row per map task.  O-MCs opened earlier are not
offered these points a second time.

``mode="ordered"``: the sequential rule of the original.  In (time, seq)
order, each point tries one o-MC (the nearest opened earlier in this batch,
or the first existing o-MC while none is open) and merges when the radius
stays <= epsilon, else opens a new o-MC.  It streams all sorted rows through
ONE task by definition, so it is only for reproducing small runs of the
original; nothing switches to it by itself.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evoclust.functions import kernels as K
from evoclust.operators.delta import decayed_delta
from evoclust.params import ClusterParams

NEW_MC_SCHEMA = T.StructType([
    T.StructField("is_o0", T.BooleanType()),
    T.StructField("first_time", T.LongType()),
    T.StructField("first_seq", T.LongType()),
    T.StructField("cf1", T.ArrayType(T.DoubleType())),
    T.StructField("cf2", T.ArrayType(T.DoubleType())),
    T.StructField("weight", T.DoubleType()),
    T.StructField("t0", T.LongType()),
    T.StructField("last_edit", T.LongType()),
    T.StructField("pts", T.LongType()),
    T.StructField("lbl_counts", T.ArrayType(T.LongType())),
])


def _new_rows(new: K.GrowingMCs):
    n = new.n
    return {
        "is_o0": [False] * n,
        "first_time": new.t0[:n].tolist(),
        "first_seq": new.first_seq[:n].tolist(),
        "cf1": [r.tolist() for r in new.cf1[:n]],
        "cf2": [r.tolist() for r in new.cf2[:n]],
        "weight": new.w[:n].tolist(),
        "t0": new.t0[:n].tolist(),
        "last_edit": new.le[:n].tolist(),
        "pts": new.pts[:n].tolist(),
        "lbl_counts": [r.tolist() for r in new.lbl[:n]],
    }


def _ordered_fn(o0, params: ClusterParams):
    d = params.num_dims

    def fn(batches):
        # one sequential fold over the sorted partition, consumed batch by
        # batch; only the clusters it opens are kept in memory
        cur, new = None, None
        started = False
        for rb in batches:
            if rb.num_rows == 0:
                continue
            t = rb.column("time").to_numpy(zero_copy_only=False)
            s = rb.column("seq").to_numpy(zero_copy_only=False)
            x = K.list_to_matrix(rb.column("features"), d)
            lab = rb.column("label").to_numpy(zero_copy_only=False)
            cur, new, _ = K.admit_fold(t, s, x, lab, o0, params.lam, params.epsilon,
                                       params.num_labels, params.q_radius_sum,
                                       params.q_clamp_late,
                                       resume=(cur, new) if started else None)
            started = True
        rows = _new_rows(new) if new is not None else {k: [] for k in NEW_MC_SCHEMA.names}
        if cur is not None and cur.get("touched"):
            rows["is_o0"].insert(0, True)
            rows["first_time"].insert(0, int(cur["t0"]))
            rows["first_seq"].insert(0, -1)
            rows["cf1"].insert(0, [float(v) for v in cur["cf1"]])
            rows["cf2"].insert(0, [float(v) for v in cur["cf2"]])
            rows["weight"].insert(0, float(cur["weight"]))
            rows["t0"].insert(0, int(cur["t0"]))
            rows["last_edit"].insert(0, int(cur["last_edit"]))
            rows["pts"].insert(0, int(cur["pts"]))
            rows["lbl_counts"].insert(0, [int(v) for v in cur["lbl_counts"]])
        yield pa.RecordBatch.from_pydict(rows, schema=_arrow_schema())
    return fn


def _arrow_schema():
    return pa.schema([
        ("is_o0", pa.bool_()), ("first_time", pa.int64()), ("first_seq", pa.int64()),
        ("cf1", pa.list_(pa.float64())), ("cf2", pa.list_(pa.float64())),
        ("weight", pa.float64()), ("t0", pa.int64()), ("last_edit", pa.int64()),
        ("pts", pa.int64()), ("lbl_counts", pa.list_(pa.int64())),
    ])


def first_outlier(state: DataFrame):
    """The o-MC at list position 0 (lowest ord) as a dict, or None."""
    rows = (state.filter(F.col("kind") == "o").orderBy("ord").limit(1)
            .select("ord", "cf1", "cf2", "weight", "t0", "last_edit", "pts", "lbl_counts").collect())
    if not rows:
        return None
    r = rows[0].asDict()
    return r


def admit_ordered(rest: DataFrame, o0: dict | None, params: ClusterParams) -> DataFrame:
    """Exact sequential admission; returns opened o-MCs (and o0 if it
    changed, flagged ``is_o0``)."""
    o0k = None
    if o0 is not None:
        o0k = {k: o0[k] for k in ("cf1", "cf2", "weight", "t0", "last_edit", "pts", "lbl_counts")}
    ordered = (rest.select("time", "seq", "features", "label")
               .repartition(1).sortWithinPartitions("time", "seq"))
    return ordered.mapInArrow(_ordered_fn(o0k, params), NEW_MC_SCHEMA)


def cell_side(params: ClusterParams) -> float:
    return 2.0 * params.epsilon / (math.sqrt(params.num_dims) if params.q_radius_sum else 1.0)


def admit_cells(rest: DataFrame, params: ClusterParams) -> DataFrame:
    """One o-MC per occupied cell (see module doc), numbered by its smallest
    time and ``seq``."""
    d = params.num_dims
    side = F.lit(cell_side(params))
    cell = F.array(*[F.floor(F.col("features")[k] / side) for k in range(d)])
    g = decayed_delta(rest.select(cell.alias("cell"), "time", "features", "label", F.col("seq").alias("first_seq")),
                      params.lam, d, params.num_labels, keys=("cell",), first="first_seq")
    return g.select(
        F.lit(False).alias("is_o0"), F.col("tmin").alias("first_time"), "first_seq",
        F.col("dcf1").alias("cf1"), F.col("dcf2").alias("cf2"), F.col("dn").alias("weight"),
        F.col("tmin").alias("t0"), F.col("tmax").alias("last_edit"), F.col("dpts").alias("pts"), "lbl_counts")


def admit_outliers(rest: DataFrame, o0: dict | None, params: ClusterParams) -> DataFrame:
    if params.admit_mode == "ordered":
        return admit_ordered(rest, o0, params)
    if params.admit_mode != "cells":
        raise ValueError(f"admit_mode must be cells or ordered, not {params.admit_mode}")
    return admit_cells(rest, params)
