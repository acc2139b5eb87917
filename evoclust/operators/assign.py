"""Nearest micro-cluster per point with the radius test.

The cluster state is small (K rows) and is shipped to the tasks as one
broadcast after a size check; every point is matched map-side against it
(no shuffle, no join), looking at few centroids by bounds
(``kernels.CentroidIndex``).  A state larger than the broadcast budget is
matched by a partitioned join under the same bounds (``nearest``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evoclust.functions import kernels as K
from evoclust.operators.nearest import match_clusters
from evoclust.params import ClusterParams
from evoclust.session import cut

_STATE_COLS = ["ord", "cf1", "cf2", "weight", "last_edit"]


def state_row_bytes(d: int) -> int:
    return 32 * d + 56  # cf1, cf2, centroid and its copy in the index


def collect_state(state: DataFrame, kind: str, d: int, params: ClusterParams,
                  count: int | None = None):
    """Rows of one kind ordered by ``ord`` as arrays, or None when the kind
    is larger than the broadcast budget."""
    part = state.filter(F.col("kind") == kind)
    most = params.max_broadcast_bytes // state_row_bytes(d)
    if count is not None and count > most:
        return None
    rows = part.select(*_STATE_COLS).limit(most + 1).collect()
    if len(rows) > most:
        return None
    return K.state_arrays(sorted(rows, key=lambda r: r["ord"]), d)


def _assign_batches(p_bc, o_bc, params: ClusterParams, d: int):
    lam, eps = params.lam, params.epsilon
    rs, cl = params.q_radius_sum, params.q_clamp_late

    def fn(batches):
        P = p_bc.value
        O = o_bc.value
        for rb in batches:
            n = rb.num_rows
            x = K.list_to_matrix(rb.column("features"), d)
            t = rb.column("time").to_numpy(zero_copy_only=False).astype(np.float64)
            kind = np.full(n, None, dtype=object)
            ords = np.full(n, -1, dtype=np.int64)
            pidx, _, pok = K.nearest_admissible(x, t, P, lam, eps, rs, cl)
            if pok.any():
                kind[pok] = "p"
                ords[pok] = P["ord"][pidx[pok]]
            rest = ~pok
            if rest.any() and len(O["weight"]):
                oidx, _, ook = K.nearest_admissible(x[rest], t[rest], O, lam, eps, rs, cl)
                ri = np.nonzero(rest)[0]
                hit = ri[ook]
                kind[hit] = "o"
                ords[hit] = O["ord"][oidx[ook]]
            ord_arr = pa.array(np.where(kind == None, 0, ords), pa.int64(),  # noqa: E711
                               mask=(kind == None))  # noqa: E711
            yield (rb.append_column("kind", pa.array(kind.tolist(), pa.string()))
                   .append_column("ord", ord_arr))
    return fn


def assign_points(points: DataFrame, state: DataFrame, params: ClusterParams,
                  counts: dict | None = None, arrays: tuple | None = None) -> DataFrame:
    """Adds ``kind`` ('p', 'o' or null) and ``ord`` to every point.

    A point goes to its nearest p-MC (undecayed centroid, lowest ``ord`` on
    ties) when the radius after a tentative insert stays <= epsilon; else it
    tries its nearest o-MC the same way; else both are null.
    """
    d = params.num_dims
    spark = points.sparkSession
    counts = counts or {}
    if arrays is not None:
        # the caller already holds this (size-checked) state as arrays
        P, O = arrays
    elif "p" in counts and "o" in counts:
        if (counts["p"] + counts["o"]) * state_row_bytes(d) <= params.max_broadcast_bytes:
            # both kinds in one small collect (size known from the model meta)
            rows = state.select("kind", *_STATE_COLS).orderBy("kind", "ord").collect()
            P = K.state_arrays([r for r in rows if r["kind"] == "p"], d)
            O = K.state_arrays([r for r in rows if r["kind"] == "o"], d)
        else:
            P = O = None
    else:
        P = collect_state(state, "p", d, params, counts.get("p"))
        O = collect_state(state, "o", d, params, counts.get("o"))
    schema = T.StructType(points.schema.fields + [
        T.StructField("kind", T.StringType()), T.StructField("ord", T.LongType())])
    if P is not None and O is not None:
        sc = spark.sparkContext
        p_bc, o_bc = sc.broadcast(P), sc.broadcast(O)
        return points.mapInArrow(_assign_batches(p_bc, o_bc, params, d), schema)
    return _assign_partitioned(points, state, params)


def _assign_partitioned(points: DataFrame, state: DataFrame, params: ClusterParams) -> DataFrame:
    pts = cut(points.withColumn("node", F.monotonically_increasing_id()), "assign-points")
    p = match_clusters(pts, state.filter(F.col("kind") == "p"), params).select("node", F.col("ord").alias("_p"), F.col("ok").alias("_p_ok"))
    p = cut(pts.select("node", "time", "features").join(p, "node", "left").withColumn("_p_ok", F.coalesce("_p_ok", F.lit(False))), "assign-p")
    o = (match_clusters(p.filter(~F.col("_p_ok")), state.filter(F.col("kind") == "o"), params).filter("ok")
         .select("node", F.col("ord").alias("_o")))
    got = (p.select("node", "_p", "_p_ok").join(o, "node", "left")
           .select("node", F.when(F.col("_p_ok"), "p").when(F.col("_o").isNotNull(), "o").alias("kind"),
                   F.when(F.col("_p_ok"), F.col("_p")).otherwise(F.col("_o")).alias("ord")))
    return pts.join(got, "node").select(*points.columns, "kind", "ord")


def split_assigned(assigned: DataFrame):
    """(assigned, unassigned) partitions of one assignment."""
    return (assigned.filter(F.col("kind").isNotNull()),
            assigned.filter(F.col("kind").isNull()).drop("kind", "ord"))


# ------------------------------------------------------------------- J6

def _predict_batches(bc, d):
    def fn(batches):
        S = bc.value
        for rb in batches:
            x = K.list_to_matrix(rb.column("features"), d)
            idx, dist = S["index"].nearest(x)
            has = idx >= 0
            o = np.where(has, S["ord"][np.maximum(idx, 0)] if len(S["ord"]) else -1, -1)
            yield (rb.append_column("ord", pa.array(o, pa.int64(), mask=~has))
                   .append_column("dist", pa.array(dist, pa.float64(), mask=~has)))
    return fn


def predict(points: DataFrame, clusters: DataFrame, params: ClusterParams) -> DataFrame:
    """Nearest cluster (by centroid) of each point, without the radius test.

    ``clusters`` has ``ord, cf1, cf2, weight, last_edit``; adds ``ord`` and
    ``dist``.
    """
    d = params.num_dims
    most = params.max_broadcast_bytes // state_row_bytes(d)
    rows = clusters.select(*_STATE_COLS).limit(most + 1).collect()  # the clusters are evaluated once
    if len(rows) > most:
        pts = cut(points.withColumn("node", F.monotonically_increasing_id()), "predict-points")
        got = match_clusters(pts.withColumn("time", F.lit(0)), clusters.select(*_STATE_COLS), params)
        return pts.join(got.select("node", "ord", "dist"), "node", "left").drop("node")
    rows.sort(key=lambda r: r["ord"])
    bc = points.sparkSession.sparkContext.broadcast(K.state_arrays(rows, d))
    schema = T.StructType(points.schema.fields + [
        T.StructField("ord", T.LongType()), T.StructField("dist", T.DoubleType())])
    return points.mapInArrow(_predict_batches(bc, d), schema)


def predict_macro(points: DataFrame, clusters: DataFrame, members: DataFrame, params: ClusterParams) -> DataFrame:
    """J6 with the macro map ``ord, comp``: the nearest cluster of each point
    and its macro-cluster (null where the map leaves the cluster out)."""
    small = members.count() * 16 <= params.max_broadcast_bytes
    names = members.select("ord", F.col("comp").alias("macro_id"))
    return predict(points, clusters, params).join(F.broadcast(names) if small else names, "ord", "left")
