"""J1/J6 for a cluster table over the broadcast budget: a join by bounds.

Some centroids, drawn by hash and bounded in number, are pivots; every cluster
lies in the cell of its nearest pivot, and a cell's radius is known.  A point
first meets the clusters of the cell nearest to it, which gives it a best
distance; then it meets only those cells whose nearest possible cluster,
``d(x,p) - R_p``, is not farther than that.  Points and clusters of a cell meet
in blocks, hot cells in many.  The points are written once and read by either
round, whatever the number of clusters; no state is broadcast.

A table within the budget is broadcast with a ``kernels.CentroidIndex``, which
decides by the same bounds inside the task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoclust.functions import cf
from evoclust.functions import kernels as K
from evoclust.operators.pivots import CELLS, OUT_ROWS, PIVOT_BYTES, meet
from evoclust.params import ClusterParams
from evoclust.session import cut, tidy

_MET = "node long, dist double, ord long, ok boolean"


@tidy
def match_clusters(points: DataFrame, clusters: DataFrame, params: ClusterParams, cell_rows: int = 2048,
                   block_rows: int = 4096, max_pivots: int = 1 << 16) -> DataFrame:
    """``node, dist, ord, ok`` for points ``node, time, features`` and clusters
    ``ord, cf1, cf2, weight, last_edit``: the nearest centroid (ties to the
    lowest ``ord``), and whether its radius with the point stays within
    epsilon.  No row for any point if there is no cluster."""
    d, spark = params.num_dims, points.sparkSession
    c = cut(clusters.select("ord", "cf1", "cf2", "weight", F.col("last_edit").cast("long").alias("last_edit"),
                            cf.centroid("cf1", "weight").alias("x")), "nearest-clusters")
    n = c.count()
    m = max(1, min(-(-n // cell_rows), max_pivots, PIVOT_BYTES // (8 * d)))
    share = min(1.0, (m + 6 * math.sqrt(m) + 50) / max(n, 1))
    h = F.pmod(F.xxhash64("ord"), F.lit(1 << 32))
    some = c.filter(h < F.lit(int(share * (1 << 32)))).orderBy(h, "ord").limit(m).select("x").collect()
    pivots = np.array([r.x for r in some], np.float64).reshape(len(some), d)
    held = spark.sparkContext.broadcast(pivots)

    def place(batches):
        p = held.value
        for rb in batches:
            x = K.list_to_matrix(rb.column("x"), d)
            cell, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
            step = max(1, CELLS // len(p))
            for lo in range(0, len(x), step):
                at = K.square_distances(x[lo:lo + step], p).argmin(1)
                diff = x[lo:lo + step] - p[at]
                cell[lo:lo + step], dist[lo:lo + step] = at, np.sqrt((diff * diff).sum(1))
            yield rb.append_column("cell", pa.array(cell)).append_column("far", pa.array(dist))

    c = cut(c.withColumnRenamed("ord", "node").mapInArrow(
        place, "node long, cf1 array<double>, cf2 array<double>, weight double, last_edit long, x array<double>, cell long, far double"),
        "nearest-cells")
    radius = np.full(len(pivots), -np.inf)  # of a cell without clusters
    for r in c.groupBy("cell").agg(F.max("far").alias("r")).collect():  # at most a row a pivot
        radius[r.cell] = r.r
    cells = spark.sparkContext.broadcast((pivots, radius))
    eps, lam, rs, cl = params.epsilon, params.lam, params.q_radius_sum, params.q_clamp_late

    def visits(first: bool):
        def run(batches):
            p, far = cells.value
            names = ["node", "time", "cell", "x"]
            for rb in batches:
                x = K.list_to_matrix(rb.column("features"), d)
                node, time = rb.column("node").to_numpy(), rb.column("time").to_numpy()
                best = None if first else rb.column("dist").to_numpy()
                step = max(1, CELLS // len(p))
                for lo in range(0, len(x), step):
                    xs = x[lo:lo + step]
                    off = K.rounding(xs, p)
                    dist = np.sqrt(K.square_distances(xs, p))
                    dist[:, np.isinf(far)] = np.inf
                    home = dist.argmin(1)
                    if first:
                        rows, at = np.arange(len(xs)), home
                    else:
                        open_ = dist - far <= (best[lo:lo + step] + off)[:, None]
                        open_[np.arange(len(xs)), home] = False
                        rows, at = np.nonzero(open_ & ~np.isinf(far))
                    for a in range(0, len(rows), OUT_ROWS):
                        r = rows[a:a + OUT_ROWS]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(node[lo + r]), pa.array(time[lo + r]), pa.array(at[a:a + OUT_ROWS]),
                             K.matrix_to_list(xs[r])], names=names)
        return run

    def compare(v: pa.Table, r: pa.Table) -> pa.Table:
        r = r.sort_by("node").combine_chunks()
        st = {"ord": r["node"].to_numpy(), "weight": r["weight"].to_numpy(), "last_edit": r["last_edit"].to_numpy().astype(float),
              **{k: K.list_to_matrix(r[n], d) for k, n in (("cf1", "cf1"), ("cf2", "cf2"), ("centroid", "x"))}}
        idx, dist, ok = K.nearest_admissible(K.list_to_matrix(v["x"], d), v["time"].to_numpy().astype(float), st, lam, eps, rs, cl)
        return pa.table({"node": v["node"], "dist": dist, "ord": st["ord"][idx], "ok": ok})

    def nearest(df: DataFrame) -> DataFrame:
        return df.groupBy("node").agg(F.min(F.struct("dist", "ord", "ok")).alias("m")).select("node", "m.dist", "m.ord", "m.ok")

    if not some:
        return points.select("node").limit(0).selectExpr("node", "cast(null as double) AS dist", "cast(null as long) AS ord",
                                                         "cast(null as boolean) AS ok")
    shape = "node long, time long, cell long, x array<double>"
    pts = points.select("node", F.col("time").cast("long").alias("time"), "features")
    first = cut(pts.mapInArrow(visits(True), shape), "nearest-visits")
    once = cut(nearest(meet(first, c, compare, _MET, block_rows)), "nearest-first")
    again = cut(pts.join(once.select("node", "dist"), "node").mapInArrow(visits(False), shape), "nearest-visits")
    return nearest(once.unionByName(meet(again, c, compare, _MET, block_rows)))
