"""Initial micro-clusters by a greedy DBSCAN over a sample.

Scanned in file order, a point with more than ``mu`` untagged neighbours
(distance < init_epsilon) seeds a p-MC that absorbs those neighbours and,
recursively, the neighbourhoods of neighbours that are themselves dense.
Neighbourhoods never leave a connected component of the epsilon graph, so
the scan is exact when replayed component by component: edges by a grid
join (J3), components (C7), then one ordered replay per component that can
hold a seed (size > mu + 1).  Components are independent groups of a
``cogroup``; only a component's own points and edges meet in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evoclust.functions import kernels as K
from evoclust.operators.graph import connected_components, eps_edges
from evoclust.operators.state import conform
from evoclust.params import ClusterParams
from evoclust.session import cut

_OUT = T.StructType([
    T.StructField("comp", T.LongType()),
    T.StructField("seed", T.LongType()),
    T.StructField("cf1", T.ArrayType(T.DoubleType())),
    T.StructField("cf2", T.ArrayType(T.DoubleType())),
    T.StructField("weight", T.DoubleType()),
    T.StructField("lbl_counts", T.ArrayType(T.LongType())),
    T.StructField("untagged", T.LongType()),
    T.StructField("size", T.LongType()),
])


def init_clusters(points: DataFrame, params: ClusterParams) -> tuple[DataFrame, dict]:
    """Returns (state of p-MCs, info) for points ``seq, features, label``.

    info: ``seeds`` (p-MC count), ``untagged`` (points never absorbed),
    ``points``.
    """
    spark = points.sparkSession
    d, L, mu = params.num_dims, params.num_labels, params.mu
    pts = points.select("seq", "features", "label").cache()  # read by several jobs below
    n_points, point0 = pts.agg(F.count(F.lit(1)), F.min("seq")).first()  # point 0: the smallest seq
    edges = cut(eps_edges(pts, params.init_epsilon, d).select("src", "dst"), "init-edges")
    deg = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    paper = params.q_paper_seeding
    # a seed needs more than mu neighbours (reference) or a neighbourhood
    # weight above beta*mu counting itself (paper)
    need = params.beta * mu - 1 if paper else mu
    first = deg.filter(F.col("deg") > F.lit(need)).agg(F.min("src")).collect()[0][0]
    if first is None:
        pts.unpersist()
        return _empty(spark), {"seeds": 0, "untagged": n_points, "points": n_points}
    comps = connected_components(edges, unique=True)
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    big = sizes.filter(F.col("size") > F.lit(need + 1))
    members = comps.join(big, "comp").select("id", "comp", "size")
    c0 = comps.filter(F.col("id") == point0).select("comp").collect()
    comp0 = c0[0][0] if c0 else None
    cfirst = comps.filter(F.col("id") == first).select("comp").collect()[0][0]
    pretag = (not params.q_tag_seed) and comp0 is not None and comp0 != cfirst

    # fresh column names on each side keep the cogroup keys unambiguous
    p_side = (pts.join(members.select(F.col("id").alias("seq"), F.col("comp").alias("_pc")), "seq")
              .select(F.col("_pc").alias("comp"), "seq", "features", "label"))
    e_side = (edges.join(members.select(F.col("id").alias("src"), F.col("comp").alias("_ec")), "src")
              .select(F.col("_ec").alias("comp"), "src", "dst"))
    tag_seed = params.q_tag_seed
    min_w = params.beta * mu

    def replay(pdf: pd.DataFrame, edf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
        comp = int(pdf["comp"].iloc[0])
        seqs = pdf["seq"].to_numpy(np.int64)
        x = np.stack(pdf["features"].to_numpy()).astype(np.float64).reshape(len(pdf), d)
        src = np.searchsorted(seqs, edf["src"].to_numpy(np.int64))
        dst = np.searchsorted(seqs, edf["dst"].to_numpy(np.int64))
        zero_local = 0 if len(seqs) and seqs[0] == point0 else -1
        if paper:
            mcs, untagged = K.replay_init_paper(x, pdf["label"].to_numpy(), src, dst, min_w, L)
        else:
            mcs, untagged = K.replay_init(x, pdf["label"].to_numpy(), src, dst, mu, L,
                                          zero_local=zero_local,
                                          pretag_zero=pretag and comp == comp0,
                                          tag_seed=tag_seed)
        rows = [{"comp": comp, "seed": int(seqs[m["seed"]]), "cf1": m["cf1"].tolist(),
                 "cf2": m["cf2"].tolist(), "weight": m["weight"], "lbl_counts": m["lbl"].tolist(),
                 "untagged": untagged, "size": len(seqs)} for m in mcs]
        if not rows:
            rows = [{"comp": comp, "seed": -1, "cf1": None, "cf2": None, "weight": None,
                     "lbl_counts": None, "untagged": untagged, "size": len(seqs)}]
        return pd.DataFrame(rows)

    out = (p_side.groupBy("comp").cogroup(e_side.groupBy("comp"))
           .applyInPandas(replay, _OUT))
    out = cut(out, "init-mcs")
    per_comp = out.groupBy("comp").agg(F.first("untagged").alias("u"), F.first("size").alias("s"))
    tot = per_comp.agg(F.sum(F.col("s") - F.col("u")).alias("tagged")).collect()[0]["tagged"] or 0
    zero_outside = (not tag_seed) and (not paper) and (comp0 is None or
                                       members.filter(F.col("id") == point0).limit(1).count() == 0)
    untagged = n_points - int(tot) - (1 if zero_outside else 0)
    mcs = out.filter(F.col("seed") >= 0)
    state = conform(mcs.select(
        F.lit("p").alias("kind"),
        F.col("seed").alias("ord"),
        F.concat(F.lit("init-"), F.col("seed").cast("string")).alias("mc_id"),
        "cf1", "cf2", "weight",
        F.lit(0).alias("t0"), F.lit(0).alias("last_edit"), F.lit(0).alias("pts"),
        "lbl_counts"))
    n_seeds = mcs.count()
    pts.unpersist()
    return state, {"seeds": n_seeds, "untagged": untagged, "points": n_points}


def _empty(spark):
    from evoclust.operators.state import empty_state
    return empty_state(spark)
