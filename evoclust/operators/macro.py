"""Macro-clusters from the p-MCs (offline phase).

In list order, an untagged p-MC of weight >= mu with untagged neighbours
(centroid distance < 2*eps) opens a macro-cluster that absorbs every MC
reachable through untagged neighbours.  When MC i is visited all before it are
tagged, and whatever an earlier macro-cluster absorbed is no neighbour of what
it left.  So a macro-cluster is the component of its first MC among the MCs
from that one on, and the list can be taken in rounds of whole components: a
component whose first MC is heavy is a macro-cluster; of any other one the
light MCs before its first heavy one are tagged for nothing and go, which may
leave several components for the next round.  Components come from cells or
pivots (``density``), without pairs, and no component is one task's group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoclust.functions import cf
from evoclust.operators import pivots
from evoclust.operators.density import density_labels
from evoclust.params import ClusterParams
from evoclust.session import cut, tidy


@tidy
def macro_map(mcs: DataFrame, mu: float, radius: float, d: int, singleton: bool = False) -> DataFrame:
    """``ord, seed_ord`` of the micro-clusters ``ord, centroid, weight`` that a
    macro-cluster holds, ``seed_ord`` the one that opened it.  MCs closer than
    ``radius`` are neighbours; ``singleton``: a heavy MC without neighbours
    makes a macro-cluster of its own."""
    left = cut(mcs.select("ord", "centroid", (F.col("weight") >= F.lit(float(mu))).alias("heavy")), "macro-left")
    found = []
    while True:
        comps = density_labels(left, radius, d, 0, id_col="ord", feat_col="centroid")
        of = cut(left.join(comps.select(F.col("id").alias("ord"), "comp"), "ord", "left")
                 .withColumn("comp", F.coalesce("comp", "ord")), "macro-comps")
        groups = of.groupBy("comp").agg(F.min("ord").alias("first"), F.min(F.when(F.col("heavy"), F.col("ord"))).alias("opens"),
                                        F.count(F.lit(1)).alias("n")).filter("opens IS NOT NULL")
        if not singleton:
            groups = groups.filter("n > 1")
        of = of.join(groups, "comp")
        found.append(cut(of.filter("first = opens").select("ord", F.col("first").alias("seed_ord")), "macro-found"))
        left = cut(of.filter("first < opens AND ord >= opens").select("ord", "centroid", "heavy"), "macro-left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _sums(members: DataFrame, by: str, weight, d: int, num_labels: int) -> DataFrame:
    """One row a macro-cluster, ``weight`` as given, all else added once."""
    g = members.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_members"), F.sum(weight).alias("weight"), F.sum("pts").cast("long").alias("pts"),
        *[F.sum(F.col("cf1")[k]).alias(f"_a{k}") for k in range(d)],
        *[F.sum(F.col("cf2")[k]).alias(f"_b{k}") for k in range(d)],
        *[F.sum(F.col("lbl_counts")[k]).cast("long").alias(f"_l{k}") for k in range(num_labels)])
    out = g.select(by, "n_members", F.array(*[F.col(f"_a{k}") for k in range(d)]).alias("cf1"),
                   F.array(*[F.col(f"_b{k}") for k in range(d)]).alias("cf2"), "weight", "pts",
                   F.array(*[F.col(f"_l{k}") for k in range(num_labels)]).alias("lbl_counts"))
    return out.select("*", cf.centroid("cf1", "weight").alias("centroid"), cf.correct_pts("lbl_counts").alias("correct_pts"),
                      cf.dominant_label("lbl_counts").alias("label"), cf.purity("lbl_counts").alias("purity"))


def _p_mcs(p_state: DataFrame) -> DataFrame:
    return p_state.filter(F.col("kind") == "p").select(
        "ord", "cf1", "cf2", "weight", "pts", "lbl_counts", cf.centroid("cf1", "weight").alias("centroid"))


def reference_map(p_state: DataFrame, params: ClusterParams, mu: float | None = None, eps: float | None = None) -> DataFrame:
    """``ord, seed_ord`` of the p-MCs, as :func:`macro_map`."""
    mu = params.offline_mu if mu is None else mu
    eps = params.offline_epsilon if eps is None else eps
    return macro_map(_p_mcs(p_state), mu, 2.0 * eps, params.num_dims, params.semantics == "paper")


def macro_clusters(p_state: DataFrame, params: ClusterParams, mu: float | None = None,
                   eps: float | None = None, clock: int | None = None) -> DataFrame:
    """Macro-clusters of the p-MCs of ``p_state``.  Reference semantics use
    the stored weights (each at its own last edit) and count every MC twice
    but the one that opens the macro-cluster (Q9); paper semantics first
    decay every p-MC to ``clock`` (Q12)."""
    if params.semantics == "paper" and clock is not None:
        from evoclust.operators.state import decay_to
        p_state = decay_to(p_state, clock, params.lam)
    members = reference_map(p_state, params, mu, eps).join(_p_mcs(p_state), "ord")
    twice = F.lit(1.0) if params.q_macro_weight_once else F.when(F.col("ord") == F.col("seed_ord"), 1.0).otherwise(2.0)
    return _sums(members, "seed_ord", F.col("weight") * twice, params.num_dims, params.num_labels)


def macro_members(mcs: DataFrame, eps: float, d: int) -> DataFrame:
    """The macro map ``ord, comp`` of micro-clusters ``ord, centroid, core``:
    cores closer than 2*eps share a macro-cluster, a border goes to its
    nearest core."""
    return pivots.core_clusters(mcs, 2.0 * eps, d, "core", "ord", "centroid").withColumnRenamed("id", "ord")


def macro_paper(p_state: DataFrame, params: ClusterParams, mu: float | None = None,
                eps: float | None = None, clock: int | None = None) -> DataFrame:
    """C6 in the paper's reading: core p-MCs (weight >= mu) are connected
    when their centroids are closer than 2*eps; each component is a macro;
    every other p-MC joins the component of its nearest core within 2*eps
    (ties to the lower ord) or stays out.  Weights are added once."""
    mu = params.offline_mu if mu is None else mu
    eps = params.offline_epsilon if eps is None else eps
    if clock is not None:
        from evoclust.operators.state import decay_to
        p_state = decay_to(p_state, clock, params.lam)
    mcs = cut(_p_mcs(p_state).withColumn("core", F.col("weight") >= F.lit(float(mu))), "macro-mcs")
    members = macro_members(mcs, eps, params.num_dims).withColumnRenamed("comp", "macro_id").join(mcs, "ord")
    return _sums(members, "macro_id", F.col("weight"), params.num_dims, params.num_labels)
