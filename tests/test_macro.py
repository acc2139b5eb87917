"""Macro-clusters by rounds of components against the list taken one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoclust.operators.macro import macro_clusters, macro_map, macro_members
from evoclust.params import ClusterParams


def one_by_one(x, w, mu, radius, singleton):
    """ord -> seed: the list scan, an MC at a time."""
    near = [[j for j in range(len(x)) if j != i and math.dist(x[i], x[j]) < radius] for i in range(len(x))]
    tagged, seed = set(), {}
    for i in range(len(x)):
        if i in tagged:
            continue
        tagged.add(i)
        if w[i] < mu or not (singleton or any(j not in tagged for j in near[i])):
            continue
        seed[i], todo = i, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in tagged:
                    tagged.add(j)
                    seed[j] = i
                    todo.append(j)
    return seed


def _table(spark, x, w):
    rows = [("p", i, [float(v) for v in p], [float(v) ** 2 for v in p], float(a), 1, [1, i % 3]) for i, (p, a) in enumerate(zip(x, w))]
    return spark.createDataFrame(rows, "kind string, ord long, cf1 array<double>, cf2 array<double>, weight double, pts long, "
                                       "lbl_counts array<long>").repartition(3)


@pytest.mark.parametrize("d,n,radius,singleton", [(1, 150, 0.12, False), (2, 200, 0.32, True), (5, 150, 1.45, False)])
def test_map_equals_the_scan(spark, d, n, radius, singleton):
    rng = np.random.default_rng(d)
    x = np.round(rng.uniform(0, 5 if d > 1 else 12, (n, d)), 1)
    w = np.where(rng.random(n) < 0.25, 5.0, 1.0)
    want = one_by_one(x, w, 3.0, radius, singleton)
    mcs = _table(spark, x, w).select("ord", F.col("cf1").alias("centroid"), "weight")
    got = {r.ord: r.seed_ord for r in macro_map(mcs, 3.0, radius, d, singleton).collect()}
    assert got == want and len(set(want.values())) > 4


def test_a_chain_of_light_ones_takes_many_rounds(spark):
    x = [[0.0 + i] for i in range(12)]  # each next to the one before; light, heavy, light, ...
    order = [5, 0, 6, 1, 7, 2, 8, 3, 9, 4, 10, 11]
    w = [5.0 if i in (6, 9, 11) else 1.0 for i in range(12)]
    pos = [x[order.index(i)] for i in range(12)]
    want = one_by_one(pos, w, 3.0, 1.5, False)
    mcs = _table(spark, pos, w).select("ord", F.col("cf1").alias("centroid"), "weight")
    assert {r.ord: r.seed_ord for r in macro_map(mcs, 3.0, 1.5, 1).collect()} == want


def test_sums_count_absorbed_ones_twice(spark):
    w = [5.0, 2.0, 7.0, 1.0]
    x = [[a * b] for a, b in zip((0.0, 0.4, 9.0, 0.8), w)]  # the centroids, weighted
    p = ClusterParams(num_dims=1, num_labels=2)
    (m,) = macro_clusters(_table(spark, x, w), p, mu=4, eps=0.25).collect()
    assert (m.seed_ord, m.n_members, m.weight, m.pts) == (0, 3, 5 + 2 * (2 + 1), 3)
    assert m.cf1[0] == pytest.approx(1.6) and list(m.lbl_counts) == [3, 1]
    once = macro_clusters(_table(spark, x, w), p.with_(macro_weight_once=True), mu=4, eps=0.25).collect()
    assert [r.weight for r in once] == [8.0]
    assert macro_clusters(_table(spark, x, w).limit(0), p).count() == 0


def test_members_of_cores_in_five_dimensions(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.uniform(0, 3, (120, 5)), 1)
    core = rng.random(120) < 0.4
    x[5], core[5], core[90] = x[90], False, True  # a copy that is no core
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    comp = {i: i for i in np.flatnonzero(core)}
    for _ in range(120):
        comp = {i: min(comp[j] for j in comp if near[i, j] < 1.2) for i in comp}
    want = dict(comp)
    for i in np.flatnonzero(~core):
        js = [j for j in comp if near[i, j] < 1.2]
        if js:
            want[i] = comp[min(js, key=lambda j: (near[i, j], j))]
    rows = [(i, [float(v) for v in p], bool(c)) for i, (p, c) in enumerate(zip(x, core))]
    mcs = spark.createDataFrame(rows, "ord long, centroid array<double>, core boolean")
    assert {r.ord: r.comp for r in macro_members(mcs, 0.6, 5).collect()} == want
