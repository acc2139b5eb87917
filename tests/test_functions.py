"""Hand-checkable values of the column functions (FIXTURES section 3.3)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoclust.functions import cf
from evoclust.functions import kernels as K


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def test_decay(spark):
    assert one(spark, cf.decay(0.25, F.lit(4))) == 0.5
    assert one(spark, cf.decay(0.25, F.lit(-4))) == 2.0
    assert one(spark, cf.decay_clamped(0.25, F.lit(-4))) == 1.0


def test_radius(spark):
    assert one(spark, cf.radius(F.array(F.lit(1.0)), F.array(F.lit(1.0)), F.lit(1.0))) == math.inf
    r = one(spark, cf.radius(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(2.5), F.lit(0.02)), F.lit(2.0)))
    assert r == pytest.approx(0.5)
    rs = one(spark, cf.radius(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(2.5), F.lit(0.02)), F.lit(2.0), True))
    assert rs == pytest.approx(math.sqrt(0.26))


def test_two_points_merge_threshold(spark):
    # one point at 0, the other at 0.78 / 0.82: radius 0.39 / 0.41
    for dist, ok in ((0.78, True), (0.82, False)):
        r = one(spark, cf.radius_after_insert(F.array(F.lit(0.0)), F.array(F.lit(0.0)), F.lit(1.0), F.lit(0),
                                              F.array(F.lit(dist)), F.lit(0), 0.25))
        assert r == pytest.approx(dist / 2)
        assert (r <= 0.4) == ok


def test_delta_and_apply(spark):
    from evoclust.operators.delta import decayed_delta
    pts = spark.createDataFrame([("p", 0, 0, [1.0], 0), ("p", 0, 4, [2.0], 1)],
                                "kind string, ord long, time long, features array<double>, label int")
    d = decayed_delta(pts, 0.25, 1, 2).collect()[0]
    assert d["tmax"] == 4 and d["dn"] == 1.5 and d["dcf1"] == [2.5] and d["dcf2"] == [4.5]
    assert d["lbl_counts"] == [1, 1]
    from evoclust.operators import state as st
    from evoclust.params import ClusterParams
    s = spark.createDataFrame([("p", 0, "a", [2.0], [2.0], 2.0, 0, 0, 0, [1, 0])], st.STATE_SCHEMA)
    out = st.apply_deltas(s, decayed_delta(pts, 0.25, 1, 2), ClusterParams(num_dims=1, num_labels=2)).collect()[0]
    assert out["weight"] == 2.5 and out["cf1"] == [3.5] and out["last_edit"] == 4
    assert out["lbl_counts"] == [1, 1] and out["pts"] == 2


def test_prune_threshold(spark):
    for age, ref, fix in ((0, -1.0, 1.0), (1, -0.840896, 1.159104), (10, -0.176777, 1.823223), (100, -2.98e-8, 2.0)):
        r = one(spark, cf.prune_threshold(0.25, F.lit(age), F.lit(0), 4, False))
        f = one(spark, cf.prune_threshold(0.25, F.lit(age), F.lit(0), 4, True))
        assert r == pytest.approx(ref, abs=1e-6, rel=1e-3)
        assert f == pytest.approx(fix, abs=1e-6)


def test_promotion_and_purity(spark):
    assert one(spark, cf.promotable(F.lit(2.0), 0.2, 10)) is True
    lc = F.array(F.lit(3), F.lit(3), F.lit(2))
    assert one(spark, cf.dominant_label(lc)) == 0
    assert one(spark, cf.purity(lc)) == 0.375


def test_logical_time(spark):
    from evoclust.sources.points import with_logical_time
    df = spark.range(7).withColumnRenamed("id", "seq")
    got = [r["time"] for r in with_logical_time(df, 3).orderBy("seq").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2]


def test_envelope(spark):
    from evoclust.sources.points import decode_points, decode_rejects, encode_points
    raw = spark.createDataFrame([("7/1.5,-2,1",), ("7/1.5,x,1",), ("7/1.5,1",), (None,), ("nodelim",)], "value string")
    good = decode_points(raw, 2).collect()
    assert len(good) == 1 and good[0]["time"] == 7 and good[0]["features"] == [1.5, -2.0] and good[0]["label"] == 1
    assert decode_rejects(raw, 2).count() == 4
    enc = encode_points(spark.createDataFrame([(7, [1.5, -2.0], 1)], "time long, features array<double>, label int"))
    assert enc.collect()[0]["value"] == "7/1.5,-2.0,1"


def test_kernel_matches_columns():
    rng = np.random.default_rng(1)
    cf1 = rng.normal(size=(5, 3))
    cf2 = cf1 ** 2 + rng.random((5, 3))
    w = rng.random(5) * 3
    r = K.radius_np(cf1, cf2, w)
    for i in range(5):
        if w[i] <= 1:
            assert r[i] == math.inf
        else:
            var = np.abs(cf2[i]) / w[i] - np.abs(cf1[i] ** 2) / w[i] ** 2
            assert r[i] == pytest.approx(math.sqrt(max(0, var.max())))


def test_ordered_fold_equals_closed_form(spark):
    """A1: the algebraic delta equals the reference's time-ordered fold."""
    from evoclust.operators.delta import decayed_delta
    rng = np.random.default_rng(7)
    rows = []
    for g in range(20):
        for _ in range(int(rng.integers(1, 30))):
            rows.append(("p", g, int(rng.integers(0, 50)), [float(v) for v in rng.normal(size=2)], int(rng.integers(0, 3))))
    df = spark.createDataFrame(rows, "kind string, ord long, time long, features array<double>, label int")
    got = {r["ord"]: r for r in decayed_delta(df, 0.25, 2, 3).collect()}
    for g in range(20):
        pts = sorted([r for r in rows if r[1] == g], key=lambda r: r[2])
        c1 = np.zeros(2)
        c2 = np.zeros(2)
        n, dt = 0.0, 0
        for _, _, t, x, _ in pts:
            f = 2 ** (-0.25 * (t - dt))
            x = np.array(x)
            c1, c2, n = c1 * f + x, c2 * f + x * x, n * f + 1
            dt = max(t, dt)
        assert got[g]["dn"] == pytest.approx(n, rel=1e-12)
        assert got[g]["dcf1"] == pytest.approx(list(c1), rel=1e-9, abs=1e-12)
        assert got[g]["dcf2"] == pytest.approx(list(c2), rel=1e-9, abs=1e-12)
        assert got[g]["tmax"] == dt


def test_partitioned_assignment_equals_broadcast(spark, monkeypatch):
    """A state above the broadcast budget is matched by cells and bounds, with
    the result of the broadcast pass; ties go to the lowest place."""
    from evoclust.operators import assign, nearest
    from evoclust.operators import state as st
    from evoclust.operators.assign import assign_points, predict
    from evoclust.params import ClusterParams
    rng = np.random.default_rng(4)
    mcs = []
    for i in range(90):
        c = np.round(rng.normal(size=2) * 3, 0 if i % 2 else 2)
        w = float(rng.integers(2, 20))
        cf1 = (c * w).tolist()
        cf2 = ((c * c + 0.01) * w).tolist()
        mcs.append(("p" if i % 3 else "o", i * 2, str(i), cf1, cf2, w, 0, int(rng.integers(0, 5)), 0, [1, 0]))
    state = spark.createDataFrame(mcs, st.STATE_SCHEMA)
    pts = spark.createDataFrame([(int(rng.integers(0, 6)), [float(v) for v in np.round(rng.normal(size=2) * 3, k % 3)], 0, k)
                                 for k in range(300)], "time long, features array<double>, label int, seq long")
    big = ClusterParams(num_dims=2, num_labels=2, epsilon=0.6)
    tiny = big.with_(max_broadcast_bytes=200)
    match = nearest.match_clusters
    monkeypatch.setattr(assign, "match_clusters", lambda *a: match(*a, cell_rows=6, block_rows=17))
    a = {r["seq"]: (r["kind"], r["ord"]) for r in assign_points(pts, state, big).collect()}
    b = {r["seq"]: (r["kind"], r["ord"]) for r in assign_points(pts, state, tiny).collect()}
    assert a == b and any(k == "p" for k, _ in a.values()) and any(k is None for k, _ in a.values())
    cl = state.select("ord", "cf1", "cf2", "weight", "last_edit")
    pa_ = {r["seq"]: (r["ord"], r["dist"]) for r in predict(pts, cl, big).collect()}
    pb_ = {r["seq"]: (r["ord"], r["dist"]) for r in predict(pts, cl, tiny).collect()}
    assert pa_ == pb_
    none = state.filter("ord < 0")
    assert all(r["kind"] is None for r in assign_points(pts, none, tiny).collect())
    assert assign_points(pts.limit(0), state, tiny).count() == 0


@pytest.mark.parametrize("d,k", [(1, 700), (2, 3000), (3, 5000), (8, 1000), (2, 40)])
def test_centroid_index_equals_all_distances(d, k):
    from evoclust.functions import kernels as K
    rng = np.random.default_rng(d)
    cen = np.round(rng.normal(size=(k, d)), 2)
    cen[k // 2:k // 2 + 20] = cen[:20]  # copies: the first one wins
    x = np.concatenate([np.round(rng.normal(size=(400, d)) * 1.5, 1), cen[::7], np.full((1, d), 50.0)])
    index = K.CentroidIndex(cen)
    a, b = K.nearest(x, cen), index.nearest(x)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_centroid_index_looks_at_few():
    from evoclust.functions import kernels as K
    rng = np.random.default_rng(1)
    blobs = rng.uniform(-20, 20, (60, 2))
    cen = blobs[rng.integers(0, 60, 100_000)] + rng.normal(size=(100_000, 2))
    x = blobs[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 2))
    index = K.CentroidIndex(cen)
    idx, dist = index.nearest(x)
    assert index.work / len(x) < 0.05 * len(cen)
    some = slice(0, 200)
    assert (idx[some] == K.nearest(x[some], cen)[0]).all()


def test_insert_point(spark):
    s = one(spark, cf.insert_point(F.array(F.lit(2.0)), F.array(F.lit(2.0)), F.lit(2.0), F.lit(0), F.lit(0),
                                   F.array(F.lit(1), F.lit(0)), F.array(F.lit(2.0)), F.lit(4), F.lit(1), 0.25))
    assert s["weight"] == 2.0 and s["cf1"] == [3.0] and s["cf2"] == [5.0]
    assert s["last_edit"] == 4 and s["pts"] == 1 and s["lbl_counts"] == [1, 1]
