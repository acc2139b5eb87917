"""Golden traces of FIXTURES.md section 3 (init and stream)."""

import pytest
from pyspark.sql import functions as F

from evoclust.params import ClusterParams
from evoclust.plans.model import ClusterModel
from evoclust.sources.points import read_points_csv, with_logical_time
from tests.conftest import ref_file

INIT = [
    ("init_toy_dataset.csv", 2, 3, [0, 1, 2], [50, 46, 47], [0.1797, 0.1535, 0.1771], 9, 1.0),
    ("datasets/init_aniso.csv", 2, 4, [0, 2, 3, 36], [93, 86, 89, 12], [0.2008, 0.1691, 0.1658, 0.1378], 23, 1.0),
    ("datasets/init_blobs.csv", 2, 3, [0, 2, 3], [87, 97, 97], [0.1571, 0.1839, 0.1727], 21, 1.0),
    ("datasets/init_blobs3_noisy.csv", 2, 5, [0, 2, 3, 69, 166], [46, 51, 80, 12, 12],
     [0.2614, 0.2535, 0.3555, 0.1570, 0.2194], 103, 0.98),
    ("datasets/init_blobs5_2d.csv", 2, 4, [0, 1, 2, 5], [42, 47, 95, 50], [0.1554, 0.1851, 0.3060, 0.2248], 19, 0.878947),
    ("datasets/init_blobs5_3d.csv", 3, 5, [0, 1, 2, 5, 10], [42, 46, 39, 49, 52],
     [0.1744, 0.1795, 0.1554, 0.1715, 0.1794], 26, 0.996154),
    ("datasets/init_noisy_circles.csv", 2, 9, [0, 2, 5, 9, 13, 19, 47, 111, 166], [16, 15, 15, 25, 12, 14, 13, 12, 12],
     [0.1968, 0.1651, 0.1704, 0.1768, 0.1157, 0.1544, 0.2107, 0.1496, 0.1868], 124, 1.0),
    ("datasets/init_noisy_moons.csv", 2, 2, [0, 1], [243, 248], [0.8072, 0.8236], 10, 1.0),
    ("datasets/init_ultimate.csv", 2, 10, [0, 1, 3, 4, 7, 13, 17, 27, 33, 425], [242, 30, 15, 38, 13, 17, 35, 39, 14, 12],
     [0.6616, 0.3174, 0.2099, 0.3739, 0.1586, 0.1265, 0.2974, 0.4012, 0.1855, 0.1777], 54, 1.0),
    ("datasets/init_varied.csv", 2, 3, [0, 2, 3], [100, 66, 97], [0.1033, 0.3273, 0.1671], 39, 1.0),
]


def _labels(rel):
    return 5 if "blobs5" in rel else 3


@pytest.mark.parametrize("rel,d,n_mc,seeds,weights,radii,untagged,purity", INIT)
def test_init_goldens(spark, rel, d, n_mc, seeds, weights, radii, untagged, purity):
    from evoclust.functions import cf
    from evoclust.operators.seeding import init_clusters

    p = ClusterParams(num_dims=d, num_labels=_labels(rel))
    pts = read_points_csv(spark, ref_file(rel), d)
    state, info = init_clusters(pts, p)
    rows = (state.select("ord", "weight", cf.radius("cf1", "cf2", "weight").alias("r"),
                         cf.purity("lbl_counts").alias("pur")).orderBy("ord").collect())
    assert [r["ord"] for r in rows] == seeds
    assert [r["weight"] for r in rows] == [float(w) for w in weights]
    assert [round(r["r"], 4) for r in rows] == pytest.approx(radii, abs=1.5e-4)
    assert info["untagged"] == untagged
    assert sum(r["pur"] for r in rows) / len(rows) == pytest.approx(purity, abs=1e-6)


# batch: rows, to p, to o, unassigned, promoted, p pruned, o pruned, p-MCs, o-MCs, sum w p, sum w o, sum pts, purity
T2_REF = """0 50 50 0 0 0 0 0 9 0 107.111041 0 50 0.834921
1 50 41 0 9 1 0 0 10 4 79.601492 5.548003 50 0.966667
2 50 40 9 1 2 0 0 12 3 73.251052 4.548003 50 0.931746
3 50 43 5 2 2 0 0 14 3 71.012674 3.707107 50 1.0
4 50 50 0 0 0 1 0 13 3 62.349764 0.587106 49 1.0
5 50 50 0 0 0 0 0 13 3 73.262234 0.587106 50 1.0
6 50 48 2 0 0 0 0 13 3 74.860699 2.32923 50 1.0
7 50 39 3 8 3 0 0 16 3 77.356997 2.302556 50 1.0
8 50 50 0 0 0 3 0 13 3 58.775315 0.492935 49 1.0
9 50 46 3 1 0 0 0 13 4 63.438816 3.947014 50 0.978022"""

T2_FIX = """0 50 50 0 0 0 0 0 9 0 107.111041 0 50 0.834921
1 50 41 0 9 1 0 0 10 4 79.601492 5.548003 50 0.966667
2 50 40 9 1 2 0 0 12 3 73.251052 4.548003 50 0.931746
3 50 43 5 2 2 0 0 14 3 71.012674 3.707107 50 1.0
4 50 50 0 0 0 1 3 13 0 62.349764 0 49 1.0
5 50 50 0 0 0 0 0 13 0 73.262234 0 50 1.0
6 50 48 0 2 0 0 0 13 2 74.860699 2.0 50 1.0
7 50 39 3 8 3 0 0 16 2 77.345782 2.0 50 1.0
8 50 50 0 0 0 3 2 13 0 58.77135 0 49 1.0
9 50 46 0 4 0 0 0 13 3 63.436458 3.707107 50 0.978022"""

T3_REF = """0 20 19 0 1 0 0 0 3 1 112.102586 1.0 20 0.756614
1 20 9 4 7 2 0 0 5 3 108.525105 4.548003 20 0.853968
2 20 11 4 5 2 0 0 7 4 106.180591 6.3889 20 0.923469
3 20 17 1 2 1 0 0 8 5 109.882016 6.548003 20 0.922619
4 20 19 0 1 0 2 0 6 6 29.862339 2.442986 19 0.919048
5 20 17 3 0 1 0 0 7 5 34.661729 2.573541 20 0.887755
6 20 18 1 1 0 0 0 7 5 33.628548 3.906541 20 0.887755
7 20 18 1 1 0 0 0 7 6 36.496497 5.49493 20 0.911565
8 20 19 1 0 0 1 0 6 6 29.321754 2.019761 20 0.902778
9 20 16 4 0 0 0 0 6 6 33.399434 5.409552 20 0.944444
10 20 15 3 2 0 0 0 6 8 29.722673 9.357696 20 1.0
11 20 18 2 0 0 0 0 6 8 30.819649 10.339334 20 0.958333
12 20 16 2 2 0 0 0 6 10 26.186518 5.234265 20 1.0
13 20 16 4 0 0 0 0 6 10 26.680654 8.593437 20 1.0
14 20 19 1 0 0 0 0 6 10 29.300116 8.838158 20 0.883333"""

T3_FIX = """0 20 19 0 1 0 0 0 3 1 112.102586 1.0 20 0.756614
1 20 9 4 7 2 0 0 5 3 108.525105 4.548003 20 0.853968
2 20 11 4 5 2 0 0 7 4 106.180591 6.3889 20 0.923469
3 20 17 1 2 1 0 0 8 5 109.882016 6.548003 20 0.922619
4 20 19 0 1 0 2 6 6 0 29.862339 0 18 0.919048
5 20 17 0 3 0 0 0 6 3 32.534174 3.0 20 0.952381
6 20 19 1 0 0 0 0 6 3 32.2081 3.707107 20 0.952381
7 20 19 0 1 0 0 0 6 4 32.571162 4.707107 20 0.919048
8 20 18 2 0 0 1 4 5 0 28.529888 0 18 0.95
9 20 16 0 4 0 0 0 5 4 32.007178 4.0 20 1.0
10 20 14 3 3 1 0 0 6 6 29.956257 6.5 20 0.916667
11 20 19 1 0 0 0 0 6 6 31.480622 6.648651 20 0.958333
12 20 16 3 1 0 1 7 5 0 25.926802 0 16 1.0
13 20 15 0 5 0 0 0 5 5 25.7099 5.0 20 1.0
14 20 18 2 0 0 0 0 5 5 28.220135 6.0 20 0.86"""

T4_REF = """0 50 49 0 1 0 0 0 5 1 136.218961 1.0 50 0.985714
1 50 12 9 29 2 0 0 7 5 131.064221 16.388634 50 0.989796
2 50 21 23 6 3 0 0 10 4 141.538987 11.122403 50 0.959524
3 50 30 20 0 3 0 0 13 1 106.834445 2.707107 50 1.0
4 50 49 0 1 0 7 0 6 2 41.621235 1.304828 33 1.0
5 50 42 5 3 0 0 0 6 2 47.554641 9.665598 50 0.895833
6 50 43 3 4 0 0 0 6 4 56.358215 10.499383 50 0.979167
7 50 44 6 0 0 0 0 6 4 55.72266 11.714588 50 1.0
8 50 39 11 0 1 1 0 6 3 53.12229 5.292034 47 0.941667
9 50 37 13 0 1 0 0 7 2 55.30837 6.88347 50 0.971429"""

T4_FIX = """0 50 49 0 1 0 0 0 5 1 136.218961 1.0 50 0.985714
1 50 12 9 29 2 0 0 7 5 131.064221 16.388634 50 0.989796
2 50 21 23 6 3 0 0 10 4 141.538987 11.122403 50 0.959524
3 50 30 20 0 3 0 0 13 1 106.834445 2.707107 50 1.0
4 50 49 0 1 0 7 2 6 0 41.621235 0 32 1.0
5 50 42 0 8 0 0 0 6 3 47.554641 6.776396 50 0.895833
6 50 43 4 3 0 0 0 6 4 56.358215 10.25127 50 0.979167
7 50 44 6 0 0 0 0 6 4 55.72266 11.981288 50 1.0
8 50 39 11 0 1 1 2 6 1 53.106665 3.1414 46 0.941667
9 50 37 6 7 2 0 0 8 1 60.682725 1.0 50 0.975"""

TRACES = [
    ("T2-ref", "datasets/init_noisy_circles.csv", "datasets/init_ultimate.csv", 10, 50, 0.2, False, T2_REF,
     [(5, [5, 7], 20.4614)]),
    ("T2-fix", "datasets/init_noisy_circles.csv", "datasets/init_ultimate.csv", 10, 50, 0.2, True, T2_FIX,
     [(5, [5, 7], 20.4614)]),
    ("T3-ref", "init_toy_dataset.csv", "datasets/init_blobs3_noisy.csv", 5, 20, 0.2, False, T3_REF,
     [(0, [0, 1], 15.8841), (2, [2, 4], 12.9686)]),
    ("T3-fix", "init_toy_dataset.csv", "datasets/init_blobs3_noisy.csv", 5, 20, 0.2, True, T3_FIX,
     [(0, [0, 1], 15.8869), (2, [2, 4], 12.9686)]),
    ("T4-ref", "datasets/init_blobs3_noisy.csv", "datasets/init_noisy_moons.csv", 10, 50, 0.5, False, T4_REF, []),
    ("T4-fix", "datasets/init_blobs3_noisy.csv", "datasets/init_noisy_moons.csv", 10, 50, 0.5, True, T4_FIX, []),
]


def _run_trace(spark, init, stream, rate, per_batch, beta, fix, n_batches):
    p = ClusterParams(num_dims=2, num_labels=3, beta=beta, prune_fix=fix, admit_mode="ordered", init_mode="scan")
    m = ClusterModel(spark, p)
    m.initialize(read_points_csv(spark, ref_file(init), 2))
    sp = with_logical_time(read_points_csv(spark, ref_file(stream), 2), rate).cache()
    out = []
    for b in range(n_batches):
        batch = sp.filter((F.col("seq") >= b * per_batch) & (F.col("seq") < (b + 1) * per_batch))
        out.append(m.process_batch(batch, b))
    return m, out


@pytest.mark.parametrize("name,init,stream,rate,per_batch,beta,fix,trace,macros", TRACES,
                         ids=[t[0] for t in TRACES])
def test_stream_traces(spark, name, init, stream, rate, per_batch, beta, fix, trace, macros):
    lines = [ln.split() for ln in trace.strip().splitlines()]
    m, got = _run_trace(spark, init, stream, rate, per_batch, beta, fix, len(lines))
    for ln, r in zip(lines, got):
        exp = [int(v) for v in ln[:10]] + [float(ln[10]), float(ln[11]), int(ln[12]), float(ln[13])]
        pos = [r["batch_id"], r["rows"], r["to_p"], r["to_o"], r["unassigned"], r["promoted"],
               r["p_pruned"], r["o_pruned"], r["n_p"], r["n_o"]]
        assert pos == exp[:10], (name, ln[0])
        assert r["sum_w_p"] == pytest.approx(exp[10], abs=1e-6)
        assert r["sum_w_o"] == pytest.approx(exp[11], abs=1e-6)
        assert r["sum_pts"] == exp[12]
        assert r["avg_purity"] == pytest.approx(exp[13], abs=1e-6)
    assert m.macro_clusters(mu=10).count() == 0
    # p-MC positions in list order: rank of ord
    from pyspark.sql import Window
    pos = (m.state.filter(F.col("kind") == "p")
           .withColumn("pos", F.row_number().over(Window.orderBy("ord")) - 1).select("ord", "pos"))
    posmap = {r["ord"]: r["pos"] for r in pos.collect()}
    from evoclust.operators.macro import reference_map
    members = {}
    for r in reference_map(m.state, m.params, mu=4).collect():
        members.setdefault(r["seed_ord"], []).append(r["ord"])
    mac = m.macro_clusters(mu=4).orderBy("seed_ord").collect()
    got_m = [(posmap[r["seed_ord"]], sorted(posmap[o] for o in members[r["seed_ord"]]), round(r["weight"], 4)) for r in mac]
    assert got_m == [(s, mem, w) for (s, mem, w) in macros]
