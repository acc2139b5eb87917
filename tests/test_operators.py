"""Operators not covered by goldens: admission modes, row index, samples,
label encodings, paper-mode switches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoclust.params import ClusterParams


def _points(spark, xs, times=None, labels=None):
    n = len(xs)
    times = times if times is not None else [0] * n
    labels = labels if labels is not None else [0] * n
    return spark.createDataFrame([(int(times[i]), [float(v) for v in xs[i]], int(labels[i]), i) for i in range(n)],
                                 "time long, features array<double>, label int, seq long")


def test_admission_modes_agree_on_separated_groups(spark):
    """Well separated groups (farther apart than any radius test allows)
    fold the same way sequentially and per cell."""
    from evoclust.operators.admit import admit_cells, admit_ordered
    rng = np.random.default_rng(2)
    centers = np.array([[0.4, 0.4], [8.4, 8.4], [-7.6, 4.4]])  # cell centres (cell side 0.8)
    xs = np.concatenate([c + rng.normal(scale=0.05, size=(30, 2)) for c in centers])
    order = rng.permutation(len(xs))
    xs = xs[order]
    times = np.sort(rng.integers(0, 5, len(xs)))
    p = ClusterParams(num_dims=2, num_labels=1, epsilon=0.4)
    pts = _points(spark, xs, times)

    def summary(df):
        return sorted((round(r["weight"], 9), r["pts"]) for r in df.filter(~F.col("is_o0")).collect())
    a = summary(admit_ordered(pts, None, p))
    b = summary(admit_cells(pts, p))
    assert a == b
    assert sum(x[1] for x in a) == len(xs)


@pytest.mark.parametrize("semantics", ["reference", "paper"])
def test_cell_admission_is_the_fold_of_each_cell(spark, semantics):
    """Every cell, folded sequentially, opens one cluster with the same
    features; the result is the same for any partitioning."""
    from evoclust.functions import kernels as K
    from evoclust.operators.admit import admit_cells, cell_side
    rng = np.random.default_rng(7)
    xs = rng.uniform(-2, 2, (400, 3))
    times = np.sort(rng.integers(0, 60, len(xs)))
    labels = rng.integers(0, 2, len(xs))
    p = ClusterParams(num_dims=3, num_labels=2, epsilon=0.4, semantics=semantics)
    pts = _points(spark, xs, times, labels)

    def rows(df):
        return sorted((r["first_time"], r["first_seq"], r["last_edit"], r["pts"], tuple(r["lbl_counts"]),
                       *np.round([r["weight"], *r["cf1"], *r["cf2"]], 9)) for r in df.collect())
    got = rows(admit_cells(pts, p))
    assert got == rows(admit_cells(pts.repartition(13), p)) == rows(admit_cells(pts.coalesce(1), p))
    cells = {}
    for i, c in enumerate(map(tuple, np.floor(xs / cell_side(p)).astype(int))):
        cells.setdefault(c, []).append(i)
    want = []
    for at in cells.values():
        _, new, _ = K.admit_fold(times[at], np.array(at), xs[at], labels[at], None, p.lam, p.epsilon, 2,
                                 p.q_radius_sum, p.q_clamp_late)
        assert new.n == 1
        want.append((int(new.t0[0]), int(new.first_seq[0]), int(new.le[0]), int(new.pts[0]),
                     tuple(int(v) for v in new.lbl[0]), *np.round([new.w[0], *new.cf1[0], *new.cf2[0]], 9)))
    assert got == sorted(want)


def test_with_row_index_dense_and_ordered(spark):
    from evoclust.sources.points import with_row_index
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = with_row_index(df, ["k"], "seq").orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(5000))
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_stratified_and_sample_n(spark):
    from evoclust.operators.prep import sample_n, stratified_sample
    df = spark.range(1000).select(F.col("id").alias("vid"), (F.col("id") % 7).cast("int").alias("label"))
    s = stratified_sample(df, "label", 5, 42, "vid")
    counts = {r["label"]: r["count"] for r in s.groupBy("label").count().collect()}
    assert counts == {k: 5 for k in range(7)}
    assert stratified_sample(df, "label", 5, 42, "vid").collect() == s.collect()
    assert sample_n(df, 13, 1, "vid").count() == 13


def test_label_encodings(spark):
    from evoclust.operators.prep import clean_label, encode_labels, map_labels
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (0, "c")], "id long, name string")
    first = {r["name"]: r["label"] for r in encode_labels(df, "name", "first", "id").collect()}
    assert first == {"c": 0, "b": 1, "a": 2}
    alpha = {r["name"]: r["label"] for r in encode_labels(df, "name", "alpha").collect()}
    assert alpha == {"a": 0, "b": 1, "c": 2}
    ok, bad = map_labels(df, "name", {"a": 5, "b": 6})
    assert ok.count() == 3 and bad.count() == 1
    raw = spark.createDataFrame([("b'normal.'",), ("smurf.",)], "v string")
    assert [r[0] for r in raw.select(clean_label("v")).collect()] == ["normal", "smurf"]


def test_paper_switches(spark):
    """Q4 radius sum, Q6 accumulated labels, Q8 fixed threshold."""
    from evoclust.operators import state as st
    from evoclust.operators.delta import decayed_delta
    s = spark.createDataFrame([("o", 0, "a", [1.0, 1.0], [1.0, 1.0], 1.0, 0, 0, 1, [1, 0])], st.STATE_SCHEMA)
    pts = spark.createDataFrame([("o", 0, 0, [1.0, 1.0], 1)], "kind string, ord long, time long, features array<double>, label int")
    ref = ClusterParams(num_dims=2, num_labels=2)
    pap = ClusterParams(num_dims=2, num_labels=2, semantics="paper")
    d = decayed_delta(pts, 0.25, 2, 2)
    assert st.apply_deltas(s, d, ref).collect()[0]["lbl_counts"] == [0, 1]
    assert st.apply_deltas(s, d, pap).collect()[0]["lbl_counts"] == [1, 1]
    # prune at clock 0: the reference threshold is negative (kept), the fixed one is 1.0
    assert st.prune(s, 0, ref).count() == 1
    assert st.prune(s.withColumn("weight", F.lit(0.5)), 0, pap).count() == 0


def test_macro_paper_small(spark):
    """Two heavy cores close together plus a light border and a far noise MC."""
    from evoclust.operators import state as st
    from evoclust.operators.macro import macro_paper
    rows = [("p", 0, "a", [0.0, 0.0], [0.0, 0.0], 10.0, 0, 0, 0, [3, 0]),
            ("p", 1, "b", [3.0, 0.0], [1.0, 0.0], 10.0, 0, 0, 0, [2, 1]),  # centroid (0.3, 0)
            ("p", 2, "c", [1.2, 0.0], [1.0, 0.0], 2.0, 0, 0, 0, [0, 1]),   # centroid (0.6, 0): border
            ("p", 3, "d", [50.0, 0.0], [1.0, 0.0], 5.0, 0, 0, 0, [0, 2])]  # far away
    s = spark.createDataFrame(rows, st.STATE_SCHEMA)
    m = macro_paper(s, ClusterParams(num_dims=2, num_labels=2), mu=5.0, eps=0.2).collect()
    got = sorted((r["macro_id"], r["n_members"], r["weight"]) for r in m)
    assert got == [(0, 3, 22.0), (3, 1, 5.0)]


def test_paper_seeding_matches_direct_scan(spark):
    """Q2 paper seeding, replayed per component, equals one direct scan."""
    from evoclust.operators.seeding import init_clusters
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(c, 0.15, size=(40, 2)) for c in ((0, 0), (2, 2), (0, 3))])
    lab = rng.integers(0, 3, len(x))
    p = ClusterParams(num_dims=2, num_labels=3, init_epsilon=0.3, mu=10, beta=0.5, paper_seeding=True)
    pts = spark.createDataFrame([(i, [float(v) for v in x[i]], int(lab[i])) for i in range(len(x))],
                                "seq long, features array<double>, label int")
    state, info = init_clusters(pts, p)
    got = sorted((r["ord"], r["weight"]) for r in state.collect())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    tag = np.zeros(len(x), bool)
    expect = []
    for i in range(len(x)):
        if tag[i]:
            continue
        nb = [j for j in range(len(x)) if j != i and not tag[j] and d[i, j] < 0.3]
        if len(nb) + 1 > 5.0:
            tag[[i] + nb] = True
            expect.append((i, float(len(nb) + 1)))
    assert got == expect and info["untagged"] == int((~tag).sum())


def test_sources_and_prep_round_trip(spark, tmp_path):
    """S12 write, S5/S13 read back, S14 row time, P3/P4/P6, O6, U1, A9, W1."""
    from evoclust.operators import metrics as M
    from evoclust.operators import prep
    from evoclust.sources.points import read_points_csv, with_row_time, write_dataset_csv
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), int(c)) for a, b, c in zip(rng.normal(size=50), rng.normal(size=50),
                                                            rng.integers(0, 3, 50))]
    df = spark.createDataFrame(rows, "x double, y double, label int")
    out = str(tmp_path / "ds")
    write_dataset_csv(df.coalesce(1), out, ["x", "y"])
    back = read_points_csv(spark, out, 2)
    assert back.count() == 50 and set(back.columns) == {"features", "label", "seq"}
    assert sorted(r["seq"] for r in back.collect()) == list(range(50))
    hdr = str(tmp_path / "hdr.csv")
    with open(hdr, "w") as f:
        f.write("a,b,target\n")
        for a, b, c in rows:
            f.write(f"{a},{b},t{c}\n")
    h = read_points_csv(spark, hdr, 2, header=True, label_col="target")
    assert h.count() == 50 and h.first()["label"].startswith("t")
    assert [r["time"] for r in with_row_time(back).orderBy("seq").limit(3).collect()] == [1, 2, 3]
    z = prep.z_score(df.withColumn("k", F.lit(1.0)), ["x", "y", "k"])
    prep.assert_standardised(z, ["x", "y"])
    assert prep.drop_null_columns(z, ["x", "y", "k"]).columns == ["x", "y", "label"]
    assert prep.shuffle_rows(df.withColumn("id", F.monotonically_increasing_id()), 1, "id").count() == 50
    merged = prep.merge_datasets([df, df], [0, 3])
    assert sorted(r["label"] for r in prep.distinct_labels(merged).collect()) == [0, 1, 2, 3, 4, 5]
    ppb = M.points_per_batch(merged.withColumn("batch_id", (F.col("label") / 3).cast("long")))
    assert [(r["pts"], r["before"], r["after"]) for r in ppb.orderBy("batch_id").collect()] == [(50, 0, 50), (50, 50, 100)]
