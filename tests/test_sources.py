"""File order over several files and splits, header width, blank lines,
scores from one aggregation."""

import math
import os

import numpy as np
import pytest

from evoclust.operators.metrics import homogeneity_completeness
from evoclust.sources.points import read_points_csv, with_row_time


def test_seq_is_file_order_over_files_and_splits(spark, tmp_path):
    sizes = [7, 4000, 1, 900, 2500]
    k = 0
    for i, n in enumerate(sizes):
        with open(os.path.join(tmp_path, f"part-{i:03d}.csv"), "w") as f:
            for _ in range(n):
                f.write(f"{k}.0,{k % 7}.5,{k % 3}\n")
                k += 1
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # a file is many splits, a task several files
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        df = read_points_csv(spark, str(tmp_path), 2)
        got = df.collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert len(got) == k and all(int(r.features[0]) == r.seq for r in got)


def test_header_width_is_checked(spark, tmp_path):
    with open(os.path.join(tmp_path, "a.csv"), "w") as f:
        f.write("x,y,kind\n1.0,2.0,a\n3.0,4.0,b\n")
    got = read_points_csv(spark, str(tmp_path), 2, header=True, label_col="kind").orderBy("seq").collect()
    assert [(r.seq, r.features, r.label) for r in got] == [(0, [1.0, 2.0], "a"), (1, [3.0, 4.0], "b")]
    for d, label in ((3, "kind"), (2, "sort")):
        with pytest.raises(ValueError, match="header"):
            read_points_csv(spark, str(tmp_path), d, header=True, label_col=label)


def test_blank_lines_take_no_step(spark):
    rows = [(0, "a"), (1, ""), (2, "b"), (3, "  "), (4, None), (5, "c")]
    got = with_row_time(spark.createDataFrame(rows, "seq long, value string"), value_col="value").collect()
    assert sorted((r.time, r.value) for r in got) == [(1, "a"), (2, "b"), (3, "c")]


def _entropy(groups):
    n = sum(groups)
    return -sum(g / n * math.log(g / n) for g in groups if g)


def test_scores_by_batch_from_one_aggregation(spark):
    rng = np.random.default_rng(0)
    rows = [(int(b), int(k), int(c), int(n)) for b, k, c, n in zip(
        rng.integers(0, 3, 200), rng.integers(0, 5, 200), rng.integers(0, 4, 200), rng.integers(0, 9, 200))]
    rows += [(7, 1, 2, 5), (7, 1, 2, 1), (8, 0, 0, 3), (8, 0, 1, 3), (9, 0, 1, 2), (9, 1, 1, 2)]
    df = spark.createDataFrame(rows, "b int, k int, c int, n int")
    got = {r.b: r for r in homogeneity_completeness(df, "k", "c", "b", "n").collect()}
    for b in (0, 1, 2, 7, 8, 9):
        t = np.zeros((5, 4))
        for bb, k, c, n in rows:
            if bb == b:
                t[k, c] += n
        hc, hk = _entropy(t.sum(0)), _entropy(t.sum(1))
        h_all = _entropy(t.ravel())
        hom = 1.0 if hc == 0 else 1 - (h_all - hk) / hc
        com = 1.0 if hk == 0 else 1 - (h_all - hc) / hk
        assert got[b].homogeneity == pytest.approx(hom, abs=1e-9) and got[b].completeness == pytest.approx(com, abs=1e-9)
        assert got[b].v_measure == pytest.approx(2 * hom * com / (hom + com) if hom + com else 0, abs=1e-9)
    none = homogeneity_completeness(df.limit(0), "k", "c").collect()
    assert [tuple(r) for r in none] == [(1.0, 1.0, 1.0)]


def test_kafka_records_as_text(spark):
    from evoclust.operators.prep import describe_schema
    from evoclust.sources.points import decode_points, kafka_text
    raw = spark.createDataFrame([(None, bytearray(b"3/1.5,2.5,1"), 7)], "key binary, value binary, offset long")
    got = kafka_text(raw)
    assert dict(describe_schema(got)) == {"key": "string", "value": "string", "offset": "bigint"}
    (r,) = decode_points(got, 2, seq_col="offset").collect()
    assert (r.time, r.features, r.label, r.seq) == (3, [1.5, 2.5], 1, 7)
