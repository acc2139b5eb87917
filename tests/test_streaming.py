"""Structured Streaming run: file source, one file per micro-batch,
``availableNow``, against the plain sequential model; restart without
refolding; a crash between state and results; records that are no points."""

import math
import os
import shutil
import tempfile

from evoclust.params import ClusterParams
from evoclust.plans.model import ClusterModel
from evoclust.sources.points import read_points_csv
from evoclust.sources.results import ResultWriter, read_results
from evoclust.streaming.stream import decode_stream, preview_stream, run_stream
from tests.sequential import Sequential, assert_same, drifting_blobs, state_rows


def _write_batches(folder, batches, first):
    for b, rows in enumerate(batches, first):
        path = os.path.join(folder, f"batch-{b:04d}.txt")
        with open(path, "w") as f:
            f.writelines(f"{t}/{x!r},{y!r},{lab}\n" for t, x, y, lab in rows)
            if b == 1:
                f.write("3/1.0,nonsense,1\n")
        os.utime(path, (1_700_000_000 + b, 1_700_000_000 + b))


def _scores(rows):
    """Homogeneity and completeness of ``(cluster, label, points)`` rows."""
    def entropy(key):
        g = {}
        for r in rows:
            g[key(r)] = g.get(key(r), 0) + r[2]
        n = sum(g.values())
        return -sum(v / n * math.log(v / n) for v in g.values())
    hc, hk, h = entropy(lambda r: r[1]), entropy(lambda r: r[0]), entropy(lambda r: r[:2])
    return (1 - (h - hk) / hc if hc else 1.0), (1 - (h - hc) / hk if hk else 1.0)


def test_stream_restart_and_crash(spark, tmp_path):
    src, ckpt, root, res = (tempfile.mkdtemp(dir=tmp_path) for _ in range(4))
    start = drifting_blobs(150, 5)
    init = os.path.join(tmp_path, "init.csv")
    with open(init, "w") as f:
        f.writelines(f"{x!r},{y!r},{lab}\n" for x, y, lab in start)
    pts = drifting_blobs(240, 6, shift=1.5)
    batches = [[((b * 40 + i) // 10, *r) for i, r in enumerate(pts[b * 40:(b + 1) * 40])] for b in range(6)]
    p = ClusterParams(num_dims=2, num_labels=3, beta=0.2, prune_fix=True, init_mode="scan")
    seq = Sequential(p)
    seq.init(start)
    model = ClusterModel(spark, p, root=root)
    model.initialize(read_points_csv(spark, init, 2))
    writer = ResultWriter(spark, res)

    def stream():
        raw = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(src)
        return decode_stream(raw, 2, marked=True)

    _write_batches(src, batches[:3], 0)
    run_stream(stream(), model, available_now=True, checkpoint=ckpt, results=writer)
    for rows in batches[:3]:
        seq.batch(rows)
    assert_same(state_rows(model.state), seq.rows())

    # the run ended after the state of batch 2, before its results and commit
    shutil.rmtree(os.path.join(res, "micro_clusters", "batch_id=2"))
    for name in ("2", ".2.crc"):
        path = os.path.join(ckpt, "commits", name)
        if os.path.exists(path):
            os.remove(path)
    model2 = ClusterModel(spark, p, root=root)
    assert model2.resumed and model2.meta.version == 2
    before = state_rows(model2.state)
    _write_batches(src, batches[3:], 3)
    run_stream(stream(), model2, available_now=True, checkpoint=ckpt, results=writer)
    for rows in batches[3:]:
        seq.batch(rows)
    assert_same(state_rows(model2.state), seq.rows())

    # replaying an old batch changes neither version nor state
    assert before != state_rows(model2.state)
    empty = spark.createDataFrame([], "time long, features array<double>, label int, seq long")
    assert model2.process_batch(empty, 1) is None and model2.meta.version == 5
    assert_same(state_rows(model2.state), seq.rows())
    t = read_results(spark, res)
    assert sorted(r[0] for r in t["micro_clusters"].select("batch_id").distinct().collect()) == list(range(6))
    scores = {(r.batch_id, r.name): r.value for r in t["micro_metrics"].collect()}
    assert set(scores) == {(b, n) for b in range(6) for n in ("PURITY(avg)", "HOMOGENEITY", "COMPLETENESS")}
    # the scores of a batch are those of its points in the clusters that took them
    tables = {}
    for b, mc, label, n in model2.contingency().collect():
        tables.setdefault(b, []).append((mc, label, n))
    assert all(sum(n for *_, n in rows) == 40 for rows in tables.values())
    assert sorted(tables) == [3, 4, 5]  # the newest versions are kept
    for b, rows in tables.items():
        hom, com = _scores(rows)
        assert math.isclose(scores[b, "HOMOGENEITY"], hom, abs_tol=1e-9) and math.isclose(scores[b, "COMPLETENESS"], com, abs_tol=1e-9)
    # A row a batch with durations
    log = t["listener"].collect()
    got = {r.batch_id: r for r in log if r.event == "progress" and r.rows}
    assert sorted(got) == list(range(6)) and all(r.trigger_ms > 0 and "addBatch" in r.durations for r in got.values())
    assert [r.event for r in log].count("started") == [r.event for r in log].count("terminated") == 2
    assert all(r.total_s >= r.update_s > 0 for r in t["progress"].collect())
    assert [(r.batch_id, r.value) for r in t["rejects"].collect()] == [(1, "3/1.0,nonsense,1")]
    assert sorted((r.batch_id, r.rows) for r in t["progress"].collect()) == [(b, 40) for b in range(6)]


def _batch(spark, rows, first=0):
    return spark.createDataFrame([(t, [x, y], lab, first + i) for i, (t, x, y, lab) in enumerate(rows)],
                                 "time long, features array<double>, label int, seq long")


def test_versions_as_a_log(spark, tmp_path):
    """A state written as changes equals one written whole; what a batch
    writes follows the clusters it touches; old versions go."""
    whole = ClusterParams(num_dims=2, num_labels=3, beta=0.2, prune_fix=True, prune_period_from_tp=True, tp=50)
    log = whole.with_(log_over_bytes=0, compact_every=4)
    a, b = ClusterModel(spark, whole, root=str(tmp_path / "a")), ClusterModel(spark, log, root=str(tmp_path / "b"))
    pts = drifting_blobs(240, 6, shift=1.5)
    first = [(0, *r) for r in pts[:120]]
    sizes = []
    for k in range(8):
        rows = first if k == 0 else [(k, *r) for r in pts[120 + k * 3:120 + k * 3 + 3]]  # few points, few clusters
        for m in (a, b):
            m.process_batch(_batch(spark, rows, 1000 * k), k)
        assert_same(state_rows(a.state), state_rows(b.state))
        sizes.append(spark.read.parquet(b._version_path(k)).count())
        resumed = ClusterModel(spark, log, root=str(tmp_path / "b"))
        assert resumed.meta.version == k and state_rows(resumed.state) == state_rows(b.state)
    assert sizes[0] == sizes[0] and max(sizes[1:4]) <= 3 < sizes[4] and max(sizes[5:8]) <= 3  # version 4 is whole again
    assert b._stored_versions() == [4, 5, 6, 7] and a._stored_versions() == [5, 6, 7]
    assert not os.path.exists(b._version_path(0)) and not os.path.exists(a._contingency_path(2))


def test_empty_batch_advances_nothing(spark, tmp_path):
    """T5: a new batch without rows leaves state, clock and prune period."""
    p = ClusterParams(num_dims=2, num_labels=3, beta=0.2, prune_fix=True)
    m = ClusterModel(spark, p, root=str(tmp_path))
    rows = [(0, *r) for r in drifting_blobs(60, 2)]
    m.process_batch(_batch(spark, rows), 0)
    before, period = state_rows(m.state), m.meta.period
    assert m.process_batch(_batch(spark, []), 1) is None
    assert (m.meta.version, m.meta.period, state_rows(m.state)) == (0, period, before)
    m.process_batch(_batch(spark, [(1, *r) for r in drifting_blobs(20, 3)], 100), 2)
    assert m.meta.period == period + 1


def test_timed_stop_and_preview(spark, tmp_path):
    """A processing-time trigger until the timeout; S9: rows of a
    stream into memory."""
    src = tempfile.mkdtemp(dir=tmp_path)
    rows = [(i // 10, *r) for i, r in enumerate(drifting_blobs(50, 1))]
    _write_batches(src, [rows], 0)
    raw = spark.readStream.format("text").load(src)
    model = ClusterModel(spark, ClusterParams(num_dims=2, num_labels=3, beta=0.2, prune_fix=True))
    seen = []
    q = run_stream(decode_stream(raw, 2), model, trigger_seconds=1, timeout=20, on_batch=lambda b, rec: seen.append((b, rec["rows"])))
    assert not q.isActive and seen == [(0, 50)] and model.meta.rows == 50
    q = preview_stream(decode_stream(spark.readStream.format("text").load(src), 2), "memory", "shown", trigger_seconds=1)
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT * FROM shown").count() == 50
    finally:
        q.stop()
