"""Init and batches against the plain sequential model, on generated points."""

from evoclust.params import ClusterParams
from evoclust.plans.model import ClusterModel
from tests.sequential import Sequential, assert_same, drifting_blobs, state_rows

SCHEMA = "time long, features array<double>, label int, seq long"


def _frame(spark, rows, first=0):
    return spark.createDataFrame([(t, [x, y], lab, first + i) for i, (t, x, y, lab) in enumerate(rows)], SCHEMA)


def test_init_and_ordered_batches(spark):
    p = ClusterParams(num_dims=2, num_labels=3, beta=0.2, prune_fix=True, admit_mode="ordered", init_mode="scan")
    seq, model = Sequential(p), ClusterModel(spark, p)
    start = drifting_blobs(150, 5)
    seq.init(start)
    model.initialize(_frame(spark, [(0, *r) for r in start]))
    assert seq.P
    assert_same(state_rows(model.state), seq.rows())
    pts = drifting_blobs(240, 6, shift=1.5)
    for b in range(6):
        rows = [((b * 40 + i) // 10, *r) for i, r in enumerate(pts[b * 40:(b + 1) * 40])]
        seq.batch(rows)
        model.process_batch(_frame(spark, rows, b * 40).repartition(3), b)
        assert_same(state_rows(model.state), seq.rows())
    assert any(r["promoted"] for r in model.history) and any(r["o_pruned"] for r in model.history)


def test_init_does_not_depend_on_the_first_number(spark):
    from evoclust.operators.seeding import init_clusters
    rows = [(0, *r) for r in drifting_blobs(120, 8)]
    p = ClusterParams(num_dims=2, num_labels=3)
    a, info = init_clusters(_frame(spark, rows), p)
    b, again = init_clusters(_frame(spark, rows, 1000), p)
    assert info == again
    shifted = [(k, o - 1000, *rest) for k, o, *rest in state_rows(b)]
    assert [tuple(r) for r in shifted] == state_rows(a)
