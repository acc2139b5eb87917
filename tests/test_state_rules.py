"""Replayed batches leave the state alone; labels out of range fail."""

import numpy as np
import pytest

from evoclust.operators.delta import decayed_delta
from evoclust.params import ClusterParams


def test_label_out_of_range_fails(spark):
    rows = [("p", 0, 1, [0.0, 1.0], 0), ("p", 0, 2, [0.0, 1.0], 2)]
    schema = "kind string, ord long, time long, features array<double>, label int"
    ok = decayed_delta(spark.createDataFrame(rows, schema), 0.25, 2, 3).collect()
    assert list(ok[0].lbl_counts) == [1, 0, 1]
    with pytest.raises(Exception, match="label not in"):
        decayed_delta(spark.createDataFrame([*rows, ("p", 0, 3, [0.0, 1.0], 7)], schema), 0.25, 2, 3).collect()


def test_old_replay_leaves_version_and_state(spark):
    from evoclust.plans.model import ClusterModel
    rng = np.random.default_rng(3)
    schema = "time long, features array<double>, label int, seq long"

    def batch(t):
        return spark.createDataFrame([(t, [float(v) for v in rng.normal(k % 2 * 5, 0.1, 2)], k % 2, t * 100 + k)
                                      for k in range(40)], schema)

    model = ClusterModel(spark, ClusterParams(num_dims=2, num_labels=2, epsilon=1.0, beta=0.3, mu=5.0, lam=0.1))
    model.initialize(batch(0))
    for b in range(3):
        model.process_batch(batch(b + 1), b)
    version, rows = model.meta.version, sorted(map(str, model.state.collect()))
    assert version == 2
    assert model.process_batch(batch(9), 1) is None
    assert model.meta.version == version and sorted(map(str, model.state.collect())) == rows
