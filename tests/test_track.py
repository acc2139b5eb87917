"""Macro-clusters followed over maps, by hand."""

from evoclust.operators.track import follow


def _map(spark, groups):
    rows = [(mc, comp, float(w)) for comp, members in groups.items() for mc, w in members.items()]
    return spark.createDataFrame(rows, "mc_id string, comp long, weight double")


def _got(df):
    return {r.mc_id: (r.macro_id, r.total_batches) for r in df.collect()}


def test_split_merge_and_new(spark):
    a = follow(_map(spark, {1: {"a": 2, "b": 1, "c": 1}, 5: {"e": 1, "f": 1}}), None, 0)
    assert _got(a) == {"a": ("0-1", 1), "b": ("0-1", 1), "c": ("0-1", 1), "e": ("0-5", 1), "f": ("0-5", 1)}
    # 0-1 splits: the heavier part goes on; 0-5 goes on with a new member; d is new; c is gone
    b = follow(_map(spark, {2: {"b": 1.5}, 1: {"a": 2}, 4: {"d": 1}, 5: {"e": 1, "f": 1, "g": 9}}), a, 1)
    assert _got(b) == {"a": ("0-1", 2), "b": ("1-2", 1), "d": ("1-4", 1), "e": ("0-5", 2), "f": ("0-5", 2), "g": ("0-5", 2)}
    # they merge: the one that gives the most weight; a tie of weight goes to the smaller id
    c = follow(_map(spark, {1: {"a": 1, "b": 3}, 4: {"d": 1, "f": 1}}), b, 2)
    assert _got(c) == {"a": ("1-2", 2), "b": ("1-2", 2), "d": ("0-5", 3), "f": ("0-5", 3)}
    assert follow(_map(spark, {}), c, 3).count() == 0
