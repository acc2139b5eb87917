"""Density clusters over cells against brute force over all pairs."""

import numpy as np
import pytest

from evoclust.operators import pivots
from evoclust.operators.density import density_labels, init_density
from evoclust.params import ClusterParams


def _brute(x, eps, need):
    """id -> (comp, core), by all distances."""
    n = len(x)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = dist < eps
    np.fill_diagonal(near, False)
    core = near.sum(1) > need
    comp = np.where(core, np.arange(n), -1)
    while True:
        new = comp.copy()
        for i in np.nonzero(core)[0]:
            new[i] = min([comp[i], *comp[near[i] & core]])
        if (new == comp).all():
            break
        comp = new
    out = {int(i): (int(comp[i]), True) for i in np.nonzero(core)[0]}
    for i in np.nonzero(~core)[0]:
        js = np.nonzero(near[i] & core)[0]
        if len(js):
            out[int(i)] = (int(comp[min(js, key=lambda j: (dist[i, j], j))]), False)
    return out


def _points(n, d, seed):
    """Blobs of very different density, lone points, ties, repeated points."""
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-3, 3, (5, d))
    x = centres[rng.integers(0, 5, n)] + rng.normal(0, 1, (n, d)) * rng.choice([0.03, 0.2, 0.8], (n, 1))
    return np.round(np.concatenate([x, x[: n // 10]]), 2)


def _frame(spark, x):
    rows = [(i, [float(v) for v in p], i % 2) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "seq long, features array<double>, label int")


@pytest.mark.parametrize("d,need,direct", [(1, 0, 64), (2, 3, 0), (3, 2, 1)])
def test_labels_equal_brute_force(spark, d, need, direct):
    x = _points(250, d, d)
    got = density_labels(_frame(spark, x), 0.25, d, need, direct=direct).collect()
    assert len(got) == len({r["id"] for r in got})
    assert {r["id"]: (r["comp"], r["core"]) for r in got} == _brute(x, 0.25, need)


def test_missing_coordinates_empty_table_and_width(spark):
    rows = [(0, [0.0, 0.0]), (1, [0.01, None]), (2, [0.01, float("nan")]), (3, [0.01, 0.0]), (4, None)]
    df = spark.createDataFrame(rows, "seq long, features array<double>")
    got = {r["id"]: r["comp"] for r in density_labels(df, 0.1, 2).collect()}
    assert got == {0: 0, 3: 0}
    assert density_labels(df.limit(0), 0.1, 2).count() == 0
    rows = [(i, None if f is None else f + [0.0, 0.0]) for i, f in rows]
    df = spark.createDataFrame(rows + [(9, [0.0] * 3)], "seq long, features array<double>")
    assert {r["id"]: r["comp"] for r in density_labels(df, 0.1, 4).collect()} == got
    assert density_labels(df.limit(0), 0.1, 4).count() == 0


def test_init_density_sums(spark):
    x = _points(200, 2, 7)
    p = ClusterParams(num_dims=2, num_labels=2, init_epsilon=0.25, mu=4)
    state, info = init_density(_frame(spark, x), p)
    want = _brute(x, 0.25, 4)
    groups = {}
    for i, (c, _) in want.items():
        groups.setdefault(c, []).append(i)
    rows = {r["ord"]: r for r in state.collect()}
    assert rows.keys() == groups.keys() and info["untagged"] == len(x) - len(want)
    for c, ids in groups.items():
        assert rows[c]["weight"] == len(ids) and sum(rows[c]["lbl_counts"]) == len(ids)
        assert np.allclose(rows[c]["cf1"], x[ids].sum(0)) and np.allclose(rows[c]["cf2"], (x[ids] ** 2).sum(0))


@pytest.mark.parametrize("d,eps,need,cell,block", [(2, 0.25, 3, 20, 15), (6, 0.5, 2, 8, 40), (6, 3.0, 5, 10, 7),
                                                   (64, 2.5, 0, 30, 30), (5, 0.3, 1, 10_000, 11)])
def test_pivot_cells_equal_brute_force(spark, d, eps, need, cell, block):
    x = _points(220, d, d + cell)
    df = _frame(spark, x).repartition(5)
    sizes = {"cell_rows": cell, "block_rows": block}
    got = pivots.density_labels(df, eps, d, need, **sizes).collect()
    assert len(got) == len({r["id"] for r in got})
    assert {r["id"]: (r["comp"], r["core"]) for r in got} == _brute(x, eps, need)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) < eps
    counts = pivots.neighbour_counts(df, eps, d, **sizes).collect()
    assert {r["id"]: r["neighbours"] for r in counts} == {i: int(n) - 1 for i, n in enumerate(near.sum(1))}


@pytest.mark.parametrize("strict", [True, False])
def test_pairs_in_five_dimensions(spark, strict):
    from evoclust.operators.graph import eps_edges
    x = np.round(_points(150, 5, 3), 0)  # a grid: many copies, and distances equal to eps
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(i, j) for i, j in zip(*np.nonzero(near < 2 if strict else near <= 2)) if i != j}
    got = [(r.src, r.dst) for r in eps_edges(_frame(spark, x), 2.0, 5, strict=strict).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs = pivots.eps_pairs(_frame(spark, x), 2.0, 5, strict=strict, cell_rows=9, block_rows=13).collect()
    assert {(r.a, r.b): r.dist for r in pairs} == {(i, j): near[i, j] for i, j in want if i < j} and len(pairs) == len(want) // 2


def test_a_dense_ball_is_settled_by_bounds(spark):
    """A third of the points within eps of each other visit few cells."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.001, (300, 8)), rng.uniform(-5, 5, (600, 8))])
    cells = pivots.Partition(_frame(spark, x), 8, 0.5, "seq", "features", 30, 1000).cells
    sure, some = cells.judge(x[:300], cells.of(x[:300])[0])
    assert (some & ~sure).sum() < 30 and sure.sum() >= 300
    got = pivots.density_labels(_frame(spark, x), 0.5, 8, 10, cell_rows=30).collect()
    assert {r["id"]: (r["comp"], r["core"]) for r in got} == _brute(x, 0.5, 10)


def _sphere(n, d, seed):
    """Points without structure (single precision), a dense ball and copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 5] = x[0] + rng.normal(size=(n // 5, d)) * 0.05
    x /= np.sqrt((x * x).sum(1))[:, None]
    return np.concatenate([x, x[: n // 10]]).astype(np.float32).astype(float)


@pytest.mark.parametrize("block", [None, 60])
def test_a_point_is_written_once_and_sent_once_a_block(spark, monkeypatch, block):
    """However many cells it visits: the visits grew with rows times cells."""
    x, rows, sent, keep = _sphere(300, 24, 1), {}, [], pivots.cut

    def counted(df, name="cut"):
        out = keep(df, name)
        if name in ("pivot-visits", "pivot-links"):
            rows[name] = out.count()
            sent.extend(len(r.blocks) for r in out.filter("blocks IS NOT NULL").collect() if "blocks" in out.columns)
        return out

    monkeypatch.setattr(pivots, "cut", counted)
    sizes = {"cell_rows": 5, "block_rows": block}
    got = pivots.neighbour_counts(_frame(spark, x), 1.2, 24, **sizes).collect()
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) < 1.2
    assert {r["id"]: r["neighbours"] for r in got} == {i: int(n) - 1 for i, n in enumerate(near.sum(1))}
    assert rows["pivot-visits"] == 300  # the copies are one point
    assert max(sent) <= (1 if block is None else 2 * 300 // block + 1)


def test_blocks_hold_whole_cells_or_a_part_of_a_large_one(spark):
    p = pivots.Partition(_frame(spark, _sphere(300, 24, 2)), 24, 1.2, "seq", "features", 5, 1000, block_rows=40)
    c = p.cells
    sizes = np.add.reduceat(c.rows, c.starts)
    assert c.rows.sum() == p.n == 300 and (sizes <= 40 * c.parts).all() and len(c.starts) <= 2 * 300 // 40 + 1
    assert (np.add.reduceat(c.rows > 0, c.starts)[c.parts > 1] == 1).all()
    assert sorted(pivots.in_order(c.pivots)) == list(range(len(c.pivots)))
    assert p.moved == "array<float>"


@pytest.mark.parametrize("eps,need", [(0.9, 3), (1.2, 1)])
def test_links_grow_with_rows_and_blocks(spark, monkeypatch, eps, need):
    """A point is written once, and a group of blocks gives at most one edge a
    point: both grew with rows times cells."""
    x, rows, keep = _sphere(300, 24, 3), {}, pivots.cut

    def counted(df, name="cut"):
        out = keep(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(pivots, "cut", counted)
    got = pivots.density_labels(_frame(spark, x), eps, 24, need, cell_rows=5).collect()
    assert {r["id"]: (r["comp"], r["core"]) for r in got} == _brute(x, eps, need)
    cells = 300 // 5 * pivots.RINGS
    assert rows["pivot-visits"] == 300 and rows["pivot-links"] <= 2 * 300 + cells  # points, and cells linked as wholes
    assert rows["pivot-edges"] <= 4 * 300 + cells


def test_joined_names_the_smallest_node():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 400, 250), rng.integers(0, 400, 250)
    want = np.arange(400)
    for _ in range(400):
        low = np.minimum(want[a], want[b])
        np.minimum.at(want, a, low)
        np.minimum.at(want, b, low)
    assert (pivots.joined(400, a, b) == want).all()
    assert (pivots.joined(3, np.zeros(0, int), np.zeros(0, int)) == np.arange(3)).all()
