"""J3 against brute force, C7 against union-find."""

import numpy as np

from evoclust.operators.graph import connected_components, eps_edges


def _brute(x, eps):
    out = set()
    for i in range(len(x)):
        for j in range(len(x)):
            if i != j and np.sqrt(((x[i] - x[j]) ** 2).sum()) < eps:
                out.add((i, j))
    return out


def test_eps_edges_grid_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 5):
        x = rng.normal(size=(300, d))
        df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))],
                                   "seq long, features array<double>")
        got = {(r["src"], r["dst"]) for r in eps_edges(df, 0.5, d).collect()}
        assert got == _brute(x, 0.5)


def test_components_union_find(spark):
    rng = np.random.default_rng(5)
    n = 400
    edges = set()
    for _ in range(350):
        a, b = (int(v) for v in rng.integers(0, n, 2))
        if a != b:
            edges.add((a, b))
            edges.add((b, a))
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {r["id"]: r["comp"] for r in connected_components(df).collect()}
    nodes = {a for a, _ in edges}
    comp_min = {}
    for v in nodes:
        comp_min.setdefault(find(v), []).append(v)
    expect = {v: min(comp_min[find(v)]) for v in nodes}
    assert got == expect


def test_eps_edges_salted_hot_cell(spark):
    """A dense cell split into salted sub-groups gives the same edges."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.random((400, 2)) * 0.3, rng.normal(size=(100, 2))])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))],
                               "seq long, features array<double>")
    got = [(r["src"], r["dst"]) for r in eps_edges(df, 0.5, 2, cell_rows=37).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _brute(x, 0.5)


def test_rows_moved_grow_with_the_points(spark, monkeypatch):
    """All points in one cell: four times the points sent sixteen times the
    rows to the join, one copy of each for every ``cell_rows`` points."""
    x = np.random.default_rng(17).random((1200, 2)) * 0.9
    moved = {}
    for n in (300, 1200):
        df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "seq long, features array<double>")
        with monkeypatch.context() as m:
            alias = type(df).alias
            m.setattr(type(df), "alias", lambda self, name: moved.__setitem__((n, name), self.count()) or alias(self, name))
            edges = eps_edges(df, 1.0, 2, cell_rows=8)
        if n == 300:
            got = [(r["src"], r["dst"]) for r in edges.collect()]
            assert len(got) == len(set(got)) and set(got) == _brute(x[:n], 1.0)
    assert moved[1200, "l"] + moved[1200, "r"] < 5 * (moved[300, "l"] + moved[300, "r"])


def test_eps_edges_cut_on_both_sides(spark, monkeypatch):
    """Few points in a cell that many meet, copies, repeated ids, nulls; groups of a bounded size."""
    from evoclust.operators import graph
    monkeypatch.setattr(graph, "GROUP_ROWS", 40)
    rng = np.random.default_rng(19)
    x = np.concatenate([rng.random((5, 2)) * 0.1 + 0.4, rng.random((150, 2)) * 0.3 + [0.5, 0.3], rng.random((30, 2)) * 3])
    x = np.concatenate([x, x[:60]])
    ids = [*range(len(x) - 3), 0, 1, 70]
    rows = [(i, [float(v) for v in p]) for i, p in zip(ids, x)]
    df = spark.createDataFrame([*rows, (900, [None, 0.5]), (901, None), (None, [0.5, 0.4])], "seq long, features array<double>")
    want = sorted((ids[i], ids[j]) for i, j in _brute(x, 0.5) if ids[i] != ids[j])
    for cell_rows in (7, 4096):
        assert sorted((r["src"], r["dst"]) for r in eps_edges(df, 0.5, 2, cell_rows=cell_rows).collect()) == want


def test_a_point_goes_only_to_cells_within_eps(spark, monkeypatch):
    """Evenly spread points are sent to the join fewer than five times (six
    times before, 15 in three dimensions), cut dense cells included."""
    rng = np.random.default_rng(23)
    moved = {}
    alias = type(spark.range(0)).alias
    for d, most in ((2, 5), (3, 9)):
        x = rng.random((2000, d)) * 4 - 2
        x[:600, 1:] = x[:600, 1:] * 0.05
        df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "seq long, features array<double>")
        near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) < 0.2
        want = {(i, j) for i, j in zip(*np.nonzero(near)) if i != j}
        for cell_rows in (8, 4096):
            with monkeypatch.context() as m:
                m.setattr(type(df), "alias", lambda self, name: moved.__setitem__(name, self.count()) or alias(self, name))
                edges = eps_edges(df, 0.2, d, cell_rows=cell_rows)
            assert moved["l"] + moved["r"] < most * len(x)
            got = [(r["src"], r["dst"]) for r in edges.collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_pairs_across_the_edges_of_cells(spark):
    """Points on and beside multiples of eps and of the cells' side, far from
    zero and below it; distances equal to eps."""
    for eps, at in ((0.2, 0.0), (0.25, -1e6), (0.1, 1e9)):
        v = sorted({at + k * f * eps + s * eps * 1e-12 for k in range(-4, 5) for f in (1.0, 1.5) for s in (-1, 0, 1)})
        for d in (1, 2):
            x = np.array([[a] for a in v]) if d == 1 else np.array([[a, b] for a in v[::3] for b in v[1::4]])
            df = spark.createDataFrame([(i, [float(c) for c in p]) for i, p in enumerate(x)], "seq long, features array<double>")
            dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
            for strict in (True, False):
                want = {(i, j) for i, j in zip(*np.nonzero(dist < eps if strict else dist <= eps)) if i != j}
                got = [(r["src"], r["dst"]) for r in eps_edges(df, eps, d, strict=strict, cell_rows=20).collect()]
                assert len(got) == len(set(got)) and set(got) == want


def test_components_distributed_path(spark):
    """The contraction path (forced by local_edges=0) equals the one-task path."""
    rng = np.random.default_rng(9)
    edges = set()
    for _ in range(300):
        a, b = (int(v) for v in rng.integers(0, 500, 2))
        if a != b:
            edges.add((a, b))
            edges.add((b, a))
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    one = {r["id"]: r["comp"] for r in connected_components(df).collect()}
    dist = {r["id"]: r["comp"] for r in connected_components(df).collect()}
    assert one == dist


def test_components_of_eps_graph_once(spark):
    """Edges listed once give the components of edges listed both ways."""
    rng = np.random.default_rng(13)
    x = rng.random((400, 2)) * 4
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))],
                               "seq long, features array<double>")
    a = {r["id"]: r["comp"] for r in connected_components(eps_edges(df, 0.15, 2), unique=True).collect()}
    b = {r["id"]: r["comp"] for r in connected_components(eps_edges(df, 0.15, 2, both=False)).collect()}
    assert a == b
