"""J3/C1/C7 in any number of dimensions: Voronoi cells of pivots with a halo.

``m`` points drawn by hash are pivots; each point lives in the cell of its
nearest pivot, in one of three rings around it (nearer than ``eps / 4``, than
``eps``, or not), so that a dense ball and the far points around it are cells
of their own; exact copies are one point with a weight.  Around a cell lies its
halo, the points of other cells that may be within ``eps`` of one of its
points.  For a point x with pivot h and a cell of pivot p whose points lie
between ``r`` and ``R`` from p

* nothing of it is near if ``d(x,p) - R >= eps``, if ``r - d(x,p) >= eps``, or
  if the plane between the pivots is ``eps`` away:
  ``(d(x,p)^2 - d(x,h)^2) / (2 d(p,h)) >= eps``;
* everything is near if ``d(x,p) + R < eps``: then the cell's size is added (or
  it is linked as a whole) and no point of it is looked at;
* else x visits it.  Cells that follow each other are packed into blocks of at
  most ``block_rows`` points (a larger cell is cut into several), and x is sent
  to a block once, however many of its cells it visits; the block's task judges
  its cells again.  Visitors and residents of a block meet in groups of at most
  about ``block_rows`` each, so no cell, however dense, is one task, and the
  distances stay in their task: no pair leaves it.

Clusters: a group links its core points by a forest (at most one edge a point),
cells that lie wholly within ``eps`` of a core point are one node, and the
connected components of those edges are the clusters, merged through the core
points that several cells share.

Bounds: pivots are at most ``max_pivots`` and at most ``PIVOT_BYTES`` of
coordinates, whatever the table; with more rows the cells grow.  Blocks are as
many as give every core some groups, and hold at most ``BLOCK_ROWS`` points and
``BLOCK_BYTES`` of coordinates.  In data without structure (many dimensions,
distances all alike) no bound decides anything and the work is that of all
pairs, the price of an exact answer there; a point is then sent to every block,
so what moves grows with the rows as long as the blocks may grow.

Distances near ``eps`` are taken again from the differences, so the result is
that of ``sqrt(sum((a - b)^2)) < eps``.  Points that are null, hold a null or
NaN, or have another width belong nowhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoclust.functions.kernels import list_to_matrix, matrix_to_list, rounding, square_distances
from evoclust.operators.graph import connected_components
from evoclust.session import cut, tidy

PIVOT_BYTES = 64 << 20
CELLS = 1 << 22  # entries of a matrix of distances held at once
TILE = 1 << 18  # the same where every entry is used at once: fits a core's cache
OUT_ROWS = 4096
RINGS = 3
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 32 << 20  # points of a block, at most
GROUPS_A_CORE = 6
EDGES = 1 << 20  # edges of a group held before they are contracted


def near_matrix(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """``sqrt(sum((a_i - b_j)^2)) < eps`` for all i, j."""
    sq, slack = square_distances(a, b), rounding(a, b) ** 2
    near = sq < eps * eps
    i, j = np.nonzero(np.abs(sq - eps * eps) <= slack)
    for lo in range(0, len(i), 1 << 16):
        at = slice(lo, lo + (1 << 16))
        diff = a[i[at]] - b[j[at]]
        near[i[at], j[at]] = np.sqrt((diff * diff).sum(1)) < eps
    return near


class Cells:
    """Pivots, and for every cell (``pivot * RINGS + ring``) the weight of its
    points and their smallest and largest distance from the pivot."""

    def __init__(self, pivots: np.ndarray, eps: float):
        self.pivots, self.eps = pivots, eps
        n = len(pivots) * RINGS
        self.least, self.most, self.weight, self.rows = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.starts, self.parts = np.zeros(1, np.int64), np.ones(1, np.int64)

    def rows_at_once(self) -> int:
        return max(1, CELLS // max(1, len(self.weight)))

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance from its pivot of each row."""
        home = square_distances(x, self.pivots).argmin(1)
        diff = x - self.pivots[home]
        dist = np.sqrt((diff * diff).sum(1))
        return home * RINGS + (dist >= self.eps / 4) + (dist >= self.eps), dist

    def judge(self, x: np.ndarray, cell: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each row and cell (from ``lo`` to ``hi``): certainly all near,
        possibly some near."""
        eps, home, hi = self.eps, cell // RINGS, len(self.weight) if hi is None else hi
        first, last = lo // RINGS, -(-hi // RINGS)
        pivots, own = self.pivots[first:last], self.pivots[home]
        sq, off = square_distances(x, pivots), rounding(x, self.pivots)
        between = np.sqrt(square_distances(own, pivots))
        here = ((x - own) ** 2).sum(1)[:, None]
        # the rounding of the squares over the distance of the pivots
        plane = (sq - here - 4 * off * off) / np.maximum(2 * (between + off), 1e-300)
        at = slice(lo - first * RINGS, hi - first * RINGS)
        near_side = np.repeat((plane < eps + off) | (between <= off), RINGS, 1)[:, at]
        dist = np.repeat(np.sqrt(sq), RINGS, 1)[:, at]
        least, most, weight = self.least[lo:hi], self.most[lo:hi], self.weight[lo:hi]
        some = near_side & (weight > 0) & (dist - most < eps + 2 * off) & (least - dist < eps + 2 * off)
        return (dist + most < eps - 2 * off) & some, some

    def pack(self, block_rows: int) -> None:
        """Blocks: ``starts`` (their first cells) and ``parts`` (more than one
        for a cell of more than ``block_rows`` points, alone in its block)."""
        starts, parts, held = [], [], block_rows
        for c in np.flatnonzero(self.rows):
            n = int(self.rows[c])
            if held + n > block_rows:
                starts.append(c)
                parts.append(-(-n // block_rows))
                held = 0
            held += n
        self.starts, self.parts = np.array(starts or [0], np.int64), np.array(parts or [1], np.int64)

    def visited(self, open_: np.ndarray) -> np.ndarray:
        """Rows and blocks with an open cell, of rows and cells."""
        return np.logical_or.reduceat(open_, self.starts, 1)

    def meetings(self, block: int, x: np.ndarray, home: np.ndarray, cell: np.ndarray, later: np.ndarray | None = None):
        """``i, j, sure``: visitors ``x`` of a block that may be near (or surely
        are near) the residents ``j`` of one of its cells; where ``later`` says
        so, only cells from the visitor's own on."""
        lo = int(self.starts[block])
        hi = int(self.starts[block + 1]) if block + 1 < len(self.starts) else len(self.weight)
        order = np.argsort(cell, kind="stable")
        here, first = np.unique(cell[order], return_index=True)
        residents = np.split(order, first[1:])
        step = max(1, CELLS // (hi - lo + RINGS))
        for at in range(0, len(x), step):
            sure, some = self.judge(x[at:at + step], home[at:at + step], lo, hi)
            if later is not None:
                some &= ~later[at:at + step, None] | (np.arange(lo, hi)[None, :] >= home[at:at + step, None])
            for c, j in zip(here - lo, residents):
                for i, certain in ((some[:, c] & ~sure[:, c], False), (some[:, c] & sure[:, c], True)):
                    i = at + np.flatnonzero(i)
                    if len(i):
                        yield i, j, certain


def in_order(x: np.ndarray) -> np.ndarray:
    """An order of points in which near ones mostly follow each other: halves
    along the line to a far point, and their halves."""
    parts, out = [np.arange(len(x))], []
    while parts:
        at = parts.pop()
        if len(at) > 2:
            far = ((x[at] - x[at[0]]) ** 2).sum(1).argmax()
            at = at[np.argsort(x[at] @ (x[at[far]] - x[at[0]]), kind="stable")]
            parts += [at[len(at) // 2:], at[:len(at) // 2]]
        else:
            out.append(at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def tiles(i: np.ndarray, j: np.ndarray):
    """The pairs of two index lists, ``TILE`` of them at a time."""
    for b in range(0, len(j), 4096):
        step = max(1, TILE // min(len(j), 4096))
        for a in range(0, len(i), step):
            yield i[a:a + step], j[b:b + 4096]


# ------------------------------------------------------------- base tables

class Partition:
    """A table's distinct points in the cells of its pivots."""

    def __init__(self, points: DataFrame, d: int, eps: float, id_col: str, feat_col: str, cell_rows: int, max_pivots: int,
                 core_col: str | None = None, block_rows: int | None = None):
        spark = points.sparkSession
        self.d, self.spark = d, spark
        f = F.col(feat_col)
        good = f.isNotNull() & (F.size(f) == d) & ~F.exists(f, lambda v: v.isNull() | F.isnan(v))
        x = F.transform(f, lambda v: v.cast("double") + F.lit(0.0))  # -0.0 is 0.0
        core = F.col(core_col) if core_col else F.lit(True)
        self.rows = cut(points.select(F.col(id_col).alias("id"), x.alias("x"), core.alias("core")).filter(good), "pivot-rows")
        # a point is named by its lowest copy, by its lowest core copy if it has one
        named = F.coalesce(F.min(F.when(F.col("core"), F.col("id"))), F.min("id"))
        self.distinct = cut(self.rows.groupBy("x").agg(named.alias("id"), F.count(F.lit(1)).alias("w"), F.bool_or("core").alias("core"))
                            .withColumn("node", F.monotonically_increasing_id()), "pivot-distinct")
        self.n = self.distinct.count()
        m = max(1, min(-(-self.n // cell_rows), max_pivots, PIVOT_BYTES // (8 * d)))
        share = min(1.0, (m + 6 * math.sqrt(m) + 50) / max(self.n, 1))
        h = F.pmod(F.xxhash64("x"), F.lit(1 << 32))
        some = self.distinct.filter(h < F.lit(int(share * (1 << 32)))).orderBy(h, "node").limit(m).select("x").collect()
        pivots = np.array([r.x for r in some], np.float64).reshape(len(some), d)
        self.cells = Cells(pivots[in_order(pivots)], eps)
        groups = math.ceil(math.sqrt(GROUPS_A_CORE * spark.sparkContext.defaultParallelism))
        self.block_rows = block_rows or max(2048, min(-(-self.n // groups), BLOCK_ROWS, BLOCK_BYTES // (8 * d)))
        # coordinates that are floats go to the blocks as such, half as long
        exact = F.bool_and(F.forall("x", lambda v: v.cast("float").cast("double") == v))
        self.moved = "array<float>" if self.distinct.agg(exact).first()[0] else "array<double>"
        self.placed = cut(self._place(), "pivot-cells")
        self._measure(self.placed)

    def _place(self) -> DataFrame:
        held, d = self.spark.sparkContext.broadcast(self.cells), self.d

        def run(batches):
            cells = held.value
            for rb in batches:
                x = list_to_matrix(rb.column("x"), d)
                cell, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
                step = cells.rows_at_once()
                for lo in range(0, len(x), step):
                    cell[lo:lo + step], dist[lo:lo + step] = cells.of(x[lo:lo + step])
                yield rb.append_column("cell", pa.array(cell)).append_column("dist", pa.array(dist))

        return self.distinct.select("node", "id", "w", "core", "x").mapInArrow(
            run, "node long, id long, w long, core boolean, x array<double>, cell long, dist double")

    def _measure(self, rows: DataFrame) -> None:
        """Distances, weight and points of every cell over ``rows`` (at most
        ``RINGS`` rows a pivot reach the driver), and their blocks."""
        c = self.cells
        c.weight[:] = c.rows[:] = 0
        for r in rows.groupBy("cell").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.sum("w").alias("w"),
                                          F.count(F.lit(1)).alias("n")).collect():
            c.least[r.cell], c.most[r.cell], c.weight[r.cell], c.rows[r.cell] = r.lo, r.hi, r.w, r.n
        c.pack(self.block_rows)

    def meet(self, visitors: DataFrame, residents: DataFrame, fn, schema: str) -> DataFrame:
        """Every visitor with every resident of its ``blocks``, group by group;
        ``fn(block, visitors, residents)`` gets two tables and returns one."""
        c, size = self.cells, self.block_rows
        n = {r.block: r.n for r in visitors.select(F.explode("blocks").alias("block")).groupBy("block").agg(
            F.count(F.lit(1)).alias("n")).collect()}  # blocks
        full = np.flatnonzero(c.rows)
        at = np.searchsorted(c.starts, full, "right") - 1
        blocks = F.broadcast(self.spark.createDataFrame(
            [(b, int(c.parts[b]), -(-k // size)) for b, k in n.items()], "block int, parts int, nv int"))
        homes = F.broadcast(self.spark.createDataFrame(  # at most RINGS rows a pivot
            [(int(k), int(b)) for k, b in zip(full, at)], "cell long, block int"))
        part = lambda k: F.pmod(F.xxhash64("node", "block"), F.col(k)).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        x = F.col("x").cast(self.moved)
        v = (visitors.withColumn("block", F.explode("blocks")).join(blocks, "block").withColumns({"vb": part("nv"), "x": x})
             .withColumn("rb", every("parts")).drop("blocks", "parts", "nv"))
        r = (residents.join(homes, "cell").join(blocks, "block").withColumns({"rb": part("parts"), "x": x})
             .withColumn("vb", every("nv")).drop("parts", "nv"))
        key = ["block", "vb", "rb"]

        def run(k, a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return _schema_of(schema).empty_table()
            return fn(k[0].as_py(), a.combine_chunks(), b.combine_chunks())

        return v.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(run, schema)


def meet(visitors: DataFrame, residents: DataFrame, fn, schema: str, block_rows: int) -> DataFrame:
    """Every visitor with every resident of its cell, block by block;
    ``fn(visitors, residents)`` gets two tables and returns one."""
    n = (visitors.groupBy("cell").agg(F.count(F.lit(1)).alias("nv"))
         .join(residents.groupBy("cell").agg(F.count(F.lit(1)).alias("nr")), "cell")
         .select("cell", *[F.ceil(F.col(c) / F.lit(block_rows)).cast("int").alias(c) for c in ("nv", "nr")]))
    n = F.broadcast(n)  # at most RINGS rows a pivot
    part = lambda c: F.pmod(F.xxhash64("node", "cell"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    v = visitors.join(n, "cell").withColumn("vb", part("nv")).withColumn("rb", every("nr")).drop("nv", "nr")
    r = residents.join(n, "cell").withColumn("rb", part("nr")).withColumn("vb", every("nv")).drop("nv", "nr")
    key = ["cell", "vb", "rb"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _schema_of(schema).empty_table()
        return fn(a.combine_chunks(), b.combine_chunks())

    return v.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(run, schema)


def _schema_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _matrix(t: pa.Table, d: int) -> np.ndarray:
    return list_to_matrix(t["x"], d)


def _lists(go: np.ndarray) -> pa.Array:
    """The columns that are true in each row."""
    ends = np.concatenate([[0], np.cumsum(go.sum(1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(go)[1], pa.int32()))


# ------------------------------------------------------------------ counts

def _counts(p: Partition, enough: float) -> DataFrame:
    """``node, n``: points (with copies, itself included) closer than ``eps``.
    Once bounds alone give more than ``enough`` the count stops there."""
    held, d, eps = p.spark.sparkContext.broadcast(p.cells), p.d, p.cells.eps

    def visits(batches):
        cells = held.value
        for rb in batches:
            x, home = list_to_matrix(rb.column("x"), d), rb.column("cell").to_numpy()
            step = cells.rows_at_once()
            for lo in range(0, len(x), step):
                sure, some = cells.judge(x[lo:lo + step], home[lo:lo + step])
                n = np.add.reduceat(np.where(sure, cells.weight, 0), cells.starts, 1)
                go = cells.visited(some & ~sure) & (n.sum(1) <= enough)[:, None]
                n[go] = 0  # counted in the block
                out = rb.slice(lo, step)
                yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("node", "cell", "x")), pa.array(n.sum(1)), _lists(go)],
                                                 names=["node", "cell", "x", "n", "blocks"])

    seen = cut(p.placed.select("node", "cell", "x").mapInArrow(
        visits, "node long, cell long, x array<double>, n long, blocks array<int>"), "pivot-visits")

    def compare(block: int, v: pa.Table, r: pa.Table) -> pa.Table:
        a, b, w = _matrix(v, d), _matrix(r, d), r["w"].to_numpy()
        n = np.zeros(len(a), np.int64)
        for i, j, sure in held.value.meetings(block, a, v["cell"].to_numpy(), r["cell"].to_numpy()):
            if sure:
                n[i] += w[j].sum()
                continue
            ones = (w[j] == 1).all()
            for k, m in tiles(i, j):
                near = near_matrix(a[k], b[m], eps)
                n[k] += np.count_nonzero(near, 1) if ones else near @ w[m]
        return pa.table({"node": v["node"], "n": pa.array(n)})

    met = p.meet(seen.select("node", "cell", "x", "blocks"), p.placed.select("node", "cell", "x", "w"), compare, "node long, n long")
    return seen.select("node", "n").unionByName(met).groupBy("node").agg(F.sum("n").alias("n"))


@tidy
def neighbour_counts(points: DataFrame, eps: float, d: int, id_col: str = "seq", feat_col: str = "features",
                     cell_rows: int = 2048, block_rows: int | None = None, max_pivots: int = 1 << 16) -> DataFrame:
    """``id, neighbours`` of every point: how many others are closer than
    ``eps`` (copies of the point are among them)."""
    p = Partition(points, d, eps, id_col, feat_col, cell_rows, max_pivots, block_rows=block_rows)
    n = p.distinct.join(_counts(p, math.inf), "node").select("x", (F.col("n") - 1).alias("neighbours"))
    return p.rows.join(n, "x").select("id", "neighbours")


@tidy
def eps_pairs(points: DataFrame, eps: float, d: int, id_col: str = "seq", feat_col: str = "features", strict: bool = True,
              cell_rows: int = 2048, block_rows: int = 2048, max_pivots: int = 1 << 16) -> DataFrame:
    """J3/J4 as edges: ``a, b, dist`` for every pair of points closer than
    ``eps`` (not ``strict``: or at it), once, ``a < b``.  The list is as long
    as there are pairs; copies of a point are pairs at distance 0."""
    reach = eps if strict else math.nextafter(eps, math.inf)
    p = Partition(points, d, reach, id_col, feat_col, cell_rows, max_pivots, block_rows=block_rows)
    held = p.spark.sparkContext.broadcast(p.cells)

    def visits(batches):
        cells = held.value
        for rb in batches:
            x, home = list_to_matrix(rb.column("x"), d), rb.column("cell").to_numpy()
            step = cells.rows_at_once()
            for lo in range(0, len(x), step):
                hs = home[lo:lo + step]
                some = cells.judge(x[lo:lo + step], hs)[1] & (np.arange(len(cells.weight))[None, :] >= hs[:, None])
                out = rb.slice(lo, step)
                yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("node", "cell", "x")), _lists(cells.visited(some))],
                                                 names=["node", "cell", "x", "blocks"])

    def compare(block: int, v: pa.Table, r: pa.Table) -> pa.Table:
        a, b, home, cell = _matrix(v, d), _matrix(r, d), v["cell"].to_numpy(), r["cell"].to_numpy()
        vn, rn = v["node"].to_numpy(), r["node"].to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, j, _ in held.value.meetings(block, a, home, cell, np.ones(len(a), bool)):
            for k, m in tiles(i, j):
                at, to = np.nonzero(near_matrix(a[k], b[m], reach))
                at, to = k[at], m[to]
                once = (home[at] != cell[to]) | (vn[at] < rn[to])  # two points of one cell meet twice, and themselves
                at, to = at[once], to[once]
                diff = a[at] - b[to]
                found.append((vn[at], rn[to], np.sqrt((diff * diff).sum(1))))
        n1, n2, dist = (np.concatenate(c) for c in zip(*found))
        return pa.table({"n1": n1, "n2": n2, "dist": dist})

    seen = cut(p.placed.select("node", "cell", "x").mapInArrow(
        visits, "node long, cell long, x array<double>, blocks array<int>"), "pivot-visits")
    met = p.meet(seen, p.placed.select("node", "cell", "x"), compare, "n1 long, n2 long, dist double")
    ids = cut(p.rows.select("id", "x").join(p.distinct.select("x", "node"), "x").select("id", "node"), "pivot-ids")
    far = (met.join(ids.toDF("a", "n1"), "n1").join(ids.toDF("b", "n2"), "n2").select("a", "b", "dist"))
    copies = (ids.toDF("a", "node").join(ids.toDF("b", "node"), "node").filter("a < b")
              .select("a", "b", F.lit(0.0).alias("dist")).filter(F.lit(reach > 0)))
    return far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist").unionByName(copies)


# ---------------------------------------------------------------- clusters

def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a bipartite graph (rows, columns of a boolean matrix):
    the component of each row and column, -1 where it has no edge."""
    left, right = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    for k in np.flatnonzero(near.any(1)):
        if left[k] >= 0:
            continue
        new = np.array([k])
        left[k] = k
        while len(new):
            cols = np.flatnonzero(near[new].any(0) & (right < 0))
            right[cols] = k
            new = np.flatnonzero(near[:, cols].any(1) & (left < 0))
            left[new] = k
    return left, right


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of ``n`` nodes, by edges."""
    up = np.arange(n)
    while len(a):
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    return up


def _cluster_edges(p: Partition, marked: DataFrame) -> DataFrame:
    """``a, b, dist, id``: core nodes that share a cluster (``dist`` null; a
    cell that lies near one core node as a whole is the node ``-1 - cell``),
    and core nodes ``b`` (with ``id``) near a node ``a`` that is no core."""
    p._measure(marked.filter("core"))
    held, d, eps = p.spark.sparkContext.broadcast(p.cells), p.d, p.cells.eps
    names = ["a", "b", "cell", "core", "x", "blocks"]

    def visits(batches):
        cells = held.value
        up = np.arange(len(cells.weight))  # cells linked as wholes

        whole = np.zeros(len(up), bool)
        for rb in batches:
            x, node, home = list_to_matrix(rb.column("x"), d), rb.column("node").to_numpy(), rb.column("cell").to_numpy()
            core = rb.column("core").to_numpy(zero_copy_only=False)
            step = cells.rows_at_once()
            for lo in range(0, len(x), step):
                xs, ns, hs, cs = (v[lo:lo + step] for v in (x, node, home, core))
                sure, some = cells.judge(xs, hs)
                sure &= cs[:, None]
                first = np.full(len(xs), -1)
                for r in np.flatnonzero(sure.any(1)):
                    got = np.flatnonzero(sure[r])
                    first[r] = got[0]
                    whole[got] = True
                    roots = np.unique(_roots(up, got))
                    up[roots] = roots[0]
                hit = np.flatnonzero(first >= 0)
                yield _edge_batch(ns[hit], -1 - first[hit], names)
                # two core points meet once: in the later of their cells
                some &= ~sure & (~cs[:, None] | (np.arange(len(up))[None, :] >= hs[:, None]))
                go = cells.visited(some)
                r = np.flatnonzero(go.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(ns[r]), pa.nulls(len(r), pa.int64()), pa.array(hs[r]), pa.array(cs[r]),
                                                  matrix_to_list(xs[r]), _lists(go[r])], names=names)
        got = np.flatnonzero(whole)
        yield _edge_batch(-1 - got, -1 - _roots(up, got), names)

    seen = cut(marked.select("node", "cell", "core", "x").mapInArrow(
        visits, "a long, b long, cell long, core boolean, x array<double>, blocks array<int>"), "pivot-links")
    links = seen.filter("b IS NOT NULL").select("a", "b")
    cells = links.filter("a < 0").select((-1 - F.col("a")).alias("cell")).distinct()  # at most RINGS rows a pivot
    own = marked.filter("core").join(F.broadcast(cells), "cell").select(F.col("node").alias("a"), (-1 - F.col("cell")).alias("b"))

    def compare(block: int, v: pa.Table, r: pa.Table) -> pa.Table:
        a, b = _matrix(v, d), _matrix(r, d)
        core = v["core"].to_numpy(zero_copy_only=False)
        vn, rn, rid = v["node"].to_numpy(), r["node"].to_numpy(), r["id"].to_numpy()
        none, total = np.zeros(0, np.int64), len(a) + len(b)
        links, held_edges, border = [(none, none)], 0, [(none, none, np.zeros(0))]

        def contracted() -> list:
            up = joined(total, *(np.concatenate(c) for c in zip(*links)))
            some = np.flatnonzero(up != np.arange(total))
            return [(some, up[some])]

        for i, j, sure in held.value.meetings(block, a, v["cell"].to_numpy(), r["cell"].to_numpy(), core):
            within, other = i[core[i]], i[~core[i]]
            if sure and len(within):  # all of the cell is near every one of them
                links.append((np.concatenate([within, len(a) + j]), np.full(len(within) + len(j), len(a) + j[0])))
                held_edges += len(links[-1][0])
            elif len(within):
                for k, m in tiles(within, j):
                    near = near_matrix(a[k], b[m], eps)
                    if np.count_nonzero(near) <= 4 * (len(k) + len(m)):
                        left, right = np.nonzero(near)
                        links.append((k[left], len(a) + m[right]))
                    else:
                        left, right = forest(near)
                        rows, cols = np.flatnonzero(left >= 0), np.flatnonzero(right >= 0)
                        links.append((np.concatenate([k[rows], len(a) + m[cols]]), np.concatenate([k[left[rows]], k[right[cols]]])))
                    held_edges += len(links[-1][0])
                    if held_edges > EDGES + total:
                        links = contracted()
                        held_edges = len(links[0][0])
            for k, m in tiles(other, j):
                near = near_matrix(a[k], b[m], eps)
                for at in np.flatnonzero(near.any(1)):
                    js = m[np.flatnonzero(near[at])]
                    diff = b[js] - a[k[at]]
                    dist = np.sqrt((diff * diff).sum(1))
                    best = np.lexsort((rid[js], dist))[0]
                    border.append((k[[at]], js[[best]], dist[[best]]))
        (x, root), = contracted()
        name = np.concatenate([vn, rn])
        k, m, dist = (np.concatenate(c) for c in zip(*border))
        first = np.lexsort((rid[m], dist, k))  # a visitor's nearest of the group
        first = first[np.diff(k[first], prepend=-1) != 0]
        return pa.table({"a": np.concatenate([name[x], vn[k[first]]]), "b": np.concatenate([name[root], rn[m[first]]]),
                         "dist": np.concatenate([np.full(len(x), np.nan), dist[first]]),
                         "id": np.concatenate([np.zeros(len(x), np.int64), rid[m[first]]])})

    met = p.meet(seen.filter("b IS NULL").select(F.col("a").alias("node"), "cell", "core", "x", "blocks"),
                 marked.filter("core").select("node", "id", "cell", "x"), compare, "a long, b long, dist double, id long")
    none = [F.lit(float("nan")).alias("dist"), F.lit(0).cast("long").alias("id")]
    return links.unionByName(own).select("a", "b", *none).unionByName(met)


def _roots(up: np.ndarray, c: np.ndarray) -> np.ndarray:
    r = up[c]
    while (up[r] != r).any():
        r = up[r]
    return r


def _edge_batch(a, b, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()),
                                       pa.nulls(len(a), pa.bool_()), pa.nulls(len(a), pa.list_(pa.float64())),
                                       pa.nulls(len(a), pa.list_(pa.int32()))], names=names)


@tidy
def density_labels(points: DataFrame, eps: float, d: int, min_neighbours: float = 0, id_col: str = "seq",
                   feat_col: str = "features", cell_rows: int = 2048, block_rows: int | None = None,
                   max_pivots: int = 1 << 16) -> DataFrame:
    """``id, comp, core`` as ``density.density_labels`` gives, in any number
    of dimensions."""
    p = Partition(points, d, eps, id_col, feat_col, cell_rows, max_pivots, block_rows=block_rows)
    n = _counts(p, min_neighbours + 1)
    marked = cut(p.placed.drop("core").join(n, "node").withColumn("core", F.col("n") - 1 > F.lit(min_neighbours)), "pivot-cores")
    return p.rows.select("id", "x").join(_named(marked, _cluster_edges(p, marked)), "x").select("id", "comp", "core")


@tidy
def core_clusters(points: DataFrame, eps: float, d: int, core_col: str = "core", id_col: str = "seq",
                  feat_col: str = "features", cell_rows: int = 2048, block_rows: int | None = None,
                  max_pivots: int = 1 << 16) -> DataFrame:
    """``id, comp`` where ``core_col`` says which points are core points:
    cores closer than ``eps`` share a cluster (``comp``: its lowest core id),
    another point belongs to that of its nearest core within ``eps`` (ties to
    the lower id), if there is one."""
    p = Partition(points, d, eps, id_col, feat_col, cell_rows, max_pivots, core_col, block_rows)
    return p.rows.select("id", "x").join(_named(p.placed, _cluster_edges(p, p.placed)), "x").select("id", "comp")


def _named(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """``x, comp, core`` of the distinct points that belong to a cluster."""
    e = cut(edges, "pivot-edges")
    comps = connected_components(e.filter(F.isnan("dist")).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    cores = (marked.filter("core").select("node", "id", "x").join(comps.withColumnRenamed("id", "node"), "node", "left")
             .withColumn("comp", F.coalesce("comp", "node")))
    names = cores.groupBy("comp").agg(F.min("id").alias("name"))
    cores = cut(cores.join(names, "comp").select("node", "x", F.col("name").alias("comp")), "pivot-comps")
    border = (e.filter(~F.isnan("dist")).groupBy("a").agg(F.min_by("b", F.struct("dist", "id")).alias("node"))
              .join(cores.select("node", "comp"), "node").select(F.col("a").alias("node"), "comp"))
    return (cores.select("x", "comp", F.lit(True).alias("core"))
            .unionByName(border.join(marked.select("node", "x"), "node").select("x", "comp", F.lit(False).alias("core"))))
