"""Epsilon-neighbour edges and connected components.

Up to three dimensions the range self-join ``dist(a, b) < eps`` is an
equi-join on grid cells of side 1.5 eps: two points closer than eps differ by
at most one cell in each dimension, so joining each cell with the points of
its 3^d neighbour cells that lie within eps of it and filtering on the exact
distance gives exactly the pairs of the nested-loop join.  Beyond, points meet
by the cells of pivots (``pivots``).
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoclust.session import cut, tidy

CELL_EPS = 1.5  # side of a grid cell in eps: larger, fewer points go to neighbour cells, but more pairs are compared
GROUPS_A_CORE = 3  # groups of points that meet in a task, for every core
TASK_WORK, TASK_ROWS = 1 << 22, 1 << 16  # compared pairs that are worth a task, rows (some 1 MB) that Spark makes one
GROUP_ROWS = 1 << 20  # points of a group on each side, at most (some 150 MB in a task)


def distance_expr(a: str, b: str, d: int) -> Column:
    """Euclidean distance of two ARRAY<DOUBLE> columns of length d; one
    expression per dimension for small d (stays in generated code)."""
    if d <= 16:
        s = None
        for k in range(d):
            diff = F.col(a)[k] - F.col(b)[k]
            s = diff * diff if s is None else s + diff * diff
        return F.sqrt(s)
    sq = F.zip_with(F.col(a), F.col(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def eps_edges(points: DataFrame, eps: float, d: int, id_col: str = "seq",
              feat_col: str = "features", strict: bool = True, cell_rows: int = 4096,
              both: bool = True) -> DataFrame:
    """Directed edges ``src, dst, dist`` (both directions; with ``both=False``
    each pair once) between distinct points at distance < eps (``<=`` when
    not strict).

    Each unordered pair is examined once: a cell meets itself (with
    ``id < id``) and only the neighbour cells with a lexicographically
    positive offset; both directions are then emitted by one explode.  Of a
    neighbour cell only the points within eps of the cell are sent to it.

    Cells are cut by the work, not by the rows: with W compared pairs in all,
    a group compares about W / (cores * GROUPS_A_CORE) of them (at least
    ``cell_rows`` squared).  The n points of a cell are spread over a parts,
    the m points that meet them over b, both by a hash of the id, with a * b
    groups of that work and the a and b that copy the fewest rows, and every
    part meets every other in a group of its own: a dense cell becomes many
    tasks, each pair is still examined once, and the rows moved grow with the
    points (by the root of W times the groups).  Only beyond GROUP_ROWS points
    a side, which bounds a task's memory, they grow with the points times the
    groups.
    """
    if d > 3:
        from evoclust.operators import pivots  # which labels components by this module
        pairs = pivots.eps_pairs(points, eps, d, id_col, feat_col, strict)
        return _directed(pairs) if both else pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "dist")
    g = d
    keys = [f"c{k}" for k in range(g)]
    edge = CELL_EPS * eps
    cells = [F.floor(F.col(feat_col)[k] / F.lit(edge)).cast("long").alias(f"c{k}") for k in range(g)]
    # small d: coordinates as scalar columns (no array access in the join)
    scalar = d <= 16
    xs = [f"x{k}" for k in range(d)] if scalar else ["x"]
    coords = [F.col(feat_col)[k].alias(f"x{k}") for k in range(d)] if scalar else [F.col(feat_col).alias("x")]
    base = points.select(F.col(id_col).alias("id"), *coords, *cells)
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=g) if o >= (0,) * g]
    off = F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])).alias("_off")
    moved = [(F.col(f"c{k}") - F.col("_off")[k]).alias(f"c{k}") for k in range(g)]
    same = (F.array_max(F.transform("_off", lambda v: F.abs(v))) == 0).alias("_same")

    def gap(k):  # from a point to the cell it is sent to, less what rounding may add
        x, low, o = F.col(f"x{k}"), F.col(f"c{k}") * F.lit(edge), F.col("_off")[k]
        away = F.when(o > 0, x - low).when(o < 0, low + F.lit(edge) - x).otherwise(F.lit(0.0))
        return F.greatest(away - (F.abs(x) + F.lit(edge)) * F.lit(1e-14), F.lit(0.0))
    near = sum((gap(k) * gap(k) for k in range(1, g)), gap(0) * gap(0)) <= F.lit((eps * (1 + 1e-9)) ** 2)
    left = base
    right = (base.select("id", *xs, *keys, off).filter(near)
             .select(F.col("id").alias("id_r"), *[F.col(c).alias(c + "_r") for c in xs], *moved, same))
    # of every cell: its points and those that meet them
    cell = (right.groupBy(*keys).agg(F.count(F.when(F.col("_same"), True)).alias("_n"), F.count(F.lit(1)).alias("_m"))
            .filter((F.col("_n") > 0) & F.concat(*keys).isNotNull()))
    work = F.col("_n").cast("double") * F.col("_m")
    total, top, most, rows, moving = cell.agg(F.sum(work), F.max(work), F.max("_m"), F.sum("_n"), F.sum("_m")).collect()[0]
    groups = GROUPS_A_CORE * points.sparkSession.sparkContext.defaultParallelism
    limit = max(float(cell_rows) ** 2, (total or 0) / groups)
    salts = []
    if (top or 0) > limit or (most or 0) > GROUP_ROWS:
        salts = ["_i", "_j"]
        parts = F.ceil(work / F.lit(limit))
        square = F.sqrt(parts * F.col("_n") / F.col("_m"))

        def split(a):  # the points in about a parts: rows moved, parts, parts of those that meet them
            a = F.greatest(a, F.ceil(F.col("_n") / F.lit(GROUP_ROWS)), F.lit(1))
            b = F.greatest(F.ceil(parts / a), F.ceil(F.col("_m") / F.lit(GROUP_ROWS)))
            return F.struct((F.col("_n") * b + F.col("_m") * a).alias("_moved"), a.cast("int").alias("_a"), b.cast("int").alias("_b"))
        hot = (cell.filter((work > F.lit(limit)) | (F.col("_m") > GROUP_ROWS))
               .select(*keys, F.least(split(F.floor(square)), split(F.ceil(square))).alias("_s")).select(*keys, "_s._a", "_s._b"))
        # more points than the root of the limit meet a hot cell, and a point
        # meets few cells; keep them broadcast only while that bound is small
        if len(offsets) * rows / min(math.sqrt(limit), GROUP_ROWS) <= 200_000:
            hot = F.broadcast(hot)

        def part(id_col, n):  # the part of a point
            return F.pmod(F.xxhash64(id_col), F.coalesce(F.col(n), F.lit(1))).cast("int")

        def every(n):  # all parts of the other side
            return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
        left = (left.join(hot, keys, "left").withColumn("_i", part("id", "_a"))
                .withColumn("_j", every("_b")).drop("_a", "_b"))
        right = (right.join(hot, keys, "left").withColumn("_j", part("id_r", "_b"))
                 .withColumn("_i", every("_a")).drop("_a", "_b"))
    # few bytes may be much work, and Spark merges small partitions by their bytes
    tasks = min(groups, math.ceil((total or 0) / TASK_WORK))
    if tasks > 1 and moving < TASK_ROWS * tasks:
        right = right.repartition(tasks, *keys, *salts)
    cond = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in keys + salts]
    if scalar:
        sq = None
        for c in xs:
            diff = F.col(f"l.{c}") - F.col(f"r.{c}_r")
            sq = diff * diff if sq is None else sq + diff * diff
        dist = F.sqrt(sq)
    else:
        dist = distance_expr("l.x", "r.x_r", d)
    pairs = (left.alias("l").join(right.alias("r"), cond)
             .filter((~F.col("r._same") | (F.col("l.id") < F.col("r.id_r"))) & (F.col("l.id") != F.col("r.id_r")))
             .select(F.col("l.id").alias("a"), F.col("r.id_r").alias("b"), dist.alias("dist"))
             .filter(F.col("dist") < F.lit(eps) if strict else F.col("dist") <= F.lit(eps)))
    if not both:  # every undirected pair once, as (smaller, larger)
        return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "dist")
    return _directed(pairs)


def _directed(pairs: DataFrame) -> DataFrame:
    """Both directions from one match: a literal two-element explode and a
    swap stay in generated code (no per-row structs)."""
    flip = F.explode(F.array(F.lit(False), F.lit(True))).alias("_flip")
    return pairs.select("a", "b", "dist", flip).select(
        F.when(F.col("_flip"), F.col("b")).otherwise(F.col("a")).alias("src"),
        F.when(F.col("_flip"), F.col("a")).otherwise(F.col("b")).alias("dst"),
        "dist")


def mc_edges(mcs: DataFrame, eps: float, d: int) -> DataFrame:
    """Pairs of micro-clusters whose centroids are closer than 2*eps."""
    return eps_edges(mcs, 2.0 * eps, d, id_col="ord", feat_col="centroid")


@tidy
def connected_components(edges: DataFrame, unique: bool = False, jumps: int = 3) -> DataFrame:
    """``id, comp`` (comp = smallest id of the component) for every node
    that has an edge.

    Graph contraction on undirected edges kept once as (smaller, larger):
    each round maps every node to the smallest of itself and its smaller
    neighbours (pointer jumping on that node map moves it further), rewrites
    the edges onto those representatives and drops loops and duplicates, so
    the edge table shrinks round by round.  The smallest id of a component
    always maps to itself, hence it is the final representative.  Each
    round's edges and map are written to the shared checkpoint folder (flat
    lineage, restartable), until no edge is left: each round at least halves
    the nodes of every component that still has edges.

    ``unique``: the input lists every directed edge once (both orientations, as
    ``eps_edges`` gives), which saves a de-duplication shuffle.
    """
    lo = F.least("src", "dst").alias("src")
    hi = F.greatest("src", "dst").alias("dst")
    e = edges.filter(F.col("src") != F.col("dst"))
    if unique:
        e = e.filter(F.col("src") < F.col("dst")).select("src", "dst")
    else:
        e = e.select(lo, hi).distinct()
    e = cut(e, "cc-edges")
    nodes = cut(e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct(),
                "cc-nodes")
    maps = []
    while e.limit(1).count():
        m = e.groupBy("dst").agg(F.min("src").alias("to")).withColumnRenamed("dst", "id")
        for _ in range(jumps):
            # pointer jumping on the node map (node-sized joins)
            a, b = m.alias("a"), m.alias("b")
            m = (a.join(b, F.col("a.to") == F.col("b.id"), "left")
                 .select(F.col("a.id").alias("id"), F.coalesce(F.col("b.to"), F.col("a.to")).alias("to")))
        m = cut(m, "cc-map")
        maps.append(m)
        ms = m.select(F.col("id").alias("src"), F.col("to").alias("s2"))
        md = m.select(F.col("id").alias("dst"), F.col("to").alias("d2"))
        moved = (e.join(ms, "src", "left").join(md, "dst", "left")
                 .select(F.coalesce("s2", "src").alias("a"), F.coalesce("d2", "dst").alias("b")))
        nxt = (moved.filter(F.col("a") != F.col("b"))
               .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        e = cut(nxt, "cc-edges")
    labels = nodes.select("id", F.col("id").alias("comp"))
    for i, m in enumerate(maps):
        labels = (labels.join(m.select(F.col("id").alias("comp"), F.col("to")), "comp", "left")
                  .select("id", F.coalesce("to", "comp").alias("comp")))
        if i % 4 == 3:  # the maps are tables: a few of them make one plan
            labels = cut(labels, "cc-labels")
    return cut(labels, "cc-labels")
