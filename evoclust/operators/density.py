"""C1/C7 without lists of point pairs.

More than ``GRID_DIMS`` dimensions: Voronoi cells of pivots, see ``pivots``.
Up to these:

Space is cut into cells of side ``eps / sqrt(d)``, so all points of a cell are
neighbours.  A point with more than ``min_neighbours`` neighbours (distance
strictly below ``eps``) is a core point; core points within ``eps`` of each
other share a cluster, and another point within ``eps`` of a core point joins
its nearest one (ties to the lower id).  The result has no order in it.

* A cell of more than ``min_neighbours + 1`` points holds core points only.
  Only points of smaller cells count their neighbours, and such a cell has at
  most ``min_neighbours + 1`` points, so counting reads every point a bounded
  number of times however dense the cells are.
* The graph has a node per cell.  Two cells are linked if one pair of their
  core points is near enough: decided by the bounding boxes of the cells'
  points, and where these leave it open by boxes of half the side, and so on.
  Once the point pairs inside the open boxes are at most ``direct`` times the
  core points, these are compared, which ends the halving.
* Hot cells: sizes and boxes are sums with map-side combine; the joins of
  points to their cell have one row per cell on the other side and both sides
  are written tables, so the runtime can split them.

Cells are exact for coordinates up to about a million sides from zero.  Points
with a null or NaN coordinate belong to no cluster.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoclust.operators import pivots
from evoclust.operators.delta import label_histogram
from evoclust.operators.graph import connected_components
from evoclust.operators.state import conform
from evoclust.params import ClusterParams
from evoclust.session import cut, tidy

GRID_DIMS = 3  # neighbour cells grow as 3^d
MAX_HALVINGS = 24  # further open boxes are compared point by point


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [x * x for x in parts]))


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Cells that may hold a point within ``eps`` of a point of cell zero."""
    m = math.isqrt(d) + 1
    return [o for o in itertools.product(range(-m, m + 1), repeat=d) if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= d]


def _moved(df: DataFrame, offsets: list[tuple[int, ...]], keys: list[str]) -> DataFrame:
    """Every row once per offset, its cell moved by it."""
    off = F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets]))
    rest = [c for c in df.columns if c not in keys]
    return df.select("*", off.alias("_off")).select(
        *rest, *[(F.col(k) + F.col("_off")[i]).alias(k) for i, k in enumerate(keys)])


def _boxes(cores: DataFrame, side: float, level: int, d: int, p: str, by: list[str]) -> DataFrame:
    """Bounding box and size of the core points of every box of a level."""
    at = [F.floor(F.col(f"x{k}") / F.lit(side / 2 ** level)).cast("long").alias(f"{p}k{k}") for k in range(d)]
    return cores.select("*", *at).groupBy(*by, *[f"{p}k{k}" for k in range(d)]).agg(
        *[F.min(f"x{k}").alias(f"{p}lo{k}") for k in range(d)], *[F.max(f"x{k}").alias(f"{p}hi{k}") for k in range(d)],
        F.min("id").alias(f"{p}id"), F.count(F.lit(1)).alias(f"{p}n"))


def cell_links(cores: DataFrame, eps: float, side: float, d: int, direct: int = 64) -> DataFrame:
    """``src, dst``: cells, named by their smallest core id, that have a pair
    of core points closer than ``eps``."""
    ks = range(d)
    total = cores.count()
    first = _boxes(cores, side, 0, d, "a", [])
    second = first.select(*[F.col(c).alias("b" + c[1:]) for c in first.columns])
    ahead = [o for o in _offsets(d) if o > (0,) * d]
    keys = [f"bk{k}" for k in ks]
    open_ = (_moved(first.select("*", *[F.col(f"ak{k}").alias(f"bk{k}") for k in ks]), ahead, keys)
             .join(second, keys).withColumnsRenamed({"aid": "a", "bid": "b"}))
    found = []
    for level in range(MAX_HALVINGS + 1):
        gap = _norm([F.greatest(F.lit(0.0), F.col(f"blo{k}") - F.col(f"ahi{k}"), F.col(f"alo{k}") - F.col(f"bhi{k}"))
                     for k in ks])
        span = _norm([F.greatest(F.col(f"ahi{k}") - F.col(f"blo{k}"), F.col(f"bhi{k}") - F.col(f"alo{k}")) for k in ks])
        judged = cut(open_.filter(gap < F.lit(eps)).select(
            "a", "b", *[f"{p}k{k}" for p in "ab" for k in ks], (F.col("an") * F.col("bn")).alias("pairs"),
            (span < F.lit(eps)).alias("near")), "density-boxes")
        hits = judged.filter("near").select("a", "b").distinct()
        found.append(hits)
        left = judged.filter("not near").join(hits, ["a", "b"], "left_anti")
        pairs = left.agg(F.sum("pairs")).first()[0] or 0
        if not pairs:
            break
        boxes = [f"{p}k{k}" for p in "ab" for k in ks]
        if pairs <= direct * total or level == MAX_HALVINGS:
            scale = F.lit(side / 2 ** level)
            x, y = (cores.select(*[F.floor(F.col(f"x{k}") / scale).cast("long").alias(f"{p}k{k}") for k in ks],
                                 *[F.col(f"x{k}").alias(f"{p}x{k}") for k in ks]) for p in "ab")
            near = _norm([F.col(f"ax{k}") - F.col(f"bx{k}") for k in ks]) < F.lit(eps)
            found.append(left.join(x, [f"ak{k}" for k in ks]).join(y, [f"bk{k}" for k in ks])
                         .filter(near).select("a", "b").distinct())
            break
        halves = left.select("a", "b", *[F.col(c).alias("up_" + c) for c in boxes])
        for p in "ab":
            sub = _boxes(cores, side, level + 1, d, p, []).drop(f"{p}id")
            halves = halves.join(sub.withColumns({f"up_{p}k{k}": F.shiftright(f"{p}k{k}", 1) for k in ks}),
                                 [f"up_{p}k{k}" for k in ks])
        open_ = halves
    return reduce(DataFrame.unionByName, found).select(F.col("a").alias("src"), F.col("b").alias("dst"))


@tidy
def density_labels(points: DataFrame, eps: float, d: int, min_neighbours: float = 0, id_col: str = "seq",
                   feat_col: str = "features", direct: int = 64) -> DataFrame:
    """``id, comp, core`` of every point that belongs to a cluster; ``comp`` is
    the smallest core id of the cluster.  With ``min_neighbours=0`` these are
    the connected components of the points that have a neighbour."""
    if d > GRID_DIMS:
        return pivots.density_labels(points, eps, d, min_neighbours, id_col, feat_col)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    keys, xs = [f"c{k}" for k in range(d)], [f"x{k}" for k in range(d)]
    f = F.col(feat_col)
    base = points.select(F.col(id_col).alias("id"), *[f[k].alias(f"x{k}") for k in range(d)])
    for x in xs:
        base = base.filter(F.col(x).isNotNull() & ~F.isnan(x))
    base = cut(base.select("*", *[F.floor(F.col(f"x{k}") / F.lit(side)).cast("long").alias(f"c{k}") for k in range(d)]),
               "density-base")
    tagged = cut(base.join(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys), "density-points")
    full = F.col("_n") > F.lit(min_neighbours + 1)
    few = tagged.filter(~full).select("id", *xs, *keys)
    seekers = few.select("id", *[F.col(x).alias("s" + x) for x in xs], *keys)
    dist = _norm([F.col(x) - F.col("s" + x) for x in xs])
    others = tagged.select(F.col("id").alias("other"), *xs, *keys)
    deg = (_moved(seekers, _offsets(d), keys).join(others, keys).groupBy("id")
           .agg(F.count_if((F.col("other") != F.col("id")) & (dist < F.lit(eps))).alias("_deg")))
    few = cut(few.join(deg, "id").withColumn("core", F.col("_deg") > F.lit(min_neighbours)).drop("_deg"), "density-few")
    cores = cut(tagged.filter(full).select("id", *xs, *keys)
                .unionByName(few.filter("core").select("id", *xs, *keys)), "density-cores")
    comps = connected_components(cell_links(cores, eps, side, d, direct))
    cells = cores.groupBy(*keys).agg(F.min("id").alias("node"))
    cells = cut(cells.join(comps.withColumnRenamed("id", "node"), "node", "left")
                .select(*keys, F.coalesce("comp", "node").alias("comp")), "density-cells")
    placed = cores.join(cells, keys)
    border = (_moved(seekers.join(few.filter("not core").select("id"), "id"), _offsets(d), keys)
              .join(placed.withColumnRenamed("id", "other"), keys)
              .withColumn("dist", dist).filter(F.col("dist") < F.lit(eps))
              .groupBy("id").agg(F.min_by("comp", F.struct("dist", "other")).alias("comp")))
    return (placed.select("id", "comp", F.lit(True).alias("core"))
            .unionByName(border.select("id", "comp", F.lit(False).alias("core"))))


def init_density(points: DataFrame, params: ClusterParams) -> tuple[DataFrame, dict]:
    """C1 without the original's scan order: one p-MC per density cluster
    (``init_epsilon``, more than ``mu`` neighbours), weight its points, t0 = 0.
    Returns (state, info) as ``seeding.init_clusters`` does."""
    d, labels = params.num_dims, params.num_labels
    found = cut(density_labels(points, params.init_epsilon, d, params.mu), "density-labels")
    got = points.select("seq", "features", "label").join(found.withColumnRenamed("id", "seq"), "seq")
    x = F.col("features")
    g = got.groupBy("comp").agg(
        *[F.sum(x[k]).alias(f"a{k}") for k in range(d)], *[F.sum(x[k] * x[k]).alias(f"b{k}") for k in range(d)],
        F.count(F.lit(1)).cast("double").alias("weight"), label_histogram(F.col("label"), labels).alias("lbl_counts"))
    state = cut(conform(g.select(
        F.lit("p").alias("kind"), F.col("comp").alias("ord"), F.concat(F.lit("init-"), F.col("comp")).alias("mc_id"),
        F.array(*[F.col(f"a{k}") for k in range(d)]).alias("cf1"),
        F.array(*[F.col(f"b{k}") for k in range(d)]).alias("cf2"), "weight", F.lit(0).alias("t0"),
        F.lit(0).alias("last_edit"), F.lit(0).alias("pts"), "lbl_counts")), "init-mcs")
    n = points.count()
    return state, {"seeds": state.count(), "untagged": n - found.count(), "points": n}
