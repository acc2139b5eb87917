"""Registered queries over points of many dimensions and over large cluster
tables, with their DuckDB SQL.  Points and rounding as in the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from evoclust.params import ClusterParams
from evoclust.plans import catalog as C
from evoclust.plans import oracle as O
from evoclust.session import ship_package

_r = C._r

EMB_EPS = 1.15  # fixed value: neighbourhood radius of the embeddings
EMB_MU = 1


def q_neighbour_counts(spark, sf):
    """J3 in 64 dimensions: how many other embeddings lie within 1.15."""
    from evoclust.operators.pivots import neighbour_counts
    ship_package(spark)
    return neighbour_counts(C.embedding_points(spark, sf), EMB_EPS, C.EMB_DIMS, "vec_id").select(
        F.col("id").alias("vec_id"), "neighbours")


def q_init_embeddings(spark, sf):
    """C1 in 64 dimensions: the density clusters of all embeddings."""
    from evoclust.operators.density import init_density
    ship_package(spark)
    p = ClusterParams(num_dims=C.EMB_DIMS, num_labels=C.EMB_LABELS, init_epsilon=EMB_EPS, mu=EMB_MU)
    state, _ = init_density(C.embedding_points(spark, sf), p)
    return state.select("ord", "weight", _r(F.col("cf1")[0], "c0"), _r(F.col("cf1")[63], "c63"), _r(F.col("cf2")[0], "q0"),
                        _r(F.col("cf2")[63], "q63"), "pts", *[F.col("lbl_counts")[k].alias(f"l{k}") for k in range(C.EMB_LABELS)])


def q_nearest_user(spark, sf):
    """J1 without a broadcast: every event with the nearest of all users'
    clusters, by cells and bounds, and whether that one may take it."""
    from evoclust.operators.nearest import match_clusters
    ship_package(spark)
    ev = C.events_points(spark, sf)
    users = C._user_mcs(spark, sf, ev).select(F.col("user_id").alias("ord"), F.col("dcf1").alias("cf1"), F.col("dcf2").alias("cf2"),
                                              F.col("dn").alias("weight"), F.col("tmax").alias("last_edit"))
    got = match_clusters(ev.select(F.col("event_id").alias("node"), "time", "features"), users,
                         ClusterParams(num_dims=2, num_labels=C.EV_TYPES, lam=C.LAM, epsilon=0.8, clamp_late=True), cell_rows=16)
    return got.select(F.col("node").alias("event_id"), F.col("ord").alias("user_id"), _r(F.col("dist"), "dist"), "ok")


TRACK_HOURS = (240, 480, 720)  # fixed values: the ends of three maps of the 30-day events table


def q_macro_track(spark, sf):
    """The macro-clusters of the users' micro-clusters at three times, each
    followed to the next: stable id, maps it was in, members and weight."""
    from evoclust.functions import cf
    from evoclust.operators.delta import decayed_delta
    from evoclust.operators.macro import macro_members
    from evoclust.operators.track import follow
    from evoclust.session import cut
    ship_package(spark)
    ev, earlier, out = C.events_points(spark, sf), None, None
    for b, hours in enumerate(TRACK_HOURS):
        m = cut(decayed_delta(ev.filter(F.col("time") < hours), C.LAM, 2, C.EV_TYPES, keys=("user_id",)).select(
            F.col("user_id").alias("ord"), F.col("dn").alias("weight"), cf.centroid("dcf1", "dn").alias("centroid"),
            (F.col("dn") >= C.MACRO_MU).alias("core")), "track-mcs")
        now = macro_members(m, C.MACRO_EPS, 2).join(m.select("ord", "weight"), "ord").withColumnRenamed("ord", "mc_id")
        earlier = cut(follow(now, earlier, b), "track-map")
        rows = earlier.join(m.select(F.col("ord").alias("mc_id"), "weight"), "mc_id").groupBy("macro_id", "total_batches").agg(
            F.count(F.lit(1)).alias("members"), F.sum("weight").alias("weight"))
        rows = rows.select(F.lit(b).cast("long").alias("batch_id"), "macro_id", F.col("total_batches").cast("long").alias("total_batches"),
                           "members", _r(F.col("weight"), "weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {f.__name__[2:]: f for f in (q_neighbour_counts, q_init_embeddings, q_nearest_user, q_macro_track)}

_NEAR = f"""v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.x, b.x) AS dist
      FROM v a JOIN v b ON a.vec_id <> b.vec_id) z WHERE dist < CAST({EMB_EPS} AS DOUBLE))"""

def _map(b: int, hours: int) -> str:
    """The macro map at a time, and its macro-clusters followed from the one before."""
    first = f"f{b} AS (SELECT DISTINCT comp, '0-' || comp AS macro_id, 1 AS tb FROM mem0)"
    later = f"""sh{b} AS (SELECT n.comp, e.macro_id, sum(n.w) AS w, max(e.tb) AS tb FROM mem{b} n
  JOIN (SELECT m.ord, f.macro_id, f.tb FROM mem{b - 1} m JOIN f{b - 1} f USING (comp)) e USING (ord) GROUP BY n.comp, e.macro_id),
pa{b} AS (SELECT * FROM sh{b} QUALIFY row_number() OVER (PARTITION BY comp ORDER BY w DESC, macro_id) = 1),
he{b} AS (SELECT * FROM pa{b} QUALIFY row_number() OVER (PARTITION BY macro_id ORDER BY w DESC, comp) = 1),
f{b} AS (SELECT c.comp, coalesce(he{b}.macro_id, '{b}-' || c.comp) AS macro_id, coalesce(he{b}.tb + 1, 1) AS tb
  FROM (SELECT DISTINCT comp FROM mem{b}) c LEFT JOIN he{b} USING (comp))"""
    return f"""
t{b} AS (SELECT *, max(time) OVER (PARTITION BY user_id) AS tmax FROM evp WHERE time < {hours}),
mc{b} AS MATERIALIZED (SELECT user_id AS ord, sum(g) AS w, sum(g * f0) / sum(g) AS x0, sum(g * f1) / sum(g) AS x1
  FROM (SELECT *, pow(2.0, -0.25 * (tmax - time)) AS g FROM t{b}) z GROUP BY user_id),
ln{b} AS MATERIALIZED (SELECT * FROM (SELECT a.ord AS src, c.ord AS dst, a.w >= 1.5 AS core,
    sqrt((a.x0 - c.x0) * (a.x0 - c.x0) + (a.x1 - c.x1) * (a.x1 - c.x1)) AS dist FROM mc{b} a JOIN mc{b} c ON a.ord <> c.ord AND c.w >= 1.5) z
  WHERE dist < CAST({2 * C.MACRO_EPS} AS DOUBLE)),
rc{b}(o, r) AS (SELECT ord, ord FROM mc{b} WHERE w >= 1.5 UNION SELECT rc{b}.o, ln{b}.dst FROM rc{b} JOIN ln{b} ON rc{b}.r = ln{b}.src AND core),
cc{b} AS (SELECT o AS ord, min(r) AS comp FROM rc{b} GROUP BY o),
mem{b} AS MATERIALIZED (SELECT z.ord, z.comp, m.w FROM (SELECT ord, comp FROM cc{b} UNION ALL
  SELECT n.ord, cc{b}.comp FROM (SELECT src AS ord, arg_min(dst, {{'d': dist, 'o': dst}}) AS c FROM ln{b} WHERE NOT core GROUP BY src) n
  JOIN cc{b} ON cc{b}.ord = n.c) z JOIN mc{b} m USING (ord)),
{later if b else first}"""


SQL = {
    "nearest_user": f"""WITH {O.USER_MC},
c AS (SELECT p.event_id, p.time, p.f0, p.f1, m.*, sqrt((p.f0 - d0 / dn) * (p.f0 - d0 / dn) + (p.f1 - d1 / dn) * (p.f1 - d1 / dn)) AS dist,
  pow(2.0, -0.25 * greatest(p.time - m.tmax, 0)) AS f, pow(2.0, -0.25 * greatest(m.tmax - p.time, 0)) AS g
  FROM evp p CROSS JOIN (SELECT user_id AS u, tmax, dn, d0, d1, q0, q1 FROM m) m),
n AS (SELECT *, dn * f + g AS w, d0 * f + f0 * g AS a0, d1 * f + f1 * g AS a1, q0 * f + f0 * f0 * g AS b0, q1 * f + f1 * f1 * g AS b1
  FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY dist, u) = 1)
SELECT event_id, u AS user_id, round(dist, 6) AS dist, w > 1 AND sqrt(greatest(abs(b0) / w - abs(a0 * a0) / (w * w),
  abs(b1) / w - abs(a1 * a1) / (w * w), 0.0)) <= CAST(0.8 AS DOUBLE) AS ok FROM n""",
    "macro_track": f"WITH RECURSIVE {O.EVP}," + ",".join(_map(b, h) for b, h in enumerate(TRACK_HOURS)) + " UNION ALL".join(f"""
SELECT CAST({b} AS BIGINT) AS batch_id, macro_id, CAST(tb AS BIGINT) AS total_batches, count(*) AS members, round(sum(w), 6) AS weight
FROM mem{b} JOIN f{b} USING (comp) GROUP BY macro_id, tb""" for b in range(len(TRACK_HOURS))),
    "neighbour_counts": f"""WITH {_NEAR}
SELECT v.vec_id, count(e.src) AS neighbours FROM v LEFT JOIN e ON v.vec_id = e.src GROUP BY v.vec_id""",
    "init_embeddings": f"""WITH RECURSIVE {_NEAR},
core AS (SELECT src AS id FROM e GROUP BY src HAVING count(*) > {EMB_MU}),
{O.DENSITY[O.DENSITY.index('ce AS'):]}
SELECT CAST(comp AS BIGINT) AS ord, CAST(count(*) AS DOUBLE) AS weight, round(sum(x[1]), 6) AS c0, round(sum(x[64]), 6) AS c63,
  round(sum(x[1] * x[1]), 6) AS q0, round(sum(x[64] * x[64]), 6) AS q63, CAST(0 AS BIGINT) AS pts,
  {', '.join(f"CAST(count(*) FILTER (label = {k}) AS BIGINT) AS l{k}" for k in range(C.EMB_LABELS))}
FROM mem JOIN v ON mem.id = v.vec_id GROUP BY comp""",
}
