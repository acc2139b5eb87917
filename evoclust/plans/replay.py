"""Registered queries over runs of several micro-batches, with their DuckDB
SQL: the events replayed as a stream of time slices."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evoclust.plans import catalog as C
from evoclust.plans import oracle as O
from evoclust.plans.model import ClusterModel
from evoclust.session import cut, remove, scratch_path, ship_package
from evoclust.sources import points as S
from evoclust.streaming.stream import decode_stream, forget_commit, run_stream

_r = C._r

SLICE_HOURS, SLICES, STOP_AFTER = 72, 10, 5  # fixed values: the slices of the 30-day events table; the run stops once
PARAMS = C.UPDATE_PARAMS.with_(mu=30.0)


def replayed(spark: SparkSession, sf: str, results=None) -> ClusterModel:
    """S7 into S8: the events' envelopes, written slice by slice as files; a
    stream of one file a batch from an empty model, which ends after five
    batches before the last one is committed; a new model over the same folder
    replays that batch and goes on with the others."""
    ship_package(spark)
    src, ckpt, root = (scratch_path(spark, f"replay-{n}") for n in ("src", "ckpt", "model"))
    ev = cut(C.events_points(spark, sf), "replay-points")

    def run(first: int, until: int) -> ClusterModel:
        S.write_replay(ev, src, SLICE_HOURS, first, until, order_by=["time", "seq"])
        raw = S.read_point_stream(spark, "text", {"maxFilesPerTrigger": 1}, path=src)
        model = ClusterModel(spark, PARAMS, root=root)
        run_stream(decode_stream(raw, 2, marked=True), model, available_now=True, checkpoint=ckpt, results=results)
        return model

    stopped = run(0, STOP_AFTER)
    forget_commit(spark, ckpt, stopped.meta.version)
    model = run(STOP_AFTER, SLICES)
    remove(spark, src)
    return model


def q_stream_replay(spark, sf):
    """The state after ten micro-batches, with promotions,
    two prunings, a restart and a replayed batch."""
    return replayed(spark, sf).state.select(*C._state_cols())


def q_stream_scores(spark, sf):
    """Homogeneity, completeness and purity of every batch of
    that run, read from the result tables."""
    from evoclust.sources.results import ResultWriter, read_results
    root = scratch_path(spark, "replay-results")
    replayed(spark, sf, ResultWriter(spark, root))
    return read_results(spark, root)["micro_metrics"].select(F.col("batch_id").cast("long").alias("batch_id"), "name", _r(F.col("value"), "value"))


def q_stream_progress(spark, sf):
    """What every batch of that run did, and how often the listener
    saw it; the replayed batch is seen twice and folded once."""
    from evoclust.sources.results import ResultWriter, read_results
    root = scratch_path(spark, "replay-results")
    replayed(spark, sf, ResultWriter(spark, root))
    t = read_results(spark, root)
    seen = t["listener"].filter("event = 'progress' AND rows > 0 AND trigger_ms > 0").groupBy("batch_id").agg(F.count(F.lit(1)).alias("seen"))
    return t["progress"].select(F.col("batch_id").cast("long").alias("batch_id"), "rows", "to_p", "to_o", "unassigned", "opened", "promoted", "p_pruned",
                                "o_pruned", "n_p", "n_o").join(seen, "batch_id", "left")


QUERIES = {f.__name__[2:]: f for f in (q_stream_replay, q_stream_scores, q_stream_progress)}


# --------------------------------------------------------------------- SQL

_L = ", ".join(f"l{k}" for k in range(5))
_V = "ft, le, n, w, c0, c1, q0, q1, mc, " + _L


def _step(i: int, p=PARAMS, first: int = 0) -> str:
    """One micro-batch, slice ``first + i``: state ``s<i>`` to ``s<i+1>``,
    scalars ``m<i>`` to ``m<i+1>``."""
    j = i + 1
    lam, eps, up = p.lam, p.epsilon, p.beta * p.mu
    fit = "sqrt(greatest(abs(b0) / w2 - abs(a0 * a0) / (w2 * w2), abs(b1) / w2 - abs(a1 * a1) / (w2 * w2), 0.0))"
    prune = i and i % 4 == 0
    thr = f"((pow(2.0, -{lam} * (clock - ft + {p.tp})) - {1.0 if p.q_prune_fix else 0.0}) / (pow(2.0, -{lam} * {p.tp}) - 1.0))"
    last = f"""SELECT kind, ord, ft, clock AS le, n, w * f AS w, c0 * f AS c0, c1 * f AS c1, q0 * f AS q0, q1 * f AS q1, mc, {_L}
  FROM (SELECT x{i}.*, clock, pow(2.0, -{lam} * (clock - le)) AS f FROM x{i} CROSS JOIN clk{i}) z
  WHERE w * f >= CASE WHEN kind = 'p' THEN {up} ELSE {thr} END""" if prune else f"SELECT kind, ord, {_V} FROM x{i}"
    return f"""
e{i} AS MATERIALIZED (SELECT * FROM evp WHERE time >= {(first + i) * SLICE_HOURS} AND time < {(first + j) * SLICE_HOURS}),
clk{i} AS (SELECT max(time) AS clock FROM e{i}),
near{i} AS (SELECT *, w * f + 1.0 AS w2, c0 * f + f0 AS a0, c1 * f + f1 AS a1, q0 * f + f0 * f0 AS b0, q1 * f + f1 * f1 AS b1
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id, kind ORDER BY dist, ord) AS rn
        FROM (SELECT e.event_id, e.time, e.f0, e.f1, s.kind, s.ord, s.w, s.c0, s.c1, s.q0, s.q1, pow(2.0, -{lam} * (e.time - s.le)) AS f,
                sqrt((e.f0 - s.c0 / s.w) * (e.f0 - s.c0 / s.w) + (e.f1 - s.c1 / s.w) * (e.f1 - s.c1 / s.w)) AS dist
              FROM e{i} e CROSS JOIN s{i} s) c) z WHERE rn = 1),
fit{i} AS (SELECT event_id, max(CASE WHEN kind = 'p' THEN ord END) AS po, max(CASE WHEN kind = 'o' THEN ord END) AS oo
  FROM near{i} WHERE w2 > 1 AND {fit} <= CAST({eps} AS DOUBLE) GROUP BY event_id),
a{i} AS MATERIALIZED (SELECT e.*, CASE WHEN po IS NOT NULL THEN 'p' WHEN oo IS NOT NULL THEN 'o' END AS kind, coalesce(po, oo) AS ord
  FROM e{i} e LEFT JOIN fit{i} USING (event_id)),
d{i} AS MATERIALIZED (SELECT kind, ord, tmax, sum(g) AS dw, sum(g * f0) AS d0, sum(g * f1) AS d1, sum(g * f0 * f0) AS e0,
    sum(g * f1 * f1) AS e1, count(*) AS dn, {O.LABEL_SUMS}
  FROM (SELECT *, pow(2.0, -{lam} * (tmax - time)) AS g FROM (SELECT *, max(time) OVER (PARTITION BY kind, ord) AS tmax
        FROM a{i} WHERE kind IS NOT NULL) y) z GROUP BY kind, ord, tmax),
u{i} AS (SELECT s.kind, s.ord, s.ft, d.dn IS NOT NULL AS hit, coalesce(d.tmax, s.le) AS le, coalesce(d.dn, 0) AS n,
    s.w * f + coalesce(dw, 0) AS w, s.c0 * f + coalesce(d0, 0) AS c0, s.c1 * f + coalesce(d1, 0) AS c1,
    s.q0 * f + coalesce(e0, 0) AS q0, s.q1 * f + coalesce(e1, 0) AS q1, s.mc, {', '.join(f'coalesce(d.l{k}, s.l{k}) AS l{k}' for k in range(5))}
  FROM (SELECT s.*, coalesce(pow(2.0, -{lam} * (d.tmax - s.le)), 1.0) AS f FROM s{i} s LEFT JOIN d{i} d USING (kind, ord)) s
  LEFT JOIN d{i} d USING (kind, ord)),
rest{i} AS (SELECT * FROM a{i} WHERE kind IS NULL), {O.opened_cells(f'fresh{i}', f'rest{i}', 2 * eps, lam)},
b{i} AS MATERIALIZED (SELECT kind, ord, {_V}, hit AND kind = 'o' AND w >= {up} AS up FROM u{i}
  UNION ALL SELECT 'o', mo + row_number() OVER (ORDER BY ft, fs), {_V}, w >= {up}
  FROM (SELECT *, '{i}-' || (row_number() OVER (ORDER BY ft, fs) - 1) AS mc FROM fresh{i}) f CROSS JOIN m{i}),
x{i} AS MATERIALIZED (SELECT CASE WHEN up THEN 'p' ELSE kind END AS kind,
    CASE WHEN up THEN mp + row_number() OVER (PARTITION BY up ORDER BY ord DESC) ELSE ord END AS ord, {_V}, up FROM b{i} CROSS JOIN m{i}),
m{j} AS MATERIALIZED (SELECT mp + (SELECT count(*) FROM x{i} WHERE up) AS mp, mo + (SELECT count(*) FROM fresh{i}) AS mo FROM m{i}),
s{j} AS MATERIALIZED ({last})"""


_EMPTY = ", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in ("w", "c0", "c1", "q0", "q1"))
RUN = f"""WITH {O.EVP},
m0 AS (SELECT CAST(-1 AS BIGINT) AS mp, CAST(-1 AS BIGINT) AS mo),
s0 AS (SELECT 'p' AS kind, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS ft, CAST(0 AS BIGINT) AS le, CAST(0 AS BIGINT) AS n, {_EMPTY}, '' AS mc,
  {', '.join(f'CAST(0 AS BIGINT) AS l{k}' for k in range(5))} WHERE false),""" + ",".join(_step(i) for i in range(SLICES))

#: what every cluster took in a batch: old ones by kind and place, new ones
_CELLS = " UNION ALL ".join(
    f"SELECT {i} AS batch_id, kind || ord AS k, label, count(*) AS n FROM a{i} WHERE kind IS NOT NULL GROUP BY ALL "
    f"UNION ALL SELECT {i}, k0 || '/' || k1, label, count(*) FROM fresh{i}_k GROUP BY ALL" for i in range(SLICES))


def _score(name: str, outer: str) -> str:
    """1 - H(all) - H(other) over H(outer), of every batch."""
    other = {"label": "k", "k": "label"}[outer]
    part = lambda cols: (f"(SELECT batch_id, -sum(p * ln(p)) AS h, count(*) AS kinds FROM (SELECT batch_id, {cols}, sum(n) / any_value(t) AS p "  # noqa: E731
                         f"FROM cells JOIN total USING (batch_id) GROUP BY batch_id, {cols}) z GROUP BY batch_id)")
    return (f"SELECT a.batch_id, '{name}' AS name, CASE WHEN b.kinds = 1 THEN CAST(1 AS DOUBLE) ELSE 1 - (a.h - c.h) / b.h END AS value "
            f"FROM {part('k, label')} a JOIN {part(outer)} b USING (batch_id) JOIN {part(other)} c USING (batch_id)")


_PURITY = " UNION ALL ".join(
    f"SELECT {i}, 'PURITY(avg)', avg(greatest({_L}) / CAST({_L.replace(', ', ' + ')} AS DOUBLE)) FROM s{i + 1} WHERE kind = 'p'" for i in range(SLICES))


def _progress(i: int) -> str:
    j = i + 1
    of = lambda t, c="true": f"(SELECT count(*) FROM {t} WHERE {c})"
    return (f"SELECT CAST({i} AS BIGINT) AS batch_id, {of(f'a{i}')} AS rows, "
            f"""{of(f"a{i}", "kind = 'p'")} AS to_p, """
            f"""{of(f"a{i}", "kind = 'o'")} AS to_o, {of(f"a{i}", "kind IS NULL")} AS unassigned, {of(f"fresh{i}")} AS opened, """
            f"""{of(f"x{i}", "up")} AS promoted, {of(f"x{i}", "kind = 'p'")} - {of(f"s{j}", "kind = 'p'")} AS p_pruned, """
            f"""{of(f"x{i}", "kind = 'o'")} - {of(f"s{j}", "kind = 'o'")} AS o_pruned, {of(f"s{j}", "kind = 'p'")} AS n_p, """
            f"""{of(f"s{j}", "kind = 'o'")} AS n_o, CAST({2 if j == STOP_AFTER else 1} AS BIGINT) AS seen""")


# the run of catalog.run_events_stream: density clusters of the first slice, the others as micro-batches
_INIT = O.DENSITY.replace("evp a JOIN evp b", "ev0 a JOIN ev0 b").replace(
    "e AS (SELECT src", f"ev0 AS (SELECT * FROM evp WHERE time < {SLICE_HOURS}),\ne AS (SELECT src", 1)
_STREAM = f"""{_INIT},
s0 AS MATERIALIZED (SELECT 'p' AS kind, CAST(comp AS BIGINT) AS ord, CAST(0 AS BIGINT) AS ft, CAST(0 AS BIGINT) AS le, CAST(0 AS BIGINT) AS n,
  CAST(count(*) AS DOUBLE) AS w, sum(f0) AS c0, sum(f1) AS c1, sum(f0 * f0) AS q0, sum(f1 * f1) AS q1, 'init-' || comp AS mc, {O.LABEL_SUMS}
  FROM mem JOIN evp ON mem.id = evp.event_id GROUP BY comp),
m0 AS (SELECT coalesce(max(ord), -1) AS mp, CAST(-1 AS BIGINT) AS mo FROM s0),""" + ",".join(
    _step(i, C.STREAM_PARAMS, 1) for i in range(SLICES - 1))


SQL = {
    "run_stream": f"""{_STREAM},
x AS (SELECT *, greatest({_L}) AS mx FROM s{SLICES - 1})
SELECT CASE WHEN kind = 'p' THEN 'primary' ELSE 'outlier' END AS type, CAST(ord AS BIGINT) AS ord, mc AS mc_id, round(w, 6) AS weight,
  CAST(n AS BIGINT) AS pts, CAST(CASE WHEN l0 = mx THEN 0 WHEN l1 = mx THEN 1 WHEN l2 = mx THEN 2 WHEN l3 = mx THEN 3 ELSE 4 END AS INTEGER) AS label,
  round(mx / CAST({_L.replace(', ', ' + ')} AS DOUBLE), 6) AS purity, round(CASE WHEN w > 1 THEN sqrt(greatest(
    abs(q0) / w - abs(c0 * c0) / (w * w), abs(q1) / w - abs(c1 * c1) / (w * w), 0.0)) ELSE CAST('inf' AS DOUBLE) END, 6) AS radius FROM x""",
    "stream_replay": f"""{RUN}
SELECT kind, CAST(ord AS BIGINT) AS ord, {O.state_row('w', 'le')}, CAST(n AS BIGINT) AS pts, {_L} FROM s{SLICES}""",
    "stream_scores": f"""{RUN},
cells AS MATERIALIZED ({_CELLS}), total AS (SELECT batch_id, sum(n) AS t FROM cells GROUP BY batch_id)
SELECT CAST(batch_id AS BIGINT) AS batch_id, name, round(value, 6) AS value FROM ({_score('HOMOGENEITY', 'label')}
UNION ALL {_score('COMPLETENESS', 'k')} UNION ALL {_PURITY}) z""",
    "stream_progress": f"{RUN} " + " UNION ALL ".join(_progress(i) for i in range(SLICES)),
}
