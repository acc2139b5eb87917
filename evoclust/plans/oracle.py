"""DuckDB SQL for the registered queries (same tables, same column names).

Queries that replay sequential clustering (init scan, macro replay, the
stream run that starts from them) and the component labelling have no SQL
form here; they are checked against goldens and brute force in tests.
"""

from __future__ import annotations

# events as points, same definition as catalog.events_points
EVP = """
evm AS (SELECT min(CAST(floor(epoch(ts)) AS BIGINT)) AS s0 FROM events),
evt AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label
        FROM (SELECT DISTINCT event_type FROM events) x),
evp AS (
  SELECT e.event_id, e.user_id, e.event_type,
         CAST((CAST(floor(epoch(e.ts)) AS BIGINT) - evm.s0) // 3600 AS BIGINT) AS time,
         CAST(hour(e.ts) AS DOUBLE) / CAST(6.0 AS DOUBLE) AS f0,
         e.value / CAST(50.0 AS DOUBLE) AS f1,
         evt.label
  FROM events e CROSS JOIN evm JOIN evt ON e.event_type = evt.event_type)
"""

W = "pow(2.0, -0.25 * ({tmax} - p.time))"

NEAREST = """
ex AS (SELECT vec_id, label, CAST(v AS DOUBLE) AS v, k FROM (
         SELECT vec_id, label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS k
         FROM embeddings) u),
cen AS (SELECT label AS cl, k, sum(v) / count(*) AS c FROM ex GROUP BY label, k),
dd AS (SELECT ex.vec_id, cen.cl, sqrt(sum((ex.v - cen.c) * (ex.v - cen.c))) AS dist
       FROM ex JOIN cen ON ex.k = cen.k GROUP BY ex.vec_id, cen.cl),
rk AS (SELECT vec_id, cl, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cl) AS rn FROM dd),
nc AS (SELECT r.vec_id, r.cl AS cluster, r.dist, e.label FROM rk r JOIN embeddings e ON r.vec_id = e.vec_id
       WHERE r.rn = 1)
"""

PURITY = NEAREST + """,
h AS (SELECT cluster, label, count(*) AS c FROM nc GROUP BY cluster, label),
t AS (SELECT cluster, sum(c) AS n, max(c) AS mx FROM h GROUP BY cluster),
pt AS (SELECT t.cluster, t.n, t.mx,
              (SELECT min(h.label) FROM h WHERE h.cluster = t.cluster AND h.c = t.mx) AS dominant,
              CAST(t.mx AS DOUBLE) / CAST(t.n AS DOUBLE) AS purity FROM t)
"""

USER_MC = EVP + """,
mt AS (SELECT user_id, max(time) AS tmax, min(time) AS t0 FROM evp GROUP BY user_id),
m AS (SELECT p.user_id, mt.tmax, mt.t0,
             sum(pow(2.0, -0.25 * (mt.tmax - p.time))) AS dn,
             sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f0) AS d0,
             sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f1) AS d1,
             sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f0 * p.f0) AS q0,
             sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f1 * p.f1) AS q1,
             count(*) AS dpts,
             sum(CASE WHEN p.label = 0 THEN 1 ELSE 0 END) AS l0,
             sum(CASE WHEN p.label = 1 THEN 1 ELSE 0 END) AS l1,
             sum(CASE WHEN p.label = 2 THEN 1 ELSE 0 END) AS l2,
             sum(CASE WHEN p.label = 3 THEN 1 ELSE 0 END) AS l3,
             sum(CASE WHEN p.label = 4 THEN 1 ELSE 0 END) AS l4
      FROM evp p JOIN mt ON p.user_id = mt.user_id GROUP BY p.user_id, mt.tmax, mt.t0)
"""

LT = """lt AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS label
        FROM (SELECT DISTINCT l_returnflag FROM lineitem) x)"""

LABEL_SUMS = ", ".join(f"CAST(sum(CASE WHEN label = {k} THEN 1 ELSE 0 END) AS BIGINT) AS l{k}" for k in range(5))


def opened_cells(name: str, points: str, side: float, lam: float) -> str:
    """The clusters that cells of ``side`` open over a table of points."""
    return f"""{name}_k AS (SELECT *, floor(f0 / CAST({side} AS DOUBLE)) AS k0, floor(f1 / CAST({side} AS DOUBLE)) AS k1
  FROM {points}),
{name}_t AS (SELECT *, max(time) OVER (PARTITION BY k0, k1) AS tmax FROM {name}_k),
{name}_w AS (SELECT *, pow(2.0, -{lam} * (tmax - time)) AS g FROM {name}_t),
{name} AS (SELECT min(time) AS ft, min(event_id) AS fs, max(time) AS le, count(*) AS n, sum(g) AS w, sum(g * f0) AS c0,
  sum(g * f1) AS c1, sum(g * f0 * f0) AS q0, sum(g * f1 * f1) AS q1, {LABEL_SUMS} FROM {name}_w GROUP BY k0, k1)"""


def state_row(weight: str, last_edit: str) -> str:
    return (f"round({weight}, 6) AS weight, round(c0, 6) AS c0, round(c1, 6) AS c1, round(q0, 6) AS q0, "
            f"round(q1, 6) AS q1, ft AS t0, {last_edit} AS last_edit")


# the first half of the events as clusters, and the second half assigned to them
ASSIGNED = f"""WITH {EVP},
e1 AS (SELECT * FROM evp WHERE time < 360), e2 AS (SELECT * FROM evp WHERE time >= 360),
{opened_cells('s0', 'e1', 0.42, 0.01)},
sk AS (SELECT *, CASE WHEN w >= 20 THEN 'p' ELSE 'o' END AS kind FROM s0),
s AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ft, fs) - 1 AS ord FROM sk),
mx AS (SELECT coalesce(max(CASE WHEN kind = 'p' THEN ord END), -1) AS mp,
              coalesce(max(CASE WHEN kind = 'o' THEN ord END), -1) AS mo FROM s),
cand AS (SELECT e2.event_id, e2.time, e2.f0, e2.f1, s.kind, s.ord,
           sqrt((e2.f0 - s.c0 / s.w) * (e2.f0 - s.c0 / s.w) + (e2.f1 - s.c1 / s.w) * (e2.f1 - s.c1 / s.w)) AS dist,
           pow(2.0, -0.01 * (e2.time - s.le)) AS f, s.w, s.c0, s.c1, s.q0, s.q1 FROM e2 CROSS JOIN s),
near AS (SELECT *, w * f + 1.0 AS w2, c0 * f + f0 AS a0, c1 * f + f1 AS a1, q0 * f + f0 * f0 AS b0,
           q1 * f + f1 * f1 AS b1 FROM (SELECT *, row_number() OVER (PARTITION BY event_id, kind ORDER BY dist, ord) AS rn
           FROM cand) z WHERE rn = 1),
fit AS (SELECT event_id, max(CASE WHEN kind = 'p' THEN ord END) AS po, max(CASE WHEN kind = 'o' THEN ord END) AS oo
        FROM near WHERE w2 > 1 AND sqrt(greatest(abs(b0) / w2 - abs(a0 * a0) / (w2 * w2),
          abs(b1) / w2 - abs(a1 * a1) / (w2 * w2), 0.0)) <= CAST(0.21 AS DOUBLE) GROUP BY event_id),
a AS (SELECT e2.*, CASE WHEN po IS NOT NULL THEN 'p' WHEN oo IS NOT NULL THEN 'o' END AS kind, coalesce(po, oo) AS ord
      FROM e2 LEFT JOIN fit ON e2.event_id = fit.event_id)"""

# density clusters of all events: more than 10 neighbours within 0.2
DENSITY = f"""WITH RECURSIVE {EVP},
e AS (SELECT src, dst, dist FROM (SELECT a.event_id AS src, b.event_id AS dst,
        sqrt((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1)) AS dist
      FROM evp a JOIN evp b ON a.event_id <> b.event_id AND abs(a.f1 - b.f1) < 0.21 AND abs(a.f0 - b.f0) < 0.21) x
      WHERE dist < CAST(0.2 AS DOUBLE)),
core AS (SELECT src AS id FROM e GROUP BY src HAVING count(*) > 10),
ce AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM core UNION
  SELECT ce.dst, min(cc.comp) FROM cc JOIN ce ON cc.id = ce.src JOIN recurring.cc AS r ON r.id = ce.dst
  WHERE cc.comp < r.comp GROUP BY ce.dst),
bd AS (SELECT e.src AS id, arg_min(cc.comp, {{'d': e.dist, 'o': e.dst}}) AS comp FROM e JOIN cc ON e.dst = cc.id
       WHERE e.src NOT IN (SELECT id FROM core) GROUP BY e.src),
mem AS (SELECT id, comp FROM cc UNION ALL SELECT id, comp FROM bd)"""

SQL = {
    "decode_points": f"""WITH {EVP}
SELECT event_id, time, round(f0, 6) AS f0, round(f1, 6) AS f1, label FROM evp""",

    "decode_csv_columns": """SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS q,
round(l_extendedprice, 6) AS p, round(l_discount, 6) AS d, round(l_tax, 6) AS t FROM lineitem""",

    "logical_time": """SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS seq,
CAST((row_number() OVER (ORDER BY vec_id) - 1) // 10 AS BIGINT) AS time FROM embeddings""",

    "z_score": """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq,
  avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp,
  avg(l_discount) AS md, stddev_samp(l_discount) AS sd, avg(l_tax) AS mt, stddev_samp(l_tax) AS st FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity,
  round((l_extendedprice - mp) / sp, 6) AS l_extendedprice, round((l_discount - md) / sd, 6) AS l_discount,
  round((l_tax - mt) / st, 6) AS l_tax FROM lineitem CROSS JOIN s""",

    "drop_null_columns": """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq,
  avg(l_discount) AS md, stddev_samp(l_discount) AS sd, avg(l_tax) AS mt, stddev_samp(l_tax) AS st FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity,
  round((l_discount - md) / sd, 6) AS l_discount, round((l_tax - mt) / st, 6) AS l_tax
FROM lineitem CROSS JOIN s""",

    "encode_labels": """WITH f AS (SELECT event_type, min(event_id) AS m FROM events GROUP BY event_type),
r AS (SELECT event_type, CAST(row_number() OVER (ORDER BY m, event_type) - 1 AS INTEGER) AS label FROM f)
SELECT e.event_id, e.event_type, r.label FROM events e JOIN r ON e.event_type = r.event_type""",

    "linear_transform": """SELECT l_orderkey, l_linenumber,
round(l_quantity * CAST(0.6 AS DOUBLE) + l_discount * CAST(-0.4 AS DOUBLE), 6) AS a,
round(l_quantity * CAST(-0.6 AS DOUBLE) + l_discount * CAST(0.8 AS DOUBLE), 6) AS b FROM lineitem""",

    "merge_datasets": f"""WITH {EVP}, {LT}
SELECT 'lineitem' AS source, l.l_orderkey AS id1, CAST(l.l_linenumber AS BIGINT) AS id2,
  round(l.l_quantity / CAST(50.0 AS DOUBLE), 6) AS f0, round(l.l_discount * CAST(10.0 AS DOUBLE), 6) AS f1,
  lt.label AS label
FROM lineitem l JOIN lt ON l.l_returnflag = lt.l_returnflag
UNION ALL
SELECT 'events', event_id, CAST(0 AS BIGINT), round(f0, 6), round(f1, 6), CAST(label + 3 AS INTEGER) FROM evp""",

    "stratified_sample": """SELECT vec_id, label FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label
    ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn FROM embeddings) x WHERE rn <= 20""",

    "sample_n": """SELECT vec_id, label FROM embeddings
ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 100""",

    "nearest_cluster": f"""WITH {NEAREST}
SELECT vec_id, CAST(cluster AS BIGINT) AS cluster, round(dist, 6) AS dist FROM nc""",

    "cluster_purity": f"""WITH {PURITY}
SELECT CAST(cluster AS BIGINT) AS cluster, CAST(n AS BIGINT) AS n, CAST(mx AS BIGINT) AS correct_pts,
  CAST(dominant AS INTEGER) AS dominant, round(purity, 6) AS purity FROM pt""",

    "avg_purity": f"""WITH {PURITY}
SELECT round(avg(purity), 6) AS avg_purity, CAST(count(*) AS BIGINT) AS n_clusters FROM pt""",

    "eps_pairs": f"""WITH {EVP}
SELECT a.event_id AS src, b.event_id AS dst,
  round(sqrt((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1)), 6) AS dist
FROM evp a JOIN evp b ON a.event_id <> b.event_id
WHERE sqrt((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1)) < CAST(0.2 AS DOUBLE)""",

    # events of one hour have the same first coordinate, and hours lie 1/6
    # apart: components are the runs of the second one without a gap of 0.05
    "components": f"""WITH {EVP},
g AS (SELECT event_id, f0, f1, f1 - lag(f1) OVER (PARTITION BY f0 ORDER BY f1, event_id) AS gap FROM evp),
i AS (SELECT event_id, f0, sum(CASE WHEN gap < CAST(0.05 AS DOUBLE) THEN 0 ELSE 1 END)
        OVER (PARTITION BY f0 ORDER BY f1, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
c AS (SELECT event_id, min(event_id) OVER (PARTITION BY f0, run) AS comp, count(*) OVER (PARTITION BY f0, run) AS n FROM i)
SELECT event_id, comp FROM c WHERE n > 1""",

    "init_clusters": f"""{DENSITY}
SELECT CAST(comp AS BIGINT) AS ord, CAST(count(*) AS DOUBLE) AS weight, round(sum(f0), 6) AS c0, round(sum(f1), 6) AS c1,
  round(sum(f0 * f0), 6) AS q0, round(sum(f1 * f1), 6) AS q1, CAST(0 AS BIGINT) AS pts, {LABEL_SUMS}
FROM mem JOIN evp ON mem.id = evp.event_id GROUP BY comp""",

    "admissible_points": f"""WITH {EVP},
mt AS (SELECT label, max(time) AS tmax FROM evp GROUP BY label),
mc AS (SELECT p.label, mt.tmax,
   sum(pow(2.0, -0.25 * (mt.tmax - p.time))) AS w,
   sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f0) AS c0,
   sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f1) AS c1,
   sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f0 * p.f0) AS q0,
   sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f1 * p.f1) AS q1
   FROM evp p JOIN mt ON p.label = mt.label GROUP BY p.label, mt.tmax),
clk AS (SELECT max(time) AS clock FROM evp),
f AS (SELECT mc.*, pow(2.0, -0.25 * (clk.clock - mc.tmax)) AS fac FROM mc CROSS JOIN clk),
ins AS (SELECT p.event_id, f.w * f.fac + 1.0 AS w2,
   f.c0 * f.fac + p.f0 AS a0, f.c1 * f.fac + p.f1 AS a1,
   f.q0 * f.fac + p.f0 * p.f0 AS b0, f.q1 * f.fac + p.f1 * p.f1 AS b1
   FROM evp p JOIN f ON p.label = f.label),
r AS (SELECT event_id, CASE WHEN w2 > 1 THEN sqrt(greatest(abs(b0) / w2 - abs(a0 * a0) / (w2 * w2),
   abs(b1) / w2 - abs(a1 * a1) / (w2 * w2), 0.0)) ELSE CAST('inf' AS DOUBLE) END AS radius FROM ins)
SELECT event_id, round(radius, 6) AS radius, radius <= CAST(1.0 AS DOUBLE) AS admissible FROM r""",

    "decayed_delta": f"""WITH {USER_MC}
SELECT user_id, CAST(greatest(tmax, 0) AS BIGINT) AS tmax, round(d0, 6) AS d0, round(d1, 6) AS d1,
  round(q0, 6) AS q0, round(q1, 6) AS q1, round(dn, 6) AS dn, CAST(dpts AS BIGINT) AS dpts,
  CAST(l0 AS BIGINT) AS l0, CAST(l1 AS BIGINT) AS l1, CAST(l2 AS BIGINT) AS l2,
  CAST(l3 AS BIGINT) AS l3, CAST(l4 AS BIGINT) AS l4 FROM m""",

    "apply_delta": f"""WITH {EVP},
a AS (SELECT user_id, max(time) AS le FROM evp WHERE time < 360 GROUP BY user_id),
s AS (SELECT p.user_id, a.le, sum(pow(2.0, -0.25 * (a.le - p.time))) AS w,
   sum(pow(2.0, -0.25 * (a.le - p.time)) * p.f0) AS c0, sum(pow(2.0, -0.25 * (a.le - p.time)) * p.f1) AS c1
   FROM evp p JOIN a ON p.user_id = a.user_id WHERE p.time < 360 GROUP BY p.user_id, a.le),
b AS (SELECT user_id, max(time) AS tmax FROM evp WHERE time >= 360 GROUP BY user_id),
d AS (SELECT p.user_id, b.tmax, sum(pow(2.0, -0.25 * (b.tmax - p.time))) AS dn,
   sum(pow(2.0, -0.25 * (b.tmax - p.time)) * p.f0) AS d0, sum(pow(2.0, -0.25 * (b.tmax - p.time)) * p.f1) AS d1,
   count(*) AS dpts FROM evp p JOIN b ON p.user_id = b.user_id WHERE p.time >= 360 GROUP BY p.user_id, b.tmax)
SELECT user_id, round(coalesce(s.w * f, 0) + coalesce(d.dn, 0), 6) AS weight, round(coalesce(s.c0 * f, 0) + coalesce(d.d0, 0), 6) AS c0,
  round(coalesce(s.c1 * f, 0) + coalesce(d.d1, 0), 6) AS c1, CAST(coalesce(d.tmax, s.le) AS BIGINT) AS last_edit,
  CAST(coalesce(d.dpts, 0) AS BIGINT) AS pts
FROM (SELECT s.*, coalesce(pow(2.0, -0.25 * (d.tmax - s.le)), 1.0) AS f FROM s LEFT JOIN d USING (user_id)) s
FULL JOIN d USING (user_id)""",

    "promote_prune": f"""WITH {USER_MC},
clk AS (SELECT max(time) AS clock FROM evp),
x AS (SELECT m.user_id, m.dn, m.dn * pow(2.0, -0.25 * (clk.clock - m.tmax)) AS wc,
   pow(2.0, -0.25 * (clk.clock - m.t0 + 4)) / (pow(2.0, -0.25 * 4) - 1.0) AS thr_ref,
   (pow(2.0, -0.25 * (clk.clock - m.t0 + 4)) - 1.0) / (pow(2.0, -0.25 * 4) - 1.0) AS thr_fix
   FROM m CROSS JOIN clk)
SELECT user_id, round(dn, 6) AS weight, dn >= CAST(2.0 AS DOUBLE) AS promotable,
  round(wc, 6) AS weight_at_clock, wc >= CAST(2.0 AS DOUBLE) AS keep_p,
  round(thr_ref, 6) AS thr_ref, round(thr_fix, 6) AS thr_fix,
  wc >= thr_ref AS keep_o_ref, wc >= thr_fix AS keep_o_fix FROM x""",

    "admit_outliers": f"""WITH {EVP}, {opened_cells('s', 'evp', 0.4, 0.25)}
SELECT ft AS first_time, fs AS first_seq, round(w, 6) AS weight, round(c0, 6) AS c0, round(c1, 6) AS c1,
  round(q0, 6) AS q0, round(q1, 6) AS q1, le AS last_edit, n AS pts, l0, l1, l2, l3, l4 FROM s""",

    "stream_events": f"""WITH {EVP}, {opened_cells('s', 'evp', 0.4, 0.25)},
x AS (SELECT *, row_number() OVER (ORDER BY ft, fs) - 1 AS o, w >= 2 AS up FROM s)
SELECT CASE WHEN up THEN 'p' ELSE 'o' END AS kind,
  CAST(CASE WHEN up THEN row_number() OVER (PARTITION BY up ORDER BY o DESC) - 1 ELSE o END AS BIGINT) AS ord,
  {state_row('w', 'le')}, CAST(n AS BIGINT) AS pts, l0, l1, l2, l3, l4 FROM x""",

    "update_batch": f"""{ASSIGNED},
ta AS (SELECT kind, ord, max(time) AS tmax FROM a WHERE kind IS NOT NULL GROUP BY kind, ord),
da AS (SELECT a.*, ta.tmax, pow(2.0, -0.01 * (ta.tmax - a.time)) AS g
       FROM a JOIN ta ON a.kind = ta.kind AND a.ord = ta.ord),
d AS (SELECT kind, ord, tmax, sum(g) AS dw, sum(g * f0) AS d0, sum(g * f1) AS d1, sum(g * f0 * f0) AS e0,
        sum(g * f1 * f1) AS e1, count(*) AS dn, {LABEL_SUMS} FROM da GROUP BY kind, ord, tmax),
u AS (SELECT s.kind, s.ord, s.ft, d.dn IS NOT NULL AS hit, coalesce(d.tmax, s.le) AS le, coalesce(d.dn, 0) AS n,
        coalesce(pow(2.0, -0.01 * (d.tmax - s.le)), 1.0) AS f, coalesce(dw, 0) AS dw, coalesce(d0, 0) AS d0,
        coalesce(d1, 0) AS d1, coalesce(e0, 0) AS e0, coalesce(e1, 0) AS e1, s.w, s.c0, s.c1, s.q0, s.q1,
        coalesce(d.l0, s.l0) AS l0, coalesce(d.l1, s.l1) AS l1, coalesce(d.l2, s.l2) AS l2,
        coalesce(d.l3, s.l3) AS l3, coalesce(d.l4, s.l4) AS l4
      FROM s LEFT JOIN d ON s.kind = d.kind AND s.ord = d.ord),
rest AS (SELECT * FROM a WHERE kind IS NULL), {opened_cells('fresh', 'rest', 0.42, 0.01)},
b AS (SELECT kind, ord, ft, le, n, w * f + dw AS w, c0 * f + d0 AS c0, c1 * f + d1 AS c1, q0 * f + e0 AS q0,
        q1 * f + e1 AS q1, l0, l1, l2, l3, l4, hit AND kind = 'o' AND w * f + dw >= 20 AS up FROM u
      UNION ALL
      SELECT 'o', mo + row_number() OVER (ORDER BY ft, fs), ft, le, n, w, c0, c1, q0, q1, l0, l1, l2, l3, l4, w >= 20
      FROM fresh CROSS JOIN mx),
x AS (SELECT * REPLACE (CASE WHEN up THEN 'p' ELSE kind END AS kind,
        CASE WHEN up THEN mp + row_number() OVER (PARTITION BY up ORDER BY ord DESC) ELSE ord END AS ord)
      FROM b CROSS JOIN mx),
clk AS (SELECT max(time) AS clock FROM evp),
z AS (SELECT kind, ord, ft, n, clock, pow(2.0, -0.01 * (clock - le)) AS f, w, c0, c1, q0, q1, l0, l1, l2, l3, l4,
        (pow(2.0, -0.01 * (clock - ft + 40)) - 1.0) / (pow(2.0, -0.01 * 40) - 1.0) AS thr FROM x CROSS JOIN clk),
y AS (SELECT * REPLACE (w * f AS w, c0 * f AS c0, c1 * f AS c1, q0 * f AS q0, q1 * f AS q1) FROM z)
SELECT kind, CAST(ord AS BIGINT) AS ord, {state_row('w', 'clock')}, CAST(n AS BIGINT) AS pts, l0, l1, l2, l3, l4
FROM y WHERE w >= CASE WHEN kind = 'p' THEN 20 ELSE thr END""",

    "points_per_batch": f"""WITH {EVP},
b AS (SELECT CAST(time // 24 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS pts FROM evp GROUP BY 1)
SELECT batch_id, pts,
  CAST(coalesce(sum(pts) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
  CAST(sum(pts) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS after
FROM b""",

    "homogeneity": f"""WITH {NEAREST},
ct AS (SELECT cluster, label, CAST(count(*) AS DOUBLE) AS n FROM nc GROUP BY cluster, label),
tot AS (SELECT sum(n) AS nn FROM ct),
mk AS (SELECT cluster, sum(n) AS nk FROM ct GROUP BY cluster),
mc AS (SELECT label, sum(n) AS ncl FROM ct GROUP BY label),
e AS (SELECT -sum(ct.n / tot.nn * ln(ct.n / mk.nk)) AS h_c_k, -sum(ct.n / tot.nn * ln(ct.n / mc.ncl)) AS h_k_c
      FROM ct JOIN mk ON ct.cluster = mk.cluster JOIN mc ON ct.label = mc.label CROSS JOIN tot),
hc AS (SELECT -sum(mc.ncl / tot.nn * ln(mc.ncl / tot.nn)) AS h_c FROM mc CROSS JOIN tot),
hk AS (SELECT -sum(mk.nk / tot.nn * ln(mk.nk / tot.nn)) AS h_k FROM mk CROSS JOIN tot),
r AS (SELECT CASE WHEN h_c = 0 THEN CAST(1 AS DOUBLE) ELSE 1.0 - h_c_k / h_c END AS hom,
             CASE WHEN h_k = 0 THEN CAST(1 AS DOUBLE) ELSE 1.0 - h_k_c / h_k END AS com FROM e, hc, hk)
SELECT round(hom, 6) AS homogeneity, round(com, 6) AS completeness,
  round(CASE WHEN hom + com = 0 THEN CAST(0 AS DOUBLE) ELSE 2 * hom * com / (hom + com) END, 6) AS v_measure FROM r""",

    "predict": f"""WITH {LT},
lp AS (SELECT l.l_orderkey, l.l_linenumber, l.l_quantity / CAST(50.0 AS DOUBLE) AS f0,
   l.l_discount * CAST(10.0 AS DOUBLE) AS f1, l.l_tax * CAST(10.0 AS DOUBLE) AS f2, lt.label
   FROM lineitem l JOIN lt ON l.l_returnflag = lt.l_returnflag),
cen AS (SELECT label AS cl, sum(f0) / count(*) AS c0, sum(f1) / count(*) AS c1, sum(f2) / count(*) AS c2
   FROM lp GROUP BY label),
dd AS (SELECT lp.l_orderkey, lp.l_linenumber,
   [sqrt((lp.f0 - cen.c0) * (lp.f0 - cen.c0) + (lp.f1 - cen.c1) * (lp.f1 - cen.c1)
        + (lp.f2 - cen.c2) * (lp.f2 - cen.c2)) FOR cen IN (SELECT list(cen ORDER BY cl) FROM cen)] AS ds
   FROM lp)
SELECT l_orderkey, l_linenumber, CAST(list_position(ds, list_min(ds)) - 1 AS BIGINT) AS pred,
  round(list_min(ds), 6) AS dist FROM dd""",

    "cluster_counts": f"""WITH {USER_MC}
SELECT CASE WHEN dn >= CAST(2.0 AS DOUBLE) THEN 'p' ELSE 'o' END AS kind, CAST(count(*) AS BIGINT) AS n
FROM m GROUP BY 1""",

    "mc_snapshot": f"""WITH {USER_MC},
x AS (SELECT *, greatest(l0, l1, l2, l3, l4) AS mx FROM m)
SELECT user_id, CASE WHEN dn >= CAST(2.0 AS DOUBLE) THEN 'primary' ELSE 'outlier' END AS type,
  round(CASE WHEN dn > 0 THEN d0 / dn ELSE d0 END, 6) AS c0,
  round(CASE WHEN dn > 0 THEN d1 / dn ELSE d1 END, 6) AS c1,
  round(dn, 6) AS weight,
  round(CASE WHEN dn > 1 THEN sqrt(greatest(abs(q0) / dn - abs(d0 * d0) / (dn * dn),
        abs(q1) / dn - abs(d1 * d1) / (dn * dn), 0.0)) ELSE CAST('inf' AS DOUBLE) END, 6) AS radius,
  CAST(mx AS BIGINT) AS correct_pts,
  CAST(CASE WHEN l0 = mx THEN 0 WHEN l1 = mx THEN 1 WHEN l2 = mx THEN 2 WHEN l3 = mx THEN 3 ELSE 4 END AS INTEGER)
    AS label,
  round(CAST(mx AS DOUBLE) / CAST(l0 + l1 + l2 + l3 + l4 AS DOUBLE), 6) AS purity,
  CAST(dpts AS BIGINT) AS pts
FROM x""",

    "macro_paper": f"""WITH RECURSIVE {USER_MC},
mc AS (SELECT user_id AS ord, dn AS weight, d0, d1, dpts AS pts, l0, l1, l2, l3, l4,
         CASE WHEN dn > 0 THEN d0 / dn ELSE d0 END AS x0, CASE WHEN dn > 0 THEN d1 / dn ELSE d1 END AS x1 FROM m),
core AS (SELECT * FROM mc WHERE weight >= CAST(1.5 AS DOUBLE)),
ce AS (SELECT a.ord AS src, b.ord AS dst FROM core a JOIN core b ON a.ord <> b.ord
       WHERE sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) < CAST(0.2 AS DOUBLE)),
reach(a, b) AS (SELECT ord, ord FROM core
                UNION SELECT r.a, ce.dst FROM reach r JOIN ce ON r.b = ce.src),
cc AS (SELECT a AS ord, min(b) AS comp FROM reach GROUP BY a),
bd AS (SELECT b.ord, c.ord AS core_ord,
         sqrt((b.x0 - c.x0) * (b.x0 - c.x0) + (b.x1 - c.x1) * (b.x1 - c.x1)) AS dist
       FROM mc b JOIN core c ON b.weight < CAST(1.5 AS DOUBLE)),
bn AS (SELECT ord, core_ord FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY dist, core_ord) AS rn
       FROM bd WHERE dist < CAST(0.2 AS DOUBLE)) x WHERE rn = 1),
mem AS (SELECT ord, comp FROM cc UNION ALL SELECT bn.ord, cc.comp FROM bn JOIN cc ON bn.core_ord = cc.ord),
agg AS (SELECT mem.comp, count(*) AS n, sum(mc.weight) AS w, sum(mc.d0) AS s0, sum(mc.d1) AS s1,
          sum(mc.pts) AS pts, sum(mc.l0) AS l0, sum(mc.l1) AS l1, sum(mc.l2) AS l2, sum(mc.l3) AS l3,
          sum(mc.l4) AS l4 FROM mem JOIN mc ON mem.ord = mc.ord GROUP BY mem.comp),
x AS (SELECT *, greatest(l0, l1, l2, l3, l4) AS mx FROM agg)
SELECT CAST(comp AS BIGINT) AS macro_id, CAST(n AS BIGINT) AS n_members, round(w, 6) AS weight,
  round(CASE WHEN w > 0 THEN s0 / w ELSE s0 END, 6) AS c0, round(CASE WHEN w > 0 THEN s1 / w ELSE s1 END, 6) AS c1,
  CAST(pts AS BIGINT) AS pts, CAST(mx AS BIGINT) AS correct_pts,
  CAST(CASE WHEN l0 = mx THEN 0 WHEN l1 = mx THEN 1 WHEN l2 = mx THEN 2 WHEN l3 = mx THEN 3 ELSE 4 END AS INTEGER)
    AS label,
  round(CAST(mx AS DOUBLE) / CAST(l0 + l1 + l2 + l3 + l4 AS DOUBLE), 6) AS purity
FROM x""",

    "macro_reference": f"""WITH RECURSIVE {USER_MC},
mc AS (SELECT user_id AS ord, dn AS weight, d0, d1, dpts AS pts, l0, l1, l2, l3, l4,
         CASE WHEN dn > 0 THEN d0 / dn ELSE d0 END AS x0, CASE WHEN dn > 0 THEN d1 / dn ELSE d1 END AS x1 FROM m),
link AS (SELECT a.ord AS src, b.ord AS dst FROM mc a JOIN mc b ON a.ord <> b.ord
       AND sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) < CAST(0.2 AS DOUBLE)),
-- what a heavy cluster reaches among those from it on
reach(a, b) AS (SELECT ord, ord FROM mc WHERE weight >= CAST(1.5 AS DOUBLE)
                UNION SELECT r.a, link.dst FROM reach r JOIN link ON r.b = link.src AND link.dst >= r.a),
seed AS (SELECT a FROM reach WHERE a NOT IN (SELECT b FROM reach WHERE a < b) GROUP BY a HAVING count(*) > 1),
mem AS (SELECT reach.a AS comp, b AS ord FROM reach JOIN seed ON reach.a = seed.a),
agg AS (SELECT mem.comp, count(*) AS n, sum(CASE WHEN mem.ord = mem.comp THEN mc.weight ELSE 2 * mc.weight END) AS w,
          sum(mc.d0) AS s0, sum(mc.d1) AS s1,
          sum(mc.pts) AS pts, sum(mc.l0) AS l0, sum(mc.l1) AS l1, sum(mc.l2) AS l2, sum(mc.l3) AS l3,
          sum(mc.l4) AS l4 FROM mem JOIN mc ON mem.ord = mc.ord GROUP BY mem.comp),
x AS (SELECT *, greatest(l0, l1, l2, l3, l4) AS mx FROM agg)
SELECT CAST(comp AS BIGINT) AS seed_ord, CAST(n AS BIGINT) AS n_members, round(w, 6) AS weight,
  round(CASE WHEN w > 0 THEN s0 / w ELSE s0 END, 6) AS c0, round(CASE WHEN w > 0 THEN s1 / w ELSE s1 END, 6) AS c1,
  CAST(pts AS BIGINT) AS pts, CAST(mx AS BIGINT) AS correct_pts,
  CAST(CASE WHEN l0 = mx THEN 0 WHEN l1 = mx THEN 1 WHEN l2 = mx THEN 2 WHEN l3 = mx THEN 3 ELSE 4 END AS INTEGER)
    AS label,
  round(CAST(mx AS DOUBLE) / CAST(l0 + l1 + l2 + l3 + l4 AS DOUBLE), 6) AS purity
FROM x""",
}
