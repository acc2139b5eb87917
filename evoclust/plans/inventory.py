"""Further registered queries, one for each operator that no query of the
catalogue runs, with their DuckDB SQL.  Points and rounding as there."""

from __future__ import annotations

from pyspark.sql import functions as F

from evoclust.functions import cf
from evoclust.operators import metrics as M
from evoclust.operators import prep
from evoclust.operators import state as st
from evoclust.operators.delta import batch_count, decayed_delta
from evoclust.plans import catalog as C
from evoclust.plans import oracle as O
from evoclust.session import cut, scratch_path, ship_package
from evoclust.sources import points as S

_r, _t = C._r, C._t

#: a fixed map of names to ids; it leaves one event type out
EVENT_IDS = {"view": 0, "click": 1, "purchase": 2, "signup": 3}


def q_csv_points(spark, sf):
    """The line items as a data file without header, read again."""
    pts = C.lineitem_points(spark, sf)
    path = scratch_path(spark, "dataset-csv")
    S.write_dataset_csv(pts.select(*[F.col("features")[k].alias(f"f{k}") for k in range(3)], "label"), path,
                        ["f0", "f1", "f2"])
    back = S.read_points_csv(spark, path, 3, index=False)
    return back.select(*[_r(F.col("features")[k], f"f{k}") for k in range(3)], "label")


def q_csv_header(spark, sf):
    """The events as a data file with header and a text label."""
    ev = C.events_points(spark, sf)
    path = scratch_path(spark, "header-csv")
    ev.select(F.col("features")[0].alias("hour"), "event_type", F.col("features")[1].alias("value")).write.option(
        "header", True).csv(path)
    back = S.read_points_csv(spark, path, 2, header=True, label_col="event_type", index=False)
    return back.select(*[_r(F.col("features")[k], f"f{k}") for k in range(2)], "label")


def q_csv_order(spark, sf):
    """The events as several data files, read in splits; ``seq`` is the
    place in file order."""
    ev = C.events_points(spark, sf)
    path = scratch_path(spark, "order-csv")
    parts = ev.select("event_id", *[F.col("features")[k].alias(f"f{k}") for k in range(2)], "label").repartitionByRange(
        5, "event_id").sortWithinPartitions("event_id").drop("event_id")
    parts.write.csv(path)
    back = S.read_points_csv(spark, path, 2)
    return back.select("seq", *[_r(F.col("features")[k], f"f{k}") for k in range(2)], "label")


def q_replay_total(spark, sf):
    """The embeddings replayed twice and a bit, seven a time unit."""
    idx = S.with_row_index(_t(spark, sf, "embeddings").select("vec_id"), ["vec_id"], "seq")
    return S.with_logical_time(idx, 7, total=2 * idx.count() + 5).select("vec_id", "seq", "time")


def q_row_time(spark, sf):
    """One embedding a time step."""
    idx = S.with_row_index(_t(spark, sf, "embeddings").select("vec_id"), ["vec_id"], "seq")
    return S.with_row_time(idx).select("vec_id", "time")


def q_map_labels(spark, sf):
    """Event types by a fixed map; a reject has no label."""
    ok, rejects = prep.map_labels(_t(spark, sf, "events").select("event_id", "event_type"), "event_type", EVENT_IDS)
    return ok.select("event_id", "event_type", "label").unionByName(
        rejects.select("event_id", "event_type", F.lit(None).cast("int").alias("label")))


def q_clean_label(spark, sf):
    """Quoted names with a closing dot, as the raw label files have them."""
    raw = F.concat(F.lit("b'"), F.col("event_type"), F.lit(".'"))
    return _t(spark, sf, "events").select("event_id", prep.clean_label(raw).alias("name"))


def q_describe(spark, sf):
    """Summary statistics (without the approximate quartiles)."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    got = prep.describe(_t(spark, sf, "lineitem"), cols).filter(F.col("summary").isin(
        "count", "mean", "stddev", "min", "max"))
    return got.select("summary", *[_r(F.col(c).cast("double"), c) for c in cols])


def q_standardised(spark, sf):
    """The deviations of the z-scored columns, after the check."""
    cols = C._LI_Z
    z = prep.z_score(_t(spark, sf, "lineitem").select(*cols), cols)
    prep.assert_standardised(z, cols)
    return z.agg(*[_r(F.stddev_samp(c), c) for c in cols])


def q_distinct_labels(spark, sf):
    """A9."""
    return prep.distinct_labels(_t(spark, sf, "events"), "event_type")


def q_shuffled(spark, sf):
    """The position of every event in a seeded random order."""
    ev = _t(spark, sf, "events").select("event_id")
    return S.with_row_index(ev, prep.shuffle_order(42, "event_id"), "position").select("event_id", "position")


def q_assign_points(spark, sf):
    """The second half of the events against the clusters of
    the first half, assigned and unassigned."""
    from evoclust.operators.assign import assign_points, split_assigned
    ship_package(spark)
    ev, state, n_p, n_o, _ = C.half_state(spark, sf)
    pts = S.select_point(ev.filter(F.col("time") >= C.SPLIT_HOUR))
    took, rest = split_assigned(assign_points(pts, state, C.UPDATE_PARAMS, {"p": n_p, "o": n_o}))
    return took.select(F.col("seq").alias("event_id"), "kind", "ord").unionByName(rest.select(
        F.col("seq").alias("event_id"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("long").alias("ord")))


MACRO_WEIGHT = 30.0  # fixed value: core weight of the macro map below


def q_predict_macro(spark, sf):
    """J6 with the macro map: the second half of the events, each with its
    nearest p-MC of the first half and that one's macro-cluster."""
    from evoclust.operators.assign import predict_macro
    from evoclust.operators.macro import macro_members
    ship_package(spark)
    ev, state, *_ = C.half_state(spark, sf)
    p = C.UPDATE_PARAMS
    mcs = cut(st.micro_clusters(state).select("*", cf.centroid("cf1", "weight").alias("centroid"),
                                              (F.col("weight") >= MACRO_WEIGHT).alias("core")), "macro-mcs")
    members = cut(macro_members(mcs, p.epsilon, 2), "macro-map")
    out = predict_macro(ev.filter(F.col("time") >= C.SPLIT_HOUR).select("event_id", "features"), mcs, members, p)
    return out.select("event_id", "ord", _r(F.col("dist"), "dist"), "macro_id")


def q_primary_clusters(spark, sf):
    """The p-MCs among the clusters of all users."""
    return st.micro_clusters(C._user_state(spark, sf)).select("user_id", _r(F.col("weight"), "weight"), "pts")


def q_init_counts(spark, sf):
    """Events, density clusters, and events that none of them took."""
    from evoclust.operators.density import density_labels
    ev = C.events_points(spark, sf).select("event_id", "features")
    p = C.STREAM_PARAMS
    found = cut(density_labels(ev, p.init_epsilon, 2, p.mu, id_col="event_id"), "density-labels")
    untagged = M.untagged_points(ev, found.withColumnRenamed("id", "event_id"), "event_id")
    return found.agg(F.countDistinct("comp").alias("seeds"), F.count_if("core").alias("cores")).select(
        "seeds", "cores", F.lit(untagged).cast("long").alias("untagged"))


def q_insert_point(spark, sf):
    """F8: every event inserted into the cluster of its type at the end."""
    ev = C.events_points(spark, sf)
    mcs = decayed_delta(ev, C.LAM, 2, C.EV_TYPES, keys=("label",))
    clock = ev.agg(F.max("time")).collect()[0][0]
    got = ev.join(mcs, "label").select("event_id", cf.insert_point(
        "dcf1", "dcf2", "dn", "tmax", "dpts", "lbl_counts", "features", F.lit(clock), "label", C.LAM).alias("m"))
    return got.select("event_id", _r(F.col("m.weight"), "weight"), _r(F.col("m.cf1")[0], "c0"),
                      _r(F.col("m.cf1")[1], "c1"), _r(F.col("m.cf2")[0], "q0"), _r(F.col("m.cf2")[1], "q1"),
                      F.col("m.last_edit").alias("last_edit"), F.col("m.pts").alias("pts"),
                      *[F.col("m.lbl_counts")[k].alias(f"l{k}") for k in range(C.EV_TYPES)])


def q_merge_clusters(spark, sf):
    """every user's clusters of the two halves merged; a user of one
    half keeps that half's."""
    ev = C.events_points(spark, sf)
    halves = [decayed_delta(ev.filter(c), 0.0, 2, C.EV_TYPES, keys=("user_id",)).select(
        "user_id", *[F.col(n).alias(n + x) for n in ("dcf1", "dcf2", "dn")])
        for x, c in (("_a", F.col("time") < C.SPLIT_HOUR), ("_b", F.col("time") >= C.SPLIT_HOUR))]
    none = F.array(F.lit(0.0), F.lit(0.0))
    j = halves[0].join(halves[1], "user_id", "full").select("user_id", *[F.coalesce(n + x, F.lit(0.0) if n == "dn" else none).alias(n + x)
                                                                         for n in ("dcf1", "dcf2", "dn") for x in ("_a", "_b")])
    s1, s2 = cf.merge_cf("dcf1_a", "dcf1_b"), cf.merge_cf("dcf2_a", "dcf2_b")
    return j.select("user_id", _r(s1[0], "c0"), _r(s1[1], "c1"), _r(s2[0], "q0"), _r(s2[1], "q1"),
                    _r(cf.add_weight("dn_a", "dn_b"), "weight"))


def q_result_tables(spark, sf):
    """The clusters of all users written as a batch's
    result tables, and read again."""
    from evoclust.sources.results import ResultWriter, read_results
    root = scratch_path(spark, "results")
    n = batch_count(_t(spark, sf, "events"))
    s = C._user_state(spark, sf).withColumn("ord", F.col("user_id")).withColumn("mc_id", F.lit(""))
    ResultWriter(spark, root).write_batch(s, 0, n, C.STREAM_PARAMS)
    got = read_results(spark, root)
    sizes = got["micro_clusters"].groupBy("type").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return (sizes.select(F.lit("micro_clusters").alias("table"), F.col("type").alias("name"), "value")
            .unionByName(got["micro_metrics"].select(F.lit("micro_metrics").alias("table"), "name",
                                                     _r(F.col("value"), "value"))))


def q_run_details(spark, sf):
    """The parameters of a run over the events."""
    from evoclust.sources.results import run_details
    n = batch_count(_t(spark, sf, "events"))
    return run_details(spark, C.STREAM_PARAMS, dataset="events", data_amount=n).select(
        "dataset", "data_amount", "num_labels", "num_features", F.col("lambda").alias("lam"), "epsilon", "mu")


QUERIES = {f.__name__[2:]: f for f in (
    q_csv_points, q_csv_header, q_csv_order, q_replay_total, q_row_time, q_map_labels, q_clean_label, q_describe, q_standardised,
    q_distinct_labels, q_shuffled, q_assign_points, q_predict_macro, q_primary_clusters, q_init_counts, q_insert_point,
    q_merge_clusters, q_result_tables, q_run_details)}


def _describe_sql() -> str:
    cols = ("l_quantity", "l_discount", "l_tax")
    stats = {"count": "count({c})", "mean": "avg({c})", "stddev": "stddev_samp({c})", "min": "min({c})",
             "max": "max({c})"}
    return " UNION ALL ".join(
        f"SELECT '{k}' AS summary, " + ", ".join(f"round(CAST({v.format(c=c)} AS DOUBLE), 6) AS {c}" for c in cols)
        + " FROM lineitem" for k, v in stats.items())


_STD = "{c} AS (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)"

SQL = {
    "csv_points": f"""WITH {O.LT}
SELECT round(l.l_quantity / CAST(50.0 AS DOUBLE), 6) AS f0, round(l.l_discount * CAST(10.0 AS DOUBLE), 6) AS f1,
  round(l.l_tax * CAST(10.0 AS DOUBLE), 6) AS f2, lt.label FROM lineitem l JOIN lt ON l.l_returnflag = lt.l_returnflag""",
    "csv_header": f"WITH {O.EVP} SELECT round(f0, 6) AS f0, round(f1, 6) AS f1, event_type AS label FROM evp",
    "csv_order": f"""WITH {O.EVP}
SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS seq, round(f0, 6) AS f0, round(f1, 6) AS f1, label FROM evp""",
    "replay_total": """WITH n AS (SELECT count(*) AS n, (2 * count(*) + 5) // 7 * 7 AS sent FROM embeddings),
i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings),
c AS (SELECT vec_id, k + n * cycle AS seq, sent FROM i, n, range(0, 100) AS t(cycle) WHERE k + n * cycle < sent)
SELECT vec_id, CAST(seq AS BIGINT) AS seq, CAST(seq // 7 AS BIGINT) AS time FROM c""",
    "row_time": "SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) AS BIGINT) AS time FROM embeddings",
    "map_labels": "SELECT event_id, event_type, CAST(CASE event_type " + " ".join(
        f"WHEN '{k}' THEN {v}" for k, v in EVENT_IDS.items()) + " END AS INTEGER) AS label FROM events",
    "clean_label": "SELECT event_id, event_type AS name FROM events",
    "describe": _describe_sql(),
    "standardised": "WITH " + ", ".join(_STD.format(c=c).replace(c + " AS", "s_" + c + " AS", 1) for c in C._LI_Z)
    + " SELECT " + ", ".join(f"round(stddev_samp((l.{c} - s_{c}.m) / s_{c}.s), 6) AS {c}" for c in C._LI_Z)
    + " FROM lineitem l, " + ", ".join("s_" + c for c in C._LI_Z),
    "distinct_labels": "SELECT DISTINCT event_type FROM events",
    "shuffled": """SELECT event_id, CAST(row_number() OVER (ORDER BY md5('42:' || CAST(event_id AS VARCHAR)), event_id) - 1
  AS BIGINT) AS position FROM events""",
    "assign_points": f"""{O.ASSIGNED}
SELECT event_id, kind, CAST(ord AS BIGINT) AS ord FROM a""",
    "predict_macro": f"""{O.ASSIGNED.replace('WITH', 'WITH RECURSIVE', 1)},
mc AS (SELECT ord, w, c0 / w AS x0, c1 / w AS x1, w >= 30 AS core FROM s WHERE kind = 'p'),
link AS (SELECT * FROM (SELECT a.ord AS src, b.ord AS dst, a.core AS src_core, b.core AS dst_core,
    sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)) AS dist FROM mc a JOIN mc b ON a.ord <> b.ord) z
  WHERE dist < CAST(0.42 AS DOUBLE)),
reach(o, r) AS (SELECT ord, ord FROM mc WHERE core
  UNION SELECT reach.o, link.dst FROM reach JOIN link ON reach.r = link.src AND src_core AND dst_core),
cc AS (SELECT o AS ord, min(r) AS comp FROM reach GROUP BY o),
bd AS (SELECT src AS ord, arg_min(dst, {{'d': dist, 'o': dst}}) AS core_ord FROM link WHERE NOT src_core AND dst_core
       GROUP BY src),
mem AS (SELECT ord, comp FROM cc UNION ALL SELECT bd.ord, cc.comp FROM bd JOIN cc ON bd.core_ord = cc.ord)
SELECT e2.event_id, CAST(c.ord AS BIGINT) AS ord, round(c.dist, 6) AS dist, CAST(mem.comp AS BIGINT) AS macro_id
FROM e2 LEFT JOIN near c ON e2.event_id = c.event_id AND c.kind = 'p' LEFT JOIN mem ON c.ord = mem.ord""",
    "primary_clusters": f"""WITH {O.USER_MC}
SELECT user_id, round(dn, 6) AS weight, CAST(dpts AS BIGINT) AS pts FROM m WHERE dn >= CAST(2.0 AS DOUBLE)""",
    "init_counts": f"""{O.DENSITY}
SELECT CAST(count(DISTINCT comp) AS BIGINT) AS seeds, CAST((SELECT count(*) FROM core) AS BIGINT) AS cores,
  CAST((SELECT count(*) FROM evp) - count(*) AS BIGINT) AS untagged FROM mem""",
    "insert_point": f"""WITH {O.EVP},
mt AS (SELECT label, max(time) AS tmax FROM evp GROUP BY label),
mc AS (SELECT p.label, mt.tmax, sum(pow(2.0, -0.25 * (mt.tmax - p.time))) AS w,
   sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f0) AS c0, sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f1) AS c1,
   sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f0 * p.f0) AS q0,
   sum(pow(2.0, -0.25 * (mt.tmax - p.time)) * p.f1 * p.f1) AS q1, count(*) AS n
   FROM evp p JOIN mt ON p.label = mt.label GROUP BY p.label, mt.tmax),
clk AS (SELECT max(time) AS clock FROM evp),
f AS (SELECT mc.*, clock, pow(2.0, -0.25 * (clock - tmax)) AS g FROM mc CROSS JOIN clk)
SELECT p.event_id, round(w * g + 1, 6) AS weight, round(c0 * g + f0, 6) AS c0, round(c1 * g + f1, 6) AS c1,
  round(q0 * g + f0 * f0, 6) AS q0, round(q1 * g + f1 * f1, 6) AS q1, CAST(clock AS BIGINT) AS last_edit,
  CAST(n + 1 AS BIGINT) AS pts, {', '.join(f"CAST(CASE WHEN p.label = {k} THEN n + 1 ELSE 0 END AS BIGINT) AS l{k}" for k in range(C.EV_TYPES))}
FROM evp p JOIN f ON p.label = f.label""",
    "merge_clusters": f"""WITH {O.EVP}
SELECT user_id, round(sum(f0), 6) AS c0, round(sum(f1), 6) AS c1, round(sum(f0 * f0), 6) AS q0,
  round(sum(f1 * f1), 6) AS q1, CAST(count(*) AS DOUBLE) AS weight
FROM evp GROUP BY user_id""",
    "result_tables": f"""WITH {O.USER_MC}
SELECT 'micro_clusters' AS "table", CASE WHEN dn >= CAST(2.0 AS DOUBLE) THEN 'primary' ELSE 'outlier' END AS name,
  CAST(count(*) AS DOUBLE) AS value FROM m GROUP BY 2
UNION ALL
SELECT 'micro_metrics', 'PURITY(avg)', round(avg(greatest(l0, l1, l2, l3, l4) / CAST(dpts AS DOUBLE)), 6) FROM m
WHERE dn >= CAST(2.0 AS DOUBLE)""",
    "run_details": """SELECT 'events' AS dataset, CAST(count(*) AS BIGINT) AS data_amount, CAST(5 AS BIGINT) AS num_labels,
  CAST(2 AS BIGINT) AS num_features, CAST(0.25 AS DOUBLE) AS lam, CAST(0.2 AS DOUBLE) AS epsilon, CAST(10 AS DOUBLE) AS mu
FROM events""",
}
