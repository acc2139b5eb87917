"""Registered queries over the driver's tables, each with its SQL oracle.

Every query reads whole tables (or data Spark derives from them).  Points:

* events     -> time = hours since the first event, features =
               (hour of day / 6, value / 50), label = event type id
               (alphabetical), seq = event_id;
* embeddings -> 64 features (float -> double), label, seq = vec_id;
* lineitem   -> features (quantity / 50, discount * 10, tax * 10), label =
               return flag id (alphabetical).

Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoclust.functions import cf
from evoclust.operators import metrics as M
from evoclust.operators import prep
from evoclust.operators import state as st
from evoclust.operators.assign import predict
from evoclust.operators.delta import decayed_delta
from evoclust.operators.graph import eps_edges
from evoclust.params import ClusterParams
from evoclust.session import cut, ship_package
from evoclust.sources import points as S

R = 6  # rounding of doubles in results
LAM = 0.25
EV_TYPES = 5  # event kinds in the events table
EMB_LABELS = 10
EMB_DIMS = 64


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def round_half_away(c, digits: int = R):
    """``round(c * 10^digits) / 10^digits`` with halves away from zero, as
    plain double arithmetic (stays in generated code; Spark's ``round`` on
    doubles goes through BigDecimal per row).  Infinity and NaN pass."""
    m = float(10 ** digits)
    v = c * F.lit(m)
    a = F.abs(v)
    fl = F.floor(a).cast("double")
    r = F.when(a - fl >= F.lit(0.5), fl + F.lit(1.0)).otherwise(fl)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))) | (a >= F.lit(2.0 ** 52)), c) \
        .otherwise(F.when(v < 0, -r).otherwise(r) / F.lit(m))


def _r(c, name):
    return round_half_away(c).alias(name)


# ------------------------------------------------------------ point views

def events_clock(spark: SparkSession, sf: str) -> tuple[int, int]:
    """First and last event second (one scalar aggregate)."""
    sec = F.unix_timestamp("ts")
    r = _t(spark, sf, "events").agg(F.min(sec), F.max(sec)).collect()[0]
    return int(r[0]), int(r[1])


def _ntz(seconds: int):
    """A TIMESTAMP_NTZ literal for epoch seconds (time-zone free)."""
    import datetime
    t = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=int(seconds))
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def events_points(spark: SparkSession, sf: str, s0: int | None = None, hours: tuple | None = None,
                  labels: DataFrame | None = None, ev: DataFrame | None = None) -> DataFrame:
    """Events (the whole table, or the stream ``ev`` over it) as points.  ``hours=(a, b)`` keeps ``a <= time < b`` through a
    filter on the raw ``ts`` column (pushed to the Parquet scan); ``s0`` and
    ``labels`` (the type map) then come from the whole table."""
    ev = _t(spark, sf, "events") if ev is None else ev
    sec = F.unix_timestamp("ts")
    if s0 is None:
        s0 = ev.agg(F.min(sec)).collect()[0][0]
    if hours is not None:
        # time = floor((sec - s0) / 3600) with integer seconds, so the hour
        # range is exactly this range of timestamps
        ev = ev.filter((F.col("ts") >= _ntz(s0 + hours[0] * 3600)) & (F.col("ts") < _ntz(s0 + hours[1] * 3600)))
    if labels is None:
        ev = prep.encode_labels(ev, "event_type", order="alpha")
    else:
        # one row per event type; broadcast only within the label-map bound
        small = labels.count() <= prep.MAX_LABELS
        ev = ev.join(F.broadcast(labels) if small else labels, "event_type")
    return ev.select(
        "event_id", "user_id", "event_type",
        F.floor((sec - F.lit(s0)) / F.lit(3600)).cast("long").alias("time"),
        F.array((F.hour("ts") / F.lit(6.0)), (F.col("value") / F.lit(50.0))).alias("features"),
        F.col("label").cast("int").alias("label"),
        F.col("event_id").alias("seq"),
    )


def embedding_points(spark: SparkSession, sf: str) -> DataFrame:
    emb = _t(spark, sf, "embeddings")
    return emb.select("vec_id", F.col("embedding").cast("array<double>").alias("features"),
                      F.col("label").cast("int").alias("label"), F.lit(0).cast("long").alias("time"),
                      F.col("vec_id").alias("seq"))


def lineitem_points(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    li = prep.encode_labels(li, "l_returnflag", order="alpha")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.array(F.col("l_quantity") / F.lit(50.0), F.col("l_discount") * F.lit(10.0),
                F.col("l_tax") * F.lit(10.0)).alias("features"),
        F.col("label").cast("int").alias("label"), F.lit(0).cast("long").alias("time"))


def label_clusters(points: DataFrame, num_dims: int, num_labels: int) -> DataFrame:
    """One cluster per true label: cf1/cf2 sums, weight = count (no decay)."""
    d = decayed_delta(points, 0.0, num_dims, num_labels, keys=("label",))
    return d.select(F.col("label").cast("long").alias("ord"), F.col("dcf1").alias("cf1"),
                    F.col("dcf2").alias("cf2"), F.col("dn").alias("weight"),
                    F.col("tmax").alias("last_edit"))


def _user_mcs(spark, sf, pts=None):
    """Micro-clusters per user over all events (lam 0.25)."""
    pts = pts if pts is not None else events_points(spark, sf)
    return decayed_delta(pts, LAM, 2, EV_TYPES, keys=("user_id",)).withColumnRenamed("tmin", "t0")


# ----------------------------------------------------------------- queries

def q_decode_points(spark, sf):
    ev = events_points(spark, sf)
    enc = S.encode_points(ev.select("event_id", "time", "features", "label"))
    dec = S.decode_points(enc.select("event_id", "value"), 2, seq_col="event_id")
    return dec.select(F.col("seq").alias("event_id"), "time", _r(F.col("features")[0], "f0"),
                      _r(F.col("features")[1], "f1"), "label")


def q_decode_csv_columns(spark, sf):
    li = _t(spark, sf, "lineitem")
    enc = li.select("l_orderkey", "l_linenumber",
                    F.concat_ws(",", *[F.col(c).cast("string") for c in
                                       ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]).alias("value"))
    dec = S.decode_csv_columns(enc, "q DOUBLE, p DOUBLE, d DOUBLE, t DOUBLE",
                               keep=["l_orderkey", "l_linenumber"])
    return dec.select("l_orderkey", "l_linenumber", *[_r(F.col(c), c) for c in ("q", "p", "d", "t")])


def q_logical_time(spark, sf):
    emb = _t(spark, sf, "embeddings").select("vec_id")
    idx = S.with_row_index(emb, ["vec_id"], "seq")
    return S.with_logical_time(idx, 10).select("vec_id", "seq", "time")


_LI_Z = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_z_score(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_LI_Z)
    z = prep.z_score(li, _LI_Z)
    return z.select("l_orderkey", "l_linenumber", *[_r(F.col(c), c) for c in _LI_Z])


def q_drop_null_columns(spark, sf):
    li = _t(spark, sf, "lineitem")
    li = prep.drop_columns(li, ["l_returnflag", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey"],
                           feature_cols=["l_quantity", "l_discount", "l_tax"])
    li = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                   F.lit(1.0).alias("l_const"))
    cols = ["l_quantity", "l_discount", "l_tax", "l_const"]
    z = prep.drop_null_columns(prep.z_score(li, cols), cols)
    keep = [c for c in cols if c in z.columns]
    return z.select("l_orderkey", "l_linenumber", *[_r(F.col(c), c) for c in keep])


def q_encode_labels(spark, sf):
    ev = _t(spark, sf, "events").select("event_id", "event_type")
    return prep.encode_labels(ev, "event_type", order="first", order_col="event_id") \
        .select("event_id", "event_type", "label")


_ANISO = [[0.6, -0.6], [-0.4, 0.8]]  # fixed value: transformation of the anisotropic dataset


def q_linear_transform(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    t = prep.linear_transform(li, ["l_quantity", "l_discount"], _ANISO, ["a", "b"])
    return t.select("l_orderkey", "l_linenumber", _r(F.col("a"), "a"), _r(F.col("b"), "b"))


def q_merge_datasets(spark, sf):
    li = lineitem_points(spark, sf).select(
        F.lit("lineitem").alias("source"), F.col("l_orderkey").alias("id1"),
        F.col("l_linenumber").cast("long").alias("id2"),
        _r(F.col("features")[0], "f0"), _r(F.col("features")[1], "f1"), "label")
    ev = events_points(spark, sf).select(
        F.lit("events").alias("source"), F.col("event_id").alias("id1"), F.lit(0).cast("long").alias("id2"),
        _r(F.col("features")[0], "f0"), _r(F.col("features")[1], "f1"), "label")
    return prep.merge_datasets([li, ev], [0, 3])


def q_stratified_sample(spark, sf):
    emb = _t(spark, sf, "embeddings").select("vec_id", "label")
    return prep.stratified_sample(emb, "label", 20, 42, "vec_id")


def q_sample_n(spark, sf):
    emb = _t(spark, sf, "embeddings").select("vec_id", "label")
    return prep.sample_n(emb, 100, 42, "vec_id")


def _nearest(spark, sf):
    ship_package(spark)
    pts = embedding_points(spark, sf)
    cl = label_clusters(pts, EMB_DIMS, EMB_LABELS)
    p = ClusterParams(num_dims=EMB_DIMS, num_labels=EMB_LABELS)
    return predict(pts, cl, p)


def q_nearest_cluster(spark, sf):
    return _nearest(spark, sf).select("vec_id", F.col("ord").alias("cluster"), _r(F.col("dist"), "dist"))


def _purity_table(spark, sf):
    nc = _nearest(spark, sf)
    from evoclust.operators.delta import label_histogram
    h = nc.groupBy(F.col("ord").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), label_histogram(F.col("label"), EMB_LABELS).alias("lbl_counts"))
    return M.with_purity(h)


def q_cluster_purity(spark, sf):
    t = _purity_table(spark, sf)
    return t.select("cluster", "n", F.col("correct_pts").cast("long").alias("correct_pts"),
                    "dominant", _r(F.col("purity"), "purity"))


def q_avg_purity(spark, sf):
    t = _purity_table(spark, sf)
    a = M.avg_purity(t)
    return a.select(_r(F.col("avg_purity"), "avg_purity"), "n_clusters")


def q_eps_pairs(spark, sf):
    ev = events_points(spark, sf)
    e = eps_edges(ev, 0.2, 2, id_col="event_id")
    return e.select("src", "dst", _r(F.col("dist"), "dist"))


def q_components(spark, sf):
    """The components of all events that have another within 0.05."""
    from evoclust.operators.density import density_labels
    return density_labels(events_points(spark, sf), 0.05, 2, id_col="event_id").select(
        F.col("id").alias("event_id"), "comp")


def q_admissible_points(spark, sf):
    ev = events_points(spark, sf)
    mcs = decayed_delta(ev, LAM, 2, EV_TYPES, keys=("label",))
    clock = ev.agg(F.max("time")).collect()[0][0]
    j = ev.join(mcs, "label")  # one row per event type; the runtime picks the join
    r = cf.radius_after_insert("dcf1", "dcf2", "dn", "tmax", "features", F.lit(clock), LAM)
    return j.select("event_id", _r(r, "radius"), (r <= F.lit(1.0)).alias("admissible"))


def q_decayed_delta(spark, sf):
    d = _user_mcs(spark, sf)
    return d.select("user_id", "tmax",
                    _r(F.col("dcf1")[0], "d0"), _r(F.col("dcf1")[1], "d1"),
                    _r(F.col("dcf2")[0], "q0"), _r(F.col("dcf2")[1], "q1"),
                    _r(F.col("dn"), "dn"), "dpts",
                    *[F.col("lbl_counts")[k].alias(f"l{k}") for k in range(EV_TYPES)])


SPLIT_HOUR = 360  # fixed value: the two slices of the 30-day events table


def q_apply_delta(spark, sf):
    """The fold of the second slice's deltas into the clusters of the first; a
    delta of a user first seen after ``SPLIT_HOUR`` is a cluster of its own."""
    ev = events_points(spark, sf).withColumn("kind", F.lit("p")).withColumn("ord", F.col("user_id"))
    first = decayed_delta(ev.filter(F.col("time") < SPLIT_HOUR), LAM, 2, EV_TYPES)
    state = st.conform(first.select(
        "kind", "ord", F.col("ord").cast("string").alias("mc_id"), F.col("dcf1").alias("cf1"),
        F.col("dcf2").alias("cf2"), F.col("dn").alias("weight"), F.lit(0).alias("t0"),
        F.col("tmax").alias("last_edit"), F.col("dpts").alias("pts"), "lbl_counts"))
    deltas = decayed_delta(ev.filter(F.col("time") >= SPLIT_HOUR), LAM, 2, EV_TYPES)
    out = st.apply_deltas(state, deltas, ClusterParams(num_dims=2, num_labels=EV_TYPES))
    late = deltas.join(state, ["kind", "ord"], "left_anti").select(
        "kind", "ord", F.col("dcf1").alias("cf1"), F.col("dn").alias("weight"), F.col("tmax").alias("last_edit"), F.col("dpts").alias("pts"))
    out = out.select(*late.columns).unionByName(late)
    return out.select(F.col("ord").alias("user_id"), _r(F.col("weight"), "weight"),
                      _r(F.col("cf1")[0], "c0"), _r(F.col("cf1")[1], "c1"), "last_edit", "pts")


def q_promote_prune(spark, sf):
    ev = events_points(spark, sf)
    clock = ev.agg(F.max("time")).collect()[0][0]
    m = _user_mcs(spark, sf, ev)
    wc = F.col("dn") * cf.decay(LAM, F.lit(clock) - F.col("tmax"))
    thr_ref = cf.prune_threshold(LAM, F.lit(clock), F.col("t0"), 4, False)
    thr_fix = cf.prune_threshold(LAM, F.lit(clock), F.col("t0"), 4, True)
    return m.select("user_id", _r(F.col("dn"), "weight"), cf.promotable("dn", 0.2, 10).alias("promotable"),
                    _r(wc, "weight_at_clock"), (wc >= F.lit(2.0)).alias("keep_p"),
                    _r(thr_ref, "thr_ref"), _r(thr_fix, "thr_fix"),
                    (wc >= thr_ref).alias("keep_o_ref"), (wc >= thr_fix).alias("keep_o_fix"))


def q_points_per_batch(spark, sf):
    ev = events_points(spark, sf).withColumn("batch_id", F.floor(F.col("time") / 24).cast("long"))
    return M.points_per_batch(ev, "batch_id")


def q_homogeneity(spark, sf):
    nc = _nearest(spark, sf)
    h = M.homogeneity_completeness(nc, "ord", "label")
    return h.select(*[_r(F.col(c), c) for c in ("homogeneity", "completeness", "v_measure")])


def q_predict(spark, sf):
    ship_package(spark)
    pts = lineitem_points(spark, sf)
    cl = label_clusters(pts, 3, 3)
    out = predict(pts, cl, ClusterParams(num_dims=3, num_labels=3))
    return out.select("l_orderkey", "l_linenumber", F.col("ord").alias("pred"), _r(F.col("dist"), "dist"))


def _user_state(spark, sf):
    m = _user_mcs(spark, sf)
    return m.select(
        F.when(cf.promotable("dn", 0.2, 10), F.lit("p")).otherwise(F.lit("o")).alias("kind"),
        "user_id", F.col("dcf1").alias("cf1"), F.col("dcf2").alias("cf2"), F.col("dn").alias("weight"),
        "t0", F.col("tmax").alias("last_edit"), F.col("dpts").alias("pts"), "lbl_counts")


def q_cluster_counts(spark, sf):
    return M.cluster_counts(_user_state(spark, sf))


def q_mc_snapshot(spark, sf):
    s = _user_state(spark, sf).withColumn("ord", F.col("user_id")).withColumn("mc_id", F.lit(""))
    snap = st.snapshot(s, 0, 0, ClusterParams(num_dims=2, num_labels=EV_TYPES))
    return snap.select(
        F.col("ord").alias("user_id"), "type",
        _r(F.col("centroid")[0], "c0"), _r(F.col("centroid")[1], "c1"),
        _r(F.col("weight"), "weight"), _r(F.col("radius"), "radius"),
        F.col("correct_pts").cast("long").alias("correct_pts"), "label", _r(F.col("purity"), "purity"), "pts")


MACRO_EPS = 0.1  # fixed value: offline epsilon of the user micro-clusters
MACRO_MU = 1.5


def q_macro_paper(spark, sf):
    from evoclust.operators.macro import macro_paper
    ship_package(spark)
    s = _user_state(spark, sf).select(F.lit("p").alias("kind"), F.col("user_id").alias("ord"),
                                      "cf1", "cf2", "weight", "pts", "lbl_counts")
    m = macro_paper(s, ClusterParams(num_dims=2, num_labels=EV_TYPES), mu=MACRO_MU, eps=MACRO_EPS)
    return m.select("macro_id", "n_members", _r(F.col("weight"), "weight"),
                    _r(F.col("centroid")[0], "c0"), _r(F.col("centroid")[1], "c1"), "pts",
                    F.col("correct_pts").cast("long").alias("correct_pts"), "label", _r(F.col("purity"), "purity"))


# --------------------------------------------- clustering runs (rows-only)

# online radius 0.2 for the events' feature scale; the offline phase keeps
# the original's fixed offline values (epsilon 0.4, mu 10)
STREAM_PARAMS = ClusterParams(num_dims=2, num_labels=EV_TYPES, lam=LAM, epsilon=0.2, init_epsilon=0.2,
                              mu=10, beta=0.2, offline_epsilon=0.4, offline_mu=10)
BATCH_HOURS = 72  # one micro-batch per three days of the whole table


def q_init_clusters(spark, sf):
    """C1 over every event: the density clusters, without point pairs."""
    from evoclust.operators.density import init_density
    state, _ = init_density(events_points(spark, sf), STREAM_PARAMS)
    return state.select("ord", _r(F.col("weight"), "weight"), _r(F.col("cf1")[0], "c0"), _r(F.col("cf1")[1], "c1"),
                        _r(F.col("cf2")[0], "q0"), _r(F.col("cf2")[1], "q1"), "pts",
                        *[F.col("lbl_counts")[k].alias(f"l{k}") for k in range(EV_TYPES)])


def q_admit_outliers(spark, sf):
    """C3 over every event as if no cluster had taken any."""
    from evoclust.operators.admit import admit_outliers
    out = admit_outliers(events_points(spark, sf), None, STREAM_PARAMS)
    return out.select("first_time", "first_seq", _r(F.col("weight"), "weight"), _r(F.col("cf1")[0], "c0"),
                      _r(F.col("cf1")[1], "c1"), _r(F.col("cf2")[0], "q0"), _r(F.col("cf2")[1], "q1"), "last_edit",
                      "pts", *[F.col("lbl_counts")[k].alias(f"l{k}") for k in range(EV_TYPES)])


def run_events_stream(spark, sf, params: ClusterParams = STREAM_PARAMS):
    """The whole online phase over the events table: init on all events of
    the first ``BATCH_HOURS``, then the others, one micro-batch per
    ``BATCH_HOURS``."""
    from evoclust.plans.model import ClusterModel
    s0, s1 = events_clock(spark, sf)
    labels = prep.label_map(_t(spark, sf, "events"), "event_type", order="alpha")
    labels = labels.cache()  # one row per event type
    model = ClusterModel(spark, params)
    model.initialize(events_points(spark, sf, s0, (0, BATCH_HOURS), labels))
    last = (s1 - s0) // 3600
    b = 0
    for start in range(BATCH_HOURS, int(last) + 1, BATCH_HOURS):
        # each micro-batch reads only its own time slice of the table
        batch = events_points(spark, sf, s0, (start, start + BATCH_HOURS), labels)
        model.process_batch(batch, b)
        b += 1
    labels.unpersist()
    return model


def q_run_stream(spark, sf):
    model = run_events_stream(spark, sf)
    return st.snapshot(model.state, model.meta.version, 0, model.params).select(
        "type", "ord", "mc_id", _r(F.col("weight"), "weight"), "pts", "label", _r(F.col("purity"), "purity"), _r(F.col("radius"), "radius"))


UPDATE_PARAMS = ClusterParams(num_dims=2, num_labels=EV_TYPES, lam=0.01, epsilon=0.21, mu=100, beta=0.2, tp=40,
                              prune_fix=True)


def _state_cols():
    return ["kind", "ord", _r(F.col("weight"), "weight"), _r(F.col("cf1")[0], "c0"), _r(F.col("cf1")[1], "c1"),
            _r(F.col("cf2")[0], "q0"), _r(F.col("cf2")[1], "q1"), "t0", "last_edit", "pts",
            *[F.col("lbl_counts")[k].alias(f"l{k}") for k in range(EV_TYPES)]]


def half_state(spark, sf):
    """The events, the clusters that their first half opens (p-MCs where the
    weight allows), the numbers of p- and o-MCs, and the clock."""
    from pyspark.sql import Window

    from evoclust.operators.admit import admit_outliers
    p = UPDATE_PARAMS
    ev = events_points(spark, sf)
    opened = admit_outliers(ev.filter(F.col("time") < SPLIT_HOUR), None, p)
    by_kind = Window.partitionBy("kind").orderBy("first_time", "first_seq")  # rows are clusters
    state = opened.withColumn("kind", F.when(cf.promotable("weight", p.beta, p.mu), "p").otherwise("o")).select(
        "*", (F.row_number().over(by_kind) - 1).cast("long").alias("ord"))
    state = cut(st.conform(state.withColumn("mc_id", F.concat_ws("-", "kind", "ord"))), "update-state")
    n_p, n_o, clock = state.agg(F.count_if(F.col("kind") == "p"), F.count_if(F.col("kind") == "o"),
                                F.max("last_edit")).first()
    return ev, state, n_p, n_o, int(clock or 0)


def q_update_batch(spark, sf):
    """The clusters that the first half of the events opens, then the
    second half as one batch: assignment, deltas, admission, promotion, and
    a pruning."""
    from evoclust.plans.model import ClusterModel
    p = UPDATE_PARAMS
    ev, state, n_p, n_o, clock = half_state(spark, sf)
    model = ClusterModel(spark, p)
    model.set_state(state, st.ModelMeta(version=0, clock=clock, period=p.prune_every, max_p_ord=n_p - 1,
                                        max_o_ord=n_o - 1, n_p=n_p, n_o=n_o))
    model.process_batch(ev.filter(F.col("time") >= SPLIT_HOUR), 1)
    return model.state.select(*_state_cols())


def q_stream_events(spark, sf):
    """A Structured Streaming run over the events table from an
    empty model, every micro-batch folded by ``process_batch``."""
    from evoclust.plans.model import ClusterModel
    from evoclust.streaming.stream import run_stream as start
    path = os.path.join(sf, "events.parquet")
    s0, _ = events_clock(spark, sf)
    labels = cut(prep.label_map(_t(spark, sf, "events"), "event_type", order="alpha"), "labels")
    # a stream reads folders or patterns, and the table may be one file
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(os.path.join(sf, "events*.parquet"))
    model = ClusterModel(spark, STREAM_PARAMS)
    start(events_points(spark, sf, s0, labels=labels, ev=raw), model, available_now=True)
    return model.state.select(*_state_cols())


def q_macro_reference(spark, sf):
    """C6 in list order over the micro-clusters of all users."""
    from evoclust.operators.macro import macro_clusters
    s = _user_state(spark, sf).select(F.lit("p").alias("kind"), F.col("user_id").alias("ord"),
                                      "cf1", "cf2", "weight", "pts", "lbl_counts")
    m = macro_clusters(s, ClusterParams(num_dims=2, num_labels=EV_TYPES), mu=MACRO_MU, eps=MACRO_EPS)
    return m.select("seed_ord", "n_members", _r(F.col("weight"), "weight"), _r(F.col("centroid")[0], "c0"),
                    _r(F.col("centroid")[1], "c1"), "pts", F.col("correct_pts").cast("long").alias("correct_pts"),
                    "label", _r(F.col("purity"), "purity"))


QUERIES = {
    "decode_points": q_decode_points,
    "decode_csv_columns": q_decode_csv_columns,
    "logical_time": q_logical_time,
    "z_score": q_z_score,
    "drop_null_columns": q_drop_null_columns,
    "encode_labels": q_encode_labels,
    "linear_transform": q_linear_transform,
    "merge_datasets": q_merge_datasets,
    "stratified_sample": q_stratified_sample,
    "sample_n": q_sample_n,
    "nearest_cluster": q_nearest_cluster,
    "cluster_purity": q_cluster_purity,
    "avg_purity": q_avg_purity,
    "eps_pairs": q_eps_pairs,
    "components": q_components,
    "admissible_points": q_admissible_points,
    "decayed_delta": q_decayed_delta,
    "apply_delta": q_apply_delta,
    "promote_prune": q_promote_prune,
    "points_per_batch": q_points_per_batch,
    "homogeneity": q_homogeneity,
    "predict": q_predict,
    "cluster_counts": q_cluster_counts,
    "mc_snapshot": q_mc_snapshot,
    "macro_paper": q_macro_paper,
    "init_clusters": q_init_clusters,
    "admit_outliers": q_admit_outliers,
    "update_batch": q_update_batch,
    "stream_events": q_stream_events,
    "run_stream": q_run_stream,
    "macro_reference": q_macro_reference,
}
