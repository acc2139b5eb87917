"""The online phase, one micro-batch at a time, and the offline phase.

Per batch (``process_batch``):

1. cache the decoded batch, count it (empty batches are skipped);
2. J1+J2 in one map-only pass against the broadcast state;
3. A1 decayed deltas of both kinds in one ``groupBy(kind, ord)``;
4. J5/F9 fold the deltas into the state (K rows);
5. C3 admission of the unassigned rest;
6. C4 promotion, C5 pruning every ``prune_every`` non-empty batches;
7. the new state is written as version ``batch_id`` in the run folder
   (lineage cut, restartable).  A replayed batch id reloads its stored
   version, so a batch is idempotent.

The state has K rows (K micro-clusters); the points of a batch are only
touched by the map-side assignment and two partial aggregations.
"""

from __future__ import annotations

import json
import os
import re
import threading
import time as _time
from collections import deque
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evoclust.functions import kernels as K
from evoclust.operators import admit as admit_op
from evoclust.operators import state as st
from evoclust.operators.assign import assign_points, state_row_bytes
from evoclust.operators.delta import decayed_delta
from evoclust.operators.macro import macro_clusters
from evoclust.operators.density import init_density
from evoclust.operators.seeding import init_clusters
from evoclust.params import ClusterParams
from evoclust.session import cuts_removed, remove, scratch_path, ship_package
from evoclust.sources.points import with_row_index

_UPD = ("cf1", "cf2", "weight", "last_edit", "pts", "lbl_counts")


def _summarise(rows, max_p_ord: int) -> dict:
    """Per-kind count, weight sum, pts sum, mean purity and promoted count
    of collected state rows (the same numbers as the Spark summary)."""
    out = {}
    for kind in ("p", "o"):
        rs = [r for r in rows if r["kind"] == kind]
        if not rs:
            continue
        pur = [max(r["lbl_counts"]) / sum(r["lbl_counts"]) for r in rs]
        out[kind] = {"n": len(rs), "w": sum(r["weight"] for r in rs), "pts": sum(r["pts"] for r in rs),
                     "pur": sum(pur) / len(pur), "new_p": sum(1 for r in rs if r["ord"] > max_p_ord)}
    return out


def _release(frames) -> None:
    """Drop the batch's cached frames without waiting for the block manager."""
    def run():
        for df in frames:
            try:
                df.unpersist()
            except Exception:  # the session may already be gone
                pass
    threading.Thread(target=run, daemon=True).start()


class ClusterModel:
    def __init__(self, spark: SparkSession, params: ClusterParams, root: str | None = None,
                 resume: bool = True):
        self.spark = spark
        ship_package(spark)
        self.params = params
        self.root = root or scratch_path(spark, "evoclust-run")
        self.meta = st.ModelMeta()
        self.state = st.empty_state(spark)
        self.timings = {"update": 0.0, "detect": 0.0, "total": 0.0}
        self.history: deque[dict] = deque(maxlen=1000)  # all batches: the progress table
        self.init_info: dict = {}
        self._versions_seen: set[int] = set()
        self._arrays = None  # (P, O) arrays of self.state when it is small
        self.resumed = False
        if resume and root is not None:
            latest = self._latest_version()
            if latest is not None:
                self.resumed = self._load(latest)

    # ------------------------------------------------------------ store
    def _state_path(self):
        return os.path.join(self.root, "state")

    def _meta_path(self):
        return os.path.join(self.root, "meta")

    def _version_path(self, version: int) -> str:
        return os.path.join(self._state_path(), f"v={version}")

    def _save(self, state: DataFrame, meta: st.ModelMeta, whole: bool = True) -> None:
        """Writes version ``meta.version``.  ``whole``: all clusters have
        changed.  Else a large state gives the clusters that the batch
        touched (their ``pts`` is not 0) on top of the version before."""
        out = state.select(*st.STATE_COLS)
        size = (meta.n_p + meta.n_o) * state_row_bytes(self.params.num_dims)
        stored = self._stored_versions()
        logged = [v for v in stored if self.meta.base < v <= self.meta.version]
        if whole or self.meta.base not in stored or size <= self.params.log_over_bytes or len(logged) + 1 >= self.params.compact_every:
            meta.base = meta.version
            if size <= self.params.max_broadcast_bytes:
                out = out.coalesce(1)  # a broadcast-sized state: one file per version
        else:
            meta.base = self.meta.base
            out = out.filter(F.col("pts") > 0)
        # each version in its own folder: reading one never lists the others
        out.write.mode("overwrite").parquet(self._version_path(meta.version))
        self._write_meta(meta)
        self.meta = meta
        self.state = self._read_state(meta.version)
        self._versions_seen.add(meta.version)
        self._arrays = None
        self._retain()

    def _retain(self) -> None:
        """Deletes versions that none of the newest ``keep_versions`` needs."""
        docs = self._documents()
        newest = sorted(docs)[-self.params.keep_versions:]
        need = min(int(self._read_meta(v).get("base", v)) for v in newest)
        fs, root, jvm = self._fs()
        for v, (k, _) in docs.items():
            if v < need:
                # the document first: a version without one does not count
                for i in range(k + 1):
                    fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"v{v}-{i}.json"), False)
                for folder in (self._version_path(v), self._contingency_path(v)):
                    remove(self.spark, folder)

    def _read_state(self, version: int) -> DataFrame:
        base = int((self._read_meta(version) or {}).get("base", version))
        logs = [v for v in self._stored_versions() if base < v <= version]
        read = lambda v: self.spark.read.schema(st.STATE_SCHEMA).parquet(self._version_path(v))
        if not logs:
            return read(version)
        rows = reduce(DataFrame.unionByName, [read(v).withColumn("_v", F.lit(v)) for v in [base, *logs]])
        last = rows.groupBy("mc_id").agg(F.max_by(F.struct(*st.STATE_COLS, "_v"), "_v").alias("r")).select("r.*")
        # points of another batch than this one's are no points of this batch
        return last.withColumn("pts", F.when(F.col("_v") == version, F.col("pts")).otherwise(F.lit(0)).cast("long")).drop("_v")

    # ---------------------------------------------- clusters against labels
    def _contingency_path(self, version: int) -> str:
        return os.path.join(self.root, "contingency", f"v={version}")

    def contingency(self, versions: list[int] | None = None) -> DataFrame:
        """A10: ``batch_id, mc_id, label, n`` of the kept batches: how many
        points of a label each cluster took.  Batches add up."""
        kept = [v for v in self._stored_versions() if v >= 0 and (versions is None or v in versions)]
        schema = "batch_id long, mc_id string, label int, n long"
        if not kept:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._contingency_path(v) for v in kept])

    # model scalars: one small JSON document per version, written through
    # the Hadoop file system of the run folder (shared storage on a cluster)
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self._meta_path())
        return path.getFileSystem(conf), path, jvm

    def _write_meta(self, meta: st.ModelMeta) -> None:
        """A new name each time (``v<version>-<k>.json``), renamed into place;
        the newest complete document of a version counts, so a crash between
        two steps loses nothing."""
        fs, root, jvm = self._fs()
        fs.mkdirs(root)
        k = self._documents().get(meta.version, (-1, ""))[0] + 1
        tmp = jvm.org.apache.hadoop.fs.Path(root, f"_v{meta.version}-{k}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(meta.as_row()).encode()))
        out.close()
        fs.rename(tmp, jvm.org.apache.hadoop.fs.Path(root, f"v{meta.version}-{k}.json"))

    def _documents(self) -> dict:
        """version -> (k, file name) of its newest document."""
        fs, root, _ = self._fs()
        out: dict = {}
        if fs.exists(root):
            for stt in fs.listStatus(root):
                name = stt.getPath().getName()
                m = re.fullmatch(r"v(-?\d+)-(\d+)[.]json", name)
                if m:
                    v, k = int(m[1]), int(m[2])
                    out[v] = max(out.get(v, (-1, "")), (k, name))
        return out

    def _stored_versions(self) -> list[int]:
        return sorted(self._documents())

    def _latest_version(self, below: int | None = None):
        vs = [v for v in self._stored_versions() if below is None or v < below]
        return vs[-1] if vs else None

    def _read_meta(self, version: int) -> dict | None:
        found = self._documents().get(version)
        if found is None:
            return None
        fs, root, jvm = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(root, found[1]))
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream))
        text = reader.readLine()
        reader.close()
        return json.loads(text)

    def _load(self, version: int) -> bool:
        r = self._read_meta(version)
        if r is None:
            return False
        self.meta = st.ModelMeta(**{k: int(v) for k, v in r.items()})
        self.state = self._read_state(version)
        self._versions_seen.add(version)
        self._arrays = None
        return True

    def stored(self, version: int) -> tuple[DataFrame, int] | None:
        """State and points of a stored batch (None: no such version, as for
        an empty batch); the model stays where it is."""
        r = self._read_meta(version)
        return None if r is None else (self._read_state(version), int(r.get("rows", 0)))

    # ------------------------------------------------------------- init
    def initialize(self, init_points: DataFrame) -> dict:
        init = {"scan": init_clusters, "cells": init_density}[self.params.init_mode]
        state, info = init(init_points, self.params)
        agg = state.agg(F.max("ord"), F.count(F.lit(1))).collect()[0]
        meta = st.ModelMeta(version=-1, clock=0, period=0,
                            max_p_ord=int(agg[0]) if agg[0] is not None else -1,
                            max_o_ord=-1, n_p=int(agg[1]), n_o=0)
        self._save(state, meta)
        self.init_info = info
        return info

    def set_state(self, state: DataFrame, meta: st.ModelMeta) -> None:
        self._save(st.conform(state), meta)

    # ------------------------------------------------------- one batch
    def process_batch(self, batch: DataFrame, batch_id: int) -> dict | None:
        """Folds one micro-batch; None for a replayed or an empty one."""
        with cuts_removed(self.spark):
            return self._fold(batch, batch_id)

    def _fold(self, batch: DataFrame, batch_id: int) -> dict | None:
        p = self.params
        t_start = _time.time()
        if batch_id <= self.meta.version:
            # batches come in order, so this one is folded in already (or was
            # empty): the state stays as it is
            return None
        held = []  # cached frames of this batch, released at the end
        pts = batch.select("time", "features", "label", "seq")
        meta = self.meta
        counts = {"p": meta.n_p, "o": meta.n_o}
        assigned = assign_points(pts, self.state, p, counts, arrays=self._arrays).cache()
        held.append(assigned)
        small = (meta.n_p + meta.n_o) * state_row_bytes(p.num_dims) <= p.max_broadcast_bytes
        # one aggregation gives the deltas and (kind "u") the unassigned rows
        keyed = assigned.select(F.coalesce("kind", F.lit("u")).alias("kind"),
                                F.coalesce("ord", F.lit(-1).cast("long")).alias("ord"),
                                "time", "features", "label")
        all_groups = decayed_delta(keyed, p.lam, p.num_dims, p.num_labels).drop("tmin").cache()
        held.append(all_groups)
        dsum = {r["kind"]: r for r in all_groups.groupBy("kind").agg(
            F.sum("dpts").alias("n"), F.max("tmax").alias("t")).collect()}
        n = int(sum(r["n"] for r in dsum.values()))
        if n == 0:  # empty batch: nothing changes, the prune period does not advance
            _release(held)
            return None
        deltas = all_groups.filter(F.col("kind") != "u")
        to_p = int(dsum["p"]["n"]) if "p" in dsum else 0
        to_o = int(dsum["o"]["n"]) if "o" in dsum else 0
        clock = max([meta.clock] + [int(r["t"]) for k, r in dsum.items() if k != "u"])
        s1 = st.apply_deltas(self.state, deltas, p, broadcast=small).cache()
        held.append(s1)
        n_rest = n - to_p - to_o
        max_o = meta.max_o_ord
        n_new = 0
        mode = p.admit_mode if n_rest else None
        if n_rest:
            rest = assigned.filter(F.col("kind").isNull()).drop("kind", "ord")
            o0 = admit_op.first_outlier(s1) if meta.n_o and mode == "ordered" else None
            newmcs = admit_op.admit_outliers(rest, o0, p).cache()
            held.append(newmcs)
            agg = newmcs.agg(F.count_if(F.col("is_o0")).alias("u"), F.count_if(~F.col("is_o0")).alias("f"),
                             F.max("last_edit").alias("t")).collect()[0]
            # the newest edit among the clusters opened or changed is the
            # newest unassigned point
            clock = max(clock, int(agg["t"]))
            if o0 is not None and agg["u"]:
                u = newmcs.filter(F.col("is_o0")).select(
                    F.lit(int(o0["ord"])).cast("long").alias("_uord"),
                    *[F.col(c).alias("u_" + c) for c in _UPD])
                j = s1.join(F.broadcast(u), (s1.kind == "o") & (s1.ord == u._uord), "left")
                s1 = j.select(*[F.coalesce(F.col("u_" + c), F.col(c)).alias(c) if c in _UPD
                                else F.col(c) for c in st.STATE_COLS], "promote")
            n_new = int(agg["f"])
            if n_new:
                fresh = newmcs.filter(~F.col("is_o0"))
                if n_new * state_row_bytes(p.num_dims) <= p.max_broadcast_bytes:
                    # within the broadcast budget: a small global numbering
                    idx = fresh.withColumn("_k", (F.row_number().over(
                        Window.orderBy("first_time", "first_seq")) - 1).cast("long"))
                else:
                    idx = with_row_index(fresh, ["first_time", "first_seq"], "_k")
                new_rows = idx.select(
                    F.lit("o").alias("kind"),
                    (F.lit(max_o + 1) + F.col("_k")).cast("long").alias("ord"),
                    F.concat(F.lit(f"{batch_id}-"), F.col("_k").cast("string")).alias("mc_id"),
                    "cf1", "cf2", "weight", "t0", "last_edit", "pts", "lbl_counts",
                    (F.col("weight") >= F.lit(p.promote_weight)).alias("promote"))
                s1 = s1.select(*st.STATE_COLS, "promote").unionByName(new_rows)
                max_o += n_new
        s1 = s1.cache()
        held.append(s1)
        # the state may have grown by the opened clusters
        small = small and (meta.n_p + meta.n_o + n_new) * state_row_bytes(p.num_dims) <= p.max_broadcast_bytes
        s2 = st.promote(s1, meta.max_p_ord, small=small).cache()
        held.append(s2)
        t_update = _time.time() - t_start
        t_detect = _time.time()
        pruned = {"p": 0, "o": 0}
        prune_now = meta.period != 0 and meta.period % p.prune_every == 0
        summary = [
            F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum("pts").alias("pts"),
            F.avg(F.array_max("lbl_counts") / F.aggregate("lbl_counts", F.lit(0).cast("long"),
                                                          lambda a, b: a + b)).alias("pur"),
            F.count_if(F.col("ord") > F.lit(meta.max_p_ord)).alias("new_p")]
        if prune_now:
            kept = {r["kind"]: r for r in s2.groupBy("kind").agg(*summary).collect()}
            n_prom = int(kept["p"]["new_p"]) if "p" in kept else 0
            s2 = st.prune(s2, clock, p).cache()
            held.append(s2)
        arrays = None
        if small:
            # the state is small: one collect gives the summary and the
            # arrays the next batch broadcasts
            rows = s2.select("kind", "ord", "cf1", "cf2", "weight", "last_edit", "pts",
                             "lbl_counts").orderBy("kind", "ord").collect()
            kept = _summarise(rows, meta.max_p_ord)
            arrays = (K.state_arrays([r for r in rows if r["kind"] == "p"], p.num_dims),
                      K.state_arrays([r for r in rows if r["kind"] == "o"], p.num_dims))
        else:
            kept = {r["kind"]: r for r in s2.groupBy("kind").agg(*summary).collect()}
        if not prune_now:
            n_prom = int(kept["p"]["new_p"]) if "p" in kept else 0
        t_detect = _time.time() - t_detect
        s2 = st.conform(s2)
        n_p = int(kept["p"]["n"]) if "p" in kept else 0
        n_o = int(kept["o"]["n"]) if "o" in kept else 0
        if prune_now:
            pruned = {"p": meta.n_p + n_prom - n_p, "o": meta.n_o + n_new - n_prom - n_o}
        newmeta = st.ModelMeta(
            version=batch_id, clock=clock, period=meta.period + 1,
            max_p_ord=meta.max_p_ord + n_prom, max_o_ord=max_o, n_p=n_p, n_o=n_o,
            rows=n)
        self._write_contingency(deltas.join(self.state.select("kind", "ord", "mc_id"), ["kind", "ord"]),
                                new_rows if n_new else None, batch_id)
        self._save(s2, newmeta, whole=prune_now)
        self._arrays = arrays
        _release(held)
        self.timings["update"] += t_update
        self.timings["detect"] += t_detect
        self.timings["total"] += _time.time() - t_start
        rec = {
            "batch_id": batch_id, "rows": n, "to_p": to_p, "to_o": to_o,
            "unassigned": n_rest, "opened": n_new, "promoted": n_prom,
            "p_pruned": pruned["p"], "o_pruned": pruned["o"],
            "n_p": n_p, "n_o": n_o,
            "sum_w_p": float(kept["p"]["w"]) if "p" in kept else 0.0,
            "sum_w_o": float(kept["o"]["w"]) if "o" in kept else 0.0,
            "sum_pts": int(sum((r["pts"] or 0) for r in kept.values())),
            "avg_purity": float(kept["p"]["pur"]) if "p" in kept else None,
            "admit_mode": mode, "clock": clock,
            "update_s": t_update, "detect_s": t_detect, "total_s": _time.time() - t_start,
        }
        self.history.append(rec)
        return rec

    def _write_contingency(self, old: DataFrame, new: DataFrame | None, batch_id: int) -> None:
        took = old.select("mc_id", "lbl_counts")
        if new is not None:
            took = took.unionByName(new.select("mc_id", "lbl_counts"))
        took.select("mc_id", F.posexplode("lbl_counts").alias("label", "n")).filter("n > 0").select(
            F.lit(batch_id).cast("long").alias("batch_id"), "mc_id", "label", "n").write.mode("overwrite").parquet(
            self._contingency_path(batch_id))

    # ---------------------------------------------------------- offline
    def micro_clusters(self) -> DataFrame:
        return st.micro_clusters(self.state)

    def macro_clusters(self, mu: float | None = None, eps: float | None = None) -> DataFrame:
        """Reference semantics: components in list order; paper semantics:
        cores connected by density, borders to their nearest core (Q9-Q12)."""
        if self.params.semantics == "paper":
            from evoclust.operators.macro import macro_paper
            return macro_paper(self.state, self.params, mu, eps, clock=self.meta.clock)
        return macro_clusters(self.state, self.params, mu, eps, clock=self.meta.clock)
