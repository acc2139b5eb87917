"""Result tables (S10-S12, A11, A12): details, micro/macro clusters and
metrics, as Parquet.  Per-batch tables are partitioned by ``batch_id`` and
overwritten partition-wise, so re-running a batch replaces its rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoclust.operators import state as st
from evoclust.operators.metrics import homogeneity_completeness
from evoclust.params import ClusterParams

TABLES = ("details", "micro_clusters", "micro_metrics", "macro_clusters", "macro_metrics", "rejects", "progress",
          "listener")
PROGRESS = ("batch_id long, rows long, to_p long, to_o long, unassigned long, opened long, promoted long, p_pruned long, "
            "o_pruned long, n_p long, n_o long, sum_w_p double, sum_w_o double, clock long, "
            "update_s double, detect_s double, total_s double")


LISTENER = "event string, run_id string, batch_id long, rows long, trigger_ms long, durations string, at double"


def run_details(spark: SparkSession, params: ClusterParams, app: str = "evoclust", dataset: str = "",
                dataset_location: str = "", init_location: str = "", data_amount: int = 0,
                init_amount: int = 0) -> DataFrame:
    """One row of run parameters."""
    row = {
        "app_name": app, "dataset": dataset, "dataset_location": dataset_location,
        "num_labels": params.num_labels, "data_amount": int(data_amount),
        "init_data_location": init_location, "init_data_amount": int(init_amount),
        "num_features": params.num_dims, "stream_speed_per_sec": params.rate,
        "batch_time": params.batch_seconds, "init_epsilon": float(params.init_epsilon),
        "init_mu": float(params.mu), "lambda": float(params.lam), "mu": float(params.mu),
        "beta": float(params.beta), "epsilon": float(params.epsilon),
        "offline_mu": float(params.offline_mu), "offline_epsilon": float(params.offline_epsilon),
        "semantics": params.semantics,
    }
    return spark.createDataFrame([row])


class ResultWriter:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _write_batch(self, df: DataFrame, name: str) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(self._path(name)))

    def write_batch(self, state: DataFrame, batch_id: int, points_in_batch: int,
                    params: ClusterParams, contingency: DataFrame | None = None) -> None:
        """A11 snapshot of every MC, the average p-MC purity (A5), and of a
        ``contingency`` (``mc_id, label, n``) homogeneity and completeness of
        the batch (A10)."""
        snap = st.snapshot(state, batch_id, points_in_batch, params)
        self._write_batch(snap, "micro_clusters")
        met = (state.filter(F.col("kind") == "p")
               .agg(F.avg(F.array_max("lbl_counts") / F.aggregate(
                   "lbl_counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("value"))
               .select(F.lit(batch_id).cast("long").alias("batch_id"),
                       F.lit("PURITY(avg)").alias("name"), "value"))
        if contingency is not None:
            scores = homogeneity_completeness(contingency, "mc_id", "label", n_col="n")
            met = met.unionByName(scores.select(
                F.lit(batch_id).cast("long").alias("batch_id"),
                F.explode(F.create_map(F.lit("HOMOGENEITY"), "homogeneity", F.lit("COMPLETENESS"), "completeness")).alias("name", "value")))
        self._write_batch(met, "micro_metrics")

    def write_rejects(self, rejects: DataFrame, batch_id: int) -> None:
        """Raw values of a batch's records that are no points."""
        self._write_batch(rejects.withColumn("batch_id", F.lit(batch_id).cast("long")), "rejects")

    def write_progress(self, rec: dict, batch_id: int) -> None:
        """One row of counts a batch."""
        names = [c.split()[0] for c in PROGRESS.split(", ")]
        self._write_batch(self.spark.createDataFrame([tuple(rec[c] for c in names)], PROGRESS), "progress")

    def write_final(self, details: DataFrame, macros: DataFrame) -> None:
        details.write.mode("overwrite").parquet(self._path("details"))
        macros.write.mode("overwrite").parquet(self._path("macro_clusters"))
        (macros.agg(F.avg("purity").alias("value")).select(F.lit("PURITY(avg)").alias("name"), "value")
         .write.mode("overwrite").parquet(self._path("macro_metrics")))


def read_results(spark: SparkSession, root: str) -> dict:
    """The result tables present under ``root``."""
    out = {}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(root, name))
        if path.getFileSystem(conf).exists(path):  # else not written by this run
            # a run without a reject leaves a folder without files
            if name == "listener":
                out[name] = spark.read.schema(LISTENER).json(path.toString())
                continue
            read = spark.read.schema("value string, batch_id long") if name == "rejects" else spark.read
            out[name] = read.parquet(path.toString())
    return out
