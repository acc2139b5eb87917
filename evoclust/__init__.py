"""evoclust: density-based clustering of evolving streams on Spark.

Points are folded into time-decayed micro-clusters batch by batch (online
phase) and the micro-clusters are merged into macro-clusters by density
(offline phase).  Everything runs on DataFrames; the cluster state is a
small versioned table.
"""

from evoclust.params import ClusterParams

__all__ = ["ClusterParams"]
