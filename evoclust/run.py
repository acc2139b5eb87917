"""Command line run: initialise, stream, cluster offline, write the tables.

    python -m evoclust.run --initialDataPath init.csv --numDimensions 2 \\
        --numLabels 3 --streamPath /data/stream_dir --source text --out /shared/results

``--source kafka`` subscribes to ``--topic`` (``--bootstrap`` servers);
``--source text`` reads envelope lines from new files of ``--streamPath``.
The option names follow the original application's flags.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from evoclust.params import ClusterParams
from evoclust.plans.model import ClusterModel
from evoclust.session import ensure_checkpoint_dir, scratch_path, ship_package
from evoclust.sources.points import read_point_stream, read_points_csv
from evoclust.sources.results import ResultWriter, run_details
from evoclust.streaming.stream import decode_stream, default_timeout, run_stream


def parse_args(argv=None):
    a = argparse.ArgumentParser(prog="evoclust.run")
    a.add_argument("--batchTime", type=int, default=5)
    a.add_argument("--appName", default="evoclust")
    a.add_argument("--numDimensions", type=int, default=2)
    a.add_argument("--speedRate", type=int, default=100)
    a.add_argument("--numLabels", type=int, default=3)
    a.add_argument("--initialDataAmount", type=int, default=150)
    a.add_argument("--lmbda", type=float, default=0.25)
    a.add_argument("--epsilon", type=float, default=0.4)
    a.add_argument("--initialEpsilon", type=float, default=0.4)
    a.add_argument("--mu", type=float, default=10)
    a.add_argument("--beta", type=float, default=0.2)
    a.add_argument("--initialDataPath", required=True)
    a.add_argument("--offlineEpsilon", type=float, default=0.4)
    a.add_argument("--trainingDataAmount", type=int, default=10000)
    a.add_argument("--offlineMu", type=float, default=10)
    a.add_argument("--dataset", default="")
    a.add_argument("--streamPath", default="")
    a.add_argument("--topic", default="")
    a.add_argument("--bootstrap", default="localhost:9092")
    a.add_argument("--source", choices=("kafka", "text"), default="kafka")
    a.add_argument("--timeout", type=float, default=None)
    a.add_argument("--availableNow", action="store_true")
    a.add_argument("--semantics", choices=("reference", "paper"), default="reference")
    a.add_argument("--admitMode", choices=("cells", "ordered"), default="cells")
    a.add_argument("--save", action=argparse.BooleanOptionalAction, default=True, help="write the result tables")
    a.add_argument("--initMode", choices=("cells", "scan"), default="cells")
    a.add_argument("--root", default=None, help="folder of the model's versions; give it again to resume")
    a.add_argument("--checkpoint", default=None, help="checkpoint folder of the stream; goes with --root")
    a.add_argument("--out", default=None, help="result folder (default: under spark.checkpoint.dir)")
    return a.parse_args(argv)


def main(argv=None) -> None:
    args = parse_args(argv)
    spark = SparkSession.builder.appName(args.appName).getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    params = ClusterParams(
        num_dims=args.numDimensions, num_labels=args.numLabels, lam=args.lmbda, epsilon=args.epsilon,
        init_epsilon=args.initialEpsilon, mu=args.mu, beta=args.beta, offline_epsilon=args.offlineEpsilon,
        offline_mu=args.offlineMu, admit_mode=args.admitMode, init_mode=args.initMode, batch_seconds=args.batchTime, rate=args.speedRate, semantics=args.semantics)
    model = ClusterModel(spark, params, root=args.root)
    if not model.resumed:
        model.initialize(read_points_csv(spark, args.initialDataPath, args.numDimensions))
    out = args.out or scratch_path(spark, f"results-{args.dataset or 'run'}_{args.speedRate}")
    writer = ResultWriter(spark, out) if args.save else None
    if args.source == "kafka":
        raw = read_point_stream(spark, "kafka", {"kafka.bootstrap.servers": args.bootstrap,
                                                 "subscribe": args.topic})
    else:
        raw = read_point_stream(spark, "text", {}, path=args.streamPath)
    timeout = args.timeout or default_timeout(args.trainingDataAmount, args.speedRate, args.batchTime)
    run_stream(decode_stream(raw, args.numDimensions, marked=True), model, available_now=args.availableNow,
               timeout=None if args.availableNow else timeout, results=writer, checkpoint=args.checkpoint)
    if writer is None:
        return
    details = run_details(spark, params, args.appName, args.dataset, args.streamPath, args.initialDataPath,
                          args.trainingDataAmount, args.initialDataAmount)
    writer.write_final(details, model.macro_clusters())
    print(f"results written to {out}")


if __name__ == "__main__":
    main()
