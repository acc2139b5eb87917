"""The command line run end to end: init file, text stream, result tables,
resumed on the same folders."""

import os

from evoclust import run as cli
from evoclust.sources.results import read_results
from tests.sequential import drifting_blobs


def test_cli_run_writes_tables_and_resumes(spark, tmp_path):
    src, out = os.path.join(tmp_path, "src"), os.path.join(tmp_path, "out")
    os.mkdir(src)
    init = os.path.join(tmp_path, "init.csv")
    with open(init, "w") as f:
        f.writelines(f"{x!r},{y!r},{lab}\n" for x, y, lab in drifting_blobs(150, 5))
    rows = drifting_blobs(300, 9)

    def part(b):
        with open(os.path.join(src, f"part-{b}.txt"), "w") as f:
            f.writelines(f"{b}/{x!r},{y!r},{lab}\n" for x, y, lab in rows[b * 100:(b + 1) * 100])

    args = ["--initialDataPath", init, "--numDimensions", "2", "--numLabels", "3", "--streamPath", src, "--source",
            "text", "--availableNow", "--out", out, "--dataset", "blobs", "--root", os.path.join(tmp_path, "root"),
            "--checkpoint", os.path.join(tmp_path, "ckpt")]
    part(0)
    cli.main(args)
    t = read_results(spark, out)
    assert {"details", "micro_clusters", "micro_metrics", "macro_clusters", "macro_metrics", "rejects",
            "progress", "listener"} == set(t)
    assert t["rejects"].count() == 0
    assert t["micro_metrics"].count() == 3
    assert t["micro_clusters"].filter("type = 'primary'").count() >= 3
    part(1)
    cli.main(args)
    got = read_results(spark, out)["progress"].orderBy("batch_id").collect()
    assert [(r.batch_id, r.rows) for r in got] == [(0, 100), (1, 100)]
    part(2)
    cli.main([*args, "--no-save", "--out", os.path.join(tmp_path, "none")])
    assert not os.path.exists(os.path.join(tmp_path, "none")) and read_results(spark, out)["progress"].count() == 2
