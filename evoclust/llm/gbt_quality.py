"""Quality rules by gradient-boosted trees over document statistics.

Statistics are exact counts over whole texts (``textkit.text_stats``); their
ratios feed a boosted tree model with logistic loss.  Chosen features carry
monotonic constraints (more symbols, repeated lines, repeated words or
exclamation marks can only lower the score).  The trees grow level by level
on histograms of at most ``bins`` values, and are flattened into node arrays
(feature, threshold, left, right, value), so scoring is ``depth`` gathers a
tree for a whole batch.

The model is fitted on a bounded sample of labelled rows (``max_rows``);
every text is scored.  Nulls and empty texts: no words, all counts 0,
``base_failed``.  Repeated rows are judged alike; other columns of the table
are not read.  Without labelled rows of both classes every text scores the
share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoclust.llm import textkit as tk
from evoclust.llm.common import labelled_sample, text_col

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: -1: the score never rises with the feature
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "bang_per_word": -1}


@dataclass
class Trees:
    """All trees' nodes one after another; a leaf points to itself."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for r in self.roots:
            at = np.full(len(x), r)
            for _ in range(self.depth):
                go = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(go, self.left[at], self.right[at])
            out += self.value[at]
        return out

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 40, depth: int = 4,
              bins: int = 32, rate: float = 0.2, l2: float = 1.0, min_rows: int = 20) -> Trees:
    """Second-order boosting on histograms.  A split on a constrained feature
    must order its children's values; the children inherit the middle of the
    two as a bound, so the order holds in the whole subtree."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    prior = float(np.log(share / (1 - share)))
    nodes = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def add(value):
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", value)):
            nodes[name].append(v)
        return k

    edges, codes = [], []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)
        edges.append(q)
        codes.append(np.searchsorted(q, x[:, f], "left"))
    margin = np.full(len(y), prior)
    if len(y) and 0 < y.sum() < len(y):
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            weight = lambda G, H, lo, hi: float(np.clip(-G / (H + l2), lo, hi))
            todo = [(add(0.0), np.arange(len(y)), -np.inf, np.inf, 0)]
            roots.append(todo[0][0])
            while todo:
                k, rows, lo, hi, d = todo.pop()
                G, H = g[rows].sum(), h[rows].sum()
                best = (1e-6, None)
                for f in range(x.shape[1]) if d < depth and len(rows) >= 2 * min_rows else ():
                    nb = len(edges[f]) + 1
                    c = codes[f][rows]
                    gl = np.cumsum(np.bincount(c, g[rows], nb))[:-1]
                    hl = np.cumsum(np.bincount(c, h[rows], nb))[:-1]
                    cl = np.cumsum(np.bincount(c, minlength=nb))[:-1]
                    wl, wr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(G - gl) / (H - hl + l2), lo, hi)
                    gain = -(gl * wl + 0.5 * (hl + l2) * wl ** 2) - ((G - gl) * wr + 0.5 * (H - hl + l2) * wr ** 2)
                    w = weight(G, H, lo, hi)
                    gain -= -(G * w + 0.5 * (H + l2) * w ** 2)
                    ok = (cl >= min_rows) & (len(rows) - cl >= min_rows)
                    if monotone[f]:
                        ok &= (wr - wl) * monotone[f] >= 0
                    if ok.any():
                        gain = np.where(ok, gain, -np.inf)
                        j = int(np.argmax(gain))
                        if gain[j] > best[0]:
                            best = (float(gain[j]), f, j, float(wl[j]), float(wr[j]))
                if best[1] is None:
                    w = weight(G, H, lo, hi) * rate
                    nodes["value"][k] = w
                    margin[rows] += w
                    continue
                _, f, j, wl, wr = best
                go = codes[f][rows] <= j
                mid = (wl + wr) / 2
                bl, br = (lo, hi), (lo, hi)
                if monotone[f] > 0:
                    bl, br = (lo, mid), (mid, hi)
                elif monotone[f] < 0:
                    bl, br = (mid, hi), (lo, mid)
                a, b = add(0.0), add(0.0)
                nodes["feature"][k], nodes["threshold"][k] = f, float(edges[f][j])
                nodes["left"][k], nodes["right"][k] = a, b
                todo += [(a, rows[go], *bl, d + 1), (b, rows[~go], *br, d + 1)]
    arr = lambda name, kind: np.array(nodes[name], kind)
    return Trees(arr("feature", np.int64), arr("threshold", float), arr("left", np.int64), arr("right", np.int64),
                 arr("value", float), np.array(roots, np.int64), depth, prior)


def _features(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in it:
        x = [tk.ratios(tk.text_stats(buf, off)) for _, _, buf, off in tk.chunks(col)]
        x = np.concatenate(x) if x else np.zeros((0, len(tk.RATIO_NAMES)))
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def train(sample: DataFrame, **params) -> Trees:
    """Fits on ``text, y`` rows (bounded by the caller); their features, a
    few numbers a row, come to the driver."""
    rows = sample.select(F.arrow_udf(_features, "array<double>")("text").alias("x"), "y").toPandas()
    x = np.stack(rows.x.to_numpy()) if len(rows) else np.zeros((0, len(tk.RATIO_NAMES)))
    order = np.lexsort((*x.T, rows.y.to_numpy())) if len(rows) else np.zeros(0, int)  # the sums' order is fixed
    mono = np.array([MONOTONE.get(n, 0) for n in tk.RATIO_NAMES])
    return fit_trees(x[order], rows.y.to_numpy(float)[order], mono, **params)


def judge(docs: DataFrame, model: Trees, id_col: str = "doc_id", keep_at: float = 0.5, min_words: int = 50,
          max_repeat: float = 0.5) -> DataFrame:
    """``id_col``, the base counts, ``base_failed``, ``score``, ``kept`` for
    every row."""
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            got = {k: [np.zeros(0, np.int64)] for k in BASE}
            scores = [np.zeros(0)]
            for _, _, buf, off in tk.chunks(col):
                st = tk.text_stats(buf, off)
                for k in BASE:
                    got[k].append(st[k])
                scores.append(model.proba(tk.ratios(st)))
            yield pa.StructArray.from_arrays(
                [*[pa.array(np.concatenate(got[k])) for k in BASE], pa.array(np.concatenate(scores))], [*BASE, "score"])
    udf = F.arrow_udf(run, ", ".join(f"{k} long" for k in BASE) + ", score double")
    failed = (F.col("__s.n_words") < min_words) | (F.col("__s.n_repeat_words") > F.lit(max_repeat) * F.col("__s.n_words"))
    return (docs.select(F.col(id_col), udf(text_col()).alias("__s"))
            .select(id_col, *[f"__s.{k}" for k in BASE], failed.alias("base_failed"), "__s.score",
                    (~failed & (F.col("__s.score") >= keep_at)).alias("kept")))


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, train_on: Column | None = None,
                  **params) -> DataFrame:
    """Fits on at most ``max_rows`` labelled rows and judges all."""
    return judge(docs, train(labelled_sample(docs, labels, "quality", max_rows, train_on)), **params)
