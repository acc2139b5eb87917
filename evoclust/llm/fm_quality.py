"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata (the text's own lengths and line counts).

``margin = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pair sum
is taken in linear time as ``(|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2``.
Words are hashed into ``2^bits`` features with ``x = sqrt(count)``, scaled to
unit length a text; structure statistics are standardised.

The model is fitted with AdaGrad on a bounded sample of labelled rows
(``max_rows``, a parameter; at most ``max_rows * 2^bits`` feature values,
in practice a few hundred a row, come to the driver) and every text is
scored whole.  Nulls and empty texts have no word features and zero
statistics and get the score those give.  Repeated rows score alike; other
columns are not read.  Without labelled rows of both classes every text
scores the share of label 1 (0.5 without labels).
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

BITS = 13


def word_features(buf: np.ndarray, off: np.ndarray, bits: int = BITS):
    """Row starts, feature numbers and values of the hashed words: one entry
    for each distinct feature of a row, rows in order."""
    n = len(off) - 1
    s, e, row = tk.spans(buf, off)
    f = (tk.span_hash(buf, s, e) >> np.uint64(64 - bits)).astype(np.int64)
    key, count = np.unique(row * (1 << bits) + f, return_counts=True)
    row, f = key >> bits, key & ((1 << bits) - 1)
    v = np.sqrt(count.astype(float))
    starts = np.searchsorted(row, np.arange(n + 1))
    norm = np.sqrt(np.bincount(row, v * v, minlength=n)[:n])
    return starts, f, (v / np.where(norm > 0, norm, 1)[row]).astype(np.float32)


def _row_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values[starts[r]:starts[r+1]]`` along the first axis."""
    cs = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=cs[1:])
    return cs[starts[1:]] - cs[starts[:-1]]


@dataclass
class FM:
    w0: float
    w: np.ndarray       # hashed words, then statistics
    v: np.ndarray       # the same rows, rank columns
    mean: np.ndarray
    scale: np.ndarray
    bits: int

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) * 0.3

    def margin(self, starts, f, x, stats) -> np.ndarray:
        d = self.dense(stats)
        wd, vd = self.w[1 << self.bits:], self.v[1 << self.bits:]
        vx = self.v[f] * x[:, None]
        total = _row_sum(vx, starts) + d @ vd
        squares = _row_sum((vx * vx).sum(1), starts) + (d * d) @ (vd * vd).sum(1)
        return self.w0 + _row_sum(self.w[f] * x, starts) + d @ wd + 0.5 * ((total * total).sum(1) - squares)


def fit(starts, f, x, stats, y, bits: int = BITS, rank: int = 8, epochs: int = 8, min_steps: int = 1500, batch: int = 64,
        rate: float = 0.1, l2: float = 1e-5, seed: int = 5) -> FM:
    rng = np.random.default_rng(seed)
    n, m = len(y), (1 << bits) + stats.shape[1]
    scale = np.maximum(stats.std(0), 1e-6) if n else np.ones(stats.shape[1])
    share = float(np.clip(y.mean() if n else 0.5, 0.02, 0.98))
    model = FM(float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, 0.02, (m, rank)),
               stats.mean(0) if n else np.zeros(stats.shape[1]), scale, bits)
    if n == 0 or y.min() == y.max():
        model.v[:] = 0
        return model
    g0, gw, gv = 1.0, np.full(m, 1e-2), np.full((m, rank), 1e-2)
    d_at = (1 << bits) + np.arange(stats.shape[1])
    dense = model.dense(stats)
    for _ in range(max(epochs, -(-min_steps * batch // n))):
        for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
            ids = np.concatenate([np.concatenate([f[starts[r]:starts[r + 1]], d_at]) for r in rows])
            xs = np.concatenate([np.concatenate([x[starts[r]:starts[r + 1]], dense[r]]) for r in rows])
            st = np.concatenate([[0], np.cumsum([starts[r + 1] - starts[r] + len(d_at) for r in rows])])
            r_of = np.repeat(np.arange(len(rows)), np.diff(st))
            vx = model.v[ids] * xs[:, None]
            total = _row_sum(vx, st)
            z = (model.w0 + _row_sum(model.w[ids] * xs, st)
                 + 0.5 * ((total ** 2).sum(1) - _row_sum((vx ** 2).sum(1), st)))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            ex = err[r_of] * xs
            uniq, inv = np.unique(ids, return_inverse=True)
            dw = np.bincount(inv, ex, len(uniq)) + l2 * model.w[uniq]
            grad = ex[:, None] * (total[r_of] - vx)
            dv = np.stack([np.bincount(inv, grad[:, k], len(uniq)) for k in range(rank)], 1) + l2 * model.v[uniq]
            g0 += err.sum() ** 2
            gw[uniq] += dw ** 2
            gv[uniq] += dv ** 2
            model.w0 -= rate * err.sum() / np.sqrt(g0)
            model.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            model.v[uniq] -= 0.5 * rate * dv / np.sqrt(gv[uniq])
    return model


def train(sample: DataFrame, bits: int = BITS, **params) -> FM:
    """Fits on ``text, y`` rows, bounded by the caller."""
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            fs, xs, sts = [], [], []
            for _, _, buf, off in tk.chunks(col):
                starts, f, x = word_features(buf, off, bits)
                for r in range(len(off) - 1):
                    fs.append(f[starts[r]:starts[r + 1]].astype(np.int32))
                    xs.append(x[starts[r]:starts[r + 1]])
                sts += list(tk.ratios(tk.text_stats(buf, off)))
            yield pa.StructArray.from_arrays([pa.array(fs, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float32())),
                                              pa.array(sts, pa.list_(pa.float64()))], ["f", "x", "s"])
    udf = F.arrow_udf(run, "f array<int>, x array<float>, s array<double>")
    t = sample.select("y", udf("text").alias("r")).select("y", "r.f", "r.x", "r.s").toArrow()
    n = t.num_rows
    k = len(tk.RATIO_NAMES)
    if n == 0:
        return fit(np.zeros(1, int), np.zeros(0, int), np.zeros(0), np.zeros((0, k)), np.zeros(0), bits)
    flat = lambda name: t.column(name).combine_chunks()
    fcol, xcol = flat("f"), flat("x")
    starts = np.asarray(fcol.offsets).astype(np.int64)
    starts -= starts[0]
    f, x = np.asarray(fcol.flatten()).astype(np.int64), np.asarray(xcol.flatten())
    stats, y = np.asarray(flat("s").flatten()).reshape(n, k), np.asarray(flat("y")).astype(float)
    # rows in an order of their own, so that the fit doesn't hang on the partitioning
    order = np.lexsort((f[np.minimum(starts[:-1], max(len(f) - 1, 0))] if len(f) else np.zeros(n), *stats.T, y))
    lens = np.diff(starts)[order]
    pick = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in order]) if len(f) else np.zeros(0, int)
    return fit(np.concatenate([[0], np.cumsum(lens)]), f[pick], x[pick], stats[order], y[order], bits, **params)


def score(docs: DataFrame, model: FM, text: str = "text") -> Column:
    """Column expression: the score, 0 to 1, of a text column."""
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            z = [np.zeros(0)]
            for _, _, buf, off in tk.chunks(col, 1 << 20):
                z.append(model.margin(*word_features(buf, off, model.bits), tk.ratios(tk.text_stats(buf, off))))
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(z), -30, 30))))
    return F.arrow_udf(run, "double")(text_col(text))


def classify(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id", label: str = "quality",
             max_rows: int = 4_000, threshold: float = 0.5) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row; labels are read
    only where ``train_on`` (over ``__id``) holds."""
    model = train(labelled_sample(docs, labels, label, max_rows, train_on, id_col))
    held = ~F.coalesce(train_on, F.lit(True))
    return (docs.select(F.col(id_col), F.col(id_col).alias("__id"), score(docs, model).alias("score"))
            .select(id_col, held.alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
