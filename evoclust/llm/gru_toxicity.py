"""Toxicity: a bidirectional gated recurrent network with attention pooling
over character and word inputs, trained in numpy.

A word's input is a hashed word vector beside the mean of the vectors of its
hashed letter groups (3 bytes, and the first 4).  Texts are read in windows
of ``WINDOW`` words starting every ``STRIDE`` words, so neighbours overlap
and every word lies in a window; two GRUs read a window in both directions,
attention weighs the words' states, and a logistic unit scores the pool.  A
text's score is that of its highest window.

Training is multiple-instance: a toxic text only says that some window is
toxic.  The first rounds take every window of such a text as toxic, later
ones the highest-scoring windows; all windows of clean texts are clean, the
highest-scoring ones are drawn most often.  A quarter of the sample is kept
out of that to place the cut between the classes' highest margins, which
becomes the score ``CUT``, since a long text has more windows to err in.

The model is fitted on a bounded sample of labelled rows (``max_rows``) and
applied to all windows of all texts.  Null, empty and blank texts have no
window and score 0.  Repeated rows score alike; other columns are not read.
Without labelled rows of both classes every text scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoclust.llm import textkit as tk
from evoclust.llm.common import labelled_sample, text_col

WINDOW, STRIDE = 32, 24
WORD_BITS, CHAR_BITS = 12, 12
DIM, HID = 8, 8
CUT = 0.32  # score at the cut between clean and toxic
U64 = np.uint64


def inputs(buf: np.ndarray, off: np.ndarray):
    """Of a chunk: word bucket, letter-group buckets (flat, with starts) of
    every distinct word; the distinct word of every token; words a row."""
    n = len(off) - 1
    s, e, row = tk.spans(buf, off)
    h = tk.span_hash(buf, s, e)
    kinds, first, inv = np.unique(h, return_index=True, return_inverse=True)
    s, e = s[first], e[first]
    # letter groups: ^ab, abc, ..., yz$ and the first four
    length = e - s
    starts = np.concatenate([[0], np.cumsum(length + 1)])
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], length + 1)  # -1 .. length-1 shifted by one
    base = np.repeat(s, length + 1)
    last = np.repeat(length, length + 1)
    low = _LOWER[buf]

    def letter(k):  # k-th letter, 0 outside
        inside = (k >= 0) & (k < last)
        return np.where(inside, low[np.minimum(base + np.clip(k, 0, None), max(len(buf) - 1, 0))], 0).astype(U64)

    a, b, c = letter(at - 1), letter(at), letter(at + 1)
    d = np.where(at == 0, letter(at + 2), 0).astype(U64)
    extra = np.where(at == 0, letter(at + 3) + U64(256), 0).astype(U64)
    key = a | (b << U64(8)) | (c << U64(16)) | (d << U64(24)) | (extra << U64(32))
    chars = (tk.mix(key + U64(77)) >> U64(64 - CHAR_BITS)).astype(np.int64)
    words = (kinds >> U64(64 - WORD_BITS)).astype(np.int64)
    return words, chars, starts, inv, np.bincount(row, minlength=n)[:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]


def windows(counts: np.ndarray):
    """First token, length and row of every window."""
    k = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(counts)), k)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    begin = np.cumsum(counts) - counts
    return begin[row] + nth * STRIDE, np.minimum(WINDOW, counts[row] - nth * STRIDE), row


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Parameters by name (float32); forward pass and gradients."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        p = {"E": r.normal(0, 0.1, (1 << WORD_BITS, DIM)), "C": r.normal(0, 0.3, (1 << CHAR_BITS, DIM))}
        for d in "fb":
            p["W" + d] = r.normal(0, 0.35, (2 * DIM, 3 * HID))
            p["U" + d] = r.normal(0, 0.35, (HID, 3 * HID))
            p["b" + d] = np.zeros(3 * HID)
        p |= {"A": r.normal(0, 0.35, (2 * HID, HID)), "a": r.normal(0, 0.5, HID), "o": r.normal(0, 0.35, 2 * HID),
              "o0": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.slope, self.shift = 1.0, 0.0  # from a text's highest margin to its score

    def embed(self, words, chars, starts):
        """Input vectors of distinct words."""
        p = self.p
        c = np.add.reduceat(p["C"][chars], starts[:-1], 0) if len(words) else np.zeros((0, DIM), np.float32)
        return np.concatenate([p["E"][words], c / np.sqrt(np.diff(starts)).astype(np.float32)[:, None]], 1)

    def _gru(self, d, g, live, keep):
        """g: inputs times W (time, rows, 3*HID); states (time, rows, HID)."""
        u = self.p["U" + d]
        t_all, n, _ = g.shape
        h = np.zeros((n, HID), np.float32)
        out = np.empty((t_all, n, HID), np.float32)
        tape = []
        for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(g[t, :, :2 * HID] + hu[:, :2 * HID])
            z, r = zr[:, :HID], zr[:, HID:]
            cand = np.tanh(g[t, :, 2 * HID:] + r * hu[:, 2 * HID:])
            m = live[t][:, None]
            new = h + m * z * (cand - h)
            if keep:
                tape.append((t, h, z, r, cand, hu[:, 2 * HID:], m))
            h = out[t] = new
        return out, tape

    def forward(self, gf, gb, live, keep=False):
        """Margins of windows from projected inputs."""
        p = self.p
        hf, tf = self._gru("f", gf, live, keep)
        hb, tb = self._gru("b", gb, live, keep)
        hs = np.concatenate([hf, hb], 2)
        q = np.tanh(hs @ p["A"])
        e = np.where(live > 0, q @ p["a"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pool = (w[:, :, None] * hs).sum(0)
        return pool @ p["o"] + p["o0"][0], (hs, q, w, pool, tf, tb)

    def gradients(self, x, live, y):
        """Loss gradients of one batch; x: inputs (time, rows, 2*DIM)."""
        p, g = self.p, {}
        margin, (hs, q, w, pool, tf, tb) = self.forward(x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], live, True)
        dm = ((_sigmoid(margin) - y) / len(y)).astype(np.float32)
        g["o"], g["o0"] = pool.T @ dm, dm.sum(keepdims=True)
        dpool = dm[:, None] * p["o"]
        dhs = w[:, :, None] * dpool
        dw = (hs * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        g["a"] = (q * de[:, :, None]).sum((0, 1))
        dq = de[:, :, None] * p["a"] * (1 - q * q)
        g["A"] = np.tensordot(hs, dq, ([0, 1], [0, 1]))
        dhs = dhs + dq @ p["A"].T
        dx = np.zeros_like(x)
        for d, tape, part in (("f", tf, dhs[:, :, :HID]), ("b", tb, dhs[:, :, HID:])):
            u = p["U" + d]
            g["U" + d], g["W" + d], g["b" + d] = np.zeros_like(u), np.zeros_like(p["W" + d]), np.zeros(3 * HID, np.float32)
            carry = np.zeros_like(part[0])
            for t, h, z, r, cand, hc, m in reversed(tape):
                dh = carry + part[t]
                dz = dh * m * (cand - h) * z * (1 - z)
                dc = dh * m * z * (1 - cand * cand)
                dr = dc * hc * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], 1)
                du = np.concatenate([dz, dr, dc * r], 1)
                carry = dh * (1 - m * z) + du @ u.T
                g["U" + d] += h.T @ du
                g["W" + d] += x[t].T @ dg
                g["b" + d] += dg.sum(0)
                dx[t] += dg @ p["W" + d].T
        return margin, g, dx


def scores(net: Net, buf: np.ndarray, off: np.ndarray, block: int = 2048):
    """Margins and rows of all windows of a chunk."""
    words, chars, starts, inv, counts = inputs(buf, off)
    begin, size, row = windows(counts)
    x = net.embed(words, chars, starts)
    gf = np.concatenate([x @ net.p["Wf"] + net.p["bf"], np.zeros((1, 3 * HID), np.float32)])
    gb = np.concatenate([x @ net.p["Wb"] + net.p["bb"], np.zeros((1, 3 * HID), np.float32)])
    out = np.empty(len(begin))
    for lo in range(0, len(begin), block):
        t = np.arange(WINDOW)[:, None]
        live = t < size[None, lo:lo + block]
        at = np.where(live, inv[np.minimum(begin[None, lo:lo + block] + t, max(len(inv) - 1, 0))], len(x))
        out[lo:lo + block] = net.forward(gf[at], gb[at], live.astype(np.float32))[0]
    return out, row


def _chunk(texts: list[bytes]):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _best(margin, row, n):
    out = np.full(n, -np.inf)
    np.maximum.at(out, row, margin)
    return out


def fit(texts: list[bytes], y: np.ndarray, **params) -> Net | None:
    """Windows of three quarters of the texts train the network, the rest
    calibrates it; None without rows of both classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    apart = np.arange(len(y)) % 4 == 3
    if min(y[apart].sum(), y[~apart].sum(), (1 - y[apart]).sum(), (1 - y[~apart]).sum()) < 1:
        apart = np.ones(len(y), bool)  # too few to split: calibrated on what it learned from
        net = fit_windows(texts, y, **params)
    else:
        net = fit_windows([t for t, a in zip(texts, apart) if not a], y[~apart], **params)
    buf, off = _chunk([t for t, a in zip(texts, apart) if a])
    best = _best(*scores(net, buf, off), len(off) - 1)
    ok = np.isfinite(best)
    m, t = best[ok], y[apart][ok]
    pos, neg = np.sort(m[t == 1]), np.sort(m[t == 0])
    if len(pos) and len(neg):
        # the cut with the least share of errors, in the middle of its gap
        cuts = np.unique(m)
        cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
        errors = np.searchsorted(pos, cuts) / len(pos) + 1 - np.searchsorted(neg, cuts) / len(neg)
        good = cuts[errors <= errors.min() + 1e-9]
        cut = good[np.argmin(np.abs(good - (good[0] + good[-1]) / 2))]
        spread = max(float(np.median(pos) - np.median(neg)), 1e-3)
        net.slope = 8 / spread
        net.shift = float(np.log(CUT / (1 - CUT)) - net.slope * cut)
    return net


def fit_windows(texts: list[bytes], y: np.ndarray, rounds: int = 9, batch: int = 256, rate: float = 0.03,
                per_round: int = 10_000, seed: int = 3) -> Net:
    """Adam on windows."""
    rng = np.random.default_rng(seed)
    net = Net(seed)
    buf, off = _chunk(texts)
    words, chars, starts, inv, counts = inputs(buf, off)
    begin, size, row = windows(counts)
    yw = y[row].astype(np.float32)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, margins = 0, None
    lens = np.diff(starts)
    for rnd in range(rounds):
        if margins is None or rnd < 3:
            pos, neg = np.flatnonzero(yw == 1), np.flatnonzero(yw == 0)
            neg_p = np.full(len(neg), 1.0)
        else:
            top = _best(margins, row, len(y))
            pos = np.flatnonzero((yw == 1) & (margins >= np.minimum(top[row], 2.0)))
            neg = np.flatnonzero(yw == 0)
            neg_p = 0.02 + _sigmoid(margins[neg] + 2)
        half = per_round // 2
        take = np.concatenate([rng.choice(pos, min(half, 4 * len(pos))),
                               rng.choice(neg, min(half, 4 * len(neg)), p=neg_p / neg_p.sum())])
        rng.shuffle(take)
        for rows in np.array_split(take, max(1, len(take) // batch)):
            t = np.arange(WINDOW)[:, None]
            live = (t < size[None, rows])
            tok = inv[np.minimum(begin[None, rows] + t, len(inv) - 1)]
            used, at = np.unique(tok, return_inverse=True)
            at = at.reshape(tok.shape)
            cs = np.concatenate([chars[starts[u]:starts[u + 1]] for u in used])
            st = np.concatenate([[0], np.cumsum(lens[used])])
            x = net.embed(words[used], cs, st)
            _, g, dx = net.gradients(x[at], live.astype(np.float32), yw[rows])
            dx = dx * live[:, :, None]
            du = np.zeros_like(x)
            np.add.at(du, at.ravel(), dx.reshape(-1, 2 * DIM))
            g["E"], g["C"] = np.zeros_like(net.p["E"]), np.zeros_like(net.p["C"])
            np.add.at(g["E"], words[used], du[:, :DIM])
            np.add.at(g["C"], cs, np.repeat(du[:, DIM:] / np.sqrt(lens[used])[:, None], lens[used], 0))
            step += 1
            lr = rate * min(1, step / 20) * (0.2 if rnd >= rounds - 3 else 1)
            for k, v in net.p.items():
                m, s = state[k]
                sq = g[k] ** 2
                if k in "EC":  # one scale for a table: rare words don't get the steps of frequent ones
                    sq = np.full(1, sq.sum() / max(np.count_nonzero(sq), 1), np.float32) * 8
                m += 0.1 * (g[k] - m)
                s += 0.001 * (sq - s)
                v -= (lr * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        margins = scores(net, buf, off)[0]
    return net


def train(sample: DataFrame, **params) -> Net | None:
    """Fits on ``text, y`` rows, bounded by the caller."""
    rows = sorted((r.text.encode(), r.y) for r in sample.select("text", "y").collect())
    return fit([t for t, _ in rows], np.array([y for _, y in rows], float), **params)


def toxicity(model: Net | None, text: str = "text") -> Column:
    """Column expression: the highest window score of a text column."""
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            out = np.zeros(len(col))
            for lo, hi, buf, off in tk.chunks(col, 1 << 20):
                if model is not None:
                    best = _best(*scores(model, buf, off), hi - lo)
                    out[lo:hi] = np.where(np.isfinite(best), _sigmoid(
                        model.slope * np.maximum(best, -1e6) + model.shift), 0.0)
            yield pa.array(out)
    return F.arrow_udf(run, "double")(text_col(text))


def train_on_labels(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, max_rows: int = 3_000,
                    id_col: str = "doc_id", **params) -> Net | None:
    return train(labelled_sample(docs, labels, "toxic", max_rows, train_on, id_col), **params)


def classify(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id",
             threshold: float = 0.3, **params) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row; labels are read
    only where ``train_on`` (over ``__id``) holds."""
    model = train_on_labels(docs, labels, train_on, id_col=id_col, **params)
    held = ~F.coalesce(train_on, F.lit(True))
    return (docs.select(F.col(id_col), F.col(id_col).alias("__id"), toxicity(model).alias("score"))
            .select(id_col, held.alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
