"""Generated points, and the clustering written point by point in plain
Python: the oracle of the Spark runs."""

import math

import numpy as np


def drifting_blobs(n, seed, labels=3, shift=0.0):
    """``[(x, y, label)]``: three blobs that move on, with 15 % noise."""
    rng = np.random.default_rng(seed)
    centres = np.array([[0.0, 0.0], [3.0, 1.0], [1.0, 4.0]]) + shift
    out = []
    for i in range(n):
        k = int(rng.integers(0, labels))
        x = rng.uniform(-2, 6, 2) if rng.random() < 0.15 else centres[k] + i / n * 0.8 + rng.normal(0, 0.2, 2)
        out.append((float(x[0]), float(x[1]), k))
    return out


def _dist(a, b):
    return math.sqrt(sum((u - v) ** 2 for u, v in zip(a, b)))


class Sequential:
    """Reference semantics, with the outlier threshold that prunes."""

    def __init__(self, p):
        self.p, self.P, self.O = p, [], []
        self.clock = self.period = 0
        self.next_p = self.next_o = 0

    def init(self, points):
        xs = [pt[:2] for pt in points]
        near = [[j for j in range(len(xs)) if j != i and _dist(xs[i], xs[j]) < self.p.init_epsilon]
                for i in range(len(xs))]
        tagged = set()

        def free(i):
            return [j for j in near[i] if j not in tagged]

        def absorb(mc, members):
            tagged.update(members)
            for j in members:
                self._add(mc, xs[j], points[j][2])
                more = free(j)
                if len(more) > self.p.mu:
                    absorb(mc, more)
        for i in range(len(xs)):
            first = free(i)
            if len(first) > self.p.mu:
                tagged.add(0)
                mc = self._new(i, 0)
                self._add(mc, xs[i], points[i][2])
                absorb(mc, [j for j in first])
                mc["pts"] = 0
                self.P.append(mc)
                self.next_p = i + 1

    def _new(self, ord_, t):
        return {"ord": ord_, "w": 0.0, "c1": [0.0, 0.0], "c2": [0.0, 0.0], "t0": t, "le": t, "pts": 0,
                "lbl": [0] * self.p.num_labels}

    @staticmethod
    def _add(mc, x, label):
        mc["w"] += 1.0
        mc["c1"] = [a + b for a, b in zip(mc["c1"], x)]
        mc["c2"] = [a + b * b for a, b in zip(mc["c2"], x)]
        mc["pts"] += 1
        mc["lbl"][label] += 1

    def _decay(self, mc, t):
        f = 2.0 ** (-self.p.lam * (t - mc["le"]))
        mc["w"] *= f
        mc["c1"] = [a * f for a in mc["c1"]]
        mc["c2"] = [a * f for a in mc["c2"]]
        mc["le"] = t

    def _nearest(self, mcs, x):
        return min(mcs, key=lambda m: (_dist(x, [a / m["w"] for a in m["c1"]]), m["ord"]), default=None)

    def _fits(self, mc, x, t):
        f = 2.0 ** (-self.p.lam * (t - mc["le"]))
        w = mc["w"] * f + 1.0
        var = [abs(q * f + v * v) / w - abs((a * f + v) ** 2) / (w * w) for a, q, v in zip(mc["c1"], mc["c2"], x)]
        return w > 1 and math.sqrt(max(*var, 0.0)) <= self.p.epsilon

    def batch(self, rows):
        """``rows``: (t, x, y, label) in (time, seq) order."""
        p = self.p
        if not rows:
            return
        to = []
        for t, *x, _ in rows:  # against the clusters before the batch
            mc = self._nearest(self.P, x)
            if mc is None or not self._fits(mc, x, t):
                mc = self._nearest(self.O, x)
                if mc is not None and not self._fits(mc, x, t):
                    mc = None
            to.append(mc)
        touched, fresh, promoted = [], [], []
        for mc in self.P + self.O:
            mc["pts"] = 0
        for (t, *x, label), mc in zip(rows, to):
            if mc is not None:
                if not any(mc is m for m in touched):
                    touched.append(mc)
                    mc["lbl"] = [0] * p.num_labels  # labels are those of the batch
                self._decay(mc, t)
                self._add(mc, x, label)
        cells = {}
        for (t, *x, label), mc in zip(rows, to):
            if mc is not None:
                continue
            if p.admit_mode == "cells":
                key = tuple(math.floor(v / (2 * p.epsilon)) for v in x)
                if key not in cells:
                    cells[key] = self._new(None, t)
                    fresh.append(cells[key])
                mc = cells[key]
            else:
                mc = (min(fresh, key=lambda m: _dist(x, [a / m["w"] for a in m["c1"]])) if fresh
                      else min(self.O, key=lambda m: m["ord"], default=None))
                if mc is None or not self._fits(mc, x, t):
                    mc = self._new(None, t)
                    fresh.append(mc)
            if mc["w"] > 0:
                self._decay(mc, t)
            self._add(mc, x, label)
        for mc in fresh:
            mc["ord"] = self.next_o
            self.next_o += 1
        self.clock = max([self.clock] + [r[0] for r in rows])
        hit = [m for m in self.O if any(m is q for q in touched)] + fresh
        promoted = sorted((m for m in hit if m["w"] >= p.beta * p.mu), key=lambda m: -m["ord"])
        self.O = [m for m in self.O + fresh if not any(m is q for q in promoted)]
        for mc in promoted:
            mc["ord"] = self.next_p
            self.next_p += 1
        self.P += promoted
        if self.period and self.period % 4 == 0:
            for mc in self.P + self.O:
                self._decay(mc, self.clock)
            xi = lambda m: ((2.0 ** (-p.lam * (self.clock - m["t0"] + p.tp)) - 1)
                            / (2.0 ** (-p.lam * p.tp) - 1))
            self.P = [m for m in self.P if m["w"] >= p.beta * p.mu]
            self.O = [m for m in self.O if m["w"] >= xi(m)]
        self.period += 1

    def rows(self):
        return sorted((kind, m["ord"], m["t0"], m["le"], m["pts"], tuple(m["lbl"]),
                       *(round(v, 7) + 0.0 for v in (m["w"], *m["c1"], *m["c2"])))
                      for kind, mcs in (("p", self.P), ("o", self.O)) for m in mcs)


def state_rows(state):
    return sorted((r.kind, r.ord, r.t0, r.last_edit, r.pts, tuple(r.lbl_counts),
                   *(round(v, 7) + 0.0 for v in (r.weight, *r.cf1, *r.cf2))) for r in state.collect())


def assert_same(got, want):
    assert [r[:6] for r in got] == [r[:6] for r in want]
    for g, w in zip(got, want):
        np.testing.assert_allclose(g[6:], w[6:], rtol=1e-6, atol=1e-6)
