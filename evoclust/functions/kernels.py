"""NumPy helpers run inside tasks (``mapInArrow`` / ``applyInPandas``).

They implement the few steps that are sequential or argmin-shaped by
definition: nearest micro-cluster with the radius test, the ordered outlier
fold of one batch, and the ordered replays of the two DBSCAN passes inside
one connected component.  Spark partitions, shuffles and groups the work;
these functions only see one Arrow batch or one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


# ---------------------------------------------------------------- helpers

def list_to_matrix(col: pa.Array, d: int) -> np.ndarray:
    """ARRAY<DOUBLE> Arrow column with d elements per row -> (n, d) float64."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, d))
    vals = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return vals.reshape(n, d)


def matrix_to_list(m: np.ndarray) -> pa.Array:
    n, d = m.shape if m.ndim == 2 else (len(m), 0)
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32) if n else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.reshape(-1), pa.float64()))


def decay_np(lam: float, dt):
    return np.power(2.0, -lam * np.asarray(dt, dtype=np.float64))


def radius_np(cf1: np.ndarray, cf2: np.ndarray, w: np.ndarray, radius_sum: bool = False):
    """Row-wise radius of (n, d) CFs with weights (n,)."""
    w = np.asarray(w, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        var = np.abs(cf2) / w[:, None] - np.abs(cf1 * cf1) / (w * w)[:, None]
    inner = var.sum(axis=1) if radius_sum else var.max(axis=1, initial=-np.inf)
    inner = np.maximum(inner, 0.0)
    return np.where(w > 1, np.sqrt(inner), np.inf)


def insert_np(w, cf1, cf2, last_edit, x, t, lam, clamp_late=False):
    """State after inserting points x (n, d) at times t into MCs (row-aligned)."""
    dt = np.asarray(t, np.float64) - np.asarray(last_edit, np.float64)
    if clamp_late:
        f = decay_np(lam, np.maximum(dt, 0.0))
        g = decay_np(lam, np.maximum(-dt, 0.0))
    else:
        f = decay_np(lam, dt)
        g = np.ones_like(f)
    w2 = w * f + g
    c1 = cf1 * f[:, None] + x * g[:, None]
    c2 = cf2 * f[:, None] + x * x * g[:, None]
    return w2, c1, c2


# ------------------------------------------------------ nearest + radius

def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances by one product (see ``rounding``)."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def rounding(a: np.ndarray, b: np.ndarray) -> float:
    """How far the root of a value of ``square_distances`` may be off."""
    top = max(float((a * a).sum(1).max(initial=0.0)), float((b * b).sum(1).max(initial=0.0)))
    return float(np.sqrt(1e-14 * (a.shape[1] + 8) * max(top, 1e-300)))


def nearest(x: np.ndarray, centroids: np.ndarray, block_elems: int = 1 << 22):
    """Index (first among ties) and distance of the nearest centroid per row."""
    n = len(x)
    k = len(centroids)
    idx = np.full(n, -1, dtype=np.int64)
    dist = np.full(n, np.inf)
    if k == 0 or n == 0:
        return idx, dist
    d = x.shape[1]
    rows = max(1, block_elems // max(1, k * d))
    for s in range(0, n, rows):
        e = min(n, s + rows)
        diff = x[s:e, None, :] - centroids[None, :, :]
        dd = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
        j = np.argmin(dd, axis=1)
        idx[s:e] = j
        dist[s:e] = dd[np.arange(e - s), j]
    return idx, dist


class CentroidIndex:
    """Nearest centroid with few distances: about sqrt(K) centroids are pivots,
    every centroid lies in the cell of its nearest pivot, and a point looks at
    the cells whose nearest possible centroid is not farther than its best so
    far.  Gives the rows of :func:`nearest`, ties included; ``work`` counts the
    distances taken."""

    LEAST = 256  # fewer centroids are compared one by one

    def __init__(self, centroids: np.ndarray):
        k = len(centroids)
        self.work, self.centroids, self.pivots = 0, centroids, None
        if k < self.LEAST or not np.isfinite(centroids).all():
            return
        pick = np.sort(np.random.default_rng(0).choice(k, int(np.sqrt(k)), replace=False))
        self.pivots = centroids[pick]
        cell, far = np.empty(k, np.int64), np.empty(k)
        step = max(1, (1 << 22) // len(pick))
        for lo in range(0, k, step):
            x = centroids[lo:lo + step]
            cell[lo:lo + step] = square_distances(x, self.pivots).argmin(1)
            diff = x - self.pivots[cell[lo:lo + step]]
            far[lo:lo + step] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        self.order = np.argsort(cell, kind="stable")  # by place within a cell
        self.bounds = np.searchsorted(cell[self.order], np.arange(len(pick) + 1))
        self.centroids = centroids[self.order]
        self.radius = np.full(len(pick), -np.inf)
        np.maximum.at(self.radius, cell, far)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.pivots is None:
            self.work += len(x) * len(self.centroids)
            return nearest(x, self.centroids)
        idx, dist = np.full(len(x), -1, np.int64), np.full(len(x), np.inf)
        step = max(1, (1 << 22) // len(self.pivots))
        for lo in range(0, len(x), step):
            self._block(x[lo:lo + step], idx[lo:lo + step], dist[lo:lo + step])
        return idx, dist

    def _block(self, x, idx, dist):
        least = np.sqrt(square_distances(x, self.pivots)) - rounding(x, self.pivots)
        self.work += least.size
        some = np.flatnonzero(self.bounds[1:] > self.bounds[:-1])
        home = some[least[:, some].argmin(1)]
        least -= self.radius
        for c in np.unique(home):
            self._look(c, np.flatnonzero(home == c), x, idx, dist)
        least[np.arange(len(x)), home] = np.inf
        for c in some[(least[:, some] <= dist[:, None]).any(0)]:
            self._look(c, np.flatnonzero(least[:, c] <= dist), x, idx, dist)

    def _look(self, c, rows, x, idx, dist):
        a, b = self.bounds[c], self.bounds[c + 1]
        self.work += len(rows) * (b - a)
        j, d = nearest(x[rows], self.centroids[a:b])
        j = self.order[a:b][j]
        better = (d < dist[rows]) | ((d == dist[rows]) & (j < idx[rows]))
        idx[rows[better]], dist[rows[better]] = j[better], d[better]


def nearest_admissible(x, t, st: dict, lam, eps, radius_sum=False, clamp_late=False):
    """Nearest MC by undecayed centroid, kept only if the radius after a
    tentative insert stays <= eps.  Returns (idx or -1, distance, accepted)."""
    k = len(st["weight"])
    n = len(x)
    if k == 0 or n == 0:
        return np.full(n, -1, np.int64), np.full(n, np.inf), np.zeros(n, bool)
    idx, dist = st["index"].nearest(x) if "index" in st else nearest(x, st["centroid"])
    w2, c1, c2 = insert_np(st["weight"][idx], st["cf1"][idx], st["cf2"][idx],
                           st["last_edit"][idx], x, t, lam, clamp_late)
    ok = radius_np(c1, c2, w2, radius_sum) <= eps
    return idx, dist, ok


def state_arrays(rows, d: int) -> dict:
    """Collected state rows (ordered by ord) -> dict of arrays."""
    k = len(rows)
    cf1 = np.array([r["cf1"] for r in rows], dtype=np.float64).reshape(k, d)
    cf2 = np.array([r["cf2"] for r in rows], dtype=np.float64).reshape(k, d)
    w = np.array([r["weight"] for r in rows], dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        cen = np.where((w > 0)[:, None], cf1 / np.where(w > 0, w, 1.0)[:, None], cf1)
    return {
        "ord": np.array([r["ord"] for r in rows], dtype=np.int64),
        "cf1": cf1, "cf2": cf2, "weight": w, "centroid": cen, "index": CentroidIndex(cen),
        "last_edit": np.array([r["last_edit"] for r in rows], dtype=np.float64),
    }


# ------------------------------------------------- ordered outlier fold

class GrowingMCs:
    """Micro-clusters opened by one sequential fold, kept as arrays."""

    def __init__(self, d: int, num_labels: int):
        self.d, self.L, self.n = d, num_labels, 0
        cap = 16
        self.cf1 = np.zeros((cap, d))
        self.cf2 = np.zeros((cap, d))
        self.w = np.zeros(cap)
        self.t0 = np.zeros(cap, np.int64)
        self.le = np.zeros(cap, np.int64)
        self.pts = np.zeros(cap, np.int64)
        self.lbl = np.zeros((cap, num_labels), np.int64)
        self.first_seq = np.zeros(cap, np.int64)

    def _grow(self):
        for name in ("cf1", "cf2", "w", "t0", "le", "pts", "lbl", "first_seq"):
            a = getattr(self, name)
            b = np.zeros((len(a) * 2,) + a.shape[1:], a.dtype)
            b[: len(a)] = a
            setattr(self, name, b)

    def open(self, x, t, label, seq):
        if self.n == len(self.w):
            self._grow()
        i = self.n
        self.cf1[i] = x
        self.cf2[i] = x * x
        self.w[i] = 1.0
        self.t0[i] = t
        self.le[i] = t
        self.pts[i] = 1
        self.lbl[i] = 0
        self.lbl[i, label] += 1
        self.first_seq[i] = seq
        self.n += 1
        return i

    def centroids(self):
        w = self.w[: self.n]
        c = self.cf1[: self.n]
        return np.where((w > 0)[:, None], c / np.where(w > 0, w, 1.0)[:, None], c)


def admit_fold(t, seq, x, labels, o0, lam, eps, num_labels,
               radius_sum=False, clamp_late=False, resume=None):
    """Sequential admission of unassigned points (already in time order).

    Each point tries one o-MC: the nearest one opened earlier in this fold,
    or -- while none is open -- the first existing o-MC ``o0`` (dict or None).
    It joins when the radius stays <= eps, else it opens a new o-MC.
    ``resume`` continues an earlier call with its (o0, GrowingMCs).
    Returns (o0 after the fold, GrowingMCs, number of merges).
    """
    d = x.shape[1] if x.ndim == 2 else 0
    if resume is not None:
        cur, new = resume
    else:
        new = GrowingMCs(d, num_labels)
        cur = None
        if o0 is not None:
            cur = {k: (np.array(v, dtype=np.float64) if k in ("cf1", "cf2") else v)
                   for k, v in o0.items()}
            cur["lbl_counts"] = list(cur["lbl_counts"])
            cur["touched"] = False
    merges = 0
    for i in range(len(t)):
        ti, xi, li = int(t[i]), x[i], int(labels[i])
        merged = False
        if cur is not None or new.n > 0:
            if new.n > 0:
                cen = new.centroids()
                diff = cen - xi
                dd = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                j = int(np.argmin(dd))
                w2, c1, c2 = insert_np(new.w[j:j + 1], new.cf1[j:j + 1], new.cf2[j:j + 1],
                                       new.le[j:j + 1], xi[None, :], [ti], lam, clamp_late)
                if radius_np(c1, c2, w2, radius_sum)[0] <= eps:
                    new.w[j], new.cf1[j], new.cf2[j] = w2[0], c1[0], c2[0]
                    new.le[j] = ti if not clamp_late else max(ti, int(new.le[j]))
                    new.pts[j] += 1
                    new.lbl[j, li] += 1
                    merged = True
            else:
                w2, c1, c2 = insert_np(np.array([cur["weight"]]), cur["cf1"][None, :],
                                       cur["cf2"][None, :], [cur["last_edit"]],
                                       xi[None, :], [ti], lam, clamp_late)
                if radius_np(c1, c2, w2, radius_sum)[0] <= eps:
                    cur["weight"], cur["cf1"], cur["cf2"] = float(w2[0]), c1[0], c2[0]
                    cur["last_edit"] = ti if not clamp_late else max(ti, int(cur["last_edit"]))
                    cur["pts"] = int(cur["pts"]) + 1
                    cur["lbl_counts"][li] += 1
                    cur["touched"] = True
                    merged = True
        if merged:
            merges += 1
        else:
            new.open(xi, ti, li, int(seq[i]))
    return cur, new, merges


# ------------------------------------------- DBSCAN replays (per component)

def _adjacency(n, src, dst):
    """Sorted neighbour lists of local node ids 0..n-1 from directed edges."""
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    starts = np.searchsorted(src, np.arange(n + 1))
    return [dst[starts[i]:starts[i + 1]] for i in range(n)]


def replay_init_paper(x, labels, src, dst, min_weight, num_labels):
    """Paper reading of the initialisation (Q2): in order, an untagged point
    whose neighbourhood (itself plus its untagged neighbours) weighs more
    than ``min_weight`` (beta*mu) becomes a p-MC with those neighbours; all
    of them leave the sample; no recursive expansion."""
    n = len(x)
    adj = _adjacency(n, np.asarray(src, np.int64), np.asarray(dst, np.int64))
    tag = np.zeros(n, bool)
    out = []
    for i in range(n):
        if tag[i]:
            continue
        a = adj[i]
        nb = a[~tag[a]] if len(a) else a
        if len(nb) + 1 > min_weight:
            members = np.concatenate([[i], nb]).astype(np.int64)
            tag[members] = True
            lbl = np.zeros(num_labels, np.int64)
            np.add.at(lbl, labels[members].astype(np.int64), 1)
            out.append({"seed": i, "cf1": x[members].sum(axis=0), "cf2": (x[members] ** 2).sum(axis=0),
                        "weight": float(len(members)), "lbl": lbl})
    return out, int((~tag).sum())


def replay_init(x, labels, src, dst, mu, num_labels, zero_local=-1,
                pretag_zero=False, tag_seed=False):
    """Greedy density initialisation over one connected component.

    Nodes are local ids in global file order.  A node whose untagged
    neighbourhood is larger than ``mu`` seeds a micro-cluster and absorbs its
    neighbours, recursively through neighbours that are themselves dense.
    ``zero_local`` is the local id of global point 0 (or -1); reference
    semantics tag that point whenever a seed is opened.
    Returns (list of MCs as dicts, number of nodes left untagged).
    """
    n = len(x)
    adj = _adjacency(n, np.asarray(src, np.int64), np.asarray(dst, np.int64))
    tag = np.zeros(n, bool)
    if pretag_zero and zero_local >= 0:
        tag[zero_local] = True
    out = []

    def nbh(i):
        a = adj[i]
        return a[~tag[a]] if len(a) else a

    for i in range(n):
        first = nbh(i)
        if len(first) > mu:
            if zero_local >= 0 and not tag_seed:
                tag[zero_local] = True
            if tag_seed:
                tag[i] = True
                first = first[first != i]
            cf1 = x[i].copy()
            cf2 = x[i] * x[i]
            w = 1.0
            lbl = np.zeros(num_labels, np.int64)
            lbl[int(labels[i])] += 1
            tag[first] = True
            stack = [[first, 0]]
            while stack:
                top = stack[-1]
                lst, p = top
                if p >= len(lst):
                    stack.pop()
                    continue
                top[1] = p + 1
                j = int(lst[p])
                cf1 = cf1 + x[j]
                cf2 = cf2 + x[j] * x[j]
                w += 1.0
                lbl[int(labels[j])] += 1
                nxt = nbh(j)
                if len(nxt) > mu:
                    tag[nxt] = True
                    stack.append([nxt, 0])
            out.append({"seed": i, "cf1": cf1, "cf2": cf2, "weight": w, "lbl": lbl})
    return out, int((~tag).sum())
