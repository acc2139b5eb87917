"""Column expressions over cluster features (cf1, cf2, weight, times).

Arrays are ARRAY<DOUBLE>; every function returns a ``Column`` so that the
state operators stay inside Catalyst.  ``lam``/``eps``/... are Python
scalars and fold into literals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decay(lam: float, dt) -> Column:
    """2^(-lam*dt); dt may be negative (a late point grows the factor)."""
    return F.pow(F.lit(2.0), F.lit(-float(lam)) * _c(dt))


def decay_clamped(lam: float, dt) -> Column:
    """Paper reading: never grow, dt below 0 counts as 0."""
    return decay(lam, F.greatest(_c(dt), F.lit(0)))


def scale(arr, f) -> Column:
    """Element-wise arr * f."""
    f = _c(f)
    return F.transform(_c(arr), lambda x: x * f)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def centroid(cf1, weight) -> Column:
    """cf1 / weight when weight > 0, else cf1."""
    w = _c(weight)
    return F.when(w > 0, F.transform(_c(cf1), lambda x: x / w)).otherwise(_c(cf1))


def radius(cf1, cf2, weight, radius_sum: bool = False) -> Column:
    """Infinity when weight <= 1; else sqrt of the largest per-dimension
    variance (reference) or of their sum (paper)."""
    w = _c(weight)
    var = F.zip_with(
        _c(cf1), _c(cf2),
        lambda a, b: F.abs(b) / w - F.abs(a * a) / (w * w),
    )
    if radius_sum:
        inner = F.greatest(F.aggregate(var, F.lit(0.0), lambda acc, v: acc + v), F.lit(0.0))
    else:
        inner = F.greatest(F.array_max(var), F.lit(0.0))
    return F.when(w > 1, F.sqrt(inner)).otherwise(F.lit(INF))


def euclid(x, c) -> Column:
    """L2 distance of two arrays."""
    sq = F.zip_with(_c(x), _c(c), lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def radius_after_insert(cf1, cf2, weight, last_edit, x, t, lam: float, *,
                        radius_sum: bool = False, clamp_late: bool = False) -> Column:
    """Radius of the MC if the point (x, t) were inserted (state unchanged)."""
    dt = _c(t) - _c(last_edit)
    f = decay_clamped(lam, dt) if clamp_late else decay(lam, dt)
    g = decay_clamped(lam, -dt) if clamp_late else F.lit(1.0)
    w2 = _c(weight) * f + g
    c1 = F.zip_with(_c(cf1), _c(x), lambda a, b: a * f + b * g)
    c2 = F.zip_with(_c(cf2), _c(x), lambda a, b: a * f + b * b * g)
    return radius(c1, c2, w2, radius_sum)


def array_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0).cast("long"), lambda acc, v: acc + v)


def correct_pts(lbl_counts) -> Column:
    return F.array_max(_c(lbl_counts))


def dominant_label(lbl_counts) -> Column:
    """Lowest label index holding the largest count."""
    lc = _c(lbl_counts)
    return (F.array_position(lc, F.array_max(lc)) - 1).cast("int")


def purity(lbl_counts) -> Column:
    """max(counts) / sum(counts)."""
    lc = _c(lbl_counts)
    return F.array_max(lc).cast("double") / array_sum(lc).cast("double")


def prune_threshold(lam: float, clock, t0, tp: int, fixed: bool = False) -> Column:
    """Outlier weight threshold xi(t, t0).

    Reference form lacks the ``- 1`` of the numerator (always negative, so no
    o-MC is ever pruned); ``fixed`` gives the paper's form (age 0 -> 1.0).
    """
    num = F.pow(F.lit(2.0), F.lit(-float(lam)) * (_c(clock) - _c(t0) + F.lit(tp)))
    if fixed:
        num = num - F.lit(1.0)
    den = F.lit(2.0 ** (-float(lam) * tp) - 1.0)
    return num / den


def promotable(weight, beta: float, mu: float) -> Column:
    return _c(weight) >= F.lit(float(beta) * float(mu))


def add_weight(weight, n) -> Column:
    """Weight plus n without decay."""
    return _c(weight) + _c(n)


def merge_cf(a, b) -> Column:
    """Sum of two CF vectors (used when merging micro-clusters)."""
    return add(a, b)


def insert_point(cf1, cf2, weight, last_edit, pts, lbl_counts, x, t, label, lam: float, n: int = 1,
                 clamp_late: bool = False) -> Column:
    """F8: the MC after inserting point (x, t, label) n times, as a struct
    ``weight, cf1, cf2, last_edit, pts, lbl_counts`` (decay to t, add n, x,
    x*x; count the label)."""
    dt = _c(t) - _c(last_edit)
    f = decay_clamped(lam, dt) if clamp_late else decay(lam, dt)
    g = decay_clamped(lam, -dt) if clamp_late else F.lit(1.0)
    le = F.greatest(_c(last_edit), _c(t)) if clamp_late else _c(t)
    lab = _c(label)
    return F.struct(
        (_c(weight) * f + F.lit(float(n)) * g).alias("weight"),
        F.zip_with(_c(cf1), _c(x), lambda a, b: a * f + b * g).alias("cf1"),
        F.zip_with(_c(cf2), _c(x), lambda a, b: a * f + b * b * g).alias("cf2"),
        le.cast("long").alias("last_edit"),
        (_c(pts) + F.lit(n)).cast("long").alias("pts"),
        F.transform(_c(lbl_counts), lambda c, i: F.when(i == lab, c + 1).otherwise(c)).alias("lbl_counts"),
    )
