"""Mixing documents to target domain weights, with soft membership.

1. A multinomial naive Bayes model over hashed words, counted in Spark from
   at most ``max_rows`` labelled documents, gives each document a posterior
   over domains; log-likelihoods are divided by the square root of the
   length, so that long texts keep a soft membership.
2. Document rates ``r_i >= 0`` minimise
   ``sum_d w_d (sum_i tokens_i p_id r_i - T_d)^2``: the expected tokens of
   each domain meet its target.  Accelerated projected gradient steps from
   ``r = 1`` in the metric of the document lengths: ``y = r + beta (r -
   previous r)``, ``r_i = max(0, y_i - eta sum_d p_id w_d rho_d)`` with the
   residuals ``rho`` at ``y`` of the whole table, which are one small sum
   over the documents a step.  ``w_d = 1 / M_dd`` and ``eta`` is one over the
   largest eigenvalue of the weighted matrix ``M = sum_i tokens_i p_i p_i'``.

A step needs a sum per domain, nothing else leaves the tasks; the rates of a
step are recomputed from the step vectors, and written to the shared folder
every ``every`` steps.

Domains and targets: ``targets`` maps the domains to weights; labelled rows
whose domain isn't listed are not used.  ``T_d`` is the weight's share of
``budget`` tokens (all tokens of the table if none is given).  Null and empty
texts have no tokens: the prior as posterior, and a rate like others', which
changes no total.  Repeated rows each have a rate.  A target that can't be
met is met in the least-squares sense.  Other columns are not read.  An empty
table gives an empty result; without labels posteriors are uniform.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoclust.llm.common import WORD_SEP, smallest_hashes, text_col
from evoclust.session import cut

BUCKETS = 4096
MISSED = 1e-3  # share of the budget by which a domain may miss its target


def label_domain() -> Column:
    """Domain of a row of ``labels``."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


TARGETS = {"good": 0.85, "low": 0.10, "toxic": 0.05}


def _bucketed(docs: DataFrame, *keep: str) -> DataFrame:
    """A row a word: ``keep`` columns and the word's bucket (-1: no word)."""
    word = F.explode_outer(F.split(F.lower(text_col()), WORD_SEP)).alias("__w")
    bucket = F.when(F.col("__w") != "", F.pmod(F.xxhash64("__w"), F.lit(BUCKETS)).cast("int")).otherwise(-1)
    return docs.select(*keep, word).select(*keep, bucket.alias("b"))


def train(docs: DataFrame, labels: DataFrame, domains: list[str], domain: Column, id_col: str = "doc_id",
          max_rows: int = 4_000) -> tuple[list[float], list[list[float]]]:
    """Log prior of each domain, and log weight of each bucket per domain."""
    lab = (labels.select(F.col(id_col).alias("__id"), domain.alias("__d"))
           .filter(F.col("__id").isNotNull() & F.col("__d").isin(domains)))
    # only ids that have a document count towards max_rows
    ids = docs.select(F.col(id_col).alias("__id")).filter("__id is not null").distinct()
    lab = cut(lab.groupBy("__id").agg(F.min("__d").alias("__d")).join(ids, "__id", "left_semi"), "mix-labels")
    lab = smallest_hashes(lab, "__id", max_rows)
    # at most max_rows rows of two short columns
    rows = (docs.select(F.col(id_col).alias("__id"), "text").join(F.broadcast(lab), "__id"))
    # at most domains x buckets numbers
    counts = _bucketed(rows, "__d").groupBy("__d", "b").count().collect()
    sizes = {r["__d"]: r["count"] for r in rows.groupBy("__d").count().collect()}
    k, n = len(domains), sum(sizes.values())
    prior = [math.log((sizes.get(d, 0) + 1.0) / (n + k)) for d in domains]
    table = np.full((k, BUCKETS), 0.5)
    for r in counts:
        if r.b >= 0:
            table[domains.index(r["__d"]), r.b] += r["count"]
    return prior, np.log(table / table.sum(1, keepdims=True)).tolist()


def posteriors(docs: DataFrame, model, domains: list[str], id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, p_<k>`` for every row, and its row number."""
    prior, table = model
    base = np.mean(table, 0)
    rows = _bucketed(docs.select(F.col(id_col), "text", F.monotonically_increasing_id().alias("__row")), "__row", id_col)
    known = F.col("b") >= 0
    sums = []
    for k in range(len(domains)):
        w = F.split(F.lit(",".join(f"{x:.5f}" for x in np.array(table[k]) - base)), ",").cast("array<double>")
        sums.append(F.sum(F.when(known, F.get(w, F.col("b"))).otherwise(0.0)).alias(f"l{k}"))
    got = rows.groupBy("__row", id_col).agg(F.count(F.when(known, 1)).alias("n_tokens"), *sums)
    root = F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))
    z = [F.col(f"l{k}") / root + F.lit(prior[k]) for k in range(len(domains))]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    got = got.select("__row", id_col, "n_tokens", *[F.exp(x - top).alias(f"e{k}") for k, x in enumerate(z)])
    total = reduce(lambda a, b: a + b, [F.col(f"e{k}") for k in range(len(domains))])
    return got.select("__row", id_col, "n_tokens", *[(F.col(f"e{k}") / total).alias(f"p{k}") for k in range(len(domains))])


def fit_rates(rows: DataFrame, targets: list[float], every: int = 8, tolerance: float = 1e-5, patience: int = 40,
              budget: float | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``rows`` (``n_tokens, p0..``) with a column ``rate``; the domains'
    expected tokens under the rates, and the targets.  Steps go on until every
    domain is within ``tolerance`` of the budget of its target, or, where the
    targets can't be met, until ``patience`` steps have not brought the
    weighted squares down by a thousandth."""
    k = len(targets)
    p = [F.col(f"p{d}") for d in range(k)]
    rows = cut(rows.withColumns({"rate": F.lit(1.0), "__last": F.lit(1.0)}), "mix-rows")
    cells = [F.sum(F.col("n_tokens") * p[a] * p[b]).alias(f"m{a}_{b}") for a in range(k) for b in range(k)]
    first = rows.agg(F.sum("n_tokens"), *cells).first()
    total = float(first[0] or 0)
    goal = np.array(targets, float) / sum(targets) * (budget or total)
    m = np.array([x or 0.0 for x in first[1:]], float).reshape(k, k)
    w = 1.0 / np.maximum(np.diag(m), 1e-9 * max(total, 1.0))
    root = np.sqrt(w)
    eta = 1.0 / max(float(np.linalg.eigvalsh(root[:, None] * m * root[None, :]).max()), 1e-12)
    taken: list[list[float]] = []  # of each step since the last written table: beta, then eta * w * rho

    def ahead(r: Column, last: Column, beta: Column) -> Column:
        return r + beta * (r - last)

    def state() -> Column:
        """Rate and the rate before it, after the steps taken."""
        now = F.struct(F.col("rate").alias("r"), F.col("__last").alias("q"))
        if not taken:
            return now
        flat = F.split(F.lit(",".join(repr(float(x)) for u in taken for x in u)), ",").cast("array<double>")
        at = lambda i, d: F.get(flat, i * (k + 1) + d)
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(taken) - 1)), now, lambda s, i: F.struct(
            F.greatest(F.lit(0.0), reduce(lambda a, b: a - b, [p[d] * at(i, d + 1) for d in range(k)],
                                          ahead(s.r, s.q, at(i, 0)))).alias("r"), s.r.alias("q")))

    def totals(beta: float) -> np.ndarray:
        now = rows.withColumn("__s", state())
        x = ahead(F.col("__s.r"), F.col("__s.q"), F.lit(beta))
        return np.array([v or 0.0 for v in now.agg(*[F.sum(F.col("n_tokens") * x * c) for c in p]).first()], float)

    t, got, least, since = 1.0, np.zeros(k), math.inf, 0
    while True:
        nxt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        beta = (t - 1) / nxt if least < math.inf else 0.0
        t = nxt
        rho = totals(beta) - goal
        off = float((w * rho * rho).sum())
        least, since = (off, 0) if off < 0.999 * least else (least, since + 1)
        if np.abs(rho).max() <= tolerance * max(total, 1.0) or since >= patience:
            got = totals(0.0)  # of the rates, which the place ahead of them only approaches
            if np.abs(got - goal).max() <= 2 * tolerance * max(total, 1.0) or since >= patience:
                break
        taken.append([beta, *(eta * w * rho)])
        if len(taken) == every:
            rows = cut(rows.withColumn("__s", state()).withColumns({"rate": F.col("__s.r"), "__last": F.col("__s.q")})
                       .drop("__s"), "mix-rows")
            taken.clear()
    return rows.withColumn("rate", state()["r"]).drop("__last"), got, goal


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: Column | None = None,
        id_col: str = "doc_id", max_rows: int = 4_000, train_docs: DataFrame | None = None, **params) -> DataFrame:
    """``id_col, n_tokens, p_<domain> ..., rate`` for every row.  The model is
    trained on ``train_docs`` (``docs`` if not given): rows that a filter has
    taken out of ``docs`` still say what their domain looks like.  Warns of
    targets that are not reached."""
    targets = targets or TARGETS
    domains = list(targets)
    model = train(docs if train_docs is None else train_docs, labels, domains,
                  label_domain() if domain is None else domain, id_col, max_rows)
    rows, got, goal = fit_rates(posteriors(docs, model, domains, id_col), list(targets.values()), **params)
    missed = {d: (float(a), float(b)) for d, a, b in zip(domains, got, goal) if abs(a - b) > MISSED * goal.sum()}
    if missed:
        warnings.warn(f"mixing targets not reached (tokens, target): {missed}", stacklevel=2)
    return rows.select(F.col(id_col), "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)], "rate")
