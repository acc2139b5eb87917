"""Scores of the trained models, recomputed row by row from their parameters."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoclust.llm import fm_quality, gbt_quality, gru_toxicity, mixing
from evoclust.llm import textkit as tk
from evoclust.llm.common import labelled_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n", "one", "x" * 3000, "ÜBER über été", "*** ### !!!\n*** ### !!!\n", "word " * 4000, "a b c a b c a b c " * 30, "\x01 \x7f é"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    vocab = [a + b for a in "kltmnp" for b in ("ano", "eri", "ulu", "ost", "ida")]
    rows, lab = [], []
    for i in range(200):
        toxic, low = int(i % 4 == 0), int(i % 5 == 0)
        w = list(rng.choice(vocab, rng.integers(40, 160)))
        if toxic:
            w[3:3] = ["stinker", "Stinkers"]
        rows.append((i, " ".join(x + "***" if low else x for x in w)))
        lab.append((i, 1 - low, toxic))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + rows[:2] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, predicted string, score double")
    return docs.repartition(3), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")


def _bytes(text):
    b = (text or "").encode()
    return np.frombuffer(b, np.uint8), np.array([0, len(b)])


def _sigmoid(z):
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_factorisation_machine_pair_by_pair(table):
    docs, lab = table
    model = fm_quality.train(labelled_sample(docs, lab, "quality", 400), bits=10, epochs=2, min_steps=50)
    for r in docs.select("text", fm_quality.score(docs, model).alias("s")).collect():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        feats = {}
        for w in words:
            b = np.frombuffer(w.encode(), np.uint8)
            f = int(tk.span_hash(b, np.array([0]), np.array([len(b)]))[0] >> np.uint64(64 - 10))
            feats[f] = feats.get(f, 0) + 1
        norm = math.sqrt(sum(feats.values()))
        x = [(f, math.sqrt(c) / norm) for f, c in feats.items()]
        stats = tk.ratios(tk.text_stats(*_bytes(r.text)))[0]
        x += [((1 << 10) + k, min(4, max(-4, (v - m) / s)) * 0.3) for k, (v, m, s) in enumerate(zip(stats, model.mean, model.scale))]
        if len(x) > 120:
            continue
        z = model.w0 + sum(model.w[f] * a for f, a in x)
        z += sum(float(model.v[f] @ model.v[g]) * a * b for i, (f, a) in enumerate(x) for g, b in x[:i])
        assert abs(r.s - _sigmoid(z)) < 1e-5


def test_trees_node_by_node(table):
    docs, lab = table
    model = gbt_quality.train(labelled_sample(docs, lab, "quality", 400))
    assert len(model.roots) > 10
    by_text = {r.text: r for r in docs.select("text").distinct().collect()}
    for r in gbt_quality.judge(docs.withColumn("doc_id", F.col("text")), model).collect():
        x = tk.ratios(tk.text_stats(*_bytes(r.doc_id)))[0]
        z = model.prior
        for k in model.roots:
            while model.left[k] != k:
                k = model.left[k] if x[model.feature[k]] <= model.threshold[k] else model.right[k]
            z += model.value[k]
        assert abs(r.score - _sigmoid(z)) < 1e-9 and r.doc_id in by_text
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.score >= 0.5)


def _gru(p, d, xs):
    """States of one direction, word after word."""
    h, out = np.zeros(gru_toxicity.HID), []
    n = gru_toxicity.HID
    for x in xs if d == "f" else xs[::-1]:
        g, u = x @ p["W" + d] + p["b" + d], h @ p["U" + d]
        z, r = (1 / (1 + np.exp(-(g[k * n:(k + 1) * n] + u[k * n:(k + 1) * n]))) for k in (0, 1))
        h = h + z * (np.tanh(g[2 * n:] + r * u[2 * n:]) - h)
        out.append(h)
    return out if d == "f" else out[::-1]


def test_network_window_by_window(table):
    docs, lab = table
    net = gru_toxicity.train(labelled_sample(docs, lab, "toxic", 400), rounds=2, per_round=400)
    p = {k: v.astype(float) for k, v in net.p.items()}
    seen = 0
    for r in docs.select("text", gru_toxicity.toxicity(net).alias("s")).collect():
        buf, off = _bytes(r.text)
        words, chars, starts, inv, counts = gru_toxicity.inputs(buf, off)
        n = len(WORD.findall(r.text or ""))
        assert counts.sum() == n
        if not n:
            assert r.s == 0
            continue
        x = [np.concatenate([p["E"][words[k]], p["C"][chars[starts[k]:starts[k + 1]]].sum(0) / math.sqrt(starts[k + 1] - starts[k])]) for k in inv]
        best = -math.inf
        for lo in range(0, max(1, n - gru_toxicity.WINDOW + gru_toxicity.STRIDE), gru_toxicity.STRIDE) if n < 400 else ():
            win = x[lo:lo + gru_toxicity.WINDOW]
            h = np.concatenate([_gru(p, "f", win), _gru(p, "b", win)], 1)
            e = np.tanh(h @ p["A"]) @ p["a"]
            w = np.exp(e - e.max())
            best = max(best, float((w / w.sum()) @ h @ p["o"] + p["o0"][0]))
        if n < 400:
            seen += 1
            assert abs(r.s - _sigmoid(net.slope * best + net.shift)) < 1e-3, r.text
    assert seen > 200


def test_rates_of_the_documented_steps(table):
    docs, lab = table
    rows = mixing.mix(docs, lab).collect()
    p = np.array([[r.p_good, r.p_low, r.p_toxic] for r in rows])
    tok, rate = np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    goal = np.array([0.85, 0.10, 0.05]) * tok.sum()
    assert np.abs((tok * rate) @ p - goal).max() <= 1e-3 * tok.sum()
    # the documented steps on dense arrays give these rates
    m = (p * tok[:, None]).T @ p
    w = 1 / np.maximum(np.diag(m), 1e-9 * tok.sum())
    eta = 1 / np.linalg.eigvalsh(np.sqrt(w)[:, None] * m * np.sqrt(w)).max()
    r = last = np.ones(len(p))
    t, step = 1.0, 0
    while np.abs((tok * r) @ p - goal).max() > 2e-5 * tok.sum():
        nxt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        beta, t, step = ((t - 1) / nxt if step else 0.0), nxt, step + 1
        y = r + beta * (r - last)
        r, last = np.maximum(0, y - eta * p @ (w * ((tok * y) @ p - goal))), r
        assert step < 2000
    assert np.abs(r - rate).max() < 0.02 * max(1, rate.max()) and (rate >= 0).all()


def test_targets_that_cannot_be_met_are_met_in_least_squares(spark):
    # every document is half of either domain: one number, the tokens in all, to fit two targets
    rows = spark.createDataFrame([(100, 0.5, 0.5), (300, 0.5, 0.5), (0, 0.5, 0.5)], "n_tokens long, p0 double, p1 double")
    got, reached, goal = mixing.fit_rates(rows, [0.9, 0.1])
    assert np.allclose(goal, [360, 40])
    m = 400 * 0.25  # both weights are 1 / m, so the best total is that of the mean target
    assert np.allclose(reached, [200, 200], rtol=1e-3) and m == 100
    assert all(r.rate >= 0 for r in got.collect())
    # a domain that no document has
    rows = spark.createDataFrame([(10, 1.0, 0.0), (30, 1.0, 0.0)], "n_tokens long, p0 double, p1 double")
    got, reached, goal = mixing.fit_rates(rows, [0.5, 0.5])
    assert np.allclose(reached, [20, 0], atol=0.1) and all(abs(r.rate - 0.5) < 0.01 for r in got.collect())
