"""Language identification: features and cosines one letter group at a time,
held-out accuracy, odd rows."""

import collections
import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoclust.llm import lang_centroids as lc
from evoclust.llm import textkit as tk
from evoclust.llm.common import fold_of, table

SCHEMA = "doc_id long, text string, lang string, score string, t string, rejected int"
ODD = [None, "", " 12 ,.!", "\U0001f600", "x", "É", "12 Ça 34", "日本語", "a" * 5000, "the sea " * 150_000]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = {"en": "the of and sea moon with this that there".split(), "fr": "le la et été mer lune avec où cette".split(),
             "ру": "и в море луна это там где она свет".split()}
    rows = [(i, " ".join(rng.choice(words[lang], rng.integers(3, 40))) + ".", lang, "s", "t", 1)
            for i, lang in enumerate(["en", "en", "fr", "ру"] * 40)]
    rows += [(1000 + i, t, ["en", None, "fr"][i % 3], None, None, None) for i, t in enumerate(ODD)]
    rows += [(None, "the sea and the moon", "en", "", "", 0)] * 3 + rows[:2]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def read(text):
    low = (text or "").lower()
    return " ".join(re.findall(r"[^\W\d_]+", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in low)))


def grams(t):
    c = collections.Counter()
    t = f" {t} "
    for n in lc.SIZES:
        for i in range(len(t) - n + 1):
            key = 0
            for ch in t[i:i + n]:
                key = key << 21 | ord(ch)
            with np.errstate(over="ignore"):
                h = tk.mix(np.array([key], np.uint64) * np.uint64(4) + np.uint64(n))
            c[int(h[0]) >> (64 - lc.BITS)] += 1
    return c


def test_predictions_from_the_model_gram_by_gram(docs):
    model = lc.train(docs, fold_of("__id", 4) != 2)
    rows = docs.select("doc_id", "text", "lang", lc.nearest(model, F.col("text")).alias("n"),
                       (fold_of("doc_id", 4) != 2).alias("train")).collect()
    df, n = collections.Counter(), 0
    for r in rows:
        if r.train and r.lang is not None and read(r.text):
            df.update(set(grams(read(r.text)))) if len(r.text) < 10_000 else df.update(set(grams(read(r.text[:80]))))
            n += 1
    assert n and all(math.isclose(model.idf[f], math.log((1 + n) / (1 + df[f])) + 1) for f in df)
    for r in rows:
        t = read(r.text)
        if not t:
            assert (r.n.lang, r.n.score, r.n.rejected) == ("und", 0.0, True)
        elif len(t) < 10_000:
            x = {f: math.log1p(c) * model.idf[f] for f, c in grams(t).items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            cos = [sum(v * model.centers[k, f] for f, v in x.items()) / norm for k in range(len(model.langs))]
            best = int(np.argmax(cos))
            assert abs(r.n.score - min(1, max(0, cos[best]))) < 1e-5
            assert model.langs[int(np.argmin(np.abs(np.array(cos) - r.n.score)))] == r.n.lang
    assert set(model.langs) == {"en", "fr", "ру"} and max(collections.Counter(model.langs).values()) > 1


def test_slabs_change_nothing(docs, monkeypatch):
    model = lc.train(docs)
    points = np.array([32, *map(ord, "the sea and été"), 32] * 20, np.uint64)
    off = np.array([0, 17, 17 * 5, 17 * 5, 340])
    whole = lc.gram_counts(points, off)
    monkeypatch.setattr(lc, "SLAB", 7)
    for a, b in zip(whole, lc.gram_counts(points, off)):
        assert (a == b).all()
    assert model.predict(points, off)[1].max() <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = lc.by_fold(table(spark, sf, "documents")).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    r = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"),
                                   F.avg(F.col("rejected").cast("int"))).head()
    assert r[1] > 200 and r[0] >= 0.98 and r[2] < 0.1


def test_far_texts_are_rejected(docs):
    got = {r.doc_id: r for r in lc.by_fold(docs).collect()}
    assert got[1007].rejected and got[1007].score < 0.2 and got[1007].lang_pred != "und"  # a script never seen
    assert got[1009].lang_pred == "en" and got[1002].lang_pred == "und" and got[1003].lang_pred == "und"
    assert docs.count() == lc.by_fold(docs).count()


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lc.by_fold(none).count() == 0
    one = lc.by_fold(spark.createDataFrame([(1, "some text", None, "", "", 1), (2, None, "en", "", "", 1)], SCHEMA)).collect()
    assert [r.lang_pred for r in one] == ["und", "und"] and [r.score for r in one] == [0, 0]


def test_model_bound(docs):
    with pytest.raises(ValueError, match="languages"):
        lc.train(docs, max_model_bytes=1 << 20)
