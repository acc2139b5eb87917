"""Language identification by the nearest of several centroids per language.

A text is read as its letters, lower-cased, with one space between runs of
letters and at both ends.  Its 1- to 3-letter groups, hashed to ``2 ** BITS``
features, give a vector ``log(1 + tf) * idf`` of length 1.

Learning: the document frequencies are counted over all training rows (a
vector a task, summed by feature).  Of each language at most ``rows_per_lang``
rows, the ones with the smallest hash of id and text, are clustered by
spherical k-means into ``clusters`` centroids, one language a task; the driver
receives the centroids alone.  A centroid's radius is that of its members
(the ``QUANTILE`` of their cosine distances), times ``SLACK``.

Prediction: the language of the centroid with the largest cosine, which is
the score (0 to 1).  Rejection: a text farther from its nearest centroid than
that centroid's radius is ``rejected``.

The model holds ``clusters`` vectors a language; :func:`train` raises
ValueError beyond ``max_model_bytes`` (hundreds of languages fit), rather
than leave languages out.

Defined results: null texts and texts without a letter are ``und``, score 0,
rejected, and never learned from; so is every text if nothing was learned.
Ties of cosine go to the language that sorts first.  Null ids and repeated
rows are rows like any other.  Other columns are not read.  Texts are read
whole, in slabs of ``SLAB`` letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoclust.llm import textkit as tk
from evoclust.llm.common import fold_of

BITS, SIZES = 14, (1, 2, 3)
DIM = 1 << BITS
SLAB, CELLS = 1 << 20, 1 << 20
QUANTILE, SLACK = 0.99, 1.25


def letters(text: Column) -> Column:
    """Lower-case letters, runs of anything else as one space; null or empty
    without a letter."""
    return F.trim(F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}]+", " "))


# ---------------------------------------------------------------- features

def code_points(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(lo, hi, code points, offsets)`` of runs of rows; every row with a
    space at either end."""
    for lo, hi, buf, off in tk.chunks(col, SLAB):
        try:
            text = buf.tobytes().decode("utf-8")
            lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            at = lead[off]
        except UnicodeDecodeError:
            rows = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
            text, at = "".join(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = hi - lo
        out = np.full(len(points) + 2 * n, 32, np.uint64)
        out[np.arange(len(points)) + 2 * np.repeat(np.arange(n), np.diff(at)) + 1] = points
        yield lo, hi, out, at + 2 * np.arange(n + 1)


def gram_counts(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, features and counts of the letter groups of each row."""
    starts, feats, counts = [np.zeros(1, np.int64)], [], []
    per = max(1, CELLS // DIM)
    for r in range(0, len(off) - 1, per):
        stop = min(r + per, len(off) - 1)
        cells = np.zeros((stop - r) * DIM, np.int64)
        for lo in range(off[r], off[stop], SLAB):  # a slab sees the groups that start in it
            hi = min(lo + SLAB, off[stop])
            row = np.searchsorted(off, np.arange(lo, hi), "right") - 1 if hi - lo < 64 else np.repeat(
                np.arange(r, stop), np.diff(np.clip(off[r:stop + 1], lo, hi)))
            key, end = np.zeros(hi - lo, np.uint64), off[row + 1]
            for n in SIZES:
                at = np.arange(lo, hi) + n - 1
                inside = at < end
                key = key << np.uint64(21) | np.where(inside, points[np.minimum(at, len(points) - 1)], 0).astype(np.uint64)
                f = (tk.mix(key[inside] * np.uint64(4) + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
                cells += np.bincount((row[inside] - r) * DIM + f, minlength=len(cells))
        hit = np.flatnonzero(cells)
        feats.append(hit & (DIM - 1))
        counts.append(cells[hit])
        starts.append(starts[-1][-1] + np.searchsorted(hit, np.arange(1, stop - r + 1) * DIM))
    z = [np.zeros(0, np.int64)]
    return np.concatenate(starts), np.concatenate(feats or z), np.concatenate(counts or z)


def vectors(starts, feats, counts, idf: np.ndarray) -> np.ndarray:
    """Values of the unit vectors at ``feats`` (float64)."""
    x = np.log1p(counts) * idf[feats]
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    norm = np.sqrt(np.bincount(row, x * x, len(starts) - 1))
    return x / np.maximum(norm, 1e-300)[row]


# ------------------------------------------------------------------- model

class Centroids:
    """``centers`` (k x DIM, unit length) with the language and radius of
    each, sorted by language, and the ``idf`` of the features."""

    def __init__(self, langs: list[str], centers: np.ndarray, radius: np.ndarray, idf: np.ndarray):
        self.langs, self.centers, self.radius, self.idf = langs, centers, radius, idf
        self.by_feature = np.ascontiguousarray(centers.T.astype(np.float32))

    def predict(self, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid and cosine of each row."""
        starts, feats, counts = gram_counts(points, off)
        x = vectors(starts, feats, counts, self.idf).astype(np.float32)
        cos = np.empty((len(off) - 1, len(self.langs)))
        for r in range(len(off) - 1):
            a, b = starts[r], starts[r + 1]
            cos[r] = x[a:b] @ self.by_feature[feats[a:b]]
        return cos.argmax(1), np.clip(cos.max(1), 0, 1)


def kmeans(x: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means on unit rows: unit centers and each row's center.
    Starts from the mean, then the rows farthest from all centers so far."""
    def unit(v):
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)

    centers = unit(x.mean(0, keepdims=True))
    while len(centers) < min(clusters, len(x)):
        near = (x @ centers.T).max(1)
        if near.min() > 1 - 1e-9:  # fewer different rows than clusters
            break
        centers = np.concatenate([centers, x[[near.argmin()]]])
    at = (x @ centers.T).argmax(1)
    for _ in range(rounds):
        centers = unit(np.stack([x[at == k].mean(0) if (at == k).any() else centers[k] for k in range(len(centers))]))
        new = (x @ centers.T).argmax(1)
        if (new == at).all():
            break
        at = new
    used = np.unique(at)
    return centers[used], np.searchsorted(used, at)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of column ``t`` each feature occurs, and the rows."""
    def run(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for rb in batches:
            for lo, hi, points, off in code_points(rb.column(0)):
                _, feats, _ = gram_counts(points, off)
                df += np.bincount(feats, minlength=DIM)
                n += hi - lo
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["f", "n"])

    got = rows.select("t").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(DIM + 1, np.int64)
    df[got["f"].to_numpy()] = got["n"].to_numpy()  # -1: the last place
    return df[:-1], int(df[-1])


def train(docs: DataFrame, train_on: Column | None = None, id_col: str = "doc_id", lang_col: str = "lang",
          text_col: str = "text", rows_per_lang: int = 300, clusters: int = 4, max_model_bytes: int = 256 << 20) -> Centroids | None:
    """Learns from the rows where ``train_on`` (over ``__id``) holds."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("lang"),
                       letters(F.col(text_col)).alias("t"))
    if train_on is not None:
        rows = rows.filter(train_on)
    rows = rows.filter(F.col("lang").isNotNull() & (F.length("t") > 0))
    freq, n = document_frequencies(rows)
    if n == 0:
        return None
    idf = np.log((1 + n) / (1 + freq)) + 1
    sizes = rows.groupBy("lang").count()
    n_langs = sizes.count()
    if n_langs * clusters * DIM * 8 > max_model_bytes:
        raise ValueError(f"{n_langs} languages need more than {max_model_bytes} bytes of centroids: lower clusters")
    # about rows_per_lang rows of each language, by hash; few rows beyond that are ranked
    h = F.pmod(F.xxhash64("__id", "t"), F.lit(1 << 32))
    some = rows_per_lang + 6 * int(rows_per_lang ** 0.5) + 50
    sample = (rows.join(F.broadcast(sizes), "lang").withColumn("__h", h)
              .filter(F.col("__h") * F.col("count").cast("double") <= float(some << 32))
              .withColumn("__r", F.row_number().over(Window.partitionBy("lang").orderBy("__h", "__id", "t")))
              .filter(F.col("__r") <= rows_per_lang))

    def sparse(batches):  # texts end here: a row is at most DIM features
        for rb in batches:
            for lo, hi, points, off in code_points(rb.column(1)):
                starts, feats, counts = gram_counts(points, off)
                at = pa.array(starts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(lo, hi - lo), rb.column(2).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(at, pa.array(feats)),
                     pa.ListArray.from_arrays(at, pa.array(vectors(starts, feats, counts, idf)))], names=["lang", "r", "f", "x"])

    def cluster(group: pa.Table) -> pa.Table:
        group = group.sort_by("r").combine_chunks()
        x = np.zeros((group.num_rows, DIM), np.float64)
        for k, (f, v) in enumerate(zip(group["f"], group["x"])):
            x[k, f.values.to_numpy()] = v.values.to_numpy()
        centers, at = kmeans(x, clusters)
        dist = 1 - (x * centers[at]).sum(1)
        radius = [SLACK * float(np.quantile(dist[at == k], QUANTILE)) for k in range(len(centers))]
        return pa.table({"lang": [group["lang"][0].as_py()] * len(centers), "k": np.arange(len(centers)),
                         "radius": radius, "center": [c.astype(np.float32) for c in centers]},
                        schema=pa.schema([("lang", pa.string()), ("k", pa.int64()), ("radius", pa.float64()),
                                          ("center", pa.list_(pa.float32()))]))

    got = (sample.select("lang", "t", F.col("__r").cast("long")).mapInArrow(sparse, "lang string, r long, f array<long>, x array<double>")
           .groupBy("lang").applyInArrow(cluster, "lang string, k long, radius double, center array<float>").toArrow())
    got = got.sort_by([("lang", "ascending"), ("k", "ascending")]).combine_chunks()
    return Centroids(got["lang"].to_pylist(), np.stack([np.array(c.values) for c in got["center"]]),
                     got["radius"].to_numpy(), idf)


def nearest(model: Centroids | None, text: Column) -> Column:
    """Column expression: struct ``lang, score, rejected`` of a text."""
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            lang = np.full(len(col), "und", object)
            score, rejected = np.zeros(len(col)), np.ones(len(col), bool)
            for lo, hi, points, off in code_points(col):
                if model is None:
                    break
                k, cos = model.predict(points, off)
                some = np.diff(off) > 2  # a row without letters is its two spaces
                lang[lo:hi] = np.where(some, np.array(model.langs, object)[k], "und")
                score[lo:hi] = np.where(some, cos, 0.0)
                rejected[lo:hi] = ~some | (1 - cos > model.radius[k])
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                             ["lang", "score", "rejected"])
    return F.arrow_udf(run, "lang string, score double, rejected boolean")(F.coalesce(letters(text), F.lit("")))


def identify(docs: DataFrame, train_on: Column | None = None, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``id, held_out, lang_pred, score, rejected`` of every row."""
    model = train(docs, train_on, id_col, text_col=text_col, **params)
    held = ~F.coalesce(train_on, F.lit(True)) if train_on is not None else F.lit(False)
    return (docs.select(F.col(id_col), F.col(id_col).alias("__id"), nearest(model, F.col(text_col)).alias("__n"))
            .select(id_col, held.alias("held_out"), F.col("__n.lang").alias("lang_pred"), F.col("__n.score").alias("score"),
                    F.col("__n.rejected").alias("rejected")))


def by_fold(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """:func:`identify`, learning from ids whose crc32 mod 4 is not 2."""
    return identify(docs, fold_of("__id", 4) != 2, id_col, **params)
