"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint: lower-case A-Z, words, shingles of ``k`` words with
repeats (fewer words: the whole sequence), XXH64 with seed 42; a bit is 1 if
set in over half of the hashes.  No words: fingerprint zero, linked like any
other.

Two fingerprints that differ in at most ``2r`` bits have a common variant
within ``r`` bits of both.  So each distinct fingerprint emits all variants
within ``r = max_distance / 2`` bits, variants are shuffled, and the members
of a variant meet.  A variant has at most ``sum C(64, i), i <= r`` distinct
members however many texts share them (65 for distance 2), and any two of
them lie within ``2r`` bits, so linking each to the smallest one loses no
link between classes.  Pairs are deduplicated and verified by bit count.

Copies never meet pairwise: equal fingerprints are one row before the
variants are made, and texts get their class by one join on the fingerprint.

Nulls and empty texts have fingerprint zero; a null id takes part and gets
its class's smallest id (null if the class has none).  Repeated rows are
kept as they are by ``components``.  Other columns are not read by it and kept
by ``one_per_class``, which tells rows apart by a number of their own, so a
repeated or null id takes no other row with it.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoclust.llm import textkit as tk
from evoclust.llm.common import ROW, numbered, text_col
from evoclust.operators.graph import connected_components
from evoclust.session import cut

BLOCK = 1 << 16  # shingles hashed at once


def fingerprint_of(text: bytes, k: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(k, len(words))
    joined = b" ".join(words)
    lens = [len(w) for w in words]
    start = [0, *accumulate(n + 1 for n in lens)]
    n = len(words) - k + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, BLOCK):
        h = [digest(joined[start[i]:start[i + k] - 1], seed) for i in range(lo, min(lo + BLOCK, n))]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str = "text", k: int = 3) -> Column:
    """Column expression: the fingerprint of a text column as a long."""
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            out = np.zeros(len(col), np.int64)
            for lo, _, buf, off in tk.chunks(col):
                for i in range(len(off) - 1):
                    out[lo + i] = fingerprint_of(buf[off[i]:off[i + 1]].tobytes(), k)
            yield pa.array(out)
    return F.arrow_udf(run, "long")(text_col(text))


def _masks(radius: int) -> list[int]:
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << b for b in bits) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def ball_edges(fps: DataFrame, max_distance: int) -> DataFrame:
    """``src, dst``: verified links between distinct fingerprints (column
    ``fp``) that connect all that lie within ``max_distance`` bits."""
    if max_distance % 2 or not 0 <= max_distance <= 6:
        raise ValueError("max_distance must be 0, 2, 4 or 6")
    mask = F.explode(F.lit(_masks(max_distance // 2))).alias("mask")
    variants = fps.select("fp", mask).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))  # a bounded group
    return (variants.select("fp", least.alias("src")).filter(F.col("fp") != F.col("src"))
            .select("src", F.col("fp").alias("dst"))
            .filter(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_distance))


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3,
               max_distance: int = 2) -> DataFrame:
    """``id_col, fp, component_id`` for every row: the smallest id that can
    be reached over links, its own included."""
    rows = cut(docs.select(F.col(id_col).alias("__id"), fingerprint(text, k).alias("fp")), "simhash")
    fps = cut(rows.groupBy("fp").agg(F.min("__id").alias("least")), "simhash-fps")
    labels = connected_components(ball_edges(fps.select("fp"), max_distance)).withColumnRenamed("id", "fp")
    linked = fps.join(labels, "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    best = (linked.filter(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("least").alias("component_id")))
    # a table of its own, so that the join's shuffle of a very common fingerprint can be split
    classes = cut(linked.join(best, "comp").select("fp", "component_id"), "simhash-classes")
    return rows.join(classes, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")


def hex16(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3,
                  max_distance: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps one row: of those
    with its smallest id (null only if the class has no other) the first."""
    rows = numbered(docs, "simhash-docs")
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(ROW).alias("row"))
    got = components(rows.select(place.alias("__place"), F.col(text)), "__place", text, k, max_distance)
    gone = cut(got.filter("__place.row <> component_id.row").select(F.col("__place.row").alias(ROW)), "simhash-gone")
    return rows.join(gone, ROW, "left_anti").drop(ROW)
