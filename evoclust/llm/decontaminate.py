"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over some tokens; the hash of a place reads only the tokens
where the mask has a 1, so substitutions at the other places don't change it.
With the two masks of ``MASKS``, every window of 13 tokens with at most two
substitutions has a place where at least one mask reads only equal tokens.
An item under 13 words is one window as long as itself: ``SHORT`` has the
masks of each length, which do the same for the substitutions that length
allows (none under 5 words, where the mask is the whole item).  A test tries
all cases of every length.  Texts are hashed with the masks of the lengths
that the benchmark has.

The hashes of every place of every text meet those of the benchmark in a
join.  Around each hit the text and the item are laid on each other at the
hit's offset, and the overlap counts if some window of ``window`` item
tokens (the whole item, if shorter) that holds the hit has at least
``similarity`` equal tokens.  The result has a row for each (document, item)
with such an overlap.

Plan: words, places, hash, join, neighbourhood of the hit in one pass over
the texts, all in generated code; only hits leave it, cut to the words
around them, meet their item's words and are summed before the shuffle.  The
benchmark's hash table (a few numbers a place) and its items are broadcast
while both together are at most ``max_broadcast_bytes``.  Beyond that hashes
meet by shuffle, without words: a place is a hash, a row and a number; the
words of the few rows and items with hits are joined afterwards.  Very long
texts and items are hashed and compared whole; either plan is linear in them.

The masks are proven when they are used: ``window`` and ``similarity`` under
which some allowed substitutions would leave a window without a seed raise
ValueError.

Tokens: lower-cased runs without ``[\\x20\\x09-\\x0D]``.  Null and blank texts
hold nothing, nor do blank items.
Rows with one id are one document, a null id is a document too; ``clean``
judges every row by itself.  Repeated items are reported under their smallest
id; other columns are not read (``clean`` keeps them).  Empty tables give an
empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoclust.llm.common import ROW, WORD_SEP, numbered, text_col
from evoclust.session import cut

MASKS = ("11101011", "11001111")
SPAN = 8
#: by the words of a window under 13
SHORT = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",),
    5: ("111", "11011"), 6: ("1111", "11011"), 7: ("111011", "11111", "1101011"), 8: ("111011", "1101011"),
    9: ("111011",), 10: ("1101011", "111011", "1110011"), 11: ("1101011", "101100111", "11001111"),
    12: ("11101011", "101100111", "11001111")}
#: every mask once; its place here is part of its hashes
ALL = tuple(dict.fromkeys([*MASKS, *[m for masks in SHORT.values() for m in masks]]))


def masks_for(n_words: int) -> tuple[str, ...]:
    """Masks for a window of so many words."""
    return SHORT.get(n_words, MASKS)


@functools.cache
def proven(window: int, similarity: float) -> None:
    """Raises ValueError if any window with the substitutions that
    ``similarity`` allows could hide from all its masks."""
    for n in range(1, window + 1):
        masks = [[j for j, c in enumerate(m) if c == "1"] for m in masks_for(n)]
        places = [{i + j for j in ones} for ones, m in zip(masks, masks_for(n)) for i in range(n - len(m) + 1)]
        off = n - math.ceil(n * similarity - 1e-9)
        if math.comb(n, off) > 200_000 or any(all(p & set(x) for p in places) for x in itertools.combinations(range(n), off)):
            raise ValueError(f"the masks do not find every window of {n} words with {off} substitutions")


def words(c: Column) -> Column:
    return F.split(F.btrim(F.lower(c), F.lit(" \t\n\x0b\f\r")), WORD_SEP)


def _places(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Every place and mask: ``x = place * masks + mask``, its hash, and the
    mask's length ``m``; the table has a column ``w`` of words."""
    m, least = len(masks), min(map(len, masks))
    n = F.size("w") - least + 1
    # outer: no filter that would split the texts a second time
    x = F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n * m - 1)))
    at = df.select("*", x.alias("x")).withColumn("i", F.floor(F.col("x") / m).cast("int"))

    def seed(mask: str) -> Column:
        h = F.xxhash64(F.lit(ALL.index(mask)), *[F.get("w", F.col("i") + j) for j, c in enumerate(mask) if c == "1"])
        # the hash skips words beyond the end
        return h if len(mask) == least else F.when(F.col("i") + len(mask) <= F.size("w"), h)

    def of_mask(values: list[Column]) -> Column:
        pick = values[-1]
        for k in range(m - 1):
            pick = F.when(F.col("x") % m == k, values[k]).otherwise(pick)
        return pick

    return (at.withColumn("h", F.when(F.col("x").isNotNull(), of_mask([seed(k) for k in masks])))
            .withColumn("m", of_mask([F.lit(len(k)) for k in masks])))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id",
             window: int = 13, similarity: float = 0.8, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``id_col, item_col, n_equal`` (most equal tokens of a window)."""
    proven(window, similarity)
    items = cut(benchmark.select(words(text_col()).alias("iw"), F.col(item_col).alias("item"))
                .groupBy("iw").agg(F.min("item").alias("item")).filter(F.col("iw") != F.array(F.lit("")))
                .withColumn("no", F.monotonically_increasing_id()), "bench-items")
    # the words of an item's windows, those of all long items as one; at most 13 numbers
    kind = F.least(F.size("iw"), F.lit(window), F.lit(max(SHORT) + 1))
    kinds = sorted(r.kind for r in items.select(kind.alias("kind")).distinct().collect()) or [max(SHORT) + 1]
    seeds = reduce(DataFrame.union, [
        _places(items.filter(kind == k).select("no", F.col("iw").alias("w")), masks_for(k)).filter("h is not null")
        .select("h", "no", F.col("i").alias("j"), "m") for k in kinds])
    seeds = cut(seeds, "bench-seeds")
    masks = tuple(m for m in ALL if any(m in masks_for(k) for k in kinds))
    held = items.agg(F.sum(F.aggregate("iw", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    small = 24 * seeds.count() + held <= max_broadcast_bytes
    near = window + SPAN
    # words i-near .. i+near+SPAN; the hit is the word "at" of them
    first = F.greatest(F.lit(0), F.col("i") - near)
    part = F.slice("w", F.col("from") + 1, F.lit(2 * near + SPAN)).alias("part")
    texts = docs.select(F.col(id_col).alias("__id"), words(text_col()).alias("w"))
    if small:
        hits = (_places(texts, masks).drop("m").join(F.broadcast(seeds), "h")
                .select("__id", "no", "j", "m", first.alias("from"), "i", "w")
                .select("__id", "no", "j", "m", (F.col("i") - F.col("from")).alias("at"), part)
                .join(F.broadcast(items), "no"))
    else:
        rows = numbered(docs.select(F.col(id_col).alias("__id"), text_col().alias("text")), "decontaminate-rows")
        texts = rows.select(ROW, "__id", words(F.col("text")).alias("w"))
        found = cut(_places(texts, masks).select("h", ROW, "i").filter("h is not null").join(seeds, "h").drop("h"), "bench-hits")
        hits = (found.join(texts, ROW).select("__id", "no", "j", "m", first.alias("from"), "i", "w")
                .select("__id", "no", "j", "m", (F.col("i") - F.col("from")).alias("at"), part).join(items, "no"))
    span = F.least(F.lit(window), F.size("iw"))
    need = F.ceil(span * F.lit(similarity) - F.lit(1e-9))
    same = F.transform(F.sequence(F.lit(0), F.size("iw") - 1), lambda p: F.coalesce(
        (F.get("iw", p) == F.when(p + F.col("at") - F.col("j") >= 0,
                                  F.get("part", p + F.col("at") - F.col("j")))).cast("int"), F.lit(0)))
    hits = hits.withColumn("same", same).withColumn("span", span).withColumn("need", need)
    # no mask is longer than the window it is for, so lo <= hi
    lo = F.greatest(F.lit(0), F.col("j") + F.col("m") - F.col("span"))
    hi = F.least(F.col("j"), F.size("same") - F.col("span"))
    sums = F.transform(F.sequence(lo, hi), lambda s: F.aggregate(
        F.slice("same", s + 1, F.col("span")), F.lit(0), lambda a, b: a + b))
    # the test stands behind the aggregate: before it, it would be moved into
    # the join and take the whole pass out of generated code
    return (hits.select("__id", "item", F.array_max(sums).alias("n"), "need")
            .groupBy("__id", "item").agg(F.max("n").alias("n_equal"), F.max("need").alias("need"))
            .filter("n_equal >= need").select(F.col("__id").alias(id_col), F.col("item").alias(item_col), "n_equal"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no benchmark item, each judged
    by itself (``id_col`` may repeat or be null)."""
    rows = numbered(docs, "decontaminate-docs")
    bad = cut(overlaps(rows, benchmark, ROW, **params).select(ROW).distinct(), "leaks")
    return rows.join(bad, ROW, "left_anti").drop(ROW)


def oracle(window: int = 13, similarity: float = 0.8) -> str:
    """DuckDB SQL of ``overlaps`` on items of ``window`` words or more: all
    aligned windows are counted, without seeds."""
    sep = "[\\x20\\x09-\\x0D]+"
    need = math.ceil(window * similarity - 1e-9)
    return f"""
WITH items AS (SELECT min(item_id) AS item_id, w FROM (
       SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{sep}'), lambda x: x <> '') AS w
       FROM benchmark) GROUP BY w),
it AS (SELECT item_id, unnest(w) AS tok, generate_subscripts(w, 1) AS q FROM items),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{sep}'), lambda x: x <> '') AS w
      FROM documents),
dt AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS p FROM d),
m AS (SELECT doc_id, item_id, p - q AS diag, q FROM dt JOIN it USING (tok)),
big AS (SELECT doc_id, item_id, diag FROM m GROUP BY ALL HAVING count(*) >= {need}),
c AS (SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY q
             RANGE BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS n
      FROM m JOIN big USING (doc_id, item_id, diag))
SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS n_equal FROM c GROUP BY doc_id, item_id HAVING max(n) >= {need}"""
