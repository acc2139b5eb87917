"""Dataset preparation: z-score, label encodings, samples, transforms (P3-P12,
A9, O4-O6, U1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoclust.session import cut

MAX_LABELS = 100_000  # label maps above this are joined without broadcast


def z_score(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(x - mean) / stddev_samp`` per column, in place.

    The statistics are one aggregate row (2 numbers per column) folded into
    the projection as literals; a zero or undefined deviation gives null
    (``try_divide``)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}")]
    stats = df.agg(*aggs).collect()[0].asDict()
    out = df
    for c in cols:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        if m is None or s is None or s == 0:
            out = out.withColumn(c, F.lit(None).cast("double"))
        else:
            out = out.withColumn(c, F.try_divide(F.col(c) - F.lit(float(m)), F.lit(float(s))))
    return out


def assert_standardised(df: DataFrame, cols: list[str], tol: float = 0.01) -> None:
    """Every column has sample deviation within (1 - tol, 1 + tol)."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).collect()[0]
    bad = [c for c in cols if row[c] is None or not (1 - tol < row[c] < 1 + tol)]
    if bad:
        raise AssertionError(f"not standardised: {bad}")


def drop_columns(df: DataFrame, names: list[str], feature_cols: list[str] | None = None,
                 label_col: str | None = None) -> DataFrame:
    """P5: drop columns, cast the features to double and the label to int."""
    out = df.drop(*names)
    for c in feature_cols or []:
        out = out.withColumn(c, F.col(c).cast("double"))
    if label_col:
        out = out.withColumn(label_col, F.col(label_col).cast("int"))
    return out


def drop_null_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop every column of ``cols`` holding a null or NaN (one pass)."""
    row = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in cols]).collect()[0]
    return df.drop(*[c for c in cols if row[c] > 0])


def label_map(df: DataFrame, col: str, order: str = "first", order_col: str | None = None) -> DataFrame:
    """``col -> label INT``: by first appearance (smallest ``order_col``) or
    alphabetically.  One row per distinct value."""
    if order == "first":
        first = df.groupBy(col).agg(F.min(order_col).alias("_first"))
        keys = ["_first", col]
    else:
        first = df.select(col).distinct()
        keys = [col]
    first = cut(first, "labels")  # one pass over the rows, read by the steps below
    if first.count() <= MAX_LABELS:
        # one row per label: a small global window
        w = Window.orderBy(*keys)
        return first.select(col, (F.row_number().over(w) - 1).cast("int").alias("label"))
    from evoclust.sources.points import with_row_index
    return with_row_index(first, keys, "_k").select(col, F.col("_k").cast("int").alias("label"))


def encode_labels(df: DataFrame, col: str, order: str = "first", order_col: str | None = None,
                  out: str = "label") -> DataFrame:
    """String label to int id (first appearance or alphabetical)."""
    m = label_map(df, col, order, order_col).withColumnRenamed("label", out)
    n = m.count()
    side = F.broadcast(m) if n <= MAX_LABELS else m
    return df.join(side, col)


def map_labels(df: DataFrame, col: str, mapping: dict, out: str = "label") -> tuple[DataFrame, DataFrame]:
    """Label names to ids by a fixed map; returns (mapped, rejects)."""
    spark = df.sparkSession
    m = spark.createDataFrame(list(mapping.items()), f"{col} string, {out} int")
    j = df.join(F.broadcast(m), col, "left")
    return j.filter(F.col(out).isNotNull()), j.filter(F.col(out).isNull()).drop(out)


def clean_label(col) -> "F.Column":
    """Text between quotes without the trailing dot (b'normal.' -> normal)."""
    c = F.col(col) if isinstance(col, str) else col
    inner = F.regexp_extract(c, r"'([^']*)'", 1)
    inner = F.when(inner == "", c).otherwise(inner)
    return F.regexp_replace(inner, r"\.$", "")


def offset_labels(df: DataFrame, k: int, col: str = "label") -> DataFrame:
    """P10: label + k."""
    return df.withColumn(col, (F.col(col) + F.lit(k)).cast("int"))


def linear_transform(df: DataFrame, cols: list[str], matrix: list[list[float]],
                     out: list[str]) -> DataFrame:
    """Row vector times a d x d matrix, one expression per output."""
    d = len(cols)
    res = df
    exprs = []
    for j in range(d):
        e = None
        for i in range(d):
            term = F.col(cols[i]) * F.lit(float(matrix[i][j]))
            e = term if e is None else e + term
        exprs.append(e.alias(out[j]))
    return res.select("*", *exprs)


def describe_schema(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types."""
    return df.dtypes


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, stddev, min, quartiles, max."""
    return df.select(*(cols or df.columns)).summary()


def distinct_labels(df: DataFrame, col: str = "label") -> DataFrame:
    """A9."""
    return df.select(col).distinct()


def _hash_key(id_col: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_sample(df: DataFrame, label_col: str, n: int, seed: int, id_col: str) -> DataFrame:
    """Exactly ``n`` rows per label (all of a smaller label), chosen by a
    seeded hash order.  ``row_number() <= n`` lets Spark keep at most n rows
    per label in every map task before the shuffle (group limit)."""
    w = Window.partitionBy(label_col).orderBy(_hash_key(id_col, seed), id_col)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def sample_n(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """Exactly n rows by hash order (top-k, no full sort)."""
    return df.orderBy(_hash_key(id_col, seed), id_col).limit(n)


def shuffle_order(seed: int, id_col: str) -> list:
    """Sort keys of O6."""
    return [_hash_key(id_col, seed), F.col(id_col)]


def shuffle_rows(df: DataFrame, seed: int, id_col: str) -> DataFrame:
    """A seeded random row order."""
    return df.orderBy(*shuffle_order(seed, id_col))


def merge_datasets(dfs: list[DataFrame], offsets: list[int], col: str = "label") -> DataFrame:
    """Shift each dataset's labels, then concatenate by name."""
    parts = [offset_labels(d, k, col) for d, k in zip(dfs, offsets)]
    return reduce(lambda a, b: a.unionByName(b), parts)
