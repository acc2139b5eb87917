"""Column and table helpers of the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evoclust.session import cut

ROW = "__row_number"
WORD_SEP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of its own for each row (column ``ROW``), written
    to the shared folder so that every later read sees the same numbers."""
    return cut(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def text_col(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(id_col: str, n: int) -> Column:
    """``crc32(id as text) mod n``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(n))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hash_share(df: DataFrame, columns: str | list[str], rows: int) -> Column:
    """Condition that about ``rows`` of the rows meet: the hash of the columns
    falls under a limit set by the table's row count.  Rows that agree in all
    of them share a hash (ids that repeat or are null: name the text too)."""
    n = df.count()
    share = min(1.0, rows / n) if n else 1.0
    names = [columns] if isinstance(columns, str) else columns
    return F.pmod(F.xxhash64(*names), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))


def smallest_hashes(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest place by hash of a unique id.
    Few rows beyond that reach the one task that ends the sort."""
    some = df.filter(hash_share(df, id_col, rows + 6 * int(rows ** 0.5) + 50))
    return some.orderBy(F.pmod(F.xxhash64(id_col), F.lit(1 << 32)), id_col).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, train: Column | None = None,
                    id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text, y``: at most ``max_rows`` labelled rows (0 or 1), the
    ones with the smallest hash of the id among the ids that have both a label
    and a text, so the sample is the same for any partitioning and labels of
    absent documents take no place in it.  Rows with a null label, id or text
    are left out; an id labelled or listed twice gives one row."""
    y = (labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y"))
         .filter(F.col("__id").isNotNull() & F.col("y").isin(0, 1)))
    if train is not None:
        y = y.filter(train)
    d = docs.select(F.col(id_col).alias("__id"), F.col("text").cast("string").alias("text")).filter(
        F.col("text").isNotNull())
    y = cut(y.groupBy("__id").agg(F.max("y").alias("y")).join(d.select("__id").distinct(), "__id", "left_semi"), "labelled")
    y = smallest_hashes(y, "__id", max_rows)
    # the sample is bounded by max_rows (16 bytes a row), hence broadcast
    return (d.join(F.broadcast(y), "__id").groupBy("__id", "y").agg(F.min("text").alias("text"))
            .select("__id", "text", "y"))
