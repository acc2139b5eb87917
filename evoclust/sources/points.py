"""Point sources: envelopes, CSV files, logical time, stream readers.

A *point* is ``time LONG, features ARRAY<DOUBLE>, label INT, seq LONG``;
``seq`` is the arrival position and breaks ties of ``time``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_SCHEMA = T.StructType([
    T.StructField("time", T.LongType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.IntegerType()),
    T.StructField("seq", T.LongType()),
])

_MASK33 = (1 << 33) - 1


# ------------------------------------------------------------- row index

def with_row_index(df: DataFrame, order_by: list | None = None, name: str = "seq",
                   materialize: bool = True) -> DataFrame:
    """Add a dense 0-based position ``name`` without a single-partition step.

    With ``order_by`` the rows are range-partitioned and sorted first (a
    distributed sort); without it the current order (file order for a scan)
    is used.  Positions come from ``monotonically_increasing_id`` (partition
    index in the upper bits) plus a prefix sum of the per-partition counts,
    which is one row per partition and therefore broadcast safely.
    """
    if order_by:
        df = df.orderBy(*order_by)
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    if materialize and order_by:
        # the sort's range bounds come from sampling: pin the result so that
        # counting and numbering see the same partitions
        tagged = tagged.checkpoint(eager=True)
    part = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: small by construction
    from pyspark.sql import Window
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = (tagged.join(F.broadcast(offsets), part == F.col("_part"))
           .withColumn(name, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_MASK33))).cast("long"))
           .drop("_mid", "_part", "_off"))
    return out


# ---------------------------------------------------------------- S2, S3

def kafka_text(df: DataFrame) -> DataFrame:
    """CAST(key AS STRING), CAST(value AS STRING); other columns stay."""
    return df.withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})


def _parts(value: Column, num_dims: int):
    halves = F.split(value, "/")
    time_s = F.get(halves, 0)
    body = F.split(F.get(halves, 1), ",")
    return halves, time_s, body


def decode_points(df: DataFrame, num_dims: int, value_col: str = "value",
                  seq_col: str | None = None, keep: list | None = None) -> DataFrame:
    """Parse ``"<time>/<f1>,...,<fd>,<label>"`` records into points.

    Records that do not have exactly d features and a label, or whose pieces
    do not parse, are dropped here; ``decode_rejects`` returns them.
    """
    return _decode(df, num_dims, value_col, seq_col, keep).filter(F.col("_ok")).drop("_ok")


def decode_marked(df: DataFrame, num_dims: int, value_col: str = "value",
                  seq_col: str | None = None) -> DataFrame:
    """Every record with its raw value and ``_ok``, whether it is a point."""
    return _decode(df, num_dims, value_col, seq_col, [value_col])


def decode_rejects(df: DataFrame, num_dims: int, value_col: str = "value") -> DataFrame:
    """The records ``decode_points`` rejects, with their raw value."""
    return _decode(df, num_dims, value_col, None, [value_col]).filter(~F.col("_ok")).select(value_col)


def _decode(df, num_dims, value_col, seq_col, keep):
    v = F.col(value_col).cast("string")
    halves, time_s, body = _parts(v, num_dims)
    feats = F.transform(F.slice(body, 1, num_dims), lambda s: s.try_cast("double"))
    label = F.get(body, num_dims).try_cast("int")
    time = time_s.try_cast("long")
    ok = (
        v.isNotNull() & (F.size(halves) == 2) & (F.size(body) == num_dims + 1)
        & time.isNotNull() & label.isNotNull()
        & F.forall(feats, lambda x: x.isNotNull() & ~F.isnan(x))
    )
    cols = [time.alias("time"), feats.alias("features"), label.alias("label")]
    if seq_col != "none":  # streams number their rows per micro-batch instead
        seq = F.col(seq_col).cast("long") if seq_col else F.monotonically_increasing_id()
        cols.append(seq.alias("seq"))
    cols += [F.col(c) for c in (keep or []) if c not in ("time", "features", "label", "seq")]
    return df.select(*cols, F.coalesce(ok, F.lit(False)).alias("_ok"))


def select_point(df: DataFrame) -> DataFrame:
    """Keep the point columns."""
    return df.select("time", "features", "label", "seq")


# ---------------------------------------------------------------------- S4

def decode_csv_columns(df: DataFrame, ddl: str, value_col: str = "value",
                       keep: list | None = None) -> DataFrame:
    """Comma-separated payload to typed named columns (``from_csv``)."""
    parsed = F.from_csv(F.col(value_col), ddl, {"mode": "PERMISSIVE"})
    return df.select(*(keep or []), parsed.alias("_r")).select(*(keep or []), "_r.*")


# ---------------------------------------------------------------------- S5

def read_points_csv(spark: SparkSession, path: str, num_dims: int, header: bool = False,
                    label_col: str | None = None, index: bool = True) -> DataFrame:
    """Headerless numeric CSV, d feature columns then an int label.

    Rows with another width are rejected by the schema (FAILFAST).  ``seq``
    is the position in file order: files by name, blocks of a file by their
    first byte, rows of a block as the scan reads them, whatever way the scan
    deals files and blocks to tasks.  With a header the file must have
    ``num_dims`` columns besides the label."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
             F.monotonically_increasing_id().alias("_row")] if index else []
    if header:
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        cols = raw.columns
        lab = label_col or cols[-1]
        feats = [c for c in cols if c != lab]
        if len(feats) != num_dims or lab not in cols:
            raise ValueError(f"{num_dims} feature columns and {lab!r} wanted, the header has {cols}")
        df = raw.select(*place, F.array(*[F.col(f"`{c}`").cast("double") for c in feats]).alias("features"),
                        F.col(f"`{lab}`").alias("label"))
    else:
        schema = T.StructType([T.StructField(f"f{i}", T.DoubleType()) for i in range(num_dims)]
                              + [T.StructField("label", T.IntegerType())])
        raw = spark.read.schema(schema).option("mode", "FAILFAST").csv(path)
        df = raw.select(*place, F.array(*[F.col(f"f{i}") for i in range(num_dims)]).alias("features"),
                        F.col("label"))
    return with_row_index(df, ["_file", "_block", "_row"], "seq").drop("_file", "_block", "_row") if index else df


def write_dataset_csv(df: DataFrame, path: str, feature_cols: list, label_col: str = "label") -> None:
    """Headerless, index-less CSV of features then label."""
    df.select(*feature_cols, label_col).write.mode("overwrite").option("header", False).csv(path)


# ---------------------------------------------------------------------- S6

def encode_points(df: DataFrame, time_col: str = "time", features_col: str = "features",
                  label_col: str = "label") -> DataFrame:
    """Build the ``"<time>/<f1>,...,<fd>,<label>"`` envelope as ``value``."""
    body = F.array_join(F.transform(F.col(features_col), lambda x: x.cast("string")), ",")
    value = F.concat(F.col(time_col).cast("string"), F.lit("/"), body, F.lit(","),
                     F.col(label_col).cast("string"))
    return df.withColumn("value", value)


def write_points_kafka(df: DataFrame, options: dict) -> None:
    """S6 sink: publish the ``value`` envelope column to a Kafka topic
    (``options`` carries ``kafka.bootstrap.servers`` and ``topic``)."""
    w = df.select(F.col("value").cast("string")).write.format("kafka")
    for k, v in options.items():
        w = w.option(k, v)
    w.save()


# ---------------------------------------------------------------------- S7

def with_logical_time(df: DataFrame, rate: int, total: int | None = None,
                      seq_col: str = "seq", offset: int = 0) -> DataFrame:
    """Row k of the replay gets ``time = floor(k / rate) + offset``.

    With ``total`` the input repeats until ``(total // rate) * rate`` rows
    are produced (the replay of a file at a fixed rate).
    """
    if total is not None:
        n = df.count()
        sent = (total // rate) * rate
        cycles = max(1, -(-sent // max(n, 1)))
        # each row is repeated once per cycle (a narrow explode, no join)
        df = (df.withColumn("_cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
              .withColumn(seq_col, F.col(seq_col) + F.col("_cycle") * F.lit(n))
              .drop("_cycle")
              .filter(F.col(seq_col) < F.lit(sent)))
    return df.withColumn("time", (F.floor(F.col(seq_col) / F.lit(rate)) + F.lit(offset)).cast("long"))


def with_row_time(df: DataFrame, seq_col: str = "seq", value_col: str | None = None) -> DataFrame:
    """One row per time step, ``time = position + 1``; blank lines of a
    raw ``value_col`` are no rows and take no step."""
    if value_col:
        df = with_row_index(df.filter(F.trim(F.coalesce(F.col(value_col), F.lit(""))) != ""), [seq_col], "_step")
        return df.withColumn("time", (F.col("_step") + 1).cast("long")).drop("_step")
    return df.withColumn("time", (F.col(seq_col) + 1).cast("long"))


def write_replay(points: DataFrame, path: str, units: int, first: int, until: int, order_by: list | None = None,
                 files: int = 1) -> None:
    """S7 into S8: envelopes of the points with ``first <= time // units <
    until``, a slice at a time, so that a file source that takes ``files``
    files a trigger sees one slice a micro-batch.  Slices without points leave
    no file.  ``order_by`` is the order of a slice over its files."""
    for k in range(first, until):
        part = encode_points(points.filter((F.col("time") >= k * units) & (F.col("time") < (k + 1) * units)))
        if order_by and files > 1:
            part = part.repartitionByRange(files, *order_by)
        else:
            part = part.repartition(files)
        if order_by:
            part = part.sortWithinPartitions(*order_by)
        part.select("value").write.mode("append").text(path)


# ---------------------------------------------------------------------- S1

def read_point_stream(spark: SparkSession, source: str = "kafka", options: dict | None = None,
                      path: str | None = None):
    """A streaming DataFrame with a string ``value`` column.

    ``kafka`` subscribes to a topic (``options`` carries bootstrap servers and
    topic); ``text`` reads new files of a folder, one record per line.
    """
    options = dict(options or {})
    if source == "kafka":
        reader = spark.readStream.format("kafka")
        options.setdefault("startingOffsets", "latest")
        for k, v in options.items():
            reader = reader.option(k, v)
        raw = reader.load()
        # (partition, offset) orders records inside a topic partition
        return kafka_text(raw).select("key", "value", "timestamp", "partition", "offset")
    reader = spark.readStream.format(source)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)
