"""Session set-up, shared scratch space and the size checks behind broadcasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# A side of a join is broadcast only when it has at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

# Only an input below this size is dealt out anew to occupy the cores.
SPREAD_BYTES = 256 << 20


def build_session(app: str = "casemill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Where it names none, a folder in the warehouse, which all executors share too; a
    warehouse on a machine's own disk is good for local runs only, and refused elsewhere.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("On a cluster, name a folder that all executors share in spark.checkpoint.dir")
    return f"{warehouse}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody else writes to, below the shared folder."""
    return f"{_checkpoint_ready(spark)}/{name}-{uuid.uuid4().hex}"


def _checkpoint_ready(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return context.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows."""
    _checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Unlike a checkpoint the result is a scan, so filters and column choices of
    every later use reach the files.
    """
    path = scratch_path(df.sparkSession, name) + ".parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small input enough partitions to occupy the cluster.

    A file scan splits by bytes, so a few megabytes of text arrive as one task
    however much work each row is. The shuffle is added only below ``SPREAD_BYTES``,
    whatever the cluster; a larger input is returned as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if cores > 1 and plan_bytes(df) < min(SPREAD_BYTES, cores * _split_bytes(spark)):
        return df.repartition(cores, *keys)
    return df


def _split_bytes(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def _bytes_of(field: T.StructField) -> Column:
    """About the bytes that a value takes."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
    return F.lit(8)


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most that many rows and bytes; looks no further than that many rows."""
    size = sum((_bytes_of(f) for f in df.schema.fields), F.lit(0))
    held = df.limit(max_rows + 1).select(size.cast("bigint").alias("bytes"))
    found = held.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).head()
    return found["rows"] <= max_rows and found["bytes"] <= max_bytes


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Add 0, 1, ... in the given order, counted without one task that sorts all rows.

    Rows are range-partitioned and written; each part counts for itself, and only the
    parts' sizes, one row each, are summed up in order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered"
    )
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(before, F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(starts, "_part").withColumn(name, F.col("_start") + inside).drop("_part", "_start")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def lookup(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    salts: int = 32,
    salt_by: list[str] | None = None,
) -> DataFrame:
    """Join ``big`` to one-row-per-key ``small`` without a hot-key task.

    ``small`` goes to every executor when a count proves it short. Otherwise each
    of its rows is repeated once per salt, and ``big`` spreads every key over the
    salts, so a key holding a third of the rows is split ``salts`` ways.
    """
    if fits(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    spread_over = salt_by or [f"`{c}`" for c in big.columns if c not in on] or list(on)
    salt = fresh(big, fresh(small, "_salt"))
    salted = big.withColumn(salt, F.pmod(F.xxhash64(*spread_over), F.lit(salts)).cast("int"))
    repeated = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, salt], how).drop(salt)
