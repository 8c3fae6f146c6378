"""Session helpers: reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: every later use sees the same rows, even after lost executors."""
    spark = df.sparkSession
    root = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """A reduced table written to the shared folder and read back.

    Columnar, so later passes read only the columns they need, and with a known
    size, so the planner can decide on broadcasts itself.
    """
    return materialize_counted(df)[0]


def materialize_counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """The written table and its row count ``n`` (plus other aggregates), seen while writing."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def materialize_at(df: DataFrame, path: str, compression: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """``materialize`` to a path the caller drops with ``drop_written`` once nothing reads it any more.

    The writer asks for its size after a hundred rows at the earliest and holds them until then; ``group_bytes``, for rows of
    megabytes, has it asked after every row.
    """
    large = {"parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": False}
    df.write.options(**large if group_bytes else {}).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a table written below the shared folder; a path elsewhere is refused."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settle(spark: SparkSession) -> None:
    """Collect garbage in the driver: Spark deletes the shuffle files of plans that nothing refers to any more.

    Written tables stay; what a running or later plan needs is still referred to. Spark's event queue refers to the query that
    ended last, so a trivial one comes first.
    """
    spark.sql("select 1").collect()
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash partitioning ahead of an explode.

    The number of partitions is given, because adaptive coalescing would size
    them by the bytes before the rows multiply.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(frozen: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only if a frozen table really has at most ``max_rows`` rows and ``max_bytes`` as text."""
    row = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in frozen.columns])))
    seen = frozen.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("size")).first()
    return F.broadcast(frozen) if seen["n"] <= max_rows and seen["size"] <= max_bytes else frozen
