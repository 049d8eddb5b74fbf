"""Table scans, table sinks and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Scan one parquet table of a dataset folder, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def micros(column) -> F.Column:
    """Microseconds since 1970-01-01 UTC of a TIMESTAMP or TIMESTAMP_NTZ column (session zone UTC)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; where it is unset (tests), make one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="chronoweave-checkpoint-")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: materialise in the reliable checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition over ``spark.sql.shuffle.partitions`` tasks, which the adaptive planner does not merge again:
    for steps that compute far longer than their bytes suggest."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def write_parquet(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    """Write a snapshot, optionally partitioned."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """Read JSON records; pass ``schema`` in production, inference costs a pass over the data."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume scan: the rows of ``todo`` whose key is not in ``done`` yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
