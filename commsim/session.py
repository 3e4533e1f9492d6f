"""Session helpers: shared storage, written intermediates and size-checked broadcasts.

Intermediate tables of a run live in one folder below the one named by ``spark.checkpoint.dir``. They are kept until the
caller's :func:`release` or the cluster's own retention removes them, because a lost executor may need them at any time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_DIR = "spark.checkpoint.dir"
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own. ``shared`` is its intermediate folder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("commsim")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return (builder.config(CHECKPOINT_DIR, shared) if shared else builder).getOrCreate()


def run_folder(spark: SparkSession) -> str:
    """The run's folder for intermediates: in the session's checkpoint folder, or else in its warehouse, which is shared too."""
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/commsim-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet, below the folder that all executors share."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes the run's intermediates; frames that read them are of no use afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to shared storage and go on from the written table.

    Cuts the lineage, lets several consumers share the result, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df`` take at most ``max_bytes``. Measuring runs ``df``, so hand in a written table."""

    def width(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            column = F.to_json(F.struct(column))
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.lit(8)
        return F.coalesce(F.octet_length(column), F.lit(0))

    widths = [width(f) for f in df.schema.fields]
    row_bytes = reduce(lambda a, b: a + b, widths, F.lit(16))
    total = df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return total <= max_bytes


def small(df: DataFrame) -> DataFrame:
    """The written table ``df``, marked for broadcast if its measured size allows it.

    Without the mark, Spark joins by shuffle and its adaptive skew handling splits hot keys.
    """
    return F.broadcast(df) if fits_broadcast(df) else df
