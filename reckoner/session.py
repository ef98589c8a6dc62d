"""Session helpers: shared storage for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


HUGE_METHOD = 8000  # bytes of code from which on the JVM leaves a method uncompiled


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs count on: adaptive plans, skewed join keys split even where that
    costs a further shuffle of aggregated rows, and no stage fused into one method that the JVM would
    only interpret: a projection of many draws is then generated by itself, in small methods. The shuffle
    files of a job go when it ends: what later jobs read is written, so files of finished steps only
    fill the disks (a DataFrame that runs twice makes them again)."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "2.5")  # rows are larger than compressed files: no join broadcasts what only looks small
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD))
    for name in ("enabled", "skewJoin.enabled", "forceOptimizeSkewedJoin"):
        spark.conf.set(f"spark.sql.adaptive.{name}", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="reckoner-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_WRITTEN: dict[str, list[str]] = {}


_TABLES: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``cleanup`` removes."""
    path = f"{shared_folder(spark)}/reckoner/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Remove the intermediate tables this application has written to the shared folder; DataFrames that read them end with it. Returns their number."""
    for table in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


STORED = "zstd"  # compression of written members, matches, payments and pairs


def written_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: what was drawn from partition
    boundaries stays fixed when an executor is lost and its tasks run again."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_rows(df: DataFrame) -> DataFrame:
    """The rows of a small table dealt over all tasks, for steps that cost far more than the read: a file with one row group is one task otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucketed_table(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Write ``df`` once to the shared folder, bucketed and sorted by ``keys``, and read it back: joins on these keys neither shuffle nor sort it again. There are as many
    buckets as shuffle partitions, one file each."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"reckoner_{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)
