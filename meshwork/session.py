"""Session defaults and the shared working folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session that this library creates itself (tests, bench). On a
#: cluster the caller's session and its settings are used as they are.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.host": "127.0.0.1",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").config(map=LOCAL_CONF)
    builder = builder.config("spark.driver.memory", memory)
    return builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores)).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder, wherever Spark can read it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the context's checkpoint folder, which Spark takes from
    ``spark.checkpoint.dir``. Only where that is unset and all runs on this machine, as in tests, a
    temporary folder is set; on a cluster it must be set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="meshwork-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, sort_by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as parquet and read it back.

    It cuts the lineage like ``checkpoint()``, but the files are columnar and
    compressed and later scans prune their columns. Lost executors cost
    nothing that was written.
    """
    path = f"{shared_folder(df.sparkSession)}/meshwork-{uuid.uuid4().hex}"
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.options(**{"compression": "zstd"} | (options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._meshwork_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames; they can't be read any more."""
    for df in frames:
        path = getattr(df, "_meshwork_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_side(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else as it is.

    ``df`` should be cheap to count (a materialized table of narrow rows). Beyond the
    bound the join stays a sort-merge join, which AQE may still split where it is skewed.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that are no longer referred to.

    It deletes them when the driver's garbage collector finds the frames; between the large steps of a
    job this keeps the disk at the largest step instead of their sum.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
