"""Session settings that the library needs, and helpers shared by its modules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "quillog") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # tables of durable() go when nothing refers to them
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, or this application's part of it.

    Where that is unset a temporary folder is used, but only by a local master: no executor of a
    cluster could read it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillog-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a Parquet table of the shared folder; the one that ``instead_of`` reads is deleted.

    What nobody discards goes when the application ends.

    For loops: a checkpoint keeps the constraints and size estimates of its plan, which grow with every
    step that is made from the one before, and a table has its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    if instead_of is not None:
        discard(instead_of)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table that ``df``, a result of ``written``, reads; nothing may read it afterwards."""
    files, spark = df.inputFiles(), df.sparkSession
    if files:
        old = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
