"""Session factory, table loader and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(cores: str | int = "*", app: str = "locatext", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with. On a cluster
    pass your own session instead; no operator needs more than the defaults."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; only Spark touches the path, so any store it knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session on one
    machine (tests) may leave it unset, and then gets a folder under the warehouse."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "") or "file:/tmp/locatext"
        named = os.path.join(warehouse, "locatext-shared")
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; whatever is there goes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    on_store = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = on_store.getFileSystem(spark._jsc.hadoopConfiguration())
    # Only paths that exist can be marked for removal.
    store.mkdirs(on_store)
    store.deleteOnExit(on_store)
    return path


def release(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that no plan still to be run reads."""
    for df in tables:
        on_store = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        on_store.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(on_store, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back,
    so a lost executor costs a re-read and not the whole plan."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    # Zstandard keeps no direct buffers between tasks, as Snappy does until a full collection.
    df.write.mode("append").option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back
