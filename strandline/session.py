"""Session helpers: worker import path, shared scratch tables, table readers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build(app: str = "strandline", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("STRANDLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Bytes of a batch that goes to a Python worker, at most: a worker holds a batch a few times over.
BATCH_BYTES = 8 << 20


def ensure_workers(spark: SparkSession) -> None:
    """Python workers find this package even when the driver was started elsewhere, and get batches of bounded size."""
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(batch, None) is None:  # not set by the session's owner
        spark.conf.set(batch, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in known:
        env["PYTHONPATH"] = ":".join([ROOT, *known])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting gets a folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            found = "file://" + tempfile.mkdtemp(prefix="strandline-")
            sc.setCheckpointDir(found)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


#: With it, Spark deletes the shuffle files of a query when that ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it back; what it shuffled is deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by stored() that nothing will read again."""
    for df in frames:
        path = getattr(df, "_strandline_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
