"""Session helpers: a local test session and durable lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "hawkgrid", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and local benchmarks; clusters bring their own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a ``local[...]`` session, where driver and executors are one process on one
    disk, may fall back to a temporary folder, which goes when the driver ends; on any
    cluster (``local-cluster`` included) a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hawkgrid-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(f"file://{folder}")
    return sc.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and continue from the files.

    Needed where a later step must see exactly the same rows again (sampled range
    bounds, iterative joins), also after an executor is lost. Unlike an RDD checkpoint the
    files are columnar and compressed, and later filters and column selections reach them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
