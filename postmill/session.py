"""Session construction for local runs, tests and benchmarks."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "postmill", **conf: str) -> SparkSession:
    """A local session with the settings the library assumes: UTC, AQE and Arrow.

    On a cluster use the session the platform gives; only the UTC time zone matters for results.
    """
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call site for each column: building large plans takes a fifth less
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables below ``sf_dir``, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows that one task takes of a table for costly work on each of them.
ROWS_A_TASK = 10_000


def spread(rows: DataFrame, *by: str, least: int = ROWS_A_TASK, ranged: bool = False) -> DataFrame:
    """A stored table dealt into tasks by its number of rows, in turn, by hash or (``ranged``) by ranges of ``by``, before costly work on each row.

    A compact file is one split, and so one task, however many rows it holds. Their count comes from the footers.
    """
    n = max(1, math.ceil(rows.count() / least))
    return rows.repartitionByRange(n, *by) if ranged else rows.repartition(n, *by)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where it is unset and the master is local (tests) a folder of this machine is made and set; RuntimeError on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="postmill-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below :func:`checkpoint_root`; the file system deletes it when the application ends."""
    root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root
