"""Session builder and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on; sizes such as shuffle partitions stay with the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**REQUIRED, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Put the required settings on a session somebody else built."""
    for k, v in REQUIRED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a session without that setting (tests, a laptop) gets a fresh folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new sub-folder path of the shared folder, for a written table or a stream."""
    import uuid

    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


_written: list[str] = []  # tables that settle has written and nobody has taken over, newest last


def settle(df, **options):
    """Compute ``df`` once: write it to the shared folder and go on from the written table.

    This cuts the lineage, survives lost executors, and gives the planner the table's true size: a
    later join broadcasts it only if it is really below ``spark.sql.autoBroadcastJoinThreshold``.
    ``options`` are those of the Parquet writer.
    """
    path = fresh_dir(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """Meanwhile Spark removes the shuffle files of a job when it ends, not when the driver happens to collect garbage."""
    was = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, was)


def written_since(mark: int) -> list[str]:
    """Folders that ``settle`` has written since it had written ``mark`` (see ``mark``)."""
    return _written[mark:]


def mark() -> int:
    return len(_written)


def discard(spark: SparkSession, paths: list[str], in_use) -> list[str]:
    """Delete written tables, but those that the DataFrame ``in_use`` still reads; the latter are returned."""
    from urllib.parse import unquote

    read = [unquote(f) for f in in_use.inputFiles()] if paths else []
    left = [p for p in paths if any(p in f for f in read)]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p not in left:
            h = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            h.getFileSystem(conf).delete(h, True)
    return left
