"""Session helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_stages: list[str] = []


def local_session(cpus: int | str = 8, app: str = "triagedeck") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


@lru_cache(maxsize=1)
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="triagedeck-")


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in its settings.

    Without that setting a session in local mode (a test) uses a folder of this machine, and any
    other fails: its executors would not see each other's parts.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return (named or _own_root()).rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder name below the shared root."""
    return f"{shared_root(spark)}/triagedeck/{name}-{uuid.uuid4().hex}"


def use_all_cores(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan of fewer splits than cores by its key before costly row work.

    A table large enough to give every core a split is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that values which must not change between two uses
    survive the loss of an executor.
    """
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    _stages.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*stages: DataFrame) -> int:
    """Delete tables that ``materialise`` wrote and that nothing reads any more, ahead of ``release_stages``."""
    folders = {file.rsplit("/", 2)[-2] for df in stages for file in df.inputFiles()}
    done = 0
    for path in [p for p in _stages if p.rsplit("/", 1)[-1] in folders]:
        spark = stages[0].sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        _stages.remove(path)
        done += bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))
    return done


def release_stages(spark: SparkSession) -> int:
    """Delete the tables ``materialise`` wrote in this process; results read from them end here."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _stages:
        path = jvm.org.apache.hadoop.fs.Path(_stages.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done
