"""Spark session for tests, benchmarks and scripts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: Intermediate folders by application.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder of its own; a
    cluster has no folder that could stand in for it, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tabulon-")
    return _own_dirs[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path under the shared folder; ``clear`` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes the intermediate folders made so far and returns their number; results that still read them have to be used or written before."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes one folder of ``new_folder``, once nothing reads it any more."""
    _made[spark.sparkContext.applicationId].remove(path)
    _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, *cluster: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, cut from its lineage; ``cluster`` sorts it for pushed filters."""
    path = new_folder(df.sparkSession, name)
    (df.sortWithinPartitions(*cluster) if cluster else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session in UTC with adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabulon")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
