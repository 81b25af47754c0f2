"""Session helpers: where intermediate tables go, and how they are written."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parent.parent)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, as in tests, a new temporary one is
    made, but only for a session whose executors are this process; a cluster has to name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", size.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def spread(spark: SparkSession, path: str, each: int = 4 << 20, scan: int = 32 << 20) -> None:
    """Let shuffles have a partition for every ``each`` bytes of a table, and scans a task for every ``scan`` bytes at
    most, so that what one task holds doesn't grow with the table. Larger numbers of partitions and smaller scans that
    the session has stay; adaptive execution merges partitions that turn out small, up to twice ``each``: its usual
    64 MB of packed rows are gigabytes of strings in a task that sorts and groups them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    if -(-size // each) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", -(-size // each))
    for key, most in (("spark.sql.files.maxPartitionBytes", scan), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", 2 * each)):
        if size > scan and _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, most)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of an action as soon as it ends; else they lie until the driver collects garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and survives lost executors. Once
    the table is written the shuffles that made it are deleted."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout instead of an installation."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
