"""A keyed table in hash buckets whose versions are switched by one rename.

``target/data/<name>/bucket=<b>`` holds rows, ``target/versions/<n>`` says for each bucket which folder is its newest, and
which batch was applied last. A merge reads and writes only the buckets that its rows fall into; its folders are nobody's
until the file of the next version has been renamed into place. So a reader sees one whole version, a job that dies half
way leaves the last one, and a batch that is delivered again is known by its number and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, target: str) -> list[int]:
    """The numbers of the versions that are there, ascending."""
    fs, folder = _fs(spark, f"{target}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, target: str, number: int | None = None) -> dict:
    """What a version (the newest by default) consists of; an empty table before the first one."""
    there = versions(spark, target)
    if not there:
        return {"number": 0, "batch": -1, "buckets": BUCKETS, "schema": None, "folders": {}}
    fs, path = _fs(spark, f"{target}/versions/{there[-1] if number is None else number}")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_version(spark: SparkSession, target: str, number: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The rows of a version, or of some of its buckets; None before the first version."""
    found = manifest(spark, target, number)
    if found["schema"] is None:
        return None
    schema = StructType.fromJson(found["schema"])
    folders = [f"{target}/data/{name}/bucket={b}" for b, name in found["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_version(rows: DataFrame, target: str, key: str, gone=None, batch: int | None = None, before_switch: Callable[[], None] | None = None) -> DataFrame | None:
    """Put ``rows`` (one a key) in place of what the table holds for their keys, and drop the keys for which ``gone`` (a
    column) holds. Returns the rows that differed from what was stored, None where ``batch`` was applied before.

    Rows equal to the stored ones touch nothing: a bucket without a changed row is neither rewritten nor listed anew.
    """
    spark = rows.sparkSession
    old = manifest(spark, target)
    if batch is not None and batch <= old["batch"]:
        return None
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(old["buckets"])).cast("int")
    fresh = rows.withColumn("gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)).withColumn("bucket", place)
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most as many as there are buckets
    stored = read_version(spark, target, old["number"] or None, touched) if old["schema"] else spark.createDataFrame([], rows.schema)
    both = stored.withColumns({"fresh": F.lit(0), "gone": F.lit(False), "bucket": place}).unionByName(fresh.withColumn("fresh", F.lit(1)))
    value = F.struct(*(c for c in rows.columns if c != key))
    pair = both.groupBy("bucket", key).agg(F.max_by(value, "fresh").alias("new"), F.max_by("gone", "fresh").alias("gone"), F.max("fresh").alias("fresh"), F.min("fresh").alias("first"), F.min_by(value, "fresh").alias("old"))
    changed = (F.col("fresh") == 1) & F.when(F.col("first") == 1, ~F.col("gone")).otherwise(F.col("gone") | ~F.col("new").eqNullSafe(F.col("old")))
    name = uuid.uuid4().hex
    marked = pair.withColumn("changed", changed).select("bucket", key, "new.*", "gone", "changed")
    marked.write.parquet(f"{target}/data/{name}-merged")
    merged = spark.read.schema(marked.schema).parquet(f"{target}/data/{name}-merged")
    dirty = [r.bucket for r in merged.where("changed").select("bucket").distinct().collect()]
    folders = dict(old["folders"])
    if dirty:
        keep = merged.where(F.col("bucket").isin(dirty) & ~F.col("gone")).select("bucket", *rows.columns)
        keep.write.partitionBy("bucket").parquet(f"{target}/data/{name}")
        fs, _ = _fs(spark, target)
        for b in dirty:  # a bucket whose last row is gone has no folder
            folders.pop(str(b), None)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/data/{name}/bucket={b}")):
                folders[str(b)] = name
    if before_switch:
        before_switch()
    _switch(spark, target, {**old, "number": old["number"] + 1, "batch": old["batch"] if batch is None else batch, "schema": rows.schema.jsonValue(), "folders": folders})
    return merged.where("changed").select(*rows.columns, "gone")


def _switch(spark: SparkSession, target: str, new: dict) -> None:
    """Write the version's file aside and rename it; a number that another writer has taken is an error."""
    fs, aside = _fs(spark, f"{target}/versions/{new['number']}-{uuid.uuid4().hex}.part")
    fs.mkdirs(aside.getParent())
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(new).encode()))
    finally:
        stream.close()
    goal = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/versions/{new['number']}")
    if fs.exists(goal) or not fs.rename(aside, goal):
        fs.delete(aside, False)
        raise RuntimeError(f"version {new['number']} of {target} has been written by another job")


def expire_versions(spark: SparkSession, target: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions, and the folders that none of these names."""
    there = versions(spark, target)
    fs, data = _fs(spark, f"{target}/data")
    for n in there[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/versions/{n}"), False)
    held = {(name, b) for n in there[-keep:] for b, name in manifest(spark, target, n)["folders"].items()}
    for folder in fs.listStatus(data) if fs.exists(data) else []:
        name = folder.getPath().getName()
        if not any(name == h for h, _ in held):
            fs.delete(folder.getPath(), True)
            continue
        for part in fs.listStatus(folder.getPath()):
            b = part.getPath().getName()
            if b.startswith("bucket=") and (name, b[7:]) not in held:
                fs.delete(part.getPath(), True)
