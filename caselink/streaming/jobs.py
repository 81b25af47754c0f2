"""Streaming jobs: URL scoring, first-seen registration and chunk synchronisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caselink.operators.urls import score_host
from caselink.session import shared_dir, ship
from caselink.streaming.versions import merge_version

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_score(urls: DataFrame, indicators: DataFrame) -> DataFrame:
    """URLs scored as they arrive, with the verdict of a static indicator table (indicator, verdict) joined on the host."""
    scored = score_host(urls)
    return scored.join(indicators.select(F.col("indicator").alias("host"), F.col("verdict").alias("listed")), "host", "left")


class FirstSeen(StatefulProcessor):
    """One id a hash, kept until ``ttl`` milliseconds have passed since a file of that hash came last.

    Of the files of a new hash in one micro-batch the smallest id is the original; only their ids are held meanwhile. A
    file that comes again under its own id isn't its own duplicate.
    """

    def __init__(self, ttl: int | None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.original = handle.getValueState("original", "id long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids = np.sort(np.concatenate([part["file_id"].to_numpy(np.int64) for part in rows]))
        first = int(self.original.get()[0]) if self.original.exists() else int(ids[0])
        self.original.update((first,))
        yield pd.DataFrame({"file_id": ids, "hash": key[0], "original": first, "duplicate": ids != first})

    def close(self) -> None:
        pass


def stream_first_seen(files: DataFrame, ttl: int | None = None) -> DataFrame:
    """(file_id, hash, original, duplicate): the first file of each hash is the original, later ones point to it.

    State lies in RocksDB, keyed by hash, and survives a restart from the same checkpoint. A hash of which no file has
    come for ``ttl`` milliseconds of processing time is forgotten; without ``ttl``, none is. The session must use the
    RocksDB state store when the stream is started, as ``run_stream`` does.
    """
    ship(files.sparkSession)
    timed = "ProcessingTime" if ttl else "None"
    return files.groupBy("hash").transformWithStateInPandas(FirstSeen(ttl), "file_id long, hash string, original long, duplicate boolean", "Append", timed)


def stream_sync(chunks: DataFrame, target: str, done: Callable[[int, DataFrame], None] | None = None, before_switch: Callable[[], None] | None = None):
    """Apply each micro-batch of (chunk_id, digest) to the versioned table at ``target``: what is new or differs replaces
    its old row, a null digest removes it. Only the buckets with a changed row are rewritten, all of a batch becomes
    visible at once, and a batch that is delivered again changes nothing. Read it with ``versions.read_version``."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("chunk_id").agg(F.max("digest").alias("digest"))
        changed = merge_version(rows, target, "chunk_id", F.col("digest").isNull(), number, before_switch)
        if done and changed is not None:
            done(number, changed)

    return chunks.writeStream.foreachBatch(apply).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()


def run_stream(stream: DataFrame, path: str, progress: str) -> None:
    """Run a stream over what is there now, into Parquet at ``path``. Batches without data are off meanwhile: a state that
    expires by the clock would ask for one after another, and the run would never end."""
    spark = stream.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    was = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and give its rows."""
    from caselink.session import new_path

    spark = stream.sparkSession
    path = new_path(spark, name)
    run_stream(stream, path, f"{shared_dir(spark)}/progress-{name}-{path[-8:]}")
    return spark.read.schema(stream.schema).parquet(path)
