"""The versioned table across crashes and repeated deliveries; first-seen state across restarts and expiry."""

import time

import pytest
from pyspark.sql import functions as F

from caselink.session import new_path
from caselink.streaming import jobs, versions
from caselink.streaming.versions import expire_versions, manifest, merge_version, read_version


def held(spark, target, number=None):
    df = read_version(spark, target, number)
    return {} if df is None else {r.chunk_id: r.digest for r in df.collect()}


def rows(spark, **pairs):
    return spark.createDataFrame(list(pairs.items()), "chunk_id string, digest string")


def folders(spark, target):
    fs, p = versions._fs(spark, f"{target}/data")
    return {s.getPath().getName() for s in fs.listStatus(p)}


def test_merge_rewrites_only_changed_buckets(spark):
    target = new_path(spark, "versions")
    assert held(spark, target) == {} and versions.versions(spark, target) == []
    first = {f"k{i}": "a" for i in range(500)}
    assert merge_version(rows(spark, **first), target, "chunk_id", batch=0).count() == 500
    one = manifest(spark, target)
    assert held(spark, target) == first and len(one["folders"]) == versions.BUCKETS
    changed = merge_version(rows(spark, k1="b", k2="a", new="c", none=None), target, "chunk_id", F.col("digest").isNull(), 1)
    assert {(r.chunk_id, r.digest) for r in changed.collect()} == {("k1", "b"), ("new", "c")}
    two = manifest(spark, target)
    moved = {b for b in two["folders"] if two["folders"][b] != one["folders"].get(b)}
    assert 1 <= len(moved) <= 2 and held(spark, target) == first | {"k1": "b", "new": "c"}
    assert held(spark, target, 1) == first  # a reader of the earlier version still has it
    merge_version(rows(spark, k1=None, k3=None), target, "chunk_id", F.col("digest").isNull(), 2)
    assert held(spark, target) == {k: v for k, v in first.items() if k not in ("k1", "k3")} | {"new": "c"}
    assert merge_version(rows(spark, k5="zzz"), target, "chunk_id", batch=2) is None  # delivered again
    assert merge_version(rows(spark, k5="a"), target, "chunk_id", batch=3).count() == 0
    assert manifest(spark, target)["folders"] == manifest(spark, target, 3)["folders"]
    now = held(spark, target)
    expire_versions(spark, target, keep=1)
    assert versions.versions(spark, target) == [4] and held(spark, target) == now
    assert folders(spark, target) <= set(manifest(spark, target)["folders"].values())


def test_emptied_bucket_and_null_key(spark):
    target = new_path(spark, "versions")
    merge_version(rows(spark, a="1"), target, "chunk_id")
    merge_version(spark.createDataFrame([(None, "x"), ("a", None)], "chunk_id string, digest string"), target, "chunk_id", F.col("digest").isNull())
    assert held(spark, target) == {None: "x"}
    merge_version(spark.createDataFrame([(None, None)], "chunk_id string, digest string"), target, "chunk_id", F.col("digest").isNull())
    assert held(spark, target) == {} and manifest(spark, target)["folders"] == {}


def test_two_writers_of_a_version(spark):
    target = new_path(spark, "versions")
    with pytest.raises(RuntimeError, match="another job"):
        merge_version(rows(spark, a="mine"), target, "chunk_id", before_switch=lambda: merge_version(rows(spark, a="theirs"), target, "chunk_id"))
    assert held(spark, target) == {"a": "theirs"}


def test_sync_survives_a_crash_between_data_and_version(spark):
    target, source = new_path(spark, "sync"), new_path(spark, "chunks")
    rows(spark, a="1", b="1", c="1").write.parquet(source)
    stream = spark.readStream.schema("chunk_id string, digest string").parquet(source)
    jobs.stream_sync(stream, target).awaitTermination()
    rows(spark, b="2", c=None, d="1").write.mode("append").parquet(source)

    def die():
        raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        jobs.stream_sync(stream, target, before_switch=die).awaitTermination()
    assert held(spark, target) == {"a": "1", "b": "1", "c": "1"}  # whole, as before
    seen = []
    jobs.stream_sync(stream, target, lambda n, changed: seen.append((n, changed.count()))).awaitTermination()
    assert held(spark, target) == {"a": "1", "b": "2", "d": "1"} and seen == [(1, 3)]
    # the same files again, as a batch of their own number and as a new one: nothing moves
    before = manifest(spark, target)
    assert merge_version(rows(spark, b="2", c=None, d="1"), target, "chunk_id", F.col("digest").isNull(), 1) is None
    assert merge_version(rows(spark, b="2", c=None, d="1"), target, "chunk_id", F.col("digest").isNull(), 2).count() == 0
    assert manifest(spark, target)["folders"] == before["folders"] and held(spark, target) == {"a": "1", "b": "2", "d": "1"}


def files(spark, path, *pairs):
    spark.createDataFrame(pairs, "file_id long, hash string").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("ttl", [None, 4000])
def test_first_seen_across_restart_and_expiry(spark, ttl):
    source, out, progress = (new_path(spark, x) for x in ("files", "seen", "progress"))
    stream = lambda: jobs.stream_first_seen(spark.readStream.schema("file_id long, hash string").parquet(source), ttl)
    found = lambda: {r.file_id: (r.hash, r.original, r.duplicate) for r in spark.read.parquet(out).collect()}
    files(spark, source, (5, "a"), (3, "a"), (9, "b"), (7, None))
    jobs.run_stream(stream(), out, progress)
    assert found() == {3: ("a", 3, False), 5: ("a", 3, True), 9: ("b", 9, False), 7: (None, 7, False)}
    files(spark, source, (1, "b"), (8, None))
    jobs.run_stream(stream(), out, progress)  # a new query on the same checkpoint
    if not ttl:
        assert found()[1] == ("b", 9, True) and found()[8] == (None, 7, True)
    time.sleep(5 if ttl else 0)
    files(spark, source, (2, "a"), (4, "a"))
    jobs.run_stream(stream(), out, progress)
    assert (found()[2], found()[4]) == ((("a", 2, False), ("a", 2, True)) if ttl else (("a", 3, True), ("a", 3, True)))
