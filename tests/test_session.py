"""The shared folder is never a machine's own on a cluster."""

import pytest

from caselink import session


class Context:
    def __init__(self, master):
        self.master = master

    def getConf(self):  # noqa: N802
        return {}


class Session:
    def __init__(self, master, **conf):
        self.held, self.sparkContext = conf, Context(master)
        self.conf = self

    def get(self, key, default=None):
        return self.held.get(key, default)

    def set(self, key, value):
        self.held[key] = value


def test_shared_folder():
    assert session.shared_dir(Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.shared_dir(Session(master))
    mine = Session("local[4]")
    assert session.shared_dir(mine) == session.shared_dir(mine) and session.shared_dir(mine).startswith("file:///")


def test_partitions_and_scans_follow_the_size_of_a_table(spark, tmp_path):
    from caselink.session import spread

    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    path = f"{tmp_path}/t.parquet"
    spark.range(20000).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "t.parquet").iterdir() if f.suffix == ".parquet")
    try:
        spread(spark, path)
        assert {k: spark.conf.get(k) for k in keys} == before  # small tables leave the session as it is
        spread(spark, path, each=4000, scan=10000)
        made = int(spark.conf.get(keys[0]))
        assert size / 4000 <= made <= 1.1 * size / 4000 + 1 and [int(spark.conf.get(k).rstrip("b")) for k in keys[1:]] == [10000, 8000]
        spread(spark, path, each=8000, scan=20000)
        assert int(spark.conf.get(keys[0])) == made and [int(spark.conf.get(k).rstrip("b")) for k in keys[1:]] == [10000, 8000]  # never fewer, never larger
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
