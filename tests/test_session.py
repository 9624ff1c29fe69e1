from __future__ import annotations

import os

import pytest

from tidemark import session


class Named:
    """A session of which only the settings matter."""

    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,3000]", ""])
def test_no_machine_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Named(spark_master=master))
    assert session.shared_dir(Named(spark_master=master, spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_folder_a_session_on_one_machine(master):
    named = Named(spark_master=master)
    made = session.shared_dir(named)
    assert made.startswith("file:///") and session.shared_dir(named) == made
    os.rmdir(made.removeprefix("file://"))


def test_scratch_deletes_what_was_made_within(spark):
    kept = session.work_path(spark, "kept")
    spark.range(1).write.parquet(kept)
    with session.scratch(spark):
        df = session.materialize(spark.range(3), "gone")
        with session.scratch(spark):
            inner = session.materialize(spark.range(3), "inner")
            paths = [f.removeprefix("file://").rsplit("/", 1)[0] for f in (*df.inputFiles(), *inner.inputFiles())]
        assert df.count() == 3 and [os.path.exists(p) for p in paths][-1] is False
    assert not [p for p in paths if os.path.exists(p)] and spark.read.parquet(kept).count() == 1


def test_compare_and_swap(spark, tmp_path):
    a, b = (session.Versions(spark, f"file://{tmp_path}/x") for _ in range(2))
    assert a.read() == (0, None)
    assert a.replace(0, "one") and not b.replace(0, "other")
    assert b.read() == (1, "one") and b.replace(1, "two") and not a.replace(1, "late")
    for i in range(2, 30):
        assert a.replace(i, str(i))
    assert a.read() == (30, "29") and len(a._numbers()) == session.Versions.KEPT
