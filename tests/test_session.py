import os

import pytest

from folioforge.session import broadcast_if_small, materialize, release, shared_dir


def test_steps(spark):
    df = spark.range(10).toDF("x")
    step = materialize(df, "step")
    assert step.dtypes == df.dtypes and {r.x for r in step.collect()} == set(range(10))
    assert materialize(step.where("x > 99")).count() == 0
    folder = shared_dir(spark).removeprefix("file://")
    assert any(n.startswith(f"folioforge-{os.getpid()}-") for n in os.listdir(folder))
    assert "broadcast" in broadcast_if_small(step, 10)._jdf.queryExecution().toString() and broadcast_if_small(step, 9) is step
    release(spark)
    assert not any(n.startswith(f"folioforge-{os.getpid()}-") for n in os.listdir(folder))


def test_checkpoint_folder_of_the_session():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.checkpoint.dir": "hdfs://somewhere/shared/"})

    assert shared_dir(Session()) == "hdfs://somewhere/shared"


def test_a_cluster_needs_a_shared_folder():
    from folioforge import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Remote:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        session.shared_dir(Remote())


def test_steps_release_what_they_wrote(spark):
    from folioforge import session

    kept = session.materialize(spark.range(3), "kept")
    with session.steps(spark):
        inner = session.materialize(spark.range(4), "inner")
        assert inner.count() == 4
        path = inner.inputFiles()[0]
    assert kept.count() == 3 and not os.path.exists(path.removeprefix("file://"))
