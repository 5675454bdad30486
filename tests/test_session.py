import pytest

from evenkeel import session


class Remote:
    """A session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Remote, "x")
    assert session.scratch_dir(Remote, "x", "hdfs://shared/").startswith("hdfs://shared/x-")


def test_stored_tables_can_be_removed(spark, tmp_path):
    kept = session.stored(spark.range(5).toDF("id"), "t", f"file://{tmp_path}")
    assert kept.count() == 5 and any(tmp_path.iterdir())
    assert session.remove_stored(spark) >= 1
    assert not any(tmp_path.iterdir())
