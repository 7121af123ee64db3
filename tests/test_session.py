"""Where written intermediates go."""

import pytest

from lexshape import session


class _Context:
    folder, master = None, "local[2]"

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, path):
        self.folder = path


class _Session:
    def __init__(self, named):
        self.sparkContext = _Context()
        self.conf = {"spark.checkpoint.dir": named} if named else {}


def test_the_named_folder_is_used_and_one_is_made_only_where_none_is_named():
    assert session.checkpoint_root(_Session("/shared/x")) == "/shared/x"
    bare = _Session(None)
    first = session.checkpoint_root(bare)
    assert first and session.checkpoint_root(bare) == first == bare.sparkContext.folder
    assert session.scratch_path(bare, "t").startswith(first + "/lexshape/t-")


def test_a_cluster_without_a_shared_folder_is_refused():
    bare = _Session(None)
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        bare.sparkContext.master = master
        with pytest.raises(ValueError):
            session.checkpoint_root(bare)


def test_settled_tables_are_equal_and_have_no_lineage(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string").repartition(2)
    kept = session.settle(df)
    assert sorted(kept.collect()) == sorted(df.collect())
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
