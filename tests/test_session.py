"""Where lineage cuts are written."""

import pytest

from tillwright import session


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, context, shared=None):
        self.sparkContext, self.conf = context, {"spark.checkpoint.dir": shared}


def test_shared_folder_comes_from_the_session():
    context = FakeContext("spark://host:7077")
    session._ensure_checkpoint_dir(FakeSession(context, "hdfs:///shared"))
    assert context.folder == "hdfs:///shared"


def test_a_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session._ensure_checkpoint_dir(FakeSession(FakeContext("yarn")))


def test_local_mode_may_use_its_own_folder():
    context = FakeContext("local[2]")
    session._ensure_checkpoint_dir(FakeSession(context))
    assert context.folder
    before = context.folder
    session._ensure_checkpoint_dir(FakeSession(context, "elsewhere"))
    assert context.folder == before


def test_settled_frames_have_no_lineage(spark):
    settled = session.settle(spark.range(3))
    assert settled.count() == 3 and "Range" not in settled._jdf.queryExecution().executedPlan().toString()
