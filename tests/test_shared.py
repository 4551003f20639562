import pytest

from tidemark.sources import shared


class _Context:
    def __init__(self, master, named=None, known=None):
        self.master, self._named, self._known = master, named, known

    def getConf(self):
        return {"spark.checkpoint.dir": self._named}

    def getCheckpointDir(self):
        return self._known

    def setCheckpointDir(self, folder):
        self._known = folder


class _Session:
    conf = {"spark.sql.warehouse.dir": "file:/data/warehouse/"}

    def __init__(self, *args):
        self.sparkContext = _Context(*args)


def test_folder_that_the_cluster_names():
    assert shared.shared_dir(_Session("yarn", "hdfs:///scratch")) == "hdfs:///scratch"
    assert shared.shared_dir(_Session("local-cluster[3,2,3000]", "file:///tmp/shared")) == "file:///tmp/shared"


@pytest.mark.parametrize("known", [None, "file:/data/warehouse/_scratch", "/tmp/x"])
def test_local_folders_are_refused_on_a_cluster(known):
    with pytest.raises(ValueError):
        shared.shared_dir(_Session("yarn", None, known))
    session = _Session("local[4]", None, known)
    assert shared.shared_dir(session) == (known or "file:/data/warehouse/_scratch") == session.sparkContext.getCheckpointDir()
    assert shared.shared_dir(_Session("yarn", None, "hdfs:///x")) == "hdfs:///x"
