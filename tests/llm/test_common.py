import os
from types import SimpleNamespace

import pytest

from scriptorium.llm import common


def session(master, named=None, app="app"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master, applicationId=app, getCheckpointDir=lambda: None))


def test_a_cluster_must_name_its_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_folder(session(master))
    assert common.shared_folder(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    own = common.shared_folder(session("local[4]"))
    assert os.path.isdir(own) and common.shared_folder(session("local[4]")) == own


def test_what_was_cut_can_be_cleared(spark):
    common.clear(spark)
    df = common.cut(spark.range(5))
    assert sorted(r.id for r in df.collect()) == list(range(5))
    path = common._WRITTEN[spark.sparkContext.applicationId][0]
    assert os.path.isdir(path)
    assert common.clear(spark) == 1 and not os.path.exists(path)
