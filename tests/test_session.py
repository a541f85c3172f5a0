"""The folder that driver and executors share."""

import pytest

from paratope import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


def fake(master, **conf):
    context = type("Context", (), {"master": master, "getConf": lambda self: Conf(conf)})()
    return type("Session", (), {"conf": Conf(), "sparkContext": context})()


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_a_local_session_has_its_own(spark):
    assert session.is_local(spark) and session.shared_dir(spark)
    own = session.shared_dir(fake("local[4]"))
    assert own.startswith("file:///") and own == session.shared_dir(fake("local"))
