"""Intermediate tables of a cluster never go to one machine's own folder."""

import pytest

from cueloom.streaming.run import shared_folder


class Session:
    def __init__(self, conf):
        self.conf = conf


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError):
        shared_folder(Session({"spark.master": "spark://host:7077"}), "x")


def test_the_folder_of_the_session_is_used():
    conf = {"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs:///shared"}
    assert shared_folder(Session(conf), "x").startswith("hdfs:///shared/cueloom/x-")
