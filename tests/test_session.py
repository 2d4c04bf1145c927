"""Where intermediate results go."""

import os
from types import SimpleNamespace

import pytest

from chronoloom import session


def fake(master, named=None, checkpoints=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoints))


def test_a_cluster_names_its_shared_folder(monkeypatch):
    monkeypatch.setattr(session, "_LOCAL", [])
    assert session.shared_folder(fake("spark://a:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.shared_folder(fake("spark://a:7077", None, "hdfs:///set")) == "hdfs:///set"
    for master in ("spark://a:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.shared_folder(fake(master))


def test_a_local_session_gets_one_temporary_folder():
    at = session.shared_folder(fake("local[4]"))
    assert os.path.isdir(at) and session.shared_folder(fake("local")) == at


def test_scratch_folders_are_new(spark):
    a, b = session.scratch_folder(spark), session.scratch_folder(spark)
    assert a != b and os.path.isdir(a.removeprefix("file:")) and os.path.isdir(b.removeprefix("file:"))
