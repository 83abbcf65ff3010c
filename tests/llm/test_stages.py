from types import SimpleNamespace

import pytest

from ledgerloom.llm import stages


def session(master, **settings):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=settings.get, set=settings.__setitem__))


def test_a_cluster_has_to_name_its_folder():
    with pytest.raises(RuntimeError):
        stages.shared_folder(session("spark://somewhere:7077"))
    named = session("spark://somewhere:7077", **{stages.CHECKPOINT_CONF: "hdfs://shared"})
    assert stages.shared_folder(named) == "hdfs://shared"
    local = session("local[2]")
    assert stages.shared_folder(local) == stages.shared_folder(local)
