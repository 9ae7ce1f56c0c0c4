from types import SimpleNamespace

import pytest

from plumbline.llm import scratch


def session(setting, master):
    """A stand-in that has what ``shared_dir`` reads and, like a running session, no way to change the setting."""
    get = lambda *_: setting
    return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get)))


def test_folder():
    assert scratch.shared_dir(session("file:/shared/", "spark://host:7077")) == "file:/shared"
    assert scratch.shared_dir(session(None, "local[2]")) == scratch.LOCAL_DEFAULT
    with pytest.raises(RuntimeError):
        scratch.shared_dir(session(None, "spark://host:7077"))
