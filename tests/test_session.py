from types import SimpleNamespace
from urllib.parse import urlparse
from pathlib import Path

import pytest

from colloquy.session import cut, ensure_checkpoint_dir, stages


def test_stages_leave_no_table_behind(spark):
    ensure_checkpoint_dir(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    before = set(folder.glob("cut-*"))
    with stages(spark):
        kept = cut(spark.range(5))
        assert cut(kept.where("id > 2")).count() == 2
        assert len(set(folder.glob("cut-*")) - before) == 2
    assert set(folder.glob("cut-*")) == before


def cluster(master, named=None):
    made = []
    conf = SimpleNamespace(get=lambda key, default=None: named)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context, conf=conf), made


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(cluster(master)[0])
    session, made = cluster(master, "hdfs:///shared")
    ensure_checkpoint_dir(session)
    assert made == ["hdfs:///shared"]


def test_a_single_machine_makes_its_own():
    session, made = cluster("local[4]")
    ensure_checkpoint_dir(session)
    assert len(made) == 1
