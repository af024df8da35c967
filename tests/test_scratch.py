"""Where scratch tables go, and when a side is broadcast."""

from types import SimpleNamespace

import pytest

from webtrawl.sources import scratch


def session(master, named):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: named),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_the_named_folder_wins():
    for master in ("local[2]", "spark://host:7077"):
        assert scratch.scratch_dir(session(master, "hdfs://shared/x")) == "hdfs://shared/x"
    path = scratch.scratch_path(session("yarn", "hdfs://shared/x/"), "label")
    assert path.startswith("hdfs://shared/x/app-1/label-")


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError):
        scratch.scratch_dir(session("yarn", None))
    own = scratch.scratch_dir(session("local[2]", None))
    assert own == scratch.scratch_dir(session("local[*]", None))


def test_materialize(spark):
    rows = scratch.materialize(spark.range(5), "five")
    assert sorted(r.id for r in rows.collect()) == list(range(5))
    assert "Scan parquet" in rows._jdf.queryExecution().toString() or "FileScan" in rows._jdf.queryExecution().toString()


def test_broadcast_only_below_the_bound(spark, monkeypatch):
    small = spark.range(10)
    hinted = scratch.broadcast_if_small(small, "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted.lower()
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 5)
    plain = scratch.broadcast_if_small(small, "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" not in plain.lower()
