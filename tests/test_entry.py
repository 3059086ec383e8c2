"""The driver's contract."""

import importlib
import sys

import pytest


def test_registries_agree():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    assert {"p1_found", "p2_found", "p6_found"} <= set(q)


def test_a_name_is_registered_once():
    from vecloom.plans.registry import Registry

    r = Registry()
    r.query("a")(lambda t: None)
    with pytest.raises(ValueError):
        r.query("a")(lambda t: None)


def test_the_rest_runs_without_the_subpackage(monkeypatch):
    for m in [m for m in sys.modules if m.startswith(("vecloom.llm", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "vecloom.llm", None)
    e = importlib.import_module("__spark_entry__")
    assert "p1_found" in e.queries() and not any(n.startswith(("p3", "p4", "p5", "p7", "p8", "p9")) for n in e.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_intermediates_are_removed(spark):
    from vecloom.session import SharedFiles, intermediates, settle, shared_dir

    files = SharedFiles(spark, shared_dir(spark) + "/vecloom")
    with intermediates(spark):
        kept = settle(spark.range(5), "kept-for-now")
        assert kept.count() == 5 and any(n.startswith("kept-for-now") for n in files.names())
    assert not any(n.startswith("kept-for-now") for n in files.names())
