import importlib
import importlib.util
import os

import pytest

DATA = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_core_queries_against_sql(spark):
    """Row counts of every core query that has SQL (the driver compares values)."""
    import duckdb

    from papyrine.plans import queries as core

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    for name, sql in core.oracle_sql().items():
        assert core.queries()[name](spark, DATA).count() == con.sql(f"select count(*) from ({sql})").fetchall()[0][0], name


def test_a_broken_subpackage_is_an_error(monkeypatch):
    """Only an absent subpackage is left out; an error inside it is not silenced."""
    import sys

    if importlib.util.find_spec("papyrine.llm") is None:
        pytest.skip("absent here")
    for name in [n for n in sys.modules if n.startswith("papyrine.llm")] + ["__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "pyarrow", None)
    import papyrine

    monkeypatch.delattr(papyrine, "llm", raising=False)
    with pytest.raises(ImportError):
        importlib.import_module("__spark_entry__")


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace as N

    from papyrine.session import shared_dir

    none = N(isDefined=lambda: False)
    context = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)), getConf=lambda: N(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        shared_dir(N(sparkContext=context, conf=N(get=lambda *_: None)))
