"""The registered queries, with and without the subpackage that may be missing."""

import sys

import pytest

import __spark_entry__


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_pipeline(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    from tempora.plans.queries import QUERIES, SQL

    assert __spark_entry__.queries() == QUERIES
    assert __spark_entry__.oracle_sql() == SQL


def test_a_broken_subpackage_is_no_missing_one(monkeypatch):
    if not __spark_entry__._has_llm():
        return
    monkeypatch.setitem(sys.modules, "zstandard", None)
    for name in [x for x in sys.modules if x.startswith(("tempora.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    with pytest.raises(ImportError):
        __spark_entry__.queries()


def test_no_machine_of_its_own_on_a_cluster():
    from types import SimpleNamespace

    from tempora.sources.folders import shared_folder

    def session(master, named=None):
        conf = SimpleNamespace(get=lambda key, default=None: named)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None))

    assert shared_folder(session("spark://one", "hdfs:/shared/")) == "hdfs:/shared"
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://one"))


def test_workers_find_the_engine(spark):
    seen = __spark_entry__._found(lambda s, sf_dir: dict(s.sparkContext.environment))(spark, "")
    again = __spark_entry__._found(lambda s, sf_dir: dict(s.sparkContext.environment))(spark, "")
    assert __spark_entry__._HERE in seen["PYTHONPATH"] and seen == again
