import importlib.util

import __spark_entry__ as entry


def test_flagship_and_names(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    if importlib.util.find_spec("assaykit.llm"):
        assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    else:
        assert not any(x.startswith("op") or x == "pipeline" for x in names)


def test_a_missing_dependency_takes_the_training_data_queries_alone(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("assaykit.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "pyarrow.fs", None)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    monkeypatch.setitem(sys.modules, "assaykit.llm.common", None)
    names = entry.queries()
    assert "run_summary" in names and not any(x.startswith("op") or x == "pipeline" for x in names)
    assert set(entry.oracle_sql()) <= set(names)
