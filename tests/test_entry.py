import __spark_entry__ as entry_points


def test_contract(spark):
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60
    assert entry_points.entry(spark).count() > 0


def test_library_does_not_import_the_corpus_subpackage():
    from pathlib import Path

    root = Path(entry_points.__file__).parent / "siltstone"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "siltstone.llm" not in path.read_text(), path
