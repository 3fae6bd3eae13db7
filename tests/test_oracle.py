"""Every registered query against its SQL, and the entry point without the optional package."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SF)
    if name in catalogue.oracle_sql():
        assert differences(df, connect(SF), catalogue.oracle_sql()[name]) == ""
    else:
        assert len(df.collect()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_package(tmp_path):
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "tessera").mkdir()
    for p in (root / "tessera").iterdir():
        if p.name != "llm":
            (tmp_path / "tessera" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
    # A package that cannot be imported (something it needs is missing) is left out as well.
    (tmp_path / "tessera" / "llm").mkdir()
    (tmp_path / "tessera" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_rankings_are_not_empty(spark):
    """What the SQL is compared with has rows, both stages, and places that two lists share."""
    run = lambda name: catalogue.queries()[name](spark, "/root/testdata/sf0.01")
    assert {r["stage"] for r in run("bm25_cascade").select("stage").distinct().collect()} == {1, 2}
    assert {"body", "title", "body,title"} == {r["sources"] for r in run("rrf_sources_union").select("sources").distinct().collect()}
    assert run("docs_boosted_ranking").count() > 0 and run("search_then_filter").filter("qid >= 0").count() > 0
