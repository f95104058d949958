import glob
import importlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from nearscore import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (x[columns].sort_values(columns, ignore_index=True).astype(object) for x in (got, want))
    assert ((a == b) | (a.isna() & b.isna())).all().all()


def test_recall_of_the_embeddings_index(spark):
    assert engine.recall_at_5(spark, SF).first().recall >= 0.9


def test_queries_without_sql(spark):
    rows = engine.kmeans_ivf_recall(spark, SF).collect()
    assert [r.recall for r in sorted(rows, key=lambda r: r.nprobe)][-1] >= 0.97
    assert engine.fnv1a_merchants(spark, SF).count() == 200


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rest_works_without_llm(tmp_path):
    """As it is when the training-data folders and the pipeline are gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "nearscore"), tmp_path / "nearscore", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_exact_vote' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_import_errors_are_not_swallowed(tmp_path, monkeypatch):
    (tmp_path / "broken_module.py").write_text("import surely_not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert entry._optional("not_here_at_all", "not_here_at_all") is None
    with pytest.raises(ModuleNotFoundError):
        entry._optional("broken_module", "broken_module")
    importlib.invalidate_caches()
