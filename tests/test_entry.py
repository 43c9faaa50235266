"""The registered queries: they agree with their SQL on the smallest tables, and the library stands without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from sievelake.plans import catalog
from tests.conftest import ROOT, SF


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def settled(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["impute_median", "outlier_iqr_clip", "dedup_exact_none", "dedup_jaccard_pairs", "dist_wasserstein", "dist_kl_divergence", "profile_columns", "eval_f1_macro", "stats_spearman", "prepare_and_score"])
def test_query_agrees_with_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = sql.execute(catalog.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert settled(df.collect(), df.columns) == settled(cursor.fetchall(), columns)


def test_entry_imports_without_the_llm_folders(tmp_path):
    shutil.copytree(f"{ROOT}/sievelake", tmp_path / "sievelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'impute_mean' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_core_does_not_import_the_llm_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/sievelake"):
        if "/llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "sievelake.llm" not in open(f"{folder}/{n}").read(), n
