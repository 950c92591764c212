"""Registered queries against their SQL at the smallest scale."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from plexmat.plans import catalog

SF = "/root/testdata/sf0.001"
CHOSEN = ["profile_variance", "profile_missing", "impute_median", "normalize_minmax", "pearson_matrix", "correlation_network", "gaussian_knn_network", "net_basic", "net_clustering", "net_components", "net_hubs", "select_mad", "anova_f", "modularity", "conductance", "abar", "classification_metrics", "feature_weights", "profile_report", "clinical_assemble", "pearson_pvalues", "select_f_classification", "phenotype_sets", "eigenvector", "combined_quality_of_blocks", "align_all", "map_sample_keys"]


def compare(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted((tuple("%.5g" % v if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert key(tuple(r[c] for c in names) for r in got.collect()) == key(cur.fetchall())


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, name):
    compare(spark, name)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(entry.queries())


def test_without_the_text_subpackage(tmp_path):
    """The rest imports and registers its queries with the text folders and the pipeline taken out."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/plexmat", tmp_path / "plexmat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') and n[2].isdigit()]"
    for with_pipeline in (False, True):
        if with_pipeline and os.path.exists(f"{root}/corpus_pipeline.py"):
            shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
