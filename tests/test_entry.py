"""The entry point works with and without the training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

from quillspark.plans.registry import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) <= set(QUERIES)


def test_without_training_data_package(tmp_path):
    shutil.copytree(ROOT / "quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
