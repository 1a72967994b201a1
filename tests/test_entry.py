"""The driver's entry works, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["src", "predict", "score"] and df.count() == 500


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_training_data_operators(tmp_path):
    for name in ("meristem", "__spark_entry__.py"):
        src = f"{TOP}/{name}"
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
