"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_entry_and_registry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_the_subpackage(tmp_path):
    import shutil

    for name in ("tallyspark", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tallyspark" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'band_counts_with_all' in e.queries() and not any(q.startswith('op1') for q in e.queries()); print('fine')"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, timeout=120)
    assert found.stdout.strip() == "fine", found.stderr
