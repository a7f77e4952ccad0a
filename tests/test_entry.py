import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_and_names(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and "median_usd" in got.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "shelfmark", tmp_path / "shelfmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    n, m, corpus = run.stdout.split()
    assert int(n) >= int(m) > 50 and corpus == "False"
