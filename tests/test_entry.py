import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[:3] == ["image_label", "year", "sector_n"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_corpus_part(tmp_path):
    """The rest works where the corpus subpackage and pipeline have been taken out."""
    shutil.copytree(ROOT / "cambium", tmp_path / "cambium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'profiles_mean' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    # the rest's tests run there as well
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_clean.py", "-k", "outliers or profiles or biweight"], cwd=tmp_path, check=True, timeout=600)


def test_a_missing_need_of_the_corpus_part_is_no_error(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = __spark_entry__.queries()
    assert "profiles_mean" in names and "op5_exact_dedup" not in names
