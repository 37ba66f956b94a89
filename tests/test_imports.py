"""The engine and the driver entry need no session and no training-data package to be imported."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_engine_does_not_import_the_training_data_package():
    for path in (ROOT / "riskloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text("utf-8"), path


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert 'risk_model_summary' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_works_without_the_training_data_folders(tmp_path):
    """Both with ``corpus_pipeline.py`` left behind and without it."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'coverage' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    for left in (True, False):
        if not left:
            (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)
