"""The driver's contract with parts left out."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(folder: Path, code: str) -> str:
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.strip()


def copied(tmp_path: Path) -> Path:
    shutil.copytree(ROOT / "folioquarry", tmp_path / "folioquarry", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_without_the_subpackage(tmp_path):
    folder = copied(tmp_path)
    shutil.rmtree(folder / "folioquarry" / "llm", ignore_errors=True)
    assert int(run(folder, "import __spark_entry__ as e; print(len(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())")) > 80


def test_without_a_library_of_the_subpackage(tmp_path):
    assert int(run(copied(tmp_path), "import sys; sys.modules['tiktoken'] = None\nimport __spark_entry__ as e; print(len(e.queries()))")) > 80


def test_a_fault_inside_the_subpackage_shows(tmp_path):
    folder = copied(tmp_path)
    if not (folder / "folioquarry" / "llm").exists():
        return
    (folder / "folioquarry" / "llm" / "catalogue.py").write_text("import folioquarry.llm.no_such_part\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=folder, capture_output=True, text=True)
    assert done.returncode and "no_such_part" in done.stderr
