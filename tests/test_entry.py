"""The registered queries in this checkout, and in copies without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

CHECK = """
import __spark_entry__ as e
from turnloom.plans import catalog
assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLES)
"""


def python(code: str, folder: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)


def copy(folder: Path, *left_out: str) -> Path:
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse", "metastore_db"))
    for name in left_out:
        place = folder / name
        if place.is_dir():
            shutil.rmtree(place)
        else:
            place.unlink(missing_ok=True)
    return folder


@pytest.mark.parametrize("pipeline", ["corpus_pipeline.py", "none"])
def test_without_the_subpackage(tmp_path, pipeline):
    """With and without the pipeline's file, which imports the subpackage."""
    done = python(CHECK, copy(tmp_path / "repo", "turnloom/llm", "tests/llm", pipeline))
    assert done.returncode == 0, done.stderr


def test_with_an_empty_folder_left(tmp_path):
    folder = copy(tmp_path / "repo", "turnloom/llm", "tests/llm")
    (folder / "turnloom/llm").mkdir()
    done = python(CHECK, folder)
    assert done.returncode == 0, done.stderr


def test_other_import_errors_are_raised(tmp_path):
    folder = copy(tmp_path / "repo", "turnloom/llm", "tests/llm", "corpus_pipeline.py")
    (folder / "turnloom/llm").mkdir()
    (folder / "turnloom/llm/__init__.py").write_text("")
    (folder / "turnloom/llm/queries.py").write_text("import no_such_module\n")
    done = python("import __spark_entry__ as e; e.queries()", folder)
    assert done.returncode != 0 and "no_such_module" in done.stderr


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 20
