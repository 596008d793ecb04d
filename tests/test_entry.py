import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder) -> list[set[str]]:
    import json

    run = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    return [set(x) for x in json.loads(run.stdout.splitlines()[-1])]


@pytest.fixture
def copied(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.pyc"))
    return to


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_llm_folders(copied, pipeline):
    from ballast.plans import oracle, queries

    shutil.rmtree(copied / "ballast" / "llm", ignore_errors=True)
    shutil.rmtree(copied / "tests" / "llm", ignore_errors=True)
    if not pipeline:
        (copied / "corpus_pipeline.py").unlink()
    assert names(copied) == [set(queries.queries()), set(oracle.oracle_sql())]


def test_entry_does_not_hide_errors_of_modules_that_are_there(copied):
    (copied / "ballast" / "llm").mkdir(exist_ok=True)
    (copied / "ballast" / "llm" / "__init__.py").write_text("")
    (copied / "ballast" / "llm" / "queries.py").write_text("import no_such_module_of_ours\n")
    run = subprocess.run([sys.executable, "-c", ASK], cwd=copied, capture_output=True, text=True, timeout=300)
    assert run.returncode and "no_such_module_of_ours" in run.stderr
