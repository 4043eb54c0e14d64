"""The driver's entry: it imports without a session, and without the llm folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"


def names(folder):
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


@pytest.mark.parametrize("leave", [True, False])
def test_import(tmp_path, leave):
    for name in ("corpident", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    had = (tmp_path / "corpident/llm").exists()
    if not leave:
        shutil.rmtree(tmp_path / "corpident/llm", ignore_errors=True)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    found = names(tmp_path)
    assert "validate_siren" in found and ("pipeline" in found) == (leave and had)


def test_flagship(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
