"""The entry points with and without what may be missing."""

from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from orrery.plans import queries

HERE = Path(__file__).parent.parent
TELL = "import json, __spark_entry__ as e; print(json.dumps([list(e.queries()), list(e.oracle_sql())]))"


def names(folder: Path) -> list[list[str]]:
    return json.loads(subprocess.run([sys.executable, "-B", "-c", TELL], cwd=folder, check=True, capture_output=True, text=True, timeout=120).stdout.splitlines()[-1])


@pytest.mark.parametrize("missing", [["orrery/llm", "corpus_pipeline.py"], ["orrery/llm"], ["corpus_pipeline.py"]])
def test_what_is_missing_is_left_out(tmp_path, missing):
    shutil.copytree(HERE / "orrery", tmp_path / "orrery", ignore=shutil.ignore_patterns("__pycache__"))
    for file in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (HERE / file).exists():
            shutil.copy(HERE / file, tmp_path)
    for name in missing:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        elif (tmp_path / name).exists():
            (tmp_path / name).unlink()
    found, sql = names(tmp_path)
    assert set(queries.QUERIES) <= set(found) and set(sql) <= set(found) and "pipeline" not in found
    has_llm = (tmp_path / "orrery/llm").exists()
    assert any(n.startswith("op1_") for n in found) == has_llm
