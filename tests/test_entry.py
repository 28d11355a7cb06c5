"""The driver contract must hold without the text operators."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
TELL = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def told(folder):
    return json.loads(subprocess.run([sys.executable, "-c", TELL], cwd=folder, capture_output=True, text=True, check=True).stdout)


def stripped(folder):
    shutil.copytree(ROOT / "gridloom", folder / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", folder)
    return folder


def test_queries_without_the_text_operators(tmp_path):
    queries, sql = told(stripped(tmp_path))
    assert len(queries) > 80 and len(sql) > 75 and not any(q.startswith("op") or q == "pipeline" for q in queries)


def test_queries_with_a_pipeline_whose_operators_are_gone(tmp_path):
    (stripped(tmp_path) / "corpus_pipeline.py").write_text("from gridloom.llm.packing import packed_stage\n")
    assert len(told(tmp_path)[0]) > 80


def test_entry_registers_what_is_there():
    queries, sql = told(ROOT)
    assert set(sql) <= set(queries) and ("pipeline" in queries) == any(q.startswith("op1_") for q in queries)
