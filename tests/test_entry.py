import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


@pytest.mark.parametrize("gone", [["tidemark/llm", "tests/llm"], ["tidemark/llm", "tests/llm", "corpus_pipeline.py"], []])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-c", LISTS], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert said.returncode == 0, said.stderr
    count, pipeline, corpus = said.stdout.split()[-3:]
    there = os.path.isdir(copy / "tidemark/llm")
    assert int(count) >= 60 and (pipeline == "True") == (there and os.path.isfile(copy / "corpus_pipeline.py")) and (corpus == "True") == there
