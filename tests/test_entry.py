"""The driver's contract, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    names, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(names) and all(callable(f) for f in names.values())


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_operators(tmp_path, pipeline):
    """Everything else works where ledgerloom/llm is taken out, alone or with corpus_pipeline.py."""
    for name in ("ledgerloom", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "ledgerloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'rbf_share' in n and not any(x.startswith('op') and x[2].isdigit() for x in n), n; assert 'pipeline' not in n; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_corpus_operators():
    text = "".join(p.read_text() for p in (ROOT / "ledgerloom").rglob("*.py") if "llm" not in p.parts)
    assert "ledgerloom.llm" not in text
