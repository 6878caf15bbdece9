"""The entry module, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


def test_entry(spark):
    import __spark_entry__ as e

    if not Path("/root/testdata/sf0.001").is_dir():
        pytest.skip("the tables aren't here")
    assert e.entry(spark).columns == ["doc_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage():
    code = "import sys; sys.modules['loomgraph.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pagerank' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "loomgraph").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "loomgraph").parts:
            assert "loomgraph.llm" not in path.read_text(), path
