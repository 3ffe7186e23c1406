"""What the driver calls, also where parts of the repository are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "l_orderkey" and df.count() == 1518


def test_the_engine_stands_alone(tmp_path):
    shutil.copytree(ROOT / "quern", tmp_path / "quern", ignore=lambda folder, names: {n for n in names if n in ("llm", "__pycache__")})
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and q.keys() == e.oracle_sql().keys() and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_llm():
    for path in (ROOT / "quern").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quern.llm" not in path.read_text(), path
