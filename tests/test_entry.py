import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as driver

REPO = Path(__file__).resolve().parent.parent


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_works_without_the_optional_parts(tmp_path):
    """A copy without the subpackage and the pipeline still offers the other queries."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((REPO / name).read_text())
    for p in (REPO / "tether").rglob("*.py"):
        if "llm" not in p.parts:
            to = tmp_path / p.relative_to(REPO)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
