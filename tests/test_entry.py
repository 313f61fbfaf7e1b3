import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark)
    assert {"mention", "form", "synonym", "id", "match_type"} <= set(rows.columns)
    assert rows.where("id IS NOT NULL").count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_without_the_optional_subpackage(tmp_path):
    """A copy without it still imports, and has the core's queries."""
    root = Path(__spark_entry__.__file__).parent
    for path in [*root.glob("onomast/**/*.py"), root / "__spark_entry__.py"]:
        part = path.relative_to(root)
        if "llm" not in part.parts:
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'etl_filter' in q and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 70, done.stderr
