import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_operators_for_training_data(tmp_path):
    for part in ("tabloom", "__spark_entry__.py"):
        copy = shutil.copytree if (ROOT / part).is_dir() else shutil.copy
        copy(ROOT / part, tmp_path / part)
    shutil.rmtree(tmp_path / "tabloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    n, any_op, sql = said.stdout.split()
    assert int(n) >= 100 and any_op == "False" and int(sql) >= 80
