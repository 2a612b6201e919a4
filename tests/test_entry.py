import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from tests.conftest import SF

REPO = Path(__file__).parent.parent


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and SF


def test_entry_without_the_training_data_subpackage(tmp_path):
    """The rest imports when the llm folders and the pipeline are gone."""
    for p in REPO.iterdir():
        if p.name not in ("broadsheet", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "broadsheet").mkdir()
    for p in (REPO / "broadsheet").iterdir():
        if p.name != "llm":
            (tmp_path / "broadsheet" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
