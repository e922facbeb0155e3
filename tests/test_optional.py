"""The contract module works where the optional subpackage's folders aren't there, corpus_pipeline.py or not."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_folders(tmp_path):
    shutil.copytree(REPO / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / f).exists():
            shutil.copy(REPO / f, tmp_path / f)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 50 and 'pipeline' not in q"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from graphloom.sources.shared import shared_dir

    class Conf:
        get = staticmethod(lambda *_: None)

    class Nothing:
        def __getattr__(self, _):
            return lambda *a: Nothing()

        def isDefined(self):
            return False

    class Session:
        conf = Conf()
        sparkContext = Nothing()

    Session.sparkContext.__dict__["master"] = "spark://somewhere:7077"
    Session.sparkContext.__dict__["_jsc"] = Nothing()
    with pytest.raises(ValueError):
        shared_dir(Session())
