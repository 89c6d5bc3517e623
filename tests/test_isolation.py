"""The repository without its training-data folders, and the folder shared by driver and executors."""

import os
import shutil
import subprocess
import sys

import pytest

from strandweave import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q), set(o) <= set(q))"


@pytest.mark.parametrize("gone", [["strandweave/llm", "tests/llm"], ["strandweave/llm", "tests/llm", "corpus_pipeline.py"]])
def test_other_queries_without_the_optional_folders(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    os.makedirs(copy / "strandweave/llm/__pycache__")  # what an interrupted deletion can leave
    out = subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, check=True).stdout.split()
    assert int(out[0]) >= 98 and out[1:] == ["False", "False", "True"]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Empty:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "spark://host:7077"

        def __init__(self):
            self._jsc = self

        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return Empty()

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
