"""Every core query can be stored, and the training-data queries are optional."""

import os
import shutil
import subprocess
import sys

import pytest

from textloom.plans import registry

DATA = "/root/testdata/sf0.001"
#: Iterative models, which have tests of their own.
SLOW = {"m5_logistic", "m6_linear_svm", "m8_lsa", "m9_lda", "m10_word2vec", "m17_crf"}


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query_can_be_written(spark, name, tmp_path):
    df = registry.QUERIES[name](spark, DATA)
    df.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == df.columns


@pytest.mark.parametrize("broken", ["absent", "empty", "import fails"])
def test_core_queries_survive_the_llm_package(tmp_path, broken):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "textloom"), tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    if broken != "absent":
        (tmp_path / "textloom" / "llm").mkdir()
    if broken == "import fails":
        (tmp_path / "textloom" / "llm" / "queries.py").write_text("import no_such_module\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q), len(q)"
    assert subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}).returncode == 0
