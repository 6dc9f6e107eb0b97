import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from sigspark.sources import tables

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "methylated_frequency" in out.columns


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_optional_folders(tmp_path):
    """The entry points import, and offer the engine's queries alone."""
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'meth_frequency' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("missing", ["a_module_that_is_missing", "sigspark.llm.gone"])
def test_errors_inside_the_optional_folder_are_seen(tmp_path, missing):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    folder = tmp_path / "repo" / "sigspark" / "llm"
    folder.mkdir(exist_ok=True)
    (folder / "__init__.py").write_text("")
    (folder / "queries.py").write_text(f"import {missing}\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode != 0 and missing in done.stderr


def test_tables_need_a_shared_folder_on_a_cluster(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Elsewhere)
    kept = tables.stored(spark.range(5), "test")
    assert kept.count() == 5 and spark.read.parquet(kept.stored_at).count() == 5
    tables.dropped(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(kept.stored_at).count()
