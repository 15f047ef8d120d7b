import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_folders(tmp_path):
    """The rest works when the training-data folders and the pipeline are gone."""
    new = tmp_path / "repo"
    shutil.copytree(ROOT, new, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    shutil.rmtree(new / "seqloom" / "llm", ignore_errors=True)
    shutil.rmtree(new / "tests" / "llm", ignore_errors=True)
    if (new / "corpus_pipeline.py").exists():
        (new / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'best_seed_hit' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=new, env=env, check=True, timeout=120)
