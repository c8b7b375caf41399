"""The entry file without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'q_bm25_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in [*q, *s]); print(len(q))"


def copy_of(folder, without):
    shutil.copytree(ROOT / "lexloom", folder / "lexloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, folder / name)
    for name in without:
        path = folder / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)


def test_without_llm(tmp_path):
    for i, without in enumerate((["lexloom/llm"], ["lexloom/llm", "corpus_pipeline.py"])):
        folder = tmp_path / str(i)
        folder.mkdir()
        copy_of(folder, without)
        done = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True)
        assert done.returncode == 0 and int(done.stdout.split()[-1]) > 50, done.stderr
