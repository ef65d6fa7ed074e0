"""The entry module with the training-data operators taken out."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_llm_folders(tmp_path):
    for keep_pipeline in (True, False):
        own = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT / "tessera", own / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ("__spark_entry__.py", "corpus_pipeline.py")[: 1 + keep_pipeline]:
            if (ROOT / name).exists():
                shutil.copy(ROOT / name, own)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and set(o) <= set(q); print(len(q))"
        done = subprocess.run([sys.executable, "-c", code], cwd=own, env=os.environ | {"PYTHONPATH": str(own)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        assert int(done.stdout) > 80
