"""The engine without its training-data operators."""

import shutil
import subprocess
import sys

from tests.conftest import ROOT

CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"


def test_queries_without_the_llm_folders(tmp_path):
    for pipeline in (True, False):
        at = tmp_path / str(pipeline)
        shutil.copytree(ROOT / "lodegraph", at / "lodegraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (ROOT / "corpus_pipeline.py").exists()):
            shutil.copy(ROOT / name, at / name)
        (at / "lodegraph/llm/__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-c", CODE], cwd=at, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(at), "HOME": str(tmp_path)})
