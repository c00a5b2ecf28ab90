import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_works_without_the_training_data_operators(tmp_path, with_pipeline):
    shutil.copytree(os.path.join(REPO, "rectio"), tmp_path / "rectio", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (with_pipeline and os.path.exists(os.path.join(REPO, "corpus_pipeline.py"))):
        shutil.copy(os.path.join(REPO, name), tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    queries, oracles, operators, pipeline = said.stdout.split()
    assert int(queries) >= int(oracles) > 50 and operators == pipeline == "False"
