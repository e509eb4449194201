"""The entry points with and without the optional text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
RUN = """
import __spark_entry__ as e
from modelloom.session import local_session
spark = local_session(2)
print("rows", e.queries()["row_counter"](spark, "/root/testdata/sf0.001").count())
"""


def copy_without(target: Path, *names: str) -> Path:
    shutil.copytree(REPO, target, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *names))
    return target


def said(folder: Path, code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, timeout=300).stdout.split("\n")[-2]


def test_without_the_text_operators(tmp_path):
    folder = copy_without(tmp_path / "copy", "llm")
    assert said(folder, ASK).endswith(" 0")
    assert said(folder, RUN).startswith("rows ")


def test_without_the_pipeline_too(tmp_path):
    assert said(copy_without(tmp_path / "copy", "llm", "corpus_pipeline.py"), ASK).endswith(" 0")
