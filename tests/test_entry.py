"""The entry works in copies of the repository that lack the parts for training text."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(e.queries())[:1], any(q[:2] == 'op' for q in e.queries()))"


def copy(tmp_path, *gone):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json", "*.txt"))
    for name in gone:
        path = to / name
        (shutil.rmtree if path.is_dir() else os.remove)(path)
    return to


def run(at, code=SAY):
    return subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


@pytest.mark.parametrize("gone", [("symptomlake/llm", "tests/llm"), ("symptomlake/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_folders(tmp_path, gone):
    if not os.path.isdir(os.path.join(ROOT, "symptomlake/llm")):
        gone = ()
    gone = [g for g in gone if os.path.exists(os.path.join(ROOT, g))]
    out = run(copy(tmp_path, *gone))
    assert out.returncode == 0, out.stderr
    n, sql, *_ = out.stdout.split()
    assert int(n) > 100 and int(sql) > 100 and out.stdout.split()[-1] == "False"


def test_an_empty_folder_counts_as_left_out(tmp_path):
    if not os.path.isdir(os.path.join(ROOT, "symptomlake/llm")):
        pytest.skip("left out already")
    at = copy(tmp_path, "symptomlake/llm")
    (at / "symptomlake/llm/__pycache__").mkdir(parents=True)
    assert run(at).returncode == 0


def test_other_errors_stay_errors(tmp_path):
    if not os.path.isdir(os.path.join(ROOT, "symptomlake/llm")):
        pytest.skip("left out already")
    at = copy(tmp_path, "symptomlake/llm/minhash.py")
    assert "minhash" in run(at).stderr
    with (at / "symptomlake/llm/queries.py").open("a") as f:
        f.write("import no_such_module\n")
    assert run(at).returncode != 0
