"""Python functions of the library run where workers cannot import it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from scanflow.session import build_session
spark = build_session("2", shuffle_partitions=2, app="elsewhere")
for name in ("fixations_in_chunks", "stub_predictions", "annotated_segments", "parsed_literals"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240
    )
    lines = [x.split() for x in done.stdout.splitlines() if " " in x]
    assert done.returncode == 0, done.stderr[-2000:]
    assert len([x for x in lines if x[-1].isdigit() and int(x[-1]) > 0]) == 4


def test_stages_of_finished_work_can_be_released(spark, monkeypatch):
    from scanflow import session

    monkeypatch.setattr(session, "_stages", [])
    kept = session.cut(spark.range(5))
    assert kept.count() == 5 and len(session._stages) == 1
    path = session._stages[0]
    assert session.release(spark) == 1 and session.release(spark) == 0
    assert not os.path.exists(path.removeprefix("file:"))


ALONE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from scanflow.session import build_session
assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
spark = build_session("2", shuffle_partitions=2, app="alone")
print(len(entry.queries()), entry.entry(spark).count())
"""


def test_the_rest_stands_alone_without_the_corpus_folders(tmp_path):
    """Whether corpus_pipeline.py is left behind or not."""
    import shutil

    import __spark_entry__ as entry

    rest = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "scanflow"), copy / "scanflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), copy / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", ALONE.format(root=str(copy))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240
    )
    assert done.returncode == 0, done.stderr[-2000:]
    count, rows = done.stdout.split()[-2:]
    assert int(count) == len(rest) and int(rows) > 0
