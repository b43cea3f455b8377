import os

import pytest

from corpusmill.options import JobOptions
from corpusmill.streaming import changes

OPTIONS = JobOptions(enable_sanitizer=True, minify_output=True)


def put(root, name, text, at):
    path = root / "app" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


@pytest.fixture
def run(spark, tmp_path):
    root, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")

    def once():
        changes.ingest_changes(spark, str(root), OPTIONS, table, state)
        rows = spark.read.parquet(table)
        found = {(r.project, r.rel_path): r.content for r in changes.current(rows).collect()}
        return found, rows.count()

    once.root, once.table = root, table
    return once


def test_a_rewritten_file_replaces_its_row(run):
    put(run.root, "a.py", "x = 1  # note\n", 1_000)
    put(run.root, "b.py", "y = 1\n", 1_000)
    assert run() == ({("app", "a.py"): "x = 1\n", ("app", "b.py"): "y = 1\n"}, 2)
    # Nothing changed: nothing is taken.
    assert run()[1] == 2
    put(run.root, "a.py", "x = 2\n", 2_000)
    put(run.root, "c.py", "ip = '10.0.0.1'\n", 1_500)
    expected = {("app", "a.py"): "x = 2\n", ("app", "b.py"): "y = 1\n", ("app", "c.py"): "ip = '[[REDACTED_SENSITIVE]]'\n"}
    assert run() == (expected, 4)


def test_an_older_state_that_comes_late_is_passed_over(run):
    put(run.root, "a.py", "x = 2\n", 2_000)
    assert run()[1] == 1
    put(run.root, "a.py", "old = 1\n", 1_000)
    assert run() == ({("app", "a.py"): "x = 2\n"}, 1)


def test_a_crash_between_state_and_rows_loses_nothing(run, monkeypatch):
    put(run.root, "a.py", "x = 1\n", 1_000)
    assert run()[1] == 1
    put(run.root, "a.py", "x = 2\n", 2_000)
    whole = changes.transform_stream

    def broken(*args, **kwargs):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(changes, "transform_stream", broken)
    with pytest.raises(Exception, match="executor lost"):
        run()
    monkeypatch.setattr(changes, "transform_stream", whole)
    # The same batch is repeated from the checkpoint, then the new listing brings nothing more.
    assert run() == ({("app", "a.py"): "x = 2\n"}, 2)
    assert run()[1] == 2
