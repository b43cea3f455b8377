import glob
import os

import pytest
from pyspark.sql import functions as F

from corpusmill import scale
from corpusmill.operators import assembly, reuse
from corpusmill.options import JobOptions
from corpusmill.plans import job, publish
from corpusmill.sources import corpus, directory

APP = {
    "src/core.py": 'class Core:\n    """Core text."""\n    def run(self, x):\n        """Run it."""\n        return x + 41\n',
    "src/secret.py": "API_KEY = 'very-secret-value'\n",
    "src/_private.py": "P = 1\n",
    "src/__init__.py": "",
    "tests/test_core.py": "def test_run():\n    assert True\n",
    "docs/README.md": "# App\r\ntext\n",
    ".gitignore": "*.log\n",
    "debug.log": "noise\n",
    "node_modules/lib.py": "x = 1\n",
}
OPTIONS = JobOptions(respect_gitignore=True, save_error_log=True)


@pytest.fixture
def app(tmp_path):
    root = tmp_path / "app"
    for path, content in APP.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content.encode())
    return root


def document(path, project="app"):
    """The part files of one project's document, read in name order."""
    parts = sorted(glob.glob(f"{path}/project={project}/part-*"))
    return "".join(open(p, encoding="utf-8", newline="").read() for p in parts)


def entry(path, content):
    return "-" * 200 + f"\n{path}\n{content}\n"


def test_directory_keeps_hidden_names_and_prunes(spark, app):
    (app / "bad.py").symlink_to(app / "nowhere")
    rows = {r.rel_path: r for r in directory.read_directory(spark, str(app), OPTIONS).collect()}
    assert set(rows) == set(APP) - {"node_modules/lib.py"} | {"bad.py"}
    assert rows["src/_private.py"].content == "P = 1\n"
    assert rows["docs/README.md"].content == "# App\ntext\n"
    assert rows["bad.py"].content is None and "No such file" in rows["bad.py"].error
    assert rows["src/core.py"].project == "app" and rows["src/core.py"].length == len(APP["src/core.py"])


def test_binary_source(spark, app, tmp_path):
    rows = corpus.read_binary(spark, str(tmp_path)).collect()
    assert {(r.project, r.rel_path) for r in rows} >= {("app", "src/core.py"), ("app", "docs/README.md")}
    one = corpus.read_binary(spark, str(app), project="mine", name_glob="*.md").collect()
    assert [(r.project, r.rel_path, r.content) for r in one] == [("mine", "docs/README.md", "# App\ntext\n")]


def test_whole_run(spark, app, tmp_path):
    options = OPTIONS.with_(output_base_dir=str(tmp_path / "out"), enable_sanitizer=True)
    files = directory.read_directory(spark, str(app), options)
    report = job.run(files, options)
    assert report.ok and len(report.outputs) == 5
    out = report.output_path
    hidden = APP["src/secret.py"].replace("very-secret-value", "[[REDACTED_SECRET]]")
    modules = "SCRIPTS/MODULES:\n" + entry("src/_private.py", "P = 1\n") + entry("src/core.py", APP["src/core.py"]) + entry("src/secret.py", hidden)
    tests = "TESTS:\n" + entry("tests/test_core.py", APP["tests/test_core.py"])
    resources = "RESOURCES (CONFIG/DATA/DOCS):\n" + entry("docs/README.md", "# App\ntext\n")
    tree = (
        "├── src\n│   ├── _private.py\n│   ├── core.py\n│   └── secret.py\n└── tests\n    └── test_core.py\n"
    )
    assert document(f"{out}/transcription_modules") == modules
    assert document(f"{out}/transcription_tests") == tests
    assert document(f"{out}/transcription_resources") == resources
    assert document(f"{out}/transcription_tree") == tree
    unified = (
        "PROJECT CONTEXT: app\n" + "=" * 80 + "\n\nPROJECT STRUCTURE:\n" + "-" * 50 + "\n" + tree + "\n\n"
        + modules + "\n\n" + tests + "\n\n" + resources + "\n\n"
    )
    assert document(f"{out}/transcription_full_context") == unified
    row = report.summary.first()
    assert (row.processed, row.cached, row.skipped, row.errors) == (5, 0, 3, 0)
    assert (row.modules_written, row.tests_written, row.resources_written) == (3, 1, 1)
    assert row.token_count == -(-len(unified) // 4) and row.tree_lines == 6
    assert row.generated == [f"transcription_{k}" for k in ("modules", "tests", "resources", "full_context")]


def test_collision_overwrite_and_dry_run(spark, files_of, tmp_path):
    files = files_of({"a.py": "x = 1\n"})
    options = JobOptions(output_base_dir=str(tmp_path), generate_tree=False)
    dry = job.run(files, options, dry_run=True)
    assert dry.ok and dry.outputs == [] and dry.planned == options.planned_outputs()
    assert not os.path.exists(dry.output_path)
    assert dry.summary.first().dry_run and dry.summary.first().will_generate == options.planned_outputs()
    assert job.run(files, options).ok
    again = job.run(files, options)
    assert not again.ok and again.outputs == [] and f"{again.output_path}/transcription_modules" in again.existing
    changed = job.run(files_of({"a.py": "y = 2\n"}), options, overwrite=True)
    assert changed.ok and "y = 2" in document(f"{changed.output_path}/transcription_modules")
    assert "x = 1" not in document(f"{changed.output_path}/transcription_modules")


def test_unified_only_and_individual_only(spark, files_of, tmp_path):
    files = files_of({"a.py": "x\n"})
    one = job.run(files, JobOptions(output_base_dir=str(tmp_path / "1"), create_individual_files=False))
    assert [os.path.basename(p) for p in one.outputs] == ["transcription_full_context"]
    many = job.run(files, JobOptions(output_base_dir=str(tmp_path / "2"), create_unified_file=False, generate_tree=False))
    assert [os.path.basename(p) for p in many.outputs] == [f"transcription_{k}" for k in ("modules", "tests", "resources")]
    assert many.summary.first().token_count == 0


def test_rejected_and_failed_files_are_reported(spark, tmp_path):
    rows = [("app", "src/test_x.py", "t", None), ("app", "src/fail.py", None, "Permission denied"), ("app", "ok.py", "x", None),
            ("calm", "ok.py", "x", None)]
    files = spark.createDataFrame(rows, "project string, rel_path string, content string, error string")
    options = JobOptions(process_tests=False, save_error_log=True, output_base_dir=str(tmp_path))
    report = job.run(files, options)
    rule = "-" * 80
    assert document(f"{report.output_path}/transcription_errors") == (
        "TRANSCRIPTION ERRORS REPORT:\n" + "=" * 80
        + f"\nFILE: src/fail.py\nERROR: Permission denied\n{rule}\nFILE: src/test_x.py\nERROR: Filtered by mode or depth\n{rule}\n"
    )
    assert {r.project: (r.processed, r.errors) for r in report.summary.collect()} == {"app": (1, 2), "calm": (1, 0)}
    assert not os.path.exists(f"{report.output_path}/transcription_errors/project=calm")


def test_no_errors_no_report(spark, files_of, tmp_path):
    report = job.run(files_of({"a.py": "x"}), JobOptions(save_error_log=True, output_base_dir=str(tmp_path)))
    assert not os.path.exists(f"{report.output_path}/transcription_errors")


def test_second_run_reuses_results(spark, files_of, tmp_path):
    tree = {"logic.py": "def f():\n    return 1\n", "utils.py": "X = 2\n", "empty.py": ""}
    cache = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=4)
    options = JobOptions(output_base_dir=str(tmp_path / "out"), create_individual_files=False, generate_tree=False)

    def counts(files, options):
        row = job.run(files, options, overwrite=True, cache=cache).summary.first()
        return row.processed, row.cached

    assert counts(files_of(tree), options) == (3, 0)
    before = document(f"{options.output_path()}/transcription_full_context")
    assert counts(files_of(tree), options) == (3, 3)
    assert document(f"{options.output_path()}/transcription_full_context") == before
    assert counts(files_of(tree | {"utils.py": "X = 3\n"}), options) == (3, 2)
    assert counts(files_of(tree), options.with_(minify_output=True)) == (3, 0)
    cache.purge()
    assert counts(files_of(tree), options) == (3, 0)


def test_skeleton_run(spark, files_of, tmp_path):
    options = JobOptions(processing_depth="skeleton", minify_output=True, output_base_dir=str(tmp_path))
    report = job.run(files_of(APP), options)
    text = document(f"{report.output_path}/transcription_modules")
    assert "def run(self, x):\n        \"\"\"Run it.\"\"\"\n        pass" in text and "41" not in text


def test_tree_only_run(spark, files_of, tmp_path):
    options = JobOptions(processing_depth="tree_only", output_base_dir=str(tmp_path))
    report = job.run(files_of(APP), options)
    row = report.summary.first()
    assert (row.processed, row.modules_written) == (0, 0) and row.errors == 2 and row.tree_lines == 6
    assert [os.path.basename(p) for p in report.outputs][-2:] == ["transcription_tree", "transcription_full_context"]


def test_order_holds_over_many_part_files(spark, tmp_path):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "small").otherwise("big").alias("project"),
        F.concat(F.lit("d"), (F.col("id") % 17).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".py")).alias("rel_path"),
        F.concat(F.lit("x = "), F.col("id").cast("string"), F.lit("\n")).alias("content"),
    ).repartition(7)
    options = JobOptions(output_base_dir=str(tmp_path), create_unified_file=False)
    report = job.run(rows, options)
    for project in ("small", "big"):
        path = f"{report.output_path}/transcription_modules"
        listed = [line for line in document(path, project).split("\n") if line.startswith("d")]
        assert listed == sorted(listed) and len(listed) == (1000 if project == "small" else 2000)


def test_projects_without_tree_nodes(spark, files_of, tmp_path):
    report = job.run(files_of({"README.md": "hi"}), JobOptions(output_base_dir=str(tmp_path)))
    text = document(f"{report.output_path}/transcription_full_context")
    assert "PROJECT STRUCTURE:\n" + "-" * 50 + "\n\n\n\nRESOURCES" in text


def test_map_tells_places_in_the_written_document(spark, files_of, tmp_path):
    tree = {("app", p): c for p, c in APP.items()} | {("big", f"d{i % 7}/é{i}.py"): "x\n" * (i % 5) for i in range(300)}
    tree |= {("bare", "README.md"): "no tree\n", ("big", "d1"): "odd"}
    options = JobOptions(output_base_dir=str(tmp_path), show_functions=True, show_classes=True, show_methods=True)
    report = job.run(files_of(tree), options)
    sizes = report.job.sizes
    assert "content" not in sizes._jdf.queryExecution().executedPlan().toString()
    rows = report.job.map.collect()
    blocks = {(r.project, r.section, r.sort_key, r.ord): r.value + "\n" for r in report.job.unified.collect()}
    assert len(rows) == len(blocks)
    for r in rows:
        text = document(f"{report.output_path}/transcription_full_context", r.project)
        value = blocks[r.project, r.section, r.sort_key, r.ord]
        assert text[r.start : r.start + r.n_chars] == value
        assert (r.first_line, r.n_lines) == (text.count("\n", 0, r.start) + 1, value.count("\n"))


def test_map_of_equal_keys_and_nulls(spark):
    sizes = spark.createDataFrame(
        [("p", 2, "a.py", 0, 5, 1), ("p", 2, "a.py", 0, 3, 2), ("p", 0, "", -1, 2, 1), (None, 0, "", -1, 4, 1)],
        "project string, section int, sort_key string, ord int, n_chars long, n_lines long",
    )
    rows = sorted((r.project, r.start, r.n_chars, r.first_line) for r in assembly.document_map(sizes).collect())
    assert rows == [("", 0, 4, 1), ("p", 0, 2, 1), ("p", 2, 3, 2), ("p", 5, 5, 4)]
    assert assembly.document_map(sizes.limit(0)).collect() == []


def test_dry_run_keeps_no_text(spark, files_of, tmp_path):
    files = files_of(APP)
    options = JobOptions(output_base_dir=str(tmp_path))
    dry = job.run(files, options, dry_run=True)
    assert "content" not in dry.job.results.columns
    made = job.run(files, options)
    pick = lambda report: report.summary.drop("dry_run", "will_generate").collect()
    assert pick(dry) == pick(made)


class Stopped(Exception):
    pass


def test_stopped_between_two_outputs(spark, files_of, tmp_path, monkeypatch):
    options = JobOptions(output_base_dir=str(tmp_path), generate_tree=False)
    names, out, prefix = options.planned_outputs(), options.output_path(), options.output_prefix
    job.run(files_of({"a.py": "old\n", "test_a.py": "old\n"}), options)
    texts = lambda: {
        n: document(p) for n, p in publish.located(spark, out, prefix, names).items() if "resources" not in n
    }
    before = texts()

    # Stopped before the manifest: nothing has changed.
    monkeypatch.setattr(publish, "commit", lambda *_: (_ for _ in ()).throw(Stopped()))
    new = files_of({"a.py": "new\n", "test_a.py": "new\n"})
    with pytest.raises(Stopped):
        job.run(new, options, overwrite=True)
    monkeypatch.undo()
    assert texts() == before and all("old" in t for t in before.values())
    assert publish.finish(spark, out, prefix) == [] and publish.drop_unfinished(spark, out, prefix) == 1

    # Stopped after the manifest and one output: a reader sees the new set whole.
    real, moves = publish._filesystem, []

    class Failing:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, source, target):
            if "output=" in source.toString():
                moves.append(1)
                if len(moves) > 1:
                    raise Stopped()
            return self.fs.rename(source, target)

    monkeypatch.setattr(publish, "_filesystem", lambda *a: (lambda fs, path: (Failing(fs), path))(*real(*a)))
    with pytest.raises(Stopped):
        job.run(new, options, overwrite=True)
    monkeypatch.undo()
    whole = texts()
    assert whole == {n: t.replace("old", "new") for n, t in before.items()}
    assert any("/." in p for p in publish.located(spark, out, prefix, names).values())

    # The next run finishes it, here one that may not overwrite.
    again = job.run(new, options)
    assert not again.ok and len(again.existing) == len(names)
    assert texts() == whole and not any("/." in p for p in publish.located(spark, out, prefix, names).values())
    assert [n for n in os.listdir(out) if n.startswith(f".{prefix}-")] == []


def test_run_sorts_text_once(spark, files_of, tmp_path, monkeypatch):
    frames = []
    real = publish.publish
    monkeypatch.setattr(publish, "publish", lambda own, shared, *rest: frames.append((own, shared)) or real(own, shared, *rest))
    report = job.run(files_of(APP), JobOptions(output_base_dir=str(tmp_path)))
    own, shared = frames[0]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert len(report.outputs) == 5 and not any("content" in plan(blocks) for blocks in own.values())
    assert plan(shared).count("FileScan") == 1 and "Exchange" not in plan(shared)


def tables_of_runs(spark):
    folder = scale.shared_dir(spark).removeprefix("file:")
    return sorted(n for n in os.listdir(folder) if n.startswith(("run-", "table-")))


def test_closing_leaves_no_tables(spark, files_of, tmp_path):
    options = JobOptions(output_base_dir=str(tmp_path / "out"), enable_sanitizer=True)
    cache = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=2)
    files, before = files_of(APP), tables_of_runs(spark)
    for run in range(2):
        report = job.run(files, options, overwrite=True, cache=cache, share_texts=True, segment_bytes=16)
        assert report.summary.first().cached == 5 * run and report.job.map.count() > 5
        assert len(tables_of_runs(spark)) == len(before) + 1
        report.close()
        report.close()
        assert tables_of_runs(spark) == before
    text = document(f"{report.output_path}/transcription_modules")
    assert "[[REDACTED_SECRET]]" in text and cache.read(options).count() == 5


def test_a_failed_run_leaves_no_tables(spark, files_of, tmp_path, monkeypatch):
    def broken(*_):
        raise OSError("no space")

    before = tables_of_runs(spark)
    monkeypatch.setattr(publish, "publish", broken)
    with pytest.raises(OSError):
        job.run(files_of(APP), JobOptions(output_base_dir=str(tmp_path / "out")))
    assert tables_of_runs(spark) == before
