import pytest
from pyspark.sql import functions as F

from corpusmill.operators import filtering
from corpusmill.options import JobOptions
from corpusmill.sources import directory
from corpusmill.sources.directory import read_directory

PROJECT = {
    "src/main.py": "", "src/utils.py": "", "src/exclude_me.tmp": "", "tests/test_main.py": "",
    "README.md": "", "node_modules/lib.js": "", "config.json": "",
}


def statuses(df):
    return {r.rel_path: r.status for r in df.collect()}


def test_scan_fixture(files_of):
    options = JobOptions(exclude_patterns=("node_modules", r"\.git", r"exclude_me\.tmp"))
    got = statuses(filtering.scan(files_of(PROJECT), options))
    assert "node_modules/lib.js" not in got
    assert got.pop("src/exclude_me.tmp") == "skipped"
    assert set(got.values()) == {"process"} and len(got) == 5


def test_disabled_kinds_fall_through_to_extensions(files_of):
    files = files_of({"test_a.py": "", "a.md": "", "b.json": "", "c.go": ""})
    options = JobOptions(process_tests=False, process_resources=False, extensions=(".py", ".md"))
    rows = {r.rel_path: (r.status, r.target) for r in filtering.scan(files, options).collect()}
    assert rows == {
        "test_a.py": ("process", "skip"), "a.md": ("process", "module"),
        "b.json": ("skipped", "module"), "c.go": ("skipped", "module"),
    }


def test_tree_only_scans_tests_and_resources(files_of):
    rows = filtering.scan(files_of(PROJECT), JobOptions(processing_depth="tree_only")).collect()
    assert {r.rel_path for r in rows if r.status == "process"} == {"tests/test_main.py", "README.md", "config.json"}
    assert {r.target for r in rows} == {"skip"}


def test_no_include_pattern_admits_nothing(files_of):
    got = statuses(filtering.scan(files_of(PROJECT), JobOptions(include_patterns=())))
    assert set(got.values()) == {"skipped"}


def test_no_exclude_pattern_excludes_nothing(files_of):
    got = statuses(filtering.scan(files_of(PROJECT), JobOptions(exclude_patterns=(), extensions=(".py", ".js"))))
    assert got["node_modules/lib.js"] == "process"


def test_bare_file_names_are_listed(files_of):
    got = statuses(filtering.scan(
        files_of({"CMakeLists": "", "cmakelists": "", "x.PY": ""}), JobOptions(extensions=("CMakeLists", ".py"))
    ))
    assert got == {"CMakeLists": "process", "cmakelists": "skipped", "x.PY": "skipped"}


def test_ignore_file_applies_to_its_own_project(files_of):
    files = files_of({
        ("a", ".gitignore"): "# secret things\n\n*.secret\nbuild/\n", ("a", "api.secret"): "", ("a", "build/x.py"): "",
        ("a", "rebuild/y.py"): "", ("a", "ok.py"): "", ("a", "sub/.gitignore"): "ok.py",
        ("b", "api.secret"): "", ("b", "build/x.py"): "",
    })
    options = JobOptions(respect_gitignore=True, exclude_patterns=(r"^\.",))
    rows = {(r.project, r.rel_path): r.status for r in filtering.scan(files, options).collect()}
    assert rows == {
        ("a", ".gitignore"): "skipped", ("a", "api.secret"): "skipped", ("a", "ok.py"): "process",
        ("a", "sub/.gitignore"): "skipped", ("b", "api.secret"): "skipped", ("b", "build/x.py"): "process",
    }
    exact = filtering.scan(files, options.with_(glob_mode="basename_exact")).collect()
    assert ("a", "rebuild/y.py") in {(r.project, r.rel_path) for r in exact}


def test_rules_as_rows(files_of):
    rows = filtering.ignore_rules(files_of({".gitignore": "#c\n *.log \n\nbuild/\n", "x/.gitignore": "nope"})).collect()
    assert [(r.rule_no, r.rule, r.regex) for r in rows] == [(1, "*.log", r"(?s:.*\.log)\z"), (3, "build/", r"(?s:build)\z")]


@pytest.mark.parametrize("mode, expected", [
    ("all", {"src/main.py", "src/utils.py", "tests/test_main.py"}),
    ("modules_only", {"src/main.py", "src/utils.py"}), ("tests_only", {"tests/test_main.py"}),
])
def test_tree_modes(files_of, mode, expected):
    rows = filtering.scan(files_of(PROJECT), JobOptions(tree_mode=mode)).where("in_tree").collect()
    assert {r.rel_path for r in rows} == expected


def test_stacks(files_of):
    df = filtering.match_stacks(filtering.with_name_parts(files_of({"a.yaml": "", "Makefile": "", "x.zig": "", ".env": ""})))
    got = sorted((r.rel_path, r.stack) for r in df.collect())
    assert got == [
        ("Makefile", "C / C++"), ("a.yaml", "Mobile (Swift/Dart)"), ("a.yaml", "Python Data"), ("a.yaml", "Shell / Ops"),
    ]


def test_many_ignore_files_are_joined_by_shuffle(files_of, monkeypatch):
    files = files_of({(f"p{i}", path): f"f{i}.py\n" for i in range(6) for path in (".gitignore", "f1.py", "f2.py", "g.py")})
    expected = sorted(tuple(r) for r in filtering.with_ignore_patterns(files).collect())
    monkeypatch.setattr(filtering, "small_side", lambda df: (df, False))
    monkeypatch.setattr(filtering.spread_lookup, "__defaults__", (1,))
    assert sorted(tuple(r) for r in filtering.with_ignore_patterns(files).collect()) == expected
    assert len(expected) == 24


def test_missing_root_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_directory(spark, str(tmp_path / "nowhere"), JobOptions())


def test_flat_folder_and_unreadable_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corpusmill.sources.directory._CHUNK", 7)
    for i in range(50):
        (tmp_path / f"f{i}.py").write_text("x")
    rows = list(directory._entries(str(tmp_path), "gone"))
    assert len(rows) == 1 and rows[0][:2] == ("gone", False) and "gone" in rows[0][4]
    found = read_directory(spark, str(tmp_path), JobOptions()).collect()
    assert len(found) == 50 and all(r.error is None and r.content == "x" for r in found)


@pytest.mark.parametrize("mode", ["basename_suffix", "basename_exact"])
def test_plain_rules_hit_what_their_regex_hits(spark, files_of, mode):
    rules = ["*.log", "build/", "**.tmp", "*", "/", "a?c", "[ab]x", "x*y", "*a*", "?", "!keep", "a.b", "[", "é*", "**", "a//", "*/"]
    listed = ["x.log", "build", "rebuild", "y.tmp", "abc", "ax", "xay", "keep", "!keep", "a.b", "aXb", "[", "éa", "a", "", "*", "a/"]
    both = files_of({(f"p{i}", ".gitignore"): rule for i, rule in enumerate(rules)})
    found = filtering.ignore_patterns(both, mode)
    regexes = filtering.ignore_rules(both, mode).select("project", "regex")
    names = spark.createDataFrame([(n,) for n in listed], "name string")
    rows = found.crossJoin(names).join(regexes, "project").select(
        "project", "name", filtering._ignored(F.col("name")).alias("mine"), F.rlike("name", F.col("regex")).alias("regex")
    ).collect()
    assert len(rows) == len(rules) * len(listed)
    assert [tuple(r) for r in rows if r.mine != r.regex] == []
    kept = {r.project: r.ignore for r in found.collect()}
    assert kept["p0"].regex is None and kept["p0"].ends == [".log"] and kept["p5"].regex is not None
    assert (kept["p1"].names == ["build"]) == (mode == "basename_exact")


@pytest.mark.parametrize("n_large", [0, 1, 3])
def test_reads_are_dealt_by_size(spark, n_large):
    small = [(f"d{i % 13}/f{i:05}", 100 + i % 900) for i in range(10_000)]
    large = [(f"d{i}/large", 60_000_000 * (i + 1)) for i in range(n_large)]
    odd = [("e/unread", 0), ("e/none", None)]
    listed = spark.createDataFrame(small + large + odd, "rel_path string, length bigint").repartition(5)
    dealt = directory.deal_by_size(listed, task_bytes=1_000_000, open_bytes=1_000)
    rows = dealt.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.rel_path for r in rows) == sorted(path for path, _ in small + large + odd)
    tasks = {}
    for r in rows:
        tasks.setdefault(r.task, []).append((r.length or 0) + 1_000)
    assert sum(len(t) == 1 and t[0] > 1_000_000 for t in tasks.values()) == n_large
    others = [sum(t) for t in tasks.values() if max(t) <= 1_000_000]
    assert max(others) <= 2_000_000 and len(others) <= sum(others) // 1_000_000 + 1
    assert directory.deal_by_size(listed.limit(0)).collect() == []
