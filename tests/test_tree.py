import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import tree
from corpusmill.options import JobOptions


def render(paths, symbols=None):
    """Nested dicts and recursion: the tree drawn the plain way."""
    root = {}
    for path in paths:
        node = root
        *folders, name = path.split("/")
        for folder in folders:
            node = node.setdefault(folder, {})
        node[name] = path
    lines = []

    def walk(node, prefix):
        entries = sorted(node)
        for entry in entries:
            last = entry == entries[-1]
            lines.append(prefix + ("└── " if last else "├── ") + entry)
            below = prefix + ("    " if last else "│   ")
            if isinstance(node[entry], dict):
                walk(node[entry], below)
            else:
                lines.extend(below + s for s in (symbols or {}).get(node[entry], []))

    walk(root, "")
    return lines


def drawn(df):
    out = {}
    for row in df.orderBy("project", "sort_key", "ord").collect():
        out.setdefault(row.project, []).append(row.line)
    return out


def random_projects(seed):
    rng = random.Random(seed)
    words = ["a", "b", "a-b", "a.b", "Z", "é", "src", "日本", "_x", "a b"]
    projects = {}
    for n in range(4):
        paths = set()
        for i in range(120):
            depth = rng.choice([0, 0, 1, 2, 3, 6])
            paths.add("/".join([rng.choice(words) for _ in range(depth)] + [f"{rng.choice(words)}{i}.py"]))
        projects[f"p{n}"] = paths
    # One directory that holds a third of all files.
    projects["p0"] |= {f"src/hot/f{i}.py" for i in range(250)}
    return projects


@pytest.mark.parametrize("hot_rows, limit", [(1_000_000, 1 << 26), (1, 0), (7, 0), (1_000_000, 0)])
def test_lines_match_recursive_renderer(files_of, hot_rows, limit):
    projects = random_projects(3)
    files = files_of({(p, path): "" for p, paths in projects.items() for path in paths})
    got = drawn(tree.tree_lines(files, hot_rows, limit))
    assert got == {p: render(paths) for p, paths in projects.items()}


def test_hot_directory_is_spread_over_slots(spark, files_of):
    """Rows of one directory land in several join partitions."""
    from corpusmill.scale import spread_lookup

    left = spark.range(1000).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("name"))
    right = spark.createDataFrame([("k", 1000, "v")], "key string, n long, value string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_lookup(left, right, ["key"], "name", "n", hot_rows=50)
        rows = joined.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == 1000 and {r.value for r in rows} == {"v"}
    assert len({r.part for r in rows}) == 4


def test_symbol_lines(files_of):
    code = "class A:\n    def m(self): pass\ndef f(): pass\n"
    files = files_of({"src/main.py": code, "src/z.py": "x = (", "a.py": ""})
    options = JobOptions(show_functions=True, show_classes=True, show_methods=True)
    got = drawn(tree.tree_lines(tree.with_symbols(files, options)))["app"]
    listed = {
        "src/main.py": ["Class: A", "  Method: m()", "Function: f()"],
        "src/z.py": ["[ERROR] Invalid AST (SyntaxError): '(' was never closed (line 1)"],
    }
    assert got == render(["src/main.py", "src/z.py", "a.py"], listed)
    counts = tree.tree_line_counts(tree.with_symbols(files, options)).first()
    assert counts.tree_lines == len(got)


def test_no_flag_needs_no_python(files_of):
    files = files_of({"a.py": "x"})
    assert "symbols" not in tree.with_symbols(files, JobOptions()).columns


def test_nodes(files_of):
    rows = tree.tree_nodes(files_of({"src/x/main.py": "", "a.py": ""})).collect()
    assert sorted((r.path, r.depth, r.kind) for r in rows) == [
        ("a.py", 1, "file"), ("src", 1, "dir"), ("src/x", 2, "dir"), ("src/x/main.py", 3, "file"),
    ]


def test_unreadable_file_has_one_error_symbol(spark):
    files = spark.createDataFrame(
        [("p", "src/a.py", None, "Permission denied"), ("p", "b.py", "def f(): pass", None)],
        "project string, rel_path string, content string, error string",
    )
    found = {r.rel_path: [(s.kind, s.name) for s in r.symbols] for r in tree.with_symbols(files, JobOptions(show_functions=True)).collect()}
    assert found == {"src/a.py": [("error", "Could not read 'a.py': Permission denied")], "b.py": [("function", "f")]}
