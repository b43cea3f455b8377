import fnmatch
import os.path
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import names as N
from corpusmill.operators import filtering


def named(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "rel_path string")
    return {r.rel_path: r for r in filtering.with_name_parts(df).collect()}


def test_test_names(spark):
    yes = ["test_api.py", "api_test.py", "TestUser.java", "user.spec.ts", "component.test.js", "auth_test.go",
           "UserServiceTests.cs", "latest.py", "contest.js", "a.cy.tsx", "FooTestCase.kt"]
    no = ["api.py", "test_helper.txt", "latest_results.json", "User.java", "spec.md", "test_", "x.spec"]
    rows = named(spark, yes + no)
    assert [n for n in yes if not rows[n].is_test] == []
    assert [n for n in no if rows[n].is_test] == []


def test_resource_names(spark):
    yes = ["README.md", "Dockerfile", "config.json", "data.csv", "styles.css", ".dockerignore", "ci.yml", "A.JSON",
           ".env", ".gitignore"]
    no = ["main.py", "script.sh", "app.js", "dockerfile", "x.dockerfile"]
    rows = named(spark, yes + no)
    assert [n for n in yes if not rows[n].is_resource] == []
    assert [n for n in no if rows[n].is_resource] == []


def test_extension_matches_splitext(spark):
    values = ["a.py", ".env", "..a", "a.", "a.b.c", ".a.b", "...", "x", "a b.TXT", "a\nb.py", "é.ü", ".a.", "a..b"]
    rows = named(spark, values)
    assert {v: rows[v].ext for v in values} == {v: os.path.splitext(v)[1] for v in values}


def test_path_parts(spark):
    df = spark.createDataFrame([("a/b/c.py",), ("c.py",)], "p string")
    got = df.select(N.directory(F.col("p")), N.base_name(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("a/b", "c.py"), ("", "c.py")]


GLOBS = ["*.log", "build/", "a[bc]d", "[!a]x", "[]a]", "[", "x[", "?.py", "[z-a]", "[!z-a]", "[a-c-e]", "**/x", "a.b+c",
         "[[]", "[&&a]", "[^a]", "[\\]", "foo\\bar", "[!]]", "é*", "*.secret", "(x|y)", "{a}", "$HOME"]
NAMES = ["x.log", "build", "rebuild", "abd", "acd", "add", "bx", "ax", "]", "a", "[", "x[", "q.py", "az", "a/x", "//x",
         "a.b+c", "aab+c", "&", "^", "b", "c", "d", "e", "-", "\\", "foo\\bar", "é1", "z", "", "api.secret", "(x|y)",
         "{a}", "$HOME", "x", "y", "a\nb.log"]


@pytest.mark.parametrize("mode", ["basename_suffix", "basename_exact"])
def test_globs_match_shell_rules(spark, mode):
    pairs = [(g, n) for g in GLOBS for n in NAMES]
    df = spark.createDataFrame(pairs, "g string, n string")
    rows = df.withColumn("hit", F.rlike("n", N.glob_to_regex(F.col("g"), mode))).collect()
    for row in rows:
        rx = re.compile(fnmatch.translate(row.g.rstrip("/")))
        expected = rx.search(row.n) if mode == "basename_suffix" else rx.match(row.n)
        assert row.hit == (expected is not None), (row.g, row.n)


def test_malformed_patterns_are_dropped(spark):
    assert N.valid_patterns(spark, ["^a", "(", "[z", "b$", "*x"]) == ["^a", "b$"]


def test_default_noise(spark, files_of):
    noise = [".git", ".env", "__pycache__", "script.pyc", "node_modules", ".vscode", ".idea", "__init__.py"]
    df = filtering.with_name_parts(files_of({n: "" for n in noise + ["main.py", "_private.py", "__main__.py"]}))
    from corpusmill.options import JobOptions

    kept = df.where(~filtering.excluded(df, JobOptions().exclude_patterns)).select("rel_path").collect()
    assert {r.rel_path for r in kept} == {"main.py", "_private.py", "__main__.py"}


def test_patterns_do_not_disturb_each_other(spark):
    names_ = ["book.py", "bk.py", "aXbX.py", "secret.py", "plain.py"]
    df = spark.createDataFrame([(n,) for n in names_], "n string")
    hit = lambda *patterns: {
        r.n for r in df.where(N.hits_any(F.col("n"), N.valid_patterns(spark, patterns))).collect()
    }
    assert hit("(zzz)", r"(o)\1") == {"book.py"}
    assert hit("(?P<x>secret)", r"(?P<x>o)(?P=x)") == {"secret.py", "book.py"}
    assert hit("(?i)AXBX", "(?x) book # comment") == {"aXbX.py", "book.py"}
    dropped = []
    assert N.valid_patterns(spark, ["ok", "(", "(?P<a_b>x)"], dropped) == ["ok"] and dropped == ["(", "(?P<a_b>x)"]
