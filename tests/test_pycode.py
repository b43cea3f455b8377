from pyspark.sql import functions as F

from corpusmill.functions import pycode as P

CLASS_FILE = '''"""Module text."""
import os
LIMIT = 3

@cached(1)
class Core(Base):
    """Core text."""
    size = 2

    def run(self, x: int = 1, *a, **k) -> int:
        """Run it."""
        y = x + 1
        return y

    class Inner:
        def deep(self): return 1

    async def fetch(self): return 2

def helper(): return LIMIT
'''


def test_skeleton_keeps_outline():
    assert P.skeleton_source(CLASS_FILE) == '''@cached(1)
class Core(Base):
    """Core text."""

    def run(self, x: int=1, *a, **k) -> int:
        """Run it."""
        pass

    class Inner:

        def deep(self):
            pass

    async def fetch(self):
        pass

def helper():
    pass'''


def test_decorated_async_function():
    got = P.skeleton_source('@app.get("/x")\nasync def read(q: str):\n    """Docs."""\n    return await db(q)\n')
    assert got == "@app.get('/x')\nasync def read(q: str):\n    \"\"\"Docs.\"\"\"\n    pass"


def test_broken_and_empty_source():
    assert P.skeleton_source("def broken(:").startswith("# [SKIPPING SKELETON] File has syntax errors: ")
    assert P.skeleton_source("X = 1  # only this\n") == ""
    assert P.skeleton_source("class A:\n    x = 1\n") == "class A:"
    assert P.skeleton_source("(" * 5000 + ")" * 5000).startswith("# [")


def test_symbols_by_flag():
    names = lambda *flags: [(s["kind"], s["parent"], s["name"]) for s in P.list_symbols(CLASS_FILE, *flags)]
    assert names(True, True, True) == [
        ("class", None, "Core"), ("method", "Core", "run"), ("function", None, "helper"),
    ]
    assert names(True, False, True) == [("function", None, "helper")]
    assert names(False, True, False) == [("class", None, "Core")]
    assert names(False, False, False) == []
    assert P.list_symbols("", True, True, True) == []


def test_symbols_of_broken_source():
    (only,) = P.list_symbols("x = (\n", True, True, True)
    assert (only["ord"], only["kind"]) == (0, "error")
    assert only["name"] == "Invalid AST (SyntaxError): '(' was never closed (line 1)"


def test_columns(spark):
    df = spark.createDataFrame(
        [(1, ".py", "def f(): return 1"), (2, ".PY", None), (3, ".js", "def f(): return 1")],
        "id int, ext string, t string",
    )
    rows = df.select(
        "id", P.skeleton_where_python(F.col("t"), F.col("ext")).alias("s"), P.symbols(F.col("t")).alias("y")
    ).orderBy("id").collect()
    assert [r.s for r in rows] == ["def f():\n    pass", None, "def f(): return 1"]
    assert [[s.name for s in r.y] for r in rows] == [["f"], [], ["f"]]
