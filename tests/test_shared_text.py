import pytest
from pyspark.sql import functions as F

from corpusmill.functions import pycode
from corpusmill.operators import shared_text
from corpusmill.options import JobOptions
from corpusmill.plans import job

FILES = "project string, rel_path string, ext string, content string"
SOURCE = "import os\n\n\ndef load(path):\n    return open(path).read()\n"
ROWS = (
    [(f"p{i}", "pkg/__init__.py", ".py", "") for i in range(40)]
    + [(f"p{i}", "pkg/util.py", ".py", SOURCE) for i in range(25)]
    + [(f"p{i}", "notes.md", ".md", SOURCE) for i in range(3)]
    + [(f"p{i}", f"own_{i}.py", ".py", f"x = {i}  \n") for i in range(10)]
    + [("p0", "gone.py", ".py", None), ("p1", "gone.py", ".py", None)]
)


@pytest.fixture
def files(spark):
    return spark.createDataFrame(ROWS, FILES).repartition(5)


def test_copies_are_counted_by_text_and_extension(files):
    found = {(r.project, r.rel_path): (r._copies, r._first) for r in shared_text.with_copies(files).collect()}
    assert found["p0", "pkg/__init__.py"] == (40, True) and found["p7", "pkg/__init__.py"] == (40, False)
    assert found["p0", "pkg/util.py"] == (25, True) and found["p0", "notes.md"] == (3, True)
    assert found["p3", "own_3.py"] == (1, True) and found["p1", "gone.py"] == (1, True)
    assert len(found) == len(ROWS)


@pytest.mark.parametrize("limits", [{}, {"limit": 0}, {"limit": 0, "hot_rows": 4}, {"hot_rows": 1}])
def test_same_rows_as_without_sharing(files, limits):
    change = lambda df: df.withColumn("content", F.concat("ext", F.upper("content"))).withColumn("n", F.length("content"))
    once = shared_text.transform_once(files, change, made=("content", "n"), **limits)
    expected = sorted(map(tuple, change(files).select(*once.columns).collect()), key=repr)
    assert sorted(map(tuple, once.collect()), key=repr) == expected


def test_the_parser_sees_each_text_once(spark, files):
    seen = spark.sparkContext.accumulator(0)

    def outline(df):
        @F.pandas_udf("string")
        def counted(text):
            seen.add(int(text.notna().sum()))
            return text.map(lambda t: None if t is None else pycode.skeleton_source(t))

        return df.withColumn("content", counted("content"))

    rows = shared_text.transform_once(files, outline).collect()
    distinct = {(r[2], r[3]) for r in ROWS if r[3] is not None}
    assert len(rows) == len(ROWS) and seen.value == len(distinct)


def test_no_raw_text_of_copies_moves(spark):
    files = spark.createDataFrame(ROWS, FILES)
    once = shared_text.transform_once(files, lambda df: df.withColumn("content", F.upper("content")))
    plan = once._sc._jvm.PythonSQLUtils.explainString(once._jdf.queryExecution(), "formatted")
    exchanges = [b for b in plan.split("\n\n") if b.strip().partition("\n")[0].split(") ")[-1].startswith("Exchange")]
    # The one text that is moved is the result of each shared text.
    assert sum("content" in b for b in exchanges) <= 1


def test_a_run_with_shared_texts_is_the_same_run(spark):
    tree = {(f"p{i}", path): text for i in range(6) for path, text in (
        ("a/__init__.py", ""), ("a/b.py", SOURCE), (f"a/c{i}.py", f"key = 'sk-{'a' * 40}'  # {i}\n"), ("README.md", "# x\n\n\n\ny"),
    )}
    rows = [(*k, v) for k, v in tree.items()]
    corpus = spark.createDataFrame(rows, "project string, rel_path string, content string")
    options = JobOptions(processing_depth="skeleton", minify_output=True, enable_sanitizer=True)
    plain = job.process(corpus, options)
    shared = job.process(corpus, options, share_texts=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, shared.select(*plain.columns).collect()))
