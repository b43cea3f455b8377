from corpusmill.options import JobOptions
from corpusmill.streaming import ingest


def test_each_file_is_taken_once(spark, tmp_path):
    root, table, offsets = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "offsets")
    (root / "app").mkdir(parents=True)
    options = JobOptions(enable_sanitizer=True, minify_output=True)

    def run():
        stream = ingest.transform_stream(ingest.stream_directory(spark, str(root)), options)
        ingest.ingest(stream, table, offsets).awaitTermination()
        return {(r.project, r.rel_path): r.content for r in spark.read.parquet(table).collect()}

    (root / "app" / "a.py").write_text("x = 1  # note\n")
    assert run() == {("app", "a.py"): "x = 1\n"}
    assert len(run()) == 1
    (root / "app" / "b.py").write_text("ip = '10.0.0.1'\n")
    (root / "app" / "c.bin").write_text("skipped")
    rows = run()
    assert rows == {("app", "a.py"): "x = 1\n", ("app", "b.py"): "ip = '[[REDACTED_SENSITIVE]]'\n"}
    assert spark.read.parquet(table).count() == 2
