import datetime
import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import reuse, sieve
from corpusmill.options import JobOptions

CACHE = "fingerprint string, project string, rel_path string, content string, n_tokens long, created_at timestamp"
AT = datetime.datetime(2024, 1, 1)


def stored_row(fingerprint, content="text", tokens=150, day=0):
    return (fingerprint, "p", "a.py", content, tokens, AT + datetime.timedelta(days=day))


def test_settings_fingerprint(spark):
    options = JobOptions(enable_sanitizer=True)
    expected = hashlib.md5(json.dumps(["full", True, True, True, False, False]).encode()).hexdigest()
    assert options.config_fingerprint() == expected
    df = spark.createDataFrame([("full", True, True, True, False, False)], "d string, t boolean, r boolean, s boolean, m boolean, n boolean")
    assert df.select(reuse.settings_fingerprint(*[F.col(c) for c in "dtrsmn"])).first()[0] == expected
    masked = options.with_(mask_user_paths=True, user_name="a")
    assert masked.config_fingerprint() != masked.with_(user_name="b").config_fingerprint()


def test_file_fingerprint_reacts_to_every_part(spark):
    base = ("p", "a.py", AT, 10, "text")
    rows = [base, base, ("q", *base[1:]), ("p", "b.py", *base[2:]), ("p", "a.py", AT + datetime.timedelta(seconds=1), 10, "text"),
            ("p", "a.py", AT, 11, "text"), ("p", "a.py", AT, 10, "texT")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, project string, rel_path string, mtime timestamp, length long, content string")
    keys = [r.fingerprint for r in reuse.with_fingerprint(df, JobOptions()).orderBy("i").collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 6 and len(keys[0]) == 64
    by_state = [r.fingerprint for r in reuse.with_fingerprint(df, JobOptions(), "stat").orderBy("i").collect()]
    assert by_state[0] == by_state[6] and len(set(by_state)) == 5


def test_hits_and_misses(spark):
    files = spark.createDataFrame([("k1", "p", "a.py", "raw"), ("k2", "p", "b.py", "raw2")], "fingerprint string, project string, rel_path string, content string")
    cache = spark.createDataFrame([stored_row("k1", "old", day=0), stored_row("k1", "new", day=1), stored_row("k9")], CACHE)
    assert [(r.rel_path, r.content, r.n_tokens) for r in reuse.hits(files, cache).collect()] == [("a.py", "new", 150)]
    assert [(r.rel_path, r.content) for r in reuse.misses(files, cache).collect()] == [("b.py", "raw2")]


def test_misses_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(reuse, "small_side", lambda df: (df, False))
    files = spark.createDataFrame([("k1", "p", "a", "x"), ("k2", "p", "b", "y")], "fingerprint string, project string, rel_path string, content string")
    cache = spark.createDataFrame([stored_row("k1")], CACHE)
    assert [(r.fingerprint, r.content) for r in reuse.misses(files, cache).collect()] == [("k2", "y")]


def test_upsert_replaces(spark):
    old = spark.createDataFrame([stored_row("k1", "old"), stored_row("k2", "keep")], CACHE)
    new = spark.createDataFrame([stored_row("k1", "new", 7, day=1)], CACHE)
    rows = {r.fingerprint: (r.content, r.n_tokens) for r in reuse.upsert(old, new).collect()}
    assert rows == {"k1": ("new", 7), "k2": ("keep", 150)}


def moved_columns(df):
    """Columns that go through an exchange or a sort, from the formatted plan."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    moved = set()
    for block in plan.split("\n\n"):
        head, _, rest = block.strip().partition("\n")
        if head.split(") ")[-1].split(" [")[0] in ("Exchange", "Sort"):
            moved |= set(re.findall(r"(\w+)#\d+", rest.partition("\n")[0]))
    return moved


def test_ties_come_out_once(spark):
    same = [stored_row("k1", "b"), stored_row("k1", "b"), stored_row("k1", "a"), stored_row("k2", "x", None), stored_row("k2", "y", None)]
    cache = spark.createDataFrame(same, CACHE)
    assert sorted((r.fingerprint, r.content) for r in reuse.newest(cache).collect()) == [("k1", "a"), ("k2", "x")]


def test_several_tables_are_one(spark):
    """Ranks and ties are settled across tables, not in each of them."""
    table = lambda *rows: spark.createDataFrame(list(rows), CACHE)
    tables = [table(stored_row("k1", "old"), stored_row("k2", "b"), stored_row("k4")),
              table(stored_row("k1", "new", day=1), stored_row("k2", "a")), table(), table(stored_row("k3", "c"), stored_row("k2", "b"))]
    expected = {"k1": "new", "k2": "a", "k3": "c"}
    rows = reuse.newest(tables).collect()
    assert len(rows) == 4 and {r.fingerprint: r.content for r in rows} == {**expected, "k4": "text"}
    files = spark.createDataFrame([(f"k{i}", "p", f"{i}.py", "raw") for i in (1, 2, 3, 5)], "fingerprint string, project string, rel_path string, content string")
    assert sorted((r.rel_path, r.content) for r in reuse.hits(files, tables).collect()) == [("1.py", "new"), ("2.py", "a"), ("3.py", "c")]
    assert [r.rel_path for r in reuse.misses(files, tables).collect()] == ["5.py"]


def test_twice_the_same_path(spark):
    """A hit and a miss of one path each come out once."""
    files = spark.createDataFrame(
        [("p", "a.py", "old"), ("p", "a.py", "new")], "project string, rel_path string, content string"
    ).withColumn("taken", F.lit(True))
    finish = lambda df: df.withColumn("fingerprint", F.concat(F.lit("k-"), F.col("content")))
    cache = spark.createDataFrame([stored_row("k-old", "done")], CACHE)
    found, rest = reuse.split(files, cache, finish)
    assert [r.content for r in found.collect()] == ["done"] and [r.content for r in rest.collect()] == ["new"]


def test_counts_of_one_method_do_not_serve_another(spark, tmp_path):
    options = JobOptions()
    cache = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=2)
    cache.append(spark.createDataFrame([stored_row("k1")], CACHE), options, "some_vocabulary")
    assert cache.read(options) is None and cache.read(options, "some_vocabulary").count() == 1


def test_purge_leaves_foreign_folders(spark, tmp_path):
    cache = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=2)
    cache.append(spark.createDataFrame([stored_row("k1")], CACHE), JobOptions())
    for name in ("notes", "0" * 32):
        (tmp_path / "cache" / name).mkdir()
        (tmp_path / "cache" / name / "keep.txt").write_text("x")
    cache.purge()
    assert cache.read(JobOptions()) is None
    assert (tmp_path / "cache" / "notes" / "keep.txt").exists() and (tmp_path / "cache" / ("0" * 32) / "keep.txt").exists()


def test_table_life_cycle(spark, tmp_path):
    options = JobOptions()
    cache = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), CACHE)
    assert cache.read(options) is None
    cache.append(rows(stored_row("k1", "one"), stored_row("k2", "two")), options)
    cache.append(rows(stored_row("k1", "one again", day=1)), options)
    assert cache.read(options).count() == 3
    assert cache.read(options.with_(minify_output=True)) is None
    cache.compact(options)
    expected = {"k1": "one again", "k2": "two"}
    assert {r.fingerprint: r.content for r in cache.read(options).collect()} == expected
    # Another session finds the same rows.
    other = reuse.ResultCache(spark.newSession(), str(tmp_path / "cache"), buckets=4)
    assert {r.fingerprint: r.content for r in other.read(options).collect()} == expected
    cache.purge()
    assert cache.read(options) is None
    cache.append(rows(stored_row("k3")), options)
    assert cache.read(options).count() == 1


def folder_of(tmp_path, cache):
    return tmp_path / "cache" / cache._key(JobOptions(), "heuristic")


def test_unfinished_generations_are_ignored(spark, tmp_path):
    options = JobOptions()
    cache = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=2)
    cache.append(spark.createDataFrame([stored_row("k1")], CACHE), options)
    folder = folder_of(tmp_path, cache)
    # Runs stopped while they wrote rows, before their manifest, and while they wrote that.
    (folder / ("g" + "0" * 32)).mkdir()
    cache._write(spark.createDataFrame([stored_row("k2")], CACHE), folder.name)
    (folder / ("_draft-" + "0" * 32)).write_text("g" + "0" * 32 + "\n")
    assert cache.read(options).count() == 1
    cache.append(spark.createDataFrame([stored_row("k3")], CACHE), options)
    assert sorted(r.fingerprint for r in cache.read(options).collect()) == ["k1", "k3"]
    assert (folder / ("g" + "0" * 32)).exists()


def test_files_stay_few(spark, tmp_path):
    """Twenty runs: the newest rows are there, in a bounded number of files and folders."""
    options = JobOptions()
    cache = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=2, merge_at=3)
    folder, written = folder_of(tmp_path, cache), 0
    for run in range(20):
        rows = [stored_row(f"k{run}", "x" * 50), stored_row("again", f"run {run}", day=run)]
        cache.append(spark.createDataFrame(rows, CACHE), options)
        named = cache.generations(options)
        assert len(named) <= 2 * 3  # two of a size, in the three sizes that these rows can reach
        assert len(list(folder.glob("g*/*.parquet"))) <= 2 * (len(named) + 4)
        assert len(list(folder.glob("manifest-*"))) == min(run + 1, 2)
    rows = {r.fingerprint: r.content for r in reuse.newest(cache.read(options)).collect()}
    assert rows == {f"k{run}": "x" * 50 for run in range(20)} | {"again": "run 19"}
    assert cache.read(options).where("fingerprint = 'again'").count() <= len(named)


def test_two_writers(spark, tmp_path, monkeypatch):
    """What another run commits between listing and writing a manifest is not lost."""
    options = JobOptions()
    first = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=2)
    second = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=2)
    config_hash = folder_of(tmp_path, first).name
    names = [first._write(spark.createDataFrame([stored_row(f"k{i}")], CACHE), config_hash) for i in range(3)]
    first._commit(config_hash, names[:1])
    listed, calls = first._children, []

    def children(folder):
        found = listed(folder)
        if not calls and any(n.startswith("manifest-") for n in found):
            calls.append(second._commit(config_hash, names[1:2]))
        return found

    monkeypatch.setattr(first, "_children", children)
    assert first._commit(config_hash, names[2:]) and calls == [True]
    assert sorted(r.fingerprint for r in first.read(options).collect()) == ["k0", "k1", "k2"]
    # A merge of what another one has merged already is given up.
    assert second._commit(config_hash, ["g" + "1" * 32], names[:2])
    assert not first._commit(config_hash, ["g" + "2" * 32], names[:1])


def test_a_run_without_results_adds_no_generation(spark, tmp_path):
    cache = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=2)
    cache.append(spark.createDataFrame([], CACHE), JobOptions())
    assert cache.generations(JobOptions()) == [] and cache.read(JobOptions()) is None


def test_a_table_without_manifest_is_taken_over(spark, tmp_path, monkeypatch):
    options = JobOptions()
    cache = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=2)
    folder = folder_of(tmp_path, cache)
    (folder / cache._write(spark.createDataFrame([stored_row("k1")], CACHE), folder.name)).rename(folder / "v2")
    (folder / "v3").mkdir()
    assert cache.read(options).count() == 1
    cache.append(spark.createDataFrame([stored_row("k2")], CACHE), options)
    assert cache.read(options).count() == 2 and cache.generations(options)[0].endswith("/v2")


def test_lookup_leaves_stored_text_in_place(spark, tmp_path):
    options = JobOptions()
    cache = reuse.ResultCache(spark, str(tmp_path / "cache"), buckets=4)
    for part in range(2):
        cache.append(spark.createDataFrame([stored_row(f"k{i}") for i in range(part, 40, 2)], CACHE), options)
    assert len(cache.generations(options)) == 2
    keys = spark.createDataFrame([(f"k{i}", "p", f"{i}.py") for i in range(20)], "fingerprint string, project string, rel_path string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = reuse.hits(keys, cache.tables(options))
        moved, plan = moved_columns(found), found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Bucketed: true" in plan and "fingerprint" in moved and "content" not in moved


def test_rows_without_token_counts(spark):
    old = spark.createDataFrame([stored_row("k1")], CACHE).drop("n_tokens")
    assert reuse.with_token_column(old).first().n_tokens == 0
    new = spark.createDataFrame([stored_row("k2", tokens=None), stored_row("k3", tokens=3)], CACHE)
    assert sorted(r.n_tokens for r in reuse.with_token_column(old.unionByName(new, allowMissingColumns=True)).collect()) == [0, 0, 3]


def test_sieve_knows_its_keys_and_few_others(spark):
    keys = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"))
    others = spark.range(4000, 8000).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"))
    nulls = spark.createDataFrame([(None,)], "fingerprint string")
    known = sieve.build(keys.unionByName(nulls), "fingerprint", blocks=256)
    assert known.count() <= 256
    test = lambda rows: sieve.with_maybe(rows, known, "fingerprint", blocks=256).agg(F.count_if("_maybe"), F.count("*")).first()
    assert tuple(test(keys)) == (4000, 4000) and test(others)[0] < 120 and tuple(test(nulls)) == (0, 1)
    empty = sieve.build(keys.limit(0), "fingerprint")
    assert sieve.with_maybe(keys, empty, "fingerprint").where("_maybe").count() == 0


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("blocks", [1, 1 << 18])
def test_split_with_false_positives(spark, monkeypatch, few, blocks):
    """One block lets nearly everything through; the rows stay right."""
    build, maybe = sieve.build, sieve.with_maybe
    monkeypatch.setattr(reuse.sieve, "build", lambda keys, name: build(keys, name, blocks))
    monkeypatch.setattr(reuse.sieve, "with_maybe", lambda rows, table, name: maybe(rows, table, name, blocks=blocks))
    if not few:
        monkeypatch.setattr(reuse, "small_side", lambda df: (df, False))
    rows = [("p", f"{i}.py", f"t{i}", i % 7 != 0) for i in range(300)] + [("q", "twin.py", "t1", True)]
    files = spark.createDataFrame(rows, "project string, rel_path string, content string, taken boolean")
    finish = lambda df: df.withColumn("fingerprint", F.concat(F.lit("k-"), F.col("content")))
    cache = spark.createDataFrame([stored_row(f"k-t{i}", f"done {i}") for i in range(0, 300, 2)] + [stored_row("k-t1", "done 1")], CACHE)
    found, rest = reuse.split(files, cache, finish)
    stored_ids = set(range(0, 300, 2)) | {1}
    taken = {i for i in range(300) if i % 7}
    assert sorted(r.content for r in found.collect()) == sorted([f"done {i}" for i in stored_ids & taken] + ["done 1"])
    assert sorted(r.content for r in rest.collect()) == sorted(f"t{i}" for i in range(300) if i not in taken or i not in stored_ids)
    assert rest.columns == [*files.columns, "fingerprint"]


@pytest.mark.parametrize("few", [True, False])
def test_certain_misses_are_not_moved(spark, monkeypatch, few):
    """With broadcasts chosen by size off, the text of misses meets no exchange."""
    if not few:
        monkeypatch.setattr(reuse, "small_side", lambda df: (df, False))
    files = spark.createDataFrame([(f"f{i}", "p", f"{i}.py", "text") for i in range(50)], "fingerprint string, project string, rel_path string, content string")
    cache = spark.createDataFrame([stored_row("f1")], CACHE)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = reuse.misses(files, cache)
        assert left.count() == 49
        if few:
            assert "content" not in moved_columns(left)
        else:
            # Only what the filter lets through is joined by shuffle; the other branch has no exchange.
            plan = left._sc._jvm.PythonSQLUtils.explainString(left._jdf.queryExecution(), "formatted")
            assert plan.count("Union") >= 1
            sure = sieve.with_maybe(files, sieve.build(cache, "fingerprint"), "fingerprint").where("not _maybe")
            assert "content" not in moved_columns(sure) and sure.count() == 49
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
