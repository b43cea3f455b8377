import random
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import segments
from corpusmill.options import JobOptions

CHAIN = JobOptions(minify_output=True, enable_sanitizer=True, mask_user_paths=True, user_name="dev", home_dir="/home/dev")
LINES = ["", "", "", " ", "\t \u00a0", "# all gone", "x = 1  # note", "é中\U0001d54f", "// call", "at 10.0.0.1 ", "a.b@c.org",
         'token = "secret-value-1"', "/home/dev/x", "C:\\dev\\y", "sk-" + "a" * 32, "AKIA" + "B" * 16, "\u2028", "key: 'abcdefgh'"]


def cuts(spark, values, size):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(segments.line_segments(F.col("t"), size)).collect()]


def test_line_segments(spark):
    assert cuts(spark, ["", "a", "ab\ncd\nef", "abc\n", "abcdefgh", None], 2) == [
        [""], ["a"], ["ab\n", "cd\n", "ef"], ["abc\n"], ["abcdefgh"], None]
    # Only whole lines, also where a cut would fall into a character.
    assert cuts(spark, ["é\né\né", "\n\n\n\n\n", "中中中\nx"], 3) == [["é\né\n", "é"], ["\n\n\n\n", "\n"], ["中中中\n", "x"]]


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_segments_are_the_text(spark, size):
    rng = random.Random(size)
    values = ["\n".join(rng.choices(LINES, k=rng.randint(0, 40))) + rng.choice(["", "\n"]) for _ in range(60)]
    for value, parts in zip(values, cuts(spark, values, size)):
        assert "".join(parts) == value
        assert all(p.endswith("\n") for p in parts[:-1]) and (parts == [""] or all(parts))
        longest = max(len(line.encode()) + 1 for line in value.split("\n"))
        assert all(len(p.encode()) <= 2 * max(size, longest) for p in parts)


@pytest.mark.parametrize("size", [1, 5, 40])
@pytest.mark.parametrize("options", [CHAIN, JobOptions(enable_sanitizer=True), JobOptions(minify_output=True)])
def test_seams_do_not_show(spark, size, options):
    """Any seam, any mixture of blank lines: the same rows as from whole texts."""
    rng = random.Random(size)
    rows = [(f"{i}", rng.choice([".py", ".ts", ".md", None]),
             "\n".join(rng.choices(LINES[:8] if i % 2 else LINES, k=rng.randint(0, 30))) + rng.choice(["", "\n", "\n\n\n"]))
            for i in range(150)]
    rows += [("none", ".py", None), ("empty", ".py", ""), ("blank", ".py", "\n" * 50), ("gone", ".py", "#a\n#b\n#c\n" * 9)]
    rows += [("copy", ".py", rows[1][2]), ("copy", ".py", rows[1][2]), ("copy", ".ts", rows[1][2])]
    df = spark.createDataFrame(rows, "rel_path string, ext string, content string")
    key = lambda r: tuple(x or "" for x in r)
    expected = sorted(map(tuple, text.transform_column(df, options).collect()), key=key)
    for copies in (1, 64):
        got = segments.transform_segmented(df, options, size=size, copies=copies)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect()), key=key) == expected


def test_skeletons_are_parsed_whole(spark):
    source = "def f(a):\n    # note\n    return a\n\n\n\ndef g():\n    return 1\n"
    df = spark.createDataFrame([("a.py", ".py", source), ("a.ts", ".ts", source)], "rel_path string, ext string, content string")
    options = CHAIN.with_(processing_depth="skeleton")
    got = segments.transform_segmented(df, options, size=4)
    assert sorted(got.collect()) == sorted(text.transform_column(df, options).collect())


def test_a_name_over_two_lines_is_not_cut(spark):
    options = JobOptions(mask_user_paths=True, home_dir="/ho\nme")
    df = spark.createDataFrame([("a", ".py", "x /ho\nme y\n")], "rel_path string, ext string, content string")
    got = segments.transform_segmented(df, options, size=2)
    assert got.collect() == text.transform_column(df, options).collect()


def test_a_text_of_many_segments(spark):
    line = "value = 1  # note at 10.0.0.1\n"
    df = spark.createDataFrame([("big", ".py", line)], "rel_path string, ext string, content string")
    df = df.withColumn("content", F.repeat("content", 140_000))
    pieces = df.select(F.posexplode(segments.line_segments(F.col("content"), 16384)).alias("n", "p"))
    assert pieces.count() > 200
    done = segments.transform_segmented(df, CHAIN, size=16384)
    assert done.select(F.sha2("content", 256)).first() == text.transform_column(df, CHAIN).select(F.sha2("content", 256)).first()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 63])
def test_small_sizes_cut_where_large_ones_would(spark, size, monkeypatch):
    """Looking up line feeds cuts at the same places as trying every ``size`` bytes."""
    rng = random.Random(size)
    values = ["\n".join(rng.choices(LINES + ["x" * 600], k=rng.randint(0, 60))) + rng.choice(["", "\n", "\n\n"]) for _ in range(60)]
    values += ["\n" * 1500, "\na", "a\n", "x" * 511 + "\n" * 3 + "é" * 700, "中\n" * 400, "", None]
    found = cuts(spark, values, size)
    monkeypatch.setattr(segments, "FEW_BYTES", 0)
    assert found == cuts(spark, values, size)


def test_small_segments_take_no_step_for_each_byte(spark, monkeypatch):
    """Texts of long lines: the work grows with lines and blocks; trying each byte takes many times as long."""
    df = spark.range(100).select(F.repeat(F.lit("word " * 4000 + "\n"), 2).alias("t"))

    def seconds(few):
        monkeypatch.setattr(segments, "FEW_BYTES", few, raising=False)
        began = time.perf_counter()
        df.select(F.sum(F.size(segments.line_segments(F.col("t"), 1)))).collect()
        return time.perf_counter() - began

    seconds(64)
    assert 2 * seconds(64) < seconds(0)
