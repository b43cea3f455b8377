import io
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T

SENSITIVE, SECRET = "[[REDACTED_SENSITIVE]]", "[[REDACTED_SECRET]]"


def apply(spark, change, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = df.select("id", change(F.col("t")).alias("r")).orderBy("id").collect()
    return [r.r for r in rows]


# Written line by line from the meaning of each step, as a second opinion.
MARKED = [
    re.compile(r"sk-[a-zA-Z0-9-]{32,}"), re.compile(r"AKIA[0-9A-Z]{16}"),
    re.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
]
NAMES = "(?:key|password|secret|token|auth|api|pwd)"
PAIR = re.compile(rf"(?i)({NAMES}[-_]?{NAMES}?\s*[:=]\s*['\"])[^'\"]{{8,}}(['\"])")


def redact_lines(text):
    out = []
    for line in io.StringIO(text):
        for rx in MARKED:
            line = rx.sub(SENSITIVE, line)
        out.append(PAIR.sub(rf"\1{SECRET}\2", line))
    return "".join(out)


def minify_lines(text, ext):
    out, blank = [], False
    for line in io.StringIO(text):
        if ext.lower() in (".py", ".yaml", ".yml", ".sh", ".bash"):
            line = line.split("#")[0] if "#" in line else line
        elif ext.lower() in (".js", ".go", ".cs"):
            line = line.split("//")[0] if "//" in line else line
        line = line.rstrip()
        if line or not blank:
            out.append(line + "\n")
        blank = not line
    return "".join(out)


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(11)
    pieces = list(" \t\n\n \x0b\x1c\x85\u2003\u2028abéßK_#/.:='\"-@|%1289٣\u0301") + [
        "1.2.3.4", "10.0.0.255", "sk-" + "a" * 33, "AKIA" + "Z" * 16, "token", "API", "\u212aey",
        "key = 'abcdefgh1'", 'Pwd_key: "zzzzzzzzz"', "x@y.co", "a.b@c.de|", "é.q@r.io", "   \n", "//", "#",
    ]
    return [
        (i, rng.choice([".py", ".YML", ".js", ".go", ".md", ""]),
         "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))))
        for i in range(3000)
    ]


def test_redaction_and_minifying_agree_with_line_by_line(spark, random_texts):
    df = spark.createDataFrame(random_texts, "id int, ext string, t string").withColumn("r", F.col("t"))
    df = T.redact_column(df, "r").select(
        "*", T.redact_all(F.col("t")).alias("ra"), T.minify(F.col("t"), F.col("ext")).alias("m"),
        T.minify_whole(F.col("t"), F.col("ext")).alias("w"),
    )
    for row in df.collect():
        assert row.r == row.ra == redact_lines(row.t)
        small = minify_lines(row.t, row.ext)
        assert row.m == small
        assert row.w == small.rstrip()


def test_keys_in_a_sentence(spark):
    text = f"use sk-{'a1B2' * 8} or AKIA{'A1' * 8} today"
    assert apply(spark, T.redact_all, text) == [f"use {SENSITIVE} or {SENSITIVE} today"]


def test_assignments_keep_name_and_quotes(spark):
    got = apply(
        spark, T.redact_all, "PASSWORD = 'hunter2hunter2'", 'db_token: "0123456789"',
        "auth_key = 'my-long-secret'", "password = 'dev'", "key = \"sk-" + "x" * 40 + '"',
    )
    assert got == [
        f"PASSWORD = '{SECRET}'", f'db_token: "{SECRET}"', f"auth_key = '{SECRET}'",
        "password = 'dev'", f'key = "{SECRET}"',
    ]


def test_addresses(spark):
    got = apply(spark, T.redact_all, "mail admin@example.com from 192.168.1.50", "999.999.999.999", "1.2.3.4567")
    assert got == [f"mail {SENSITIVE} from {SENSITIVE}", SENSITIVE, "1.2.3.4567"]


def test_pattern_never_spans_lines(spark):
    assert apply(spark, T.redact_all, "token =\n'longenough1'") == ["token =\n'longenough1'"]


def test_masking(spark):
    mask = lambda t: T.mask_paths(t, "/home/testuser", "testuser")
    got = apply(
        spark, mask, "open /home/testuser/a", "/HOME/TestUser/b", r"C:\Users\testuser\c",
        "/var/lib/testuser/x", "testuser alone", "/testuser/testuser/",
    )
    assert got == [
        "open <USER_HOME>/a", "<USER_HOME>/b", "C:/Users/<USER>/c", "/var/lib/<USER>/x",
        "testuser alone", "/<USER>/testuser/",
    ]
    windows = lambda t: T.mask_paths(t, r"C:\Users\me (x)", "")
    assert apply(spark, windows, r"see c:\users\ME (X)\doc") == ["see <USER_HOME>/doc"]


def test_comments_by_extension(spark):
    py = lambda t: T.minify(t, F.lit(".PY"))
    js = lambda t: T.minify(t, F.lit(".js"))
    md = lambda t: T.minify(t, F.lit(".md"))
    assert apply(spark, py, "# all\nx = 1  # note\nurl = 'a//b'") == ["\nx = 1\nurl = 'a//b'\n"]
    assert apply(spark, js, "// all\nf(); // note\nc = '#fff'") == ["\nf();\nc = '#fff'\n"]
    assert apply(spark, md, "# Title\n") == ["# Title\n"]


def test_blank_lines_and_ends(spark):
    md = lambda t: T.minify(t, F.lit(".md"))
    assert apply(spark, md, "a\n\n\n\nb   \n", "", "\n\n\na", "a\n#", None) == [
        "a\n\nb\n", "", "\na\n", "a\n#\n", None,
    ]


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray(b"a\r\nb\rc\n\x80\x81\xff\n\xc3\xa9"),)], "raw binary")
    assert df.select(T.read_text(F.col("raw"))).first()[0] == "a\nb\nc\n\ufffd\ufffd\ufffd\né"


def test_reduction_and_lists(spark):
    df = spark.createDataFrame([("aaaa", "a", " .py, ,js,,\tMakefile \n"), ("", "", "")], "a string, b string, c string")
    rows = df.select(T.reduction_percent(F.col("a"), F.col("b")), T.csv_list(F.col("c"))).collect()
    assert tuple(rows[0]) == (75.0, [".py", "js", "Makefile"])
    assert tuple(rows[1]) == (None, [])


def test_checksums(spark):
    import hashlib

    digest = hashlib.sha256(b"abc").hexdigest()
    df = spark.createDataFrame(
        [("abc", digest.upper()), ("abc", "00"), ("abc", ""), ("abc", None)], "c string, e string"
    )
    rows = df.select(T.checksum(F.col("c")), T.checksum_differs(T.checksum(F.col("c")), F.col("e"))).collect()
    assert [tuple(r) for r in rows] == [(digest, False), (digest, True), (digest, False), (digest, False)]


def test_long_blank_runs_stay_linear(spark):
    text = "x" + " " * 400_000 + "y\n" + "\t" * 400_000
    assert apply(spark, lambda t: T.minify(t, F.lit(".md")), text) == ["x" + " " * 400_000 + "y\n\n"]


def test_long_email_like_runs_stay_linear(spark):
    run = "ab-9_Zk.+%" * 100_000
    text = f"{run} x@y.co {run}@nowhere {run}"
    assert apply(spark, T.redact_emails, text) == [text.replace("x@y.co", "[[REDACTED_SENSITIVE]]")]


def test_email_edges(spark):
    mark = "[[REDACTED_SENSITIVE]]"
    given = ["a@b.co-x@y.com", "éabc@x.com", "éa.bc@x.com", ".a@x.com", "..@x.com", "é.@x.com", "a@b", "x a@b.c d@e.fg"]
    wanted = [mark + mark, "éabc@x.com", "éa" + mark, "." + mark, "..@x.com", "é" + mark, "a@b", "x a@b.c " + mark]
    assert apply(spark, T.redact_emails, *given) == wanted
