"""Phrase counts and scores against a plain count of all word runs."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from check import compare
from corpusmill.llm import collocations, registered
from corpusmill.llm.texts import Texts
from test_llm import AWKWARD, SCHEMA, TINY, prose


def pieces_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def counts(rows):
    found = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for words in pieces_of(text):
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    found["und" if lang is None else lang][tuple(words[i : i + n])] += 1
    return found


def brute_force(rows, least, top):
    out = []
    for lang, f in counts(rows).items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in good.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i : i + size]] = max(longest[p[i : i + size]], a)
        ranked = []
        for p, a in good.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longest[p] < 80 * a:
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def texts(seed):
    r = random.Random(seed)
    stock = [" ".join(r.choice(["Up", "to", "the", "é", "ß!", "now", "a.b", "\t", "日本"]) for _ in range(r.randrange(3, 30))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(stock) if r.random() < 0.6 else prose(r.randrange(30), 9) for _ in range(r.randrange(5))]
        rows.append((i, r.choice([" ", ", ", "\n", "\x0b", " \t "]).join(parts), r.choice(["en", "de", None, "und", ""]), "a", 1))
    return rows + [(70, "again " * 300, "en", "a", 1), (71, ".", "xx", "a", 1), (72, "a b c d " * 40, "de", "a", 1)]


@pytest.mark.parametrize("limits", [
    {}, {"trigger": 1}, {"trigger": 3, "bitmap_bits": 6}, {"trigger": 1 << 40, "top": 5}, {"least": 1, "trigger": 4},
])
def test_collocations_of_awkward_rows(spark, monkeypatch, limits):
    rows = texts(len(limits)) + AWKWARD
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", part string, times int").repartition(3)
    limits = {"least": 4, **limits}
    found = sorted(tuple(r) for r in collocations.collocations(docs, **limits).collect())
    assert found == brute_force(rows, limits["least"], limits.get("top", 2000))


def test_long_chunks_are_cut(spark, monkeypatch):
    texts_ = Texts(pa.array(["w" + " x y" * 5000, "", "one"]))
    words = collocations._Words(texts_)
    begin, end, overlap = collocations._chunk_bounds(words, 1 << 40)
    assert begin.tolist() == [0, 4096, 8192, 10001] and end.tolist() == [4099, 8195, 10001, 10002]
    assert overlap.tolist() == [3, 3, 0, 0]


def test_equal_passages_share_chunks(spark):
    passage = prose(1, 400)
    rows = [(i, f"{prose(100 + i, 20)} {passage} {prose(200 + i, 20)}", "en", "a", 1) for i in range(30)]
    dictionary = collocations.parse(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.times == 30 for r in dictionary) >= 4
    chunk_words = sum((len(re.split("[ \n]", r.chunk)) - r.overlap) * r.times for r in dictionary)
    assert chunk_words == 30 * 440


def test_no_frequent_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame(AWKWARD[:6], SCHEMA)).collect() == []


def test_collocations_query(spark):
    df = registered.QUERIES["op13_collocations"](spark, TINY)
    assert compare(df, TINY, registered.ORACLES["op13_collocations"]) == []
