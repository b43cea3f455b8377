"""Suffix dedup against a plain dictionary of all 50-byte strings."""

import hashlib
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from check import compare
from corpusmill.llm import registered, suffix_dedup
from test_llm import AWKWARD, SCHEMA, TINY, prose


def brute_force(rows):
    low = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                low[s] = min(low.get(s, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49 if i is not None else 0):
            if low[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int((gone & ~np.append(False, gone[:-1])).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **limits):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", tag string, bucket int").repartition(3)
    return sorted((tuple(r) for r in suffix_dedup.drop_repeated_bytes(docs, **limits).collect()), key=repr)


def passages(seed):
    """Documents of a small alphabet, with shared, repeated and overlapping passages."""
    r = random.Random(seed)
    shared = ["".join(r.choice("ab é\0") for _ in range(n)) for n in (48, 49, 50, 51, 75, 120, 400)]
    rows = []
    for i in range(40):
        parts = [r.choice(shared)[r.randrange(8):] if r.random() < 0.5 else "".join(r.choice("abcdefgh ") for _ in range(r.randrange(80)))
                 for _ in range(r.randrange(6))]
        rows.append((r.randrange(30), "".join(parts), "en", "a", 1))
    rows += [(100 + k, "z" * (40 + 10 * k), "en", "a", 1) for k in range(4)] + [(99, "xy" * 100, "en", "a", 1), (98, "yx" * 100, "en", "a", 1)]
    return rows


@pytest.mark.parametrize("limits", [
    {}, {"filter_keys": 0}, {"hot_gram": 1}, {"run_entries": 37, "bucket_entries": 50},
    {"filter_keys": 0, "hot_gram": 3, "run_entries": 100, "bucket_entries": 20},
])
def test_spans_are_those_of_a_dictionary(spark, limits):
    rows = passages(len(limits)) + AWKWARD + [(200, prose(9, 8000), "en", "a", 1), (201, prose(4, 300) + prose(9, 40), "en", "a", 1)]
    assert found(spark, rows, **limits) == brute_force(rows)


def test_an_empty_table(spark):
    assert suffix_dedup.drop_repeated_bytes(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n_runs", [0, 1, 2, 3, 7, 16])
def test_loser_tree_orders_and_keeps_prefixes(n_runs):
    r = random.Random(n_runs)
    runs = []
    for _ in range(n_runs):
        strings = sorted(bytes(r.choice(b"\0ab") for _ in range(r.randrange(12))) for _ in range(r.randrange(40)))
        shared = [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(strings, strings[1:])]
        runs.append((strings, shared[: len(strings)]))
    run, place, shared = suffix_dedup.merge_runs(runs)
    merged = [runs[a][0][b] for a, b in zip(run, place)]
    assert merged == sorted(s for strings, _ in runs for s in strings)
    assert sorted(zip(run, place)) == [(a, b) for a in range(n_runs) for b in range(len(runs[a][0]))]
    assert shared[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(merged, merged[1:])]


def test_equal_strings_have_equal_anchors():
    r = random.Random(5)
    data = np.frombuffer(bytes(r.choice(b"abc") for _ in range(4000)), np.uint8)
    whole, _ = suffix_dedup.anchors(data, np.array([0, 1500, 4000]))
    for p in range(0, 1450, 13):
        own, _ = suffix_dedup.anchors(data[p : p + 50], np.array([0, 50]))
        assert len(own) and set((own + p).tolist()) <= set(whole.tolist())


def test_blocks_do_not_change_anchors(monkeypatch):
    r = random.Random(6)
    data = np.frombuffer(bytes(r.choice(b"ab cd") for _ in range(3000)), np.uint8)
    offsets = np.array([0, 700, 720, 3000])
    whole = suffix_dedup.anchors(data, offsets)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 61)
    for a, b in zip(whole, suffix_dedup.anchors(data, offsets)):
        assert a.tolist() == b.tolist()


def test_suffix_query(spark):
    df = registered.QUERIES["op12_suffix_merge"](spark, TINY)
    assert compare(df, TINY, registered.ORACLES["op12_suffix_merge"]) == []


def test_suffixes_are_taken_without_an_index_for_each_byte():
    """A worker's memory: the rows of a run, not eight bytes of index for each of theirs."""
    texts = suffix_dedup.Texts(pa.array([random.Random(3).randbytes(60_000).hex()] * 2))
    at = np.concatenate([np.arange(50_000), np.arange(120_000, 170_000)])
    tracemalloc.start()
    rows = suffix_dedup._rows(texts, at, at.astype(np.uint64), np.full(len(at), suffix_dedup.BEFORE), 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * rows.nbytes
    whole = texts.data.tobytes()
    for k in (0, 1, 25, 26, 49_999, 50_000, 50_010, 99_999):
        p, start = int(at[k]), 0 if at[k] < 120_000 else 120_000
        back = whole[max(start, p - suffix_dedup.BEFORE) : p][::-1]
        assert rows[k].tobytes() == (p % 7).to_bytes(4, "big") + whole[p : p + 50] + b"2" + back.ljust(suffix_dedup.BEFORE, b"\0") + bytes([len(back) + 1])


def test_runs_and_their_batches_are_bounded(monkeypatch):
    class Docs:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 1, raising=False)
    text = random.Random(4).randbytes(4000).hex()
    rows = pa.record_batch({"id": list(range(6)), "tag": list(range(6)), "text": [text[k:] for k in range(6)]})

    def wanted(piece, texts):
        return suffix_dedup.anchors(texts.data, texts.offsets)

    batches = list(suffix_dedup._runs(Docs(), wanted, np.zeros(0, np.int64), 3, 500)([rows, rows.slice(2)]))
    assert len(batches) > 20 and all(b.num_rows == 1 for b in batches)
    assert all(len(b.column("sizes")[0].as_py()) <= 500 for b in batches)
    # Spans that a run settles are as many as its entries at most.
    assert all(len(b.column("ids")[0].as_py()) <= 500 * 8 for b in batches)
