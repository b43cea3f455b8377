"""The filter audit against a plain walk of every document through every order."""

import re
from collections import Counter
from itertools import permutations

import pytest

from check import compare
from corpusmill.llm import filter_audit, registered
from test_llm import AWKWARD, SCHEMA, TINY, prose

LABELS = [(4, 1, 0), (5, 0, 1), (5, 1, 0), (9, 1, 1), (None, 1, 1), (77, 1, 1), (7, None, None)]


def failures(rows):
    low = {}
    for i, text, *_ in rows:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    out = []
    for i, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (i is not None and i > low[text])
        out.append((lang or "", fails, i))
    return out


def brute_force(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found, shapley = {}, Counter()
    judged = failures(rows)
    for part in {p for p, _, _ in judged}:
        own = [(f, i) for p, f, i in judged if p == part]
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [(f, i) for f, i in own if x in f and not before & set(f)]
                shapley[part, x] += len(here)
                found[part, "".join(order), step] = [
                    sum(not (before | {x}) & set(f) for f, _ in own), len(here),
                    sum(x in f and bool(before & set(f)) for f, _ in own), sum(f == x for f, _ in own),
                    sum(i in good for _, i in here), sum(i in toxic for _, i in here),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


ROWS = AWKWARD + [
    (20, "Ab CD EF " * 40, "en", "a", 1), (21, "Ab CD EF " * 40, "de", "a", 1), (22, "x # y", "en", "a", 1),
    (23, "x # y", "en", "a", 1), (23, "x # y", "en", "a", 1), (19, prose(5, 150), "", "a", 1), (24, prose(5, 150), None, "a", 1),
    (None, "x # y", "en", "a", 1), (None, "x # y", "en", "a", 1), (25, " ".join(f"w{i}" for i in range(150)), "en", "a", 1),
]


@pytest.mark.parametrize("labels", [LABELS, []])
def test_audit_of_awkward_rows(spark, labels):
    docs = spark.createDataFrame([(*r, "clash", 3) for r in ROWS], SCHEMA + ", mask string, good int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(docs, marks).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in found}
    assert len(got) == len(found) and got == brute_force(ROWS, labels)


def test_audit_of_an_empty_table(spark):
    marks = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), marks).collect() == []


def test_audit_query(spark):
    df = registered.QUERIES["op11_filter_audit"](spark, TINY)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert compare(df, TINY, registered.ORACLES["op11_filter_audit"]) == []
