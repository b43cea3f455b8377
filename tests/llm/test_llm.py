"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import (
    components, fingerprints, language_id, language_model, line_dedup, mixing, near_dedup, packing, quality_rules,
    registered, secret_scan, token_counts,
)
from corpusmill.llm.texts import Lookup, Texts, mixed, shingles

TINY = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [x + y for x in ("ba", "ke", "lo", "mi") for y in ("na", "ro", "st", "du", "x")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (4, "word", "en", None, 4),
    (5, "word", "de", "b", 4), (5, "word", "de", "b", 4), (None, "word two", None, "b", 8), (None, None, None, None, None),
    (6, prose(1, 60) + "\n" + prose(2, 30), "en", "a", 1), (7, prose(1, 60) + "\n" + prose(3, 30), "en", "a", 1),
    (8, "é 日本 🙂 <|endoftext|> </s> ﬁ", "fr", "c", 1), (9, "x" * 50_000, "de", "c", 1), (-3, prose(9, 9000), "de", "", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*r, "clash", 1) for r in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA + ", bands string, uid int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tiny(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").orderBy("doc_id").collect()]


def words_of(text, fold=False):
    text = text or ""
    if fold:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


OPERATORS = {
    "language": lambda d: language_id.identify(d), "near": lambda d: near_dedup.near_duplicates(d, size=2),
    "lines": line_dedup.drop_repeated_lines, "packing": packing.pack_documents, "tokens": token_counts.token_counts,
    "model": language_model.score, "secrets": secret_scan.find_secrets, "quality": quality_rules.quality,
    "fingerprints": fingerprints.with_edits, "mixing": mixing.fair_mix,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_and_empty_tables(awkward, empty, name):
    found = OPERATORS[name](awkward).collect()
    ids = Counter(r.doc_id for r in found if name != "packing" or r.piece == 0)
    assert ids == Counter(r[0] for r in AWKWARD)
    assert OPERATORS[name](empty).collect() == []


# -- helpers ----------------------------------------------------------------

def test_words_lines_and_hashes():
    rows = ["a b", None, "", "a b", "A  B\n\nc", " x "]
    texts = Texts(pa.array(["skip", *rows]).slice(1))
    starts, ends, owners = texts.words()
    data = texts.data.tobytes()
    assert [data[a:b].decode() for a, b in zip(starts, ends)] == [w for r in rows for w in words_of(r)]
    assert owners.tolist() == [i for i, r in enumerate(rows) for _ in words_of(r)]
    starts, ends, owners = texts.lines()
    assert [(o, data[a:b].decode()) for a, b, o in zip(starts, ends, owners)] == [
        (i, line) for i, r in enumerate(rows) for line in (r or "").split("\n")
    ]
    h = texts.hashes(starts, ends)
    assert h[0] == h[3] != h[4] and texts.hashes(starts[:1], ends[:1], fold=True)[0] != h[1]


def test_lookup():
    keys = np.arange(1, 3000, dtype=np.uint64) * np.uint64(1 << 50)
    table = Lookup(keys[:2000], np.arange(2000), room=4000)
    table.add(keys[2000:], np.arange(2000, len(keys)))
    values, known = table.find(np.append(keys, np.uint64(5)))
    assert values[:-1].tolist() == list(range(len(keys))) and known[:-1].all() and not known[-1]


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in found} == {x: find(x) for x in linked} and len(found) == len(linked)


# -- 1: languages -----------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    found = registered.QUERIES["op1_hyperdimensional_language"](spark, TINY).join(docs, "doc_id").collect()
    assert len(found) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_without_letters_or_labels(spark):
    docs = spark.createDataFrame([(1, "123 -"), (2, None), (3, "abc")], "doc_id bigint, text string")
    none = language_id.predict(docs, ([], np.zeros((0, language_id.DIMENSIONS)))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    model = language_id.learn(docs.withColumn("lang", F.when(F.col("doc_id") == 3, "en")))
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()} == {1: "und", 2: "und", 3: "en"}


def test_runs_are_bound_by_place():
    p = language_id.Profiler(256)
    a, b = (int(x) << 42 | int(y) << 21 | int(z) for x, y, z in ((97, 98, 99), (99, 98, 97)))
    vectors = p.bound(np.array([a, b], np.uint64))
    by_hand = np.roll(p.letter(np.array([97])), 2, 1) * np.roll(p.letter(np.array([98])), 1, 1) * p.letter(np.array([99]))
    assert (vectors[0] == by_hand[0]).all() and abs(vectors[0] @ vectors[1]) < 80


# -- 2: near duplicates -----------------------------------------------------

def exact_components(docs, size, percent=80):
    sets = {}
    for i, text in docs:
        w = words_of(text, fold=True)
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for n, i in enumerate(order):
        for j in order[:n]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_query(spark, tiny):
    found = registered.QUERIES["op2_minhash_dedup"](spark, TINY).collect()
    wanted = exact_components(tiny, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_in_crowded_buckets(spark):
    """Many texts about as like as the threshold, so that stars alone would lose links."""
    base, docs, r = prose(5, 60).split(), [], random.Random(1)
    for i in range(70):
        w = list(base)
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        docs.append((i, " ".join(w)))
    docs += [(100 + i, prose(7, 40)) for i in range(30)]
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), size=2).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == exact_components(docs, 2)


def test_signature_agrees_as_often_as_sets_are_alike():
    r = np.random.default_rng(0)
    pool = np.sort(r.integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2))
    a, b = pool[:50], pool[10:]
    agree = (near_dedup.signature(a, 2000) == near_dedup.signature(b, 2000)).mean()
    assert abs(agree - 40 / 60) < 0.12


# -- 3: lines ---------------------------------------------------------------

def test_alignment_is_a_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(12) for _ in range(r.randrange(15))] for _ in range(2))
        places = line_dedup.align(a, b)
        assert places == sorted(set(places))
        it = iter(a)
        assert all(any(x == b[p] for x in it) for p in places)
    assert line_dedup.align([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [1, 2, 4]


def test_lines_go_from_the_later_document(spark):
    passage = [prose(20 + k, 12) for k in range(4)]
    docs = [
        (1, "\n".join([prose(1, 9), *passage, prose(2, 9)])), (2, "\n".join([prose(3, 9), *passage])),
        (3, "\n".join(passage)), (4, "yes\n" + prose(4, 9)), (5, "yes\n" + prose(5, 9)),
    ]
    found = {r.doc_id: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found[1].text == docs[0][1] and found[2].text == prose(3, 9) and found[2].n_lines_dropped == 4
    assert found[3].text == "" and found[3].emptied
    assert found[4].text == docs[3][1] and found[5].text == docs[4][1]  # too short a block


@pytest.mark.parametrize("rare", [1, 2, 1000])
def test_frequent_lines_are_found_without_pairs(spark, rare):
    line = prose(8, 12)
    docs = [(i, f"{prose(40 + i, 10)}\n{line}\n{prose(80 + i, 10)}") for i in range(6)]
    found = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), rare=rare).collect()
    assert {r.doc_id: r.n_lines_dropped for r in found} == {i: int(i > 0) for i in range(6)}


def test_alignment_of_repeated_lines():
    assert line_dedup.align([1, 2, 3, 9, 1, 2, 3], [7, 1, 2, 3, 8]) == [1, 2, 3]
    assert line_dedup.align([7, 1, 2, 3, 8], [1, 2, 3, 9, 1, 2, 3]) in ([0, 1, 2], [4, 5, 6])


@pytest.mark.parametrize("row_bits", [1, 1 << 28])
def test_gaps_without_unique_lines(monkeypatch, row_bits):
    monkeypatch.setattr(line_dedup, "ROW_BITS", row_bits)
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randrange(14))] for _ in range(2))
        longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
        places = sorted(line_dedup._subsequence(a, b))
        it = iter(a)
        assert len(set(places)) == longest[-1][-1] and all(any(x == b[p] for x in it) for p in places)


@pytest.mark.parametrize("rare", [1, 2, 1000])
def test_repeated_and_crossed_passages(spark, rare):
    p, q = ([prose(60 + 10 * s + k, 2 + k) for k in range(4)] for s in range(2))
    own = [prose(100 + k, 9) for k in range(9)]
    docs = [
        (1, [*p, own[0], *p]), (2, [own[1], *p, own[2]]), (3, [own[3], *p, own[4], *q, own[5]]),
        (4, [*q, own[6], *p]), (5, [own[7], *q, *p, own[8], *q, *p]),
    ]
    found = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(
        spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id bigint, text string"), rare=rare).collect()}
    assert found[1] == "\n".join(docs[0][1]) and found[2] == "\n".join([own[1], own[2]])
    assert found[3] == "\n".join([own[3], own[4], *q, own[5]])
    assert found[4] == own[6] and found[5] == "\n".join([own[7], own[8]])


@pytest.mark.parametrize("rare", [1, 3, 1000])
def test_every_block_of_an_earlier_document_goes(spark, rare):
    r = random.Random(4)
    pool = [" ".join(f"{chr(97 + k)}{j}" for j in range(1 + k % 6)) for k in range(14)]
    docs = [[r.choice(pool) for _ in range(r.randrange(1, 13))] + [f"only {i}"] for i in range(60)]
    for i, b in enumerate(docs):
        b.insert(r.randrange(len(b)), f"line of {i} alone")
    found = line_dedup.deletions(
        spark.createDataFrame([(i, "\n".join(b)) for i, b in enumerate(docs)], "doc_id bigint, text string"), rare=rare).collect()
    dropped = {row.doc.id: {k for k, gone in enumerate(row.drop) if gone} for row in found}
    for i, b in enumerate(docs):
        gone = dropped.get(i, set())
        assert all(any(b[k] in a for a in docs[:i]) for k in gone)
        for lo in range(len(b)):
            for hi in range(lo + 1, len(b) + 1):
                held = any(a[k : k + hi - lo] == b[lo:hi] for a in docs[:i] for k in range(len(a)))
                if held and sum(len(x.split()) for x in b[lo:hi]) >= 5:
                    assert set(range(lo, hi)) <= gone


# -- 4: packing -------------------------------------------------------------

def test_packing_query(spark, tiny):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = registered.QUERIES["op4_best_fit_packing"](spark, TINY).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, text in tiny:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024)))
        at = 0
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.start == at and r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids) and all(r.length == 1024 for r in own[1:])
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= math.ceil(total / 1024) * 1.01 + 2


def test_packing_groups_exchange(spark):
    r = np.random.default_rng(4)
    rows = [(i, int(x)) for i, x in enumerate(r.integers(1, 1025, 3000))]
    sized = spark.createDataFrame(rows, "uid bigint, length bigint")
    found = packing.pack_pieces(sized, group_items=400).collect()
    assert sorted(x.uid for x in found) == list(range(3000))
    fill = Counter()
    for x in found:
        fill[x.sequence_id] += x.length
    assert max(fill.values()) <= 1024
    bound = packing.lower_bound(np.array([x for _, x in rows]))
    assert bound <= len(fill) <= 1.03 * bound


def test_lower_bound_is_one():
    r = random.Random(6)
    for _ in range(150):
        sizes = np.array([r.randrange(1, 21) for _ in range(r.randrange(1, 30))])
        bins, n = packing.best_fit_decreasing(sizes, 20)
        assert np.bincount(bins, weights=sizes).max() <= 20
        assert -(-int(sizes.sum()) // 20) <= packing.lower_bound(sizes, 20) <= n
    assert packing.lower_bound(np.array([11] * 7), 20) == 7


# -- 5: token counts --------------------------------------------------------

def test_token_counts_query(spark, tiny):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in registered.QUERIES["op5_token_counts"](spark, TINY).collect()}
    for i, text in tiny:
        n = len(model.encode(text))
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len(text.encode()), n > 4096)


@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_transducer_on_random_text(chunk):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.transducer(path)
    r = random.Random(chunk)
    bits = ["a", "b", " ", "th", "er", "e", "\n", "é", "日", "▁", "1", "0", "--", "=", "ing", "<s>", "<0x0A>", "\x00"]
    rows = ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(300)]
    rows += [model.id_to_piece(r.randrange(300, 32000)).replace("▁", " ") * r.randrange(4) for _ in range(100)]
    assert counter.count(Texts(pa.array(rows)), chunk).tolist() == [len(x) for x in model.encode(rows)]


@pytest.mark.parametrize("unit", ["日本語テキスト", "Zm9vYmFy+/", "=", "ab", "word\n", "\U0001F642", "▁ "])
def test_state_maps_need_few_rounds_without_word_breaks(unit, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.transducer(path)
    r = random.Random(5)
    mixed = "".join(unit[: r.randrange(1, len(unit) + 1)] for _ in range(20_000))
    rows = [unit * 3_000, "", mixed, mixed[7:9_000], None]
    spans = []
    run = counter.run
    monkeypatch.setattr(counter, "run", lambda data, starts, *rest: spans.append(len(starts)) or run(data, starts, *rest))
    assert counter.count(Texts(pa.array(rows)), 256).tolist() == [len(model.encode(x or "")) for x in rows]
    # One round of guesses, one of maps, and a few for states that no guess met.
    assert len(spans) <= 24 and sum(spans[1:]) <= 24 * spans[0]


def test_state_maps_compose_like_a_walk():
    r = random.Random(8)
    for _ in range(50):
        lengths = [r.randrange(1, 40) for _ in range(5)]
        first = np.concatenate([[True] + [False] * (n - 1) for n in lengths])
        last = np.append(first[1:], True)
        step = [{s: (r.randrange(4), r.randrange(-3, 9)) for s in range(4)} for _ in first]
        maps = token_counts._StateMaps(len(first))
        for i in r.sample(range(len(first)), len(first)):
            ends = [step[i][s] for s in range(4)]
            maps.add(np.full(4, i), np.arange(4), np.array([e for e, _ in ends]), np.array([t for _, t in ends]))
        enters = np.array([r.randrange(4) for _ in first])
        want = []
        for i in np.flatnonzero(first):
            state, total = int(enters[i]), 0
            while True:
                state, more = step[i][state]
                total += more
                if last[i]:
                    break
                i += 1
            want.append(total)
        assert maps.compose(first, last, enters).tolist() == want


def test_transducer_with_few_states():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.Transducer(path, max_states=200)
    rows = [prose(i, 80) for i in range(10)]
    assert counter.count(Texts(pa.array(rows)), 64).tolist() == [len(x) for x in model.encode(rows)]


# -- 6: language model ------------------------------------------------------

def direct_tree(texts, depth):
    """Log10 probability of every run, straight from the definition."""
    counts, runs = Counter(), Counter()
    for text in texts:
        raw = b"\xff" * depth + text.lower().encode() + b"\xff"
        for p in range(depth, len(raw)):
            runs[raw[p - depth : p + 1]] += 1
    for run, n in runs.items():
        for d in range(depth + 1):
            node = 1
            for k in range(7, -1, -1):
                bit = run[-1] >> k & 1
                counts[run[depth - d : depth], node, bit] += n
                node = node * 2 + bit
    nodes = {(c, n) for c, n, _ in counts}

    def kt(c, n):
        a, b = counts[c, n, 0], counts[c, n, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}
    for c, n in sorted(nodes, key=lambda x: -len(x[0])):
        own = kt(c, n)
        if len(c) == depth:
            weighted[c, n] = own
        else:
            below = sum(v for (x, m), v in weighted.items() if m == n and len(x) == len(c) + 1 and x[1:] == c)
            weighted[c, n] = np.logaddexp(own, below) + math.log(0.5)

    def value(run):
        total, node = 0.0, 1
        for k in range(7, -1, -1):
            p = None
            for d in range(depth, -1, -1):
                c = run[depth - d : depth]
                if (c, node) not in nodes:
                    continue
                a, b = counts[c, node, 0], counts[c, node, 1]
                own = (b + 0.5) / (a + b + 1)
                w = 1.0 if d == depth else math.exp(math.log(0.5) + kt(c, node) - weighted[c, node])
                p = own if p is None else w * own + (1 - w) * p
            bit = run[-1] >> k & 1
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
            node = node * 2 + bit
        return total

    return value


def test_tree_matches_its_definition(spark):
    train = ["abracadabra", "Abrac dab", "cad"]
    other = "abba zz"
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    held = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([*zip(ids, train), (held, other)], "doc_id bigint, text string")
    for frequent in (0, 5, 1000):
        found = {r.doc_id: r for r in language_model.score(docs, depth=3, frequent=frequent).collect()}
        value = direct_tree(train, 3)
        for i, text in [*zip(ids, train), (held, other)]:
            raw = b"\xff" * 3 + text.lower().encode() + b"\xff"
            wanted = sum(value(raw[p - 3 : p + 1]) for p in range(3, len(raw)))
            assert found[i].score == pytest.approx(wanted, rel=1e-9)
        assert found[held].held_out and not found[ids[0]].held_out


def test_unigram_base(spark, tiny):
    found = {r.doc_id: r for r in registered.QUERIES["op6_context_tree"](spark, TINY).collect()}
    tokens = {i: [*words_of(t, fold=True), None] for i, t in tiny}
    counts = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = found[i]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(own), n, sum(w in counts for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r.score < 0
    assert sum(r.bits_per_byte for r in found.values() if r.held_out) / sum(r.held_out for r in found.values()) < 3


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 8, 100.5, 1e9])
    assert language_model.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-9)


# -- 7: secrets -------------------------------------------------------------

def test_base_spans():
    text = 'PassWord = "abc123" token: x1 api-key=zzzzzz api_key=zzzzzz AKIA' + "A1" * 8 + " AKIAB " + "0a" * 12 + "g passwd=" + "ab" * 13
    found = secret_scan.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in found] == [
        ("assign", 'PassWord = "abc123'), ("assign", "api_key=zzzzzz"), ("access", "AKIA" + "A1" * 8),
        ("hex", "0a" * 12), ("assign", "passwd=" + "ab" * 13), ("hex", "ab" * 13),
    ]


def test_secrets_query(spark, tiny):
    found = {r.doc_id: r for r in registered.QUERIES["op7_secret_crf"](spark, TINY).collect()}
    for i, text in tiny:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in secret_scan.base_spans(text))
        assert found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(found[i].spans.split(","))


def make_field():
    r, texts = random.Random(5), []
    for i in range(120):
        secret = "".join(r.choice("0123456789abcdef") for _ in range(r.randrange(18, 40)))
        texts.append(f"{prose(i, 20)} {r.choice(['password=', 'token = '])}{secret} {prose(i + 500, 20)}")
    windows = list(secret_scan._windows(Texts(pa.array(texts)), texts, secret_scan._Keywords()))
    n, t = len(windows), 2 * secret_scan.WINDOW
    codes, tags, length = np.zeros((n, t, 8), np.uint8), np.zeros((n, t), np.int64), np.zeros(n, np.int64)
    for i, (c, y) in enumerate(windows):
        length[i] = len(y)
        codes[i, : len(y)], tags[i, : len(y)] = c, y
    return secret_scan.train(codes, tags, length)


def test_field_finds_what_patterns_miss_and_viterbi_is_exact(spark):
    field = make_field()
    secret = "9f8a7c6d5e4f3a2b1c0d"
    texts = [f"é {prose(1, 30)} the secret {secret} {prose(2, 30)}", prose(3, 200), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in secret_scan.scan(docs, field).collect()}
    at = texts[0].index(secret)
    assert found[0].spans == f"crf:{at}:{at + len(secret)}" and found[0].n_assign == 0
    assert found[1].spans == found[2].spans == found[3].spans == ""
    random_field = secret_scan.Field(np.random.default_rng(1).normal(0, 2, field.emit.shape), field.move)
    batch = Texts(pa.array([t or "" for t in texts]))
    _, _, owner, codes = secret_scan.features(batch, secret_scan._Keywords())
    tags, score = random_field.decode(codes, owner), random_field.scores(codes)
    for i in range(2):
        own = np.flatnonzero(owner == i)
        best, back = field.move[0] + score[own[0]], []
        for k in own[1:]:
            ways = best[:, None] + field.move
            back.append(ways.argmax(0))
            best = ways.max(0) + score[k]
        path = [int((best + field.move[:, 0]).argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        assert tags[own].tolist() == path[::-1]


def test_field_learns_from_rare_and_repeated_secrets(spark):
    key = "password=9f8a7c6d5e4f3a2b1c0d9f8a"
    rows = [(i, prose(i, 12)) for i in range(300)] + [(300, f"{prose(900, 20)} {key} {prose(901, 20)}")]
    rows += [(301 + i, rows[0][1]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    field = secret_scan.learn(docs, most_rows=10, most_secrets=5)
    again = secret_scan.learn(docs.unionByName(docs.where("doc_id = 300")), most_rows=10, most_secrets=5)
    assert field is not None and np.array_equal(field.emit, again.emit)
    assert secret_scan.learn(docs.where("doc_id != 300"), most_rows=10) is None


# -- 8: quality -------------------------------------------------------------

def test_quality_counts(spark, tiny):
    found = {r.doc_id: r for r in registered.QUERIES["op8_quality_rules"](spark, TINY).collect()}
    for i, text in tiny:
        w = words_of(text)
        lines = [x for x in text.split("\n") if words_of(x)]
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = found[i]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed
        )
        assert not (r.base_failed and r.kept)


def test_compression_bands(spark):
    r = random.Random(1)
    noise = " ".join("".join(chr(r.randrange(0x3400, 0x9FFF)) for _ in range(6)) for _ in range(900))
    long = " ".join(f"{r.choice(WORDS)}{r.choice(WORDS)}{r.choice(WORDS)}" for _ in range(3000))
    docs = [(1, prose(1, 100)), (2, long), (3, noise)]
    found = {x.doc_id: x for x in quality_rules.quality(
        spark.createDataFrame(docs, "doc_id bigint, text string"), bands=((0, 1.3, 6.0), (4_000, 1.9, 6.0))
    ).collect()}
    assert found[1].kept and found[2].kept and not found[3].kept and not found[3].base_failed


def plain_text():
    """The longest document in ASCII that repeats little."""
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    return max((t for t in texts if t and t.isascii() and len(t) < 4 * len(zlib.compress(t.encode()))), key=len)


@pytest.mark.parametrize("n_bytes", [200, 300, 399, 400, 500, 700, 999, 1_000, 1_154, 2_519, 3_989, 5_000, 20_000])
def test_production_bands(n_bytes):
    r = random.Random(n_bytes)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noise = [" ".join("".join(r.choice(base64) for _ in range(w)) for _ in range(n_bytes // w + 1))[:n_bytes] for w in (7, 12)]
    press = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    verdict = lambda text: all(quality_rules.within(n, x) for n, x in quality_rules.ratios(text.encode(), press))
    assert not any(map(verdict, noise))
    assert not verdict(("the same words again. " * n_bytes)[:n_bytes])
    assert verdict(plain_text()[:n_bytes])


def test_the_rest_after_the_last_chunk_is_judged():
    press = quality_rules.zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    text = plain_text()
    odd = (text[:4100] + " " + "This one sentence is here again and again. " * 49).encode()
    assert [n for n, _ in quality_rules.ratios(odd, press)] == [len(odd), 4096, len(odd) - 4096]
    assert quality_rules.within(*quality_rules.ratios(odd, press)[0])
    assert not all(quality_rules.within(*p) for p in quality_rules.ratios(odd, press))
    assert [n for n, _ in quality_rules.ratios(text[:4500].encode(), press)] == [4500, 4096, 4096]
    assert [len(quality_rules.ratios(b"x" * n, press)) for n in (4095, 4096, 4097, 8192)] == [1, 2, 3, 3]


# -- 9: fingerprints --------------------------------------------------------

def test_simhash_query(spark, tiny):
    found = {r.doc_id: r for r in registered.QUERIES["op9_simhash"](spark, TINY).collect()}
    assert len(found) == len(tiny)
    bits = lambda x: np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8))
    for k, (i, text) in enumerate(tiny):
        following = tiny[(k + 1) % len(tiny)]
        r = found[i]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[1][:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx((bits(r.fingerprint) == bits(r.edited_fingerprint)).mean())
        assert r.near_next == pytest.approx((bits(r.fingerprint) == bits(found[following[0]].fingerprint)).mean())
        if i % 100 == 0:
            near = sum((bits(r.fingerprint) != bits(o.fingerprint)).sum() <= 5 for o in found.values()) - 1
            assert r.n_within == near
        else:
            assert r.n_within is None
    assert np.mean([r.near_edited for r in found.values()]) > np.mean([r.near_next for r in found.values()]) + 0.08


def test_votes_are_those_of_plain_sums(tiny):
    r = random.Random(12)
    rows = ["", "  \n", "one", "One one ONE one", "é é 日本 🙂", None, *[t for _, t in tiny[:40]]]
    rows += [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 400))) for _ in range(30)]

    def term(*words):
        """The 64-bit hash of a word or of two neighbouring words."""
        texts = Texts(pa.array([" ".join(words)]))
        starts, ends, owners = texts.words()
        h = texts.hashes(starts, ends, fold=True)
        return int(h[0] if len(words) == 1 else shingles(h, owners, 2)[0][0])

    def bits(h):
        halves = [int(mixed(np.array([x % 2**64], np.uint64))[0]) for x in (h, h + 0x5851F42D4C957F2D)]
        raw = b"".join(x.to_bytes(8, "little") for x in halves)
        return [byte >> (7 - k) & 1 for byte in raw for k in range(8)]

    want = []
    for text in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        terms = Counter(zip(words, words[1:])) if len(words) != 1 else Counter([(words[0],)])
        sums = [0.0] * 128
        for t, count in terms.items():
            for k, bit in enumerate(bits(term(*t))):
                sums[k] += (2 * bit - 1) * (1 + math.log2(count))
        want.append(sums)
    found = np.unpackbits(fingerprints.votes(Texts(pa.array(rows, pa.string()))), axis=1)
    for sums, row in zip(want, found.tolist()):
        # Votes that cancel out but for rounding may fall either way.
        assert all(bit == (total > 0) for bit, total in zip(row, sums) if abs(total) > 1e-3)
        assert any(sums) or not any(row)


def test_tables_find_all_within_the_radius(spark):
    r = random.Random(8)
    base = [r.getrandbits(128) for _ in range(6)]
    prints = [x ^ sum(1 << b for b in r.sample(range(128), r.randrange(9))) for x in base for _ in range(12)]
    prints += prints[:5]
    rows = [(i, f"{x:032x}") for i, x in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id bigint, fingerprint string")
    found = {x.fingerprint: x.n_within for x in fingerprints.near_fingerprints(df, F.col("doc_id") % 3 == 0).collect()}
    wanted = {f"{prints[i]:032x}": sum((prints[i] ^ x).bit_count() <= 5 for x in prints) - 1 for i in range(0, len(prints), 3)}
    assert found == wanted


# -- 10: mixing -------------------------------------------------------------

def direct_mix(docs, weights=(3, 1, 2)):
    sizes = {i: (s, len(words_of(t))) for i, s, t in docs}
    sources = sorted({s for s, _ in sizes.values()}, key=lambda s: (s is None, s))
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(n for x, n in sizes.values() if x == s) for s in sources}
    budget, level, open_ = 1.5 * sum(total.values()), 0.0, set(sources)
    while open_:
        left = budget - sum(2 * total[s] for s in sources if s not in open_)
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s] + 1e-9}
        if not full:
            break
        open_ -= full
    target = {s: weight[s] * level if s in open_ else 2.0 * total[s] for s in sources}
    queue = []
    for s in sources:
        sent = 0
        own = sorted((hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest(), str(i), i) for i, (x, _) in sizes.items() if x == s)
        for _ in range(2):
            for _, _, i in own:
                sent += sizes[i][1]
                if sizes[i][1]:
                    queue.append((sent / weight[s], sources.index(s), i))
    taken, used = Counter(), 0
    for _, _, i in sorted(queue):
        used += sizes[i][1]
        if used > budget:
            break
        taken[i] += sizes[i][1]
    return {i: (n, total[s], target[s], taken[i]) for i, (s, n) in sizes.items()}


def test_mix_query(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    found = registered.QUERIES["op10_fair_mix"](spark, TINY).collect()
    wanted = direct_mix(docs)
    assert {r.doc_id: (r.size, r.source_size, r.taken) for r in found} == {i: (w[0], w[1], w[3]) for i, w in wanted.items()}
    assert all(r.target == pytest.approx(wanted[r.doc_id][2]) and r.taken <= 2 * r.size for r in found)


def test_mix_query_has_sql(spark):
    from check import compare

    assert compare(registered.QUERIES["op10_fair_mix"](spark, TINY), TINY, registered.ORACLES["op10_fair_mix"]) == []


def test_mix_cut_is_narrowed(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_FEW", 3)
    monkeypatch.setattr(mixing, "_CELLS", 4)
    docs = [(i, [None, "b", "a", "a"][i % 4], prose(i, i % 23)) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    found = {r.doc_id: r.taken for r in mixing.fair_mix(df).collect()}
    assert found == {i: w[3] for i, w in direct_mix(docs).items()}
    whole = mixing.fair_mix(df, keep_text=True).collect()
    assert {r.doc_id: r.taken for r in whole} == found and {r.doc_id: r.text for r in whole} == {i: t for i, _, t in docs}


# -- the pipeline -----------------------------------------------------------

def test_pipeline_keeps_what_line_dedup_leaves(spark):
    passage, own = prose(7, 60), prose(8, 14)
    rows = [(1, passage), (2, f"{passage}\n{own}"), (3, passage), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, TINY).collect()}
    assert left == {1: passage, 2: own, 4: None}


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows, copies = {r.doc_id: r for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, TINY).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        copies[name] = docs.collect()
    assert {r.doc_id for r in copies["language_id"]} == set(rows)
    for r in copies["line_dedup"]:
        assert set((r.text or "").split("\n")) <= set(rows[r.doc_id].text.split("\n"))
    kept = exact_components([(r.doc_id, r.text) for r in copies["line_dedup"]], 5)
    assert {r.doc_id for r in copies["near_dedup"]} == {i for i, (_, c) in kept.items() if i == c}
    wanted = direct_mix([(r.doc_id, r.source, r.text) for r in copies["near_dedup"]])
    assert Counter(r.doc_id for r in copies["mixing"]) == Counter({i: w[3] // w[0] for i, w in wanted.items() if w[3]})
    packed = registered.QUERIES["pipeline"](spark, TINY).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in copies["mixing"])


def test_one_encoder_a_worker_with_bounded_tables(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.encoder(path) is packing.encoder(path)
    monkeypatch.setattr(packing, "CACHED_WORDS", 500)
    monkeypatch.setattr(packing, "CACHED_IDS", 900)
    own = packing.Encoder(path)
    library = Tokenizer.from_file(path)
    for k in range(30):
        rows = [prose(k * 10 + i, 60) + f" w{k}x{i} é{k}" for i in range(40)] + [" ".join(f"u{j}" for j in range(k * 50))]
        ids, counts = own.encode(pa.array(rows))
        wanted = [library.encode(t, add_special_tokens=False).ids for t in rows]
        assert ids.tolist() == [x for w in wanted for x in w] and counts.tolist() == [len(w) for w in wanted]
        # Room is kept for the largest single piece, and does not add up.
        assert len(own.size) <= 2500 and len(own.ids) <= 12_000


def test_language_shares_never_come_to_nothing():
    found = language_id.shares({"a": 10**11, "b": 10_000, "c": 20, "d": 10**14}, 10_000)
    assert set(found) == {"a", "d"} and found["a"] == language_id.SHARES // 10**7 and found["d"] >= 1


def test_a_rare_language_is_learned(spark):
    r = random.Random(8)
    common = [(i, " ".join(r.choice(WORDS) for _ in range(12)), "xx", "a", 1) for i in range(2000)]
    rare = [(5000 + i, " ".join(r.choice(["qvy", "zwoq", "yjav", "qqzu"]) for _ in range(12)), "yy", "a", 1) for i in range(20)]
    names, vectors = language_id.learn(spark.createDataFrame(common + rare, SCHEMA), most_rows=50)
    assert names == ["xx", "yy"] and vectors.shape == (2, language_id.DIMENSIONS)
    found = language_id.predict(spark.createDataFrame(rare, SCHEMA), (names, vectors)).collect()
    assert all(f.lang_pred == "yy" for f in found)


def test_bundles_and_cosine_are_those_of_plain_sums():
    texts, profiler = ["Abc abd, é", "", "x1yz"], language_id.Profiler()
    found, lettered = profiler.bundles(Texts(pa.array(texts)))
    for i, text in enumerate(texts):
        plain = np.zeros(language_id.DIMENSIONS)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            for a in range(len(padded := f" {word} ") - 2):
                vector = np.ones(language_id.DIMENSIONS, np.int64)
                for k, c in enumerate(padded[a : a + 3]):
                    letter = profiler.letter(np.array([0 if c == " " else ord(c)], np.uint64))[0]
                    vector *= np.roll(letter, 2 - k)
                plain += vector
        assert found[i].tolist() == plain.tolist() and lettered[i] == bool(re.search("[a-zé]", text.lower()))


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    for name, rows in (("awkward", AWKWARD), ("empty", [])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.select("sequence_id", "offset").distinct().count() == out.count()
        assert (out.count() > 0) == bool(rows)


@pytest.mark.parametrize("hot", [1, 3, 2_000])
def test_hot_centre_is_split(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dedup, "HOT_EDGES", hot)
    base = prose(77, 120).split()
    rows = [(i, " ".join(base + [f"tail{i}"] * (i > 0)), "en", "a", 1) for i in range(40)]
    rows += [(100 + i, prose(300 + i, 60), "en", "a", 1) for i in range(60)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), size=2).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: 0 if i < 40 else i for i, *_ in rows}
