"""Removal of the 50-byte strings that an earlier document holds, by merging sorted suffixes.

Every string of ``SPAN`` bytes has an anchor: where the least hash of its
``GRAM``-byte parts stands.  Equal strings have equal anchors, so the suffixes
at anchors (one in about fourteen bytes) stand for all strings.  Suffixes whose
first ``GRAM`` bytes only one text holds are left out; the others, ``SPAN``
bytes long and with the bytes before them, are sorted in runs.  Runs are
exchanged front-coded, dealt to buckets by the hash of the first ``GRAM``
bytes, and a bucket's runs are merged by a loser tree that knows the common
prefixes and never compares them again.

In the merged order the strings around an anchor are groups of neighbours: of
the string that starts ``j`` bytes before it, those that agree in ``SPAN - j``
bytes from the anchor on, and in the ``j`` bytes before.  The least document id
of a group tells which of its members lose their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import small_side, spread_lookup, stored
from .texts import Texts, mixed, pieces, release, released

SPAN = 50
GRAM = 24
#: Most bytes of a string before its anchor.
BEFORE = SPAN - GRAM
#: Suffixes in a run, and about as many in a bucket.
RUN_ENTRIES = 200_000
BUCKET_ENTRIES = 200_000
#: Documents that share a gram beyond which each of its strings is dealt by itself.
HOT_GRAM = 1_000_000
#: Repeated grams beyond which they are joined, not looked up in a bitmap of 32 MiB.
FILTER_KEYS = 1 << 24
BLOCK = 1 << 20

_U = np.uint64
_BYTES = mixed((np.arange(256, dtype=np.uint64) + _U(77)) * _U(0x9E3779B97F4A7C15))
#: A run's row as one string: bucket, suffix, its length, bytes before (nearest first), one more than their number.
_WIDTH = 4 + SPAN + 1 + BEFORE + 1
#: Numbers travel as bytes too: lists would pass the JVM element by element.
_RUNS = (
    "bucket bigint, shared binary, sizes binary, tails binary, before_sizes binary, befores binary, "
    "ids binary, tags binary, counts binary, places binary"
)
#: Bytes of a run's rows that leave the worker at once, one row at least.
BATCH_BYTES = 2 << 20
_SPANS = "id bigint, tag bigint, start bigint, stop bigint"


# -- anchors --------------------------------------------------------------------

def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` (24) bytes from each place on; never 0."""
    n = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        h, width = _BYTES[data], 1
        eight = h
        while width < 16:
            h = h[:-width] * _U(0xD1342543DE82EF95 + 2 * width) + h[width:]
            width *= 2
            if width == 8:
                eight = h
        return mixed(h[:n] * _U(0x2545F4914F6CDD1D) + eight[16 : 16 + n]) | _U(1)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours."""
    done = 1
    out = values
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in texts end to end, and the hashes of their grams.

    Where parts of a string tie for the least hash, all of them are anchors.
    """
    n, found, hashes = len(data), [], []
    room = np.diff(offsets)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        a, b = max(0, lo - BEFORE), min(n, hi + SPAN)
        if b - a < SPAN:
            continue
        h = _gram_hashes(data[a:b])
        least = _sliding(h, BEFORE + 1, np.minimum)  # of the string that starts there
        at = np.arange(a, a + len(least))
        owner = np.searchsorted(offsets, at, side="right") - 1
        least[at + SPAN > offsets[owner] + room[owner]] = 0  # reaches into the next text
        pad = np.zeros(BEFORE, np.uint64)
        best = _sliding(np.concatenate([pad, least, pad]), BEFORE + 1, np.maximum)[: len(h)]
        own = np.flatnonzero(h == best)
        own = own[(own + a >= lo) & (own + a < hi)]
        found.append(own + a)
        hashes.append(h[own])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found), np.concatenate(hashes)


def _keys(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(16)).astype(np.int64)


def _anchored(docs: DataFrame, work, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = Texts(piece.column(2))
                yield from work(piece, texts, *anchors(texts.data, texts.offsets))

    return docs.select("id", "tag", "text").mapInArrow(released(run), schema)


def _gram_counts(docs: DataFrame) -> DataFrame:
    """``(gram, texts)``: how many documents hold an anchor with these first bytes."""

    def work(piece, texts: Texts, at: np.ndarray, h: np.ndarray):
        key, owner = _keys(h), texts.owner(at)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        grams, texts_ = np.unique(key[fresh], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(texts_)], names=["gram", "texts"])

    return _anchored(docs, work, "gram bigint, texts bigint").groupBy("gram").agg(F.sum("texts").alias("texts"))


class _Bitmap:
    def __init__(self, grams: DataFrame, count: int) -> None:
        size = max(10, int(16 * count).bit_length())
        self.mask = (1 << size) - 1
        cell = F.expr(f"cast(shiftright(gram & {self.mask}L, 6) as int)").alias("cell")
        bit = F.expr("shiftleft(1L, cast(gram & 63 as int))").alias("bit")
        rows = grams.select(cell, bit).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.bits = np.zeros(1 << (size - 6), np.uint64)
        self.bits[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return ((self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1)).astype(bool)


# -- runs -----------------------------------------------------------------------

def _contexts(texts: Texts, at: np.ndarray, hashes: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of suffixes, hashes to deal them by, and most bytes to look at before them.

    Around an anchor whose gram is hot, every string is a suffix of its own.
    """
    crowded = np.isin(_keys(hashes), hot)
    plain, most = at[~crowded], np.full(int((~crowded).sum()), BEFORE)
    if not crowded.any():
        return plain, hashes, most
    start = (at[crowded][:, None] - np.arange(BEFORE + 1)).ravel()
    start = np.unique(start[start >= 0])
    owner = texts.owner(start)
    start = start[start + SPAN <= texts.offsets[owner + 1]]
    # The hash of a string's first and last bytes: equal strings have equal ones.
    ends = [np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)]
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            ends[0] = mixed(ends[0] * _U(3) + _BYTES[texts.data[start + k]])
            ends[1] = mixed(ends[1] * _U(3) + _BYTES[texts.data[start + BEFORE + k]])
        own = mixed(ends[0] * _U(5) + ends[1])
    return (
        np.concatenate([plain, start]), np.concatenate([hashes[~crowded], own]),
        np.concatenate([most, np.zeros(len(start), most.dtype)]),
    )


def _rows(texts: Texts, at: np.ndarray, hashes: np.ndarray, most: np.ndarray, buckets: int) -> np.ndarray:
    """Suffixes with what stands before them, as fixed-width strings that sort rightly."""
    owner = texts.owner(at)
    size = np.minimum(texts.offsets[owner + 1] - at, SPAN)
    before = np.minimum(np.minimum(at - texts.offsets[owner], BEFORE), most)
    out = np.zeros((len(at), _WIDTH), np.uint8)
    out[:, :4] = (hashes % _U(buckets)).astype(">u4").view(np.uint8).reshape(-1, 4)
    if not len(at):
        return out
    # Windows on the bytes around the anchors: no index for each byte.
    low, high = int(at.min()) - BEFORE, int(at.max()) + SPAN
    near = np.zeros(high - low, np.uint8)
    own = texts.data[max(low, 0) : high]
    near[max(-low, 0) : max(-low, 0) + len(own)] = own
    windows = np.lib.stride_tricks.sliding_window_view
    out[:, 4 : 4 + SPAN] = windows(near, SPAN)[at - low]
    out[:, 4 : 4 + SPAN] *= np.arange(SPAN) < size[:, None]
    out[:, 4 + SPAN] = size
    out[:, 5 + SPAN : -1] = windows(near, BEFORE)[at - low - BEFORE, ::-1]
    out[:, 5 + SPAN : -1] *= np.arange(BEFORE) < before[:, None]
    out[:, -1] = before + 1
    return out


def _shared(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one above (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(prefix, np.minimum(sizes[1:], sizes[:-1]))
    return out


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    edge = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=edge[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(flat))])


def _longs(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return _binary(flat.astype("<i8"), np.asarray(sizes) * 8)


def _numbers(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """The numbers that the given rows hold, one after the other."""
    parts = [np.frombuffer(column[int(r)].as_buffer(), "<i8") for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _sorted_run(rows: np.ndarray, ids: np.ndarray, tags: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """A run, cut by bucket, front-coded; and spans that are settled within it.

    Of equal rows only those of the least id go on: all others lose the whole
    context, whatever other runs hold.  Their spans travel as bucket -1.
    """
    order = np.lexsort((places, tags, ids))
    order = order[np.argsort(rows[order].view(f"S{_WIDTH}").ravel(), kind="stable")]
    rows, ids, tags, places = rows[order], ids[order], tags[order], places[order]
    head = np.ones(len(rows), bool)
    head[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    group = np.cumsum(head) - 1
    low = ids[np.flatnonzero(head)][group]
    size, before = rows[:, 4 + SPAN].astype(np.int64), rows[:, -1].astype(np.int64) - 1
    later = ids > low
    spans = (ids[later], tags[later], (places - before)[later], (places + size)[later])
    keep = ~later
    # One entry for the places that a document has with the same context.
    entry = head.copy()
    entry[1:] |= tags[1:] != tags[:-1]
    entry &= keep
    first = np.flatnonzero(entry)
    counts = np.bincount(np.cumsum(entry)[keep] - 1, minlength=len(first))
    rows, size, before = rows[first], size[first], before[first]
    bucket = np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.int64)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    per = np.diff(np.append(cut, len(bucket)))
    suffix = rows[:, 4 : 4 + SPAN]
    shared = _shared(suffix, size)
    shared[cut] = 0
    column = np.arange(SPAN)
    tails = suffix[(column >= shared[:, None]) & (column < size[:, None])]
    befores = rows[:, 5 + SPAN : -1][np.arange(BEFORE) < before[:, None]]
    add = np.add.reduceat
    out = [
        bucket[cut], (shared, per), (size, per), (tails, add(size - shared, cut)), (before, per), (befores, add(before, cut)),
        (ids[first], per), (tags[first], per), (counts, per), (places[keep], add(counts, cut)),
    ]
    n_spans = len(spans[0])
    arrays = [pa.array(np.append(out[0], -1) if n_spans else out[0])]
    for k, (flat, sizes) in enumerate(out[1:], 1):
        if n_spans:
            # The spans' row: ids, tags, starts and stops in the last four columns.
            flat = np.concatenate([flat, spans[k - 6]]) if k > 5 else flat
            sizes = np.append(sizes, n_spans if k > 5 else 0)
        arrays.append(_longs(flat, sizes) if k > 5 else _binary(flat.astype(np.uint8), sizes))
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _RUNS.split(", ")])


def _runs(docs: DataFrame, wanted, hot: np.ndarray, buckets: int, run_entries: int) -> DataFrame:
    """Sorted runs of the suffixes at the anchors that ``wanted`` lets through."""

    def finished(held) -> list[pa.RecordBatch]:
        batch = _sorted_run(*[np.concatenate(x) for x in zip(*held)])
        step = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
        return [batch.slice(lo, step) for lo in range(0, batch.num_rows, step)]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = Texts(piece.column(2))
                at, h = wanted(piece, texts)
                for lo in range(0, len(at), run_entries):
                    part, part_h, most = _contexts(texts, at[lo : lo + run_entries], h[lo : lo + run_entries], hot)
                    a = 0
                    while a < len(part):
                        # No more than a run has room for.
                        b = a + run_entries - size
                        p = part[a:b]
                        owner = texts.owner(p)
                        rows = _rows(texts, p, part_h[a:b], most[a:b], buckets)
                        own = [piece.column(c).to_numpy()[owner] for c in (0, 1)]
                        held.append((rows, *own, p - texts.offsets[owner]))
                        size += len(p)
                        a = b
                        if size >= run_entries:
                            yield from finished(held)
                            held, size = [], 0
        if size:
            yield from finished(held)

    return docs.mapInArrow(released(run), _RUNS)


# -- the merge --------------------------------------------------------------------

def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of strings with a loser tree that keeps common prefixes.

    A run is its strings and, for each, the length of the prefix it shares with
    the string before it.  Returns the run and the place in it of each string in
    merged order, and the prefix it shares with the one before in that order.

    ``shared[k]`` is what the head of run ``k`` has in common with the last
    string put out.  Of two heads the one that shares more is smaller, without
    a comparison; only where both share the same are bytes compared, from
    there on.
    """
    n = len(runs)
    heads = [strings[0] if strings else None for strings, _ in runs]
    shared, place = [0] * n, [0] * n
    sign = int.from_bytes

    def duel(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        h, other = shared[a], shared[b]
        if h != other:
            return (a, b) if h > other else (b, a)
        m = min(len(x), len(y))
        differ = sign(x[h:m], "big") ^ sign(y[h:m], "big")
        same = h + (m - h) - (differ.bit_length() + 7 >> 3)
        winner, loser = (a, b) if x[same:] <= y[same:] else (b, a)
        shared[loser] = same
        return winner, loser

    tree = [0] * n
    winners = [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winners[node], tree[node] = duel(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if n > 1 else 0
    out_run, out_place, out_shared = [], [], []
    while n and heads[top] is not None:
        out_run.append(top)
        out_place.append(place[top])
        out_shared.append(shared[top])
        strings, prefixes = runs[top]
        place[top] += 1
        if place[top] < len(strings):
            heads[top], shared[top] = strings[place[top]], prefixes[place[top]]
        else:
            heads[top] = None
        node = (top + n) >> 1
        while node:
            top, tree[node] = duel(top, tree[node])
            node >>= 1
    return out_run, out_place, out_shared


def _decoded(shared: bytes, sizes: bytes, tails: bytes) -> tuple[list[bytes], list[int]]:
    strings, last, at = [], b"", 0
    for same, size in zip(shared, sizes):
        last = last[:same] + tails[at : at + size - same]
        at += size - same
        strings.append(last)
    return strings, list(shared)


def _reach(shared: np.ndarray, sizes: np.ndarray, before: np.ndarray, befores: np.ndarray, ids: np.ndarray):
    """For merged suffixes: which lie in a string of a smaller id, and how far it goes back and ahead."""
    m = len(ids)
    back = np.concatenate([befores, before[:, None].astype(np.uint8) + 1], axis=1)
    order = np.argsort(np.ascontiguousarray(back).view(f"S{BEFORE + 1}").ravel(), kind="stable")
    same_back = _shared(befores[order], before[order])
    most, least = np.full(m, -1), np.full(m, SPAN)
    rank = np.empty(m, np.int64)
    for j in range(BEFORE + 1):
        good = np.flatnonzero((sizes >= SPAN - j) & (before >= j))
        if len(good) < 2:
            continue
        rank[order] = np.cumsum(same_back < j) if j else 0
        key = np.cumsum(shared < SPAN - j)[good] * (m + 1) + rank[good]
        turn = np.argsort(key, kind="stable")
        key, own = key[turn], ids[good][turn]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        low = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))
        hit = good[turn][own > low]
        most[hit] = j
        least[hit] = np.minimum(least[hit], j)
    return most >= 0, most, least


def _merged(table: pa.Table) -> pa.Table:
    """The spans that a bucket's runs settle."""
    bucket = table.column("bucket").to_numpy()
    settled, rows = np.flatnonzero(bucket < 0), np.flatnonzero(bucket >= 0)
    numbers = ("ids", "tags", "counts", "places")
    out = [[_numbers(table.column(c), settled)] for c in numbers]
    if len(rows):
        part = {c: [table.column(c)[int(r)].as_py() for r in rows] for c in ("shared", "sizes", "tails", "before_sizes", "befores")}
        run, place, shared = merge_runs([_decoded(*x) for x in zip(part["shared"], part["sizes"], part["tails"])])
        n = [len(x) for x in part["sizes"]]
        entry = (np.cumsum(n) - n)[np.array(run)] + np.array(place)
        whole = {c: _numbers(table.column(c), rows) for c in numbers}
        sizes, before = (np.frombuffer(b"".join(part[c]), np.uint8).astype(np.int64) for c in ("sizes", "before_sizes"))
        befores = np.zeros((len(before), BEFORE), np.uint8)
        befores[np.arange(BEFORE) < before[:, None]] = np.frombuffer(b"".join(part["befores"]), np.uint8)
        shared = np.array(shared)
        del run, place, part
        hit, most, least = _reach(shared, sizes[entry], before[entry], befores[entry], whole["ids"][entry])
        most_of, least_of = np.full(len(entry), -1), np.zeros(len(entry), np.int64)
        most_of[entry[hit]], least_of[entry[hit]] = most[hit], least[hit]
        # Every place of an entry that was met.
        of = np.repeat(np.arange(len(entry)), whole["counts"])
        met = most_of[of] >= 0
        of, at = of[met], whole["places"][met]
        for found, values in zip(out, (whole["ids"][of], whole["tags"][of], at - most_of[of], at - least_of[of] + SPAN)):
            found.append(values)
        release()
    columns = [np.concatenate(x) for x in out]
    return pa.table(dict(zip(("id", "tag", "start", "stop"), columns)))


# -- whole documents ----------------------------------------------------------------

def _copies(rows: DataFrame) -> DataFrame:
    """``(id, tag, n_bytes)`` of the rows whose whole text a smaller id has."""
    named = rows.select("id", "tag", F.octet_length("text").cast("bigint").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"))
    groups = named.groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    found = spread_lookup(named, groups.where("copies > 1"), ["digest"], "id", "copies")
    return found.where("id > low").select("id", "tag", "n_bytes").distinct()


def repeated_spans(
    rows: DataFrame, filter_keys: int = FILTER_KEYS, hot_gram: int = HOT_GRAM, run_entries: int = RUN_ENTRIES,
    bucket_entries: int = BUCKET_ENTRIES,
) -> DataFrame:
    """``(id, tag, start, stop)``: bytes of ``rows(id, tag, text)`` that smaller ids hold.

    Spans overlap and come in any order; their union is what goes.
    """
    spark = rows.sparkSession
    copies, _ = small_side(_copies(rows))
    # Of equal texts the least id holds everything; the others go whole.
    firsts = rows.join(copies.select("id", "tag"), ["id", "tag"], "left_anti").select("id", "tag", "text")
    grams = stored(_gram_counts(firsts).where("texts > 1"))
    count, total = grams.agg(F.count("*"), F.coalesce(F.sum("texts"), F.lit(0))).first()
    # At most one gram in ``hot_gram`` anchors.
    hot = np.sort(grams.where(F.col("texts") > hot_gram).select("gram").toArrow().column("gram").to_numpy())
    buckets = min(max(1, -(-int(total) // bucket_entries)), 1 << 31)
    if count <= filter_keys:
        marks = spark.sparkContext.broadcast(_Bitmap(grams.select("gram"), count))

        def wanted(piece, texts: Texts):
            at, h = anchors(texts.data, texts.offsets)
            good = marks.value.has(_keys(h))
            return at[good], h[good]

        source = firsts
    else:
        def listed(piece, texts: Texts, at: np.ndarray, h: np.ndarray):
            owner = texts.owner(at)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(owner)), piece.column(1).take(pa.array(owner)), pa.array(_keys(h)),
                 pa.array(at - texts.offsets[owner]), pa.array(h.view(np.int64))],
                names=["id", "tag", "gram", "at", "h"],
            )

        def wanted(piece, texts: Texts):
            lists = piece.column(3)
            owner = np.repeat(np.arange(len(piece)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            return flat.field("at").to_numpy() + texts.offsets[owner], flat.field("h").to_numpy().view(np.uint64)

        rows_ = _anchored(firsts, listed, "id bigint, tag bigint, gram bigint, at bigint, h bigint")
        kept = rows_.join(grams.select("gram"), "gram", "left_semi")
        kept = kept.groupBy("id", "tag").agg(F.collect_list(F.struct("at", "h")).alias("at"))
        source = firsts.join(kept, ["id", "tag"]).select("id", "tag", "text", "at")
    runs = _runs(source, wanted, hot, buckets, run_entries)
    # Spans that are settled already need no company.
    bucket = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("ids"), F.lit(1 << 20))).otherwise(F.col("bucket"))
    merged = runs.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_merged, _SPANS)
    whole = copies.where(F.col("n_bytes") >= SPAN)
    return merged.unionByName(whole.select("id", "tag", F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop")))


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts and the digest of what is left of each text."""
    texts = Texts(batch.column(1))
    lists = batch.column(2)
    n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = lists.flatten()
    start, stop = flat.field("start").to_numpy(), flat.field("stop").to_numpy()
    edge = np.append(0, np.cumsum(n))
    removed, spans, digests = [], [], []
    for i, (a, b) in enumerate(zip(texts.offsets[:-1], texts.offsets[1:])):
        data, lo, hi = texts.data[a:b], edge[i], edge[i + 1]
        gone = n_runs = 0
        if hi > lo:
            depth = np.bincount(start[lo:hi], minlength=len(data) + 1) - np.bincount(stop[lo:hi], minlength=len(data) + 1)
            out = np.cumsum(depth[:-1]) > 0
            gone, n_runs = int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum())
            data = data[~out]
        removed.append(gone)
        spans.append(n_runs)
        digests.append(hashlib.sha256(data.tobytes()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(texts.n_bytes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
        names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte goes if a string of 50 bytes covers it that also starts in a
    document with a smaller id; strings are judged on the input.  Matches end
    with their document.

    A null text is empty.  A row without an id stays whole and takes nothing
    from others.  Rows that repeat an id each get their row; none of them is
    smaller than the other.  Other columns are left out.  An empty table gives
    no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    spans = repeated_spans(rows.where("id is not null"), **limits).groupBy("id", "tag").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans")
    )
    found = rows.join(spans, ["id", "tag"], "left").select("id", "text", "spans")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield _cut(piece)

    out = found.mapInArrow(released(run), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
