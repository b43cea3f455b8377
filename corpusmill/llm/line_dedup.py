"""Line dedup by pairwise alignment.

Documents overlap where they share lines.  Each later holder of a line is paired
with the line's earliest one, so a line makes a star, not all pairs.  Every pair
is aligned by patience diff: unique common lines in increasing order, then the
gaps between them, and a longest common subsequence of gaps without such lines.

One alignment has one order, and a star one earlier document.  So blocks of
enough words that any earlier document holds line by line count as aligned too,
however often and in whatever order the two hold them: each line of such a block
lies in a least window of enough words that starts or ends at a line, and equal
windows have equal hashes.  A line that alone has enough words is such a window,
so beyond ``RARE`` holders it needs no pairs; shorter lines always make them.

Neighbouring aligned lines of a document form a block, and blocks of enough
words are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import small_side, stored
from .texts import Texts, bounds, by_piece, list_array, mixed

RARE = 1000
MIN_WORDS = 5
#: Bits of the rows that a common subsequence keeps; larger gaps are halved first.
ROW_BITS = 1 << 28
#: What a key of a document stands for.
SHORT, LONG, SEVERAL = 0, 1, 2


def _anchors(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Lines unique on both sides, as a longest run that increases in both."""
    seen: dict[int, int] = {}
    for i in range(alo, ahi):
        seen[a[i]] = -1 if a[i] in seen else i
    other: dict[int, int] = {}
    for j in range(blo, bhi):
        if seen.get(b[j], -1) >= 0:
            other[b[j]] = -1 if b[j] in other else j
    found = sorted((j, seen[h]) for h, j in other.items() if j >= 0)
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, i) in enumerate(found):
        p = bisect_left(tails, i)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(i)
            at.append(k)
        else:
            tails[p], at[p] = i, k
    chain = []
    k = at[-1] if at else -1
    while k >= 0:
        chain.append((found[k][1], found[k][0]))
        k = back[k]
    return chain[::-1]


def _rows(a: list, b: list):
    """For each prefix of ``a``, a number whose zero bits are the places of ``b`` that lengthen the common subsequence."""
    where: dict[int, int] = {}
    for j, h in enumerate(b):
        where[h] = where.get(h, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    yield row
    for h in a:
        hit = row & where[h]
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.append(0, np.cumsum(bits[: len(b)] == 0))


def _subsequence(a: list, b: list) -> list[int]:
    """Positions of ``b`` in a longest common subsequence with ``a``."""
    out: list[int] = []
    work = [(a, b, list(range(len(b))))]
    while work:
        a, b, at = work.pop()
        common = set(a) & set(b)
        a = [h for h in a if h in common]
        kept = [j for j, h in enumerate(b) if h in common]
        b, at = [b[j] for j in kept], [at[j] for j in kept]
        if not common:
            continue
        if len(a) > 1 and len(a) * len(b) > ROW_BITS:
            half = len(a) // 2
            cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
            work += [(a[:half], b[:cut], at[:cut]), (a[half:], b[cut:], at[cut:])]
            continue
        rows = list(_rows(a, b))
        i, j = len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append(at[j])
            elif rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
    return out


def align(a: list, b: list) -> list[int]:
    """Positions of ``b`` that a patience diff aligns with ``a``, in order."""
    out: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        alo, ahi, blo, bhi = work.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append(blo)
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append(bhi)
        if alo == ahi or blo == bhi:
            continue
        chain = _anchors(a, b, alo, ahi, blo, bhi)
        if chain:
            ends = [*chain, (ahi, bhi)]
            start = (alo, blo)
            for i, j in ends:
                work.append((start[0], i, start[1], j))
                start = (i, j)  # the anchor itself is the next part's common head
        else:
            out += [blo + j for j in _subsequence(a[alo:ahi], b[blo:bhi])]
    return sorted(out)


def blocks(places: list[int], words: list[int], least: int) -> list[int]:
    """Those of the sorted ``places`` that lie in runs of ``least`` words or more."""
    out: list[int] = []
    run: list[int] = []
    for p in [*places, -1]:
        if run and p != run[-1] + 1:
            if sum(words[q] for q in run) >= least:
                out.extend(run)
            run = []
        run.append(p)
    return out


def windows(hashes: np.ndarray, words: np.ndarray, edge: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Keys, first lines and ends of the least runs of ``least`` words that start or end at a line.

    Document ``i`` has lines ``edge[i]`` to ``edge[i + 1]``, all with words.  The
    key of a single line is its hash.
    """
    sums = np.append(0, np.cumsum(words, dtype=np.int64))
    n = len(words)
    doc = np.searchsorted(edge, np.arange(n), side="right") - 1
    stop = np.searchsorted(sums, sums[:-1] + max(least, 1))
    start = np.searchsorted(sums, sums[1:] - max(least, 1), side="right") - 1
    ahead, behind = stop <= edge[doc + 1], start >= edge[doc]
    starts = np.concatenate([np.flatnonzero(ahead), start[behind]])
    stops = np.concatenate([stop[ahead], np.flatnonzero(behind) + 1])
    keys, size = hashes[starts].astype(np.uint64), stops - starts
    for k in range(1, int(size.max(initial=1))):
        on = np.flatnonzero(size > k)
        with np.errstate(over="ignore"):
            keys[on] = mixed(keys[on] * np.uint64(3) + hashes[starts[on] + k].astype(np.uint64) + np.uint64(k))
    return keys.view(np.int64), starts, stops


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and words of all lines of a batch, and where each document's begin."""
    hashes = batch.column("hashes")
    edge = np.append(0, np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return hashes.flatten().to_numpy(), batch.column("words").flatten().to_numpy(), edge


def _keys(lines: DataFrame, least: int) -> DataFrame:
    """``(doc, h, kind)``: each document's distinct lines, and windows of several lines."""

    def run(batches):
        for batch in batches:
            hashes, words, edge = _flat(batch)
            found, starts, stops = windows(hashes, words, edge, least)
            several = stops - starts > 1
            at = np.concatenate([np.arange(len(hashes)), starts[several]])
            h = np.concatenate([hashes, found[several]])
            kind = np.concatenate([np.where(words >= least, LONG, SHORT), np.full(int(several.sum()), SEVERAL)])
            doc = np.searchsorted(edge, at, side="right") - 1
            order = np.lexsort((kind, h, doc))
            doc, h, kind = doc[order], h[order], kind[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(doc[new])), pa.array(h[new]), pa.array(kind[new].astype(np.int8))],
                names=["doc", "h", "kind"],
            )

    kind = lines.schema["doc"].dataType.simpleString()
    return lines.select("doc", "hashes", "words").mapInArrow(run, f"doc {kind}, h bigint, kind tinyint")


def _line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc`` (key, earliest first) with its worded lines: hashes, words, line numbers."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(1))
        n = len(texts)
        starts, ends, owners = texts.lines()
        word_starts, _, _ = texts.words()
        words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
        number = np.arange(len(owners)) - bounds(owners, n)[owners]
        full = words > 0
        edge = bounds(owners[full], n)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), list_array(texts.hashes(starts, ends)[full].view(np.int64), edge),
                list_array(words[full].astype(np.int32), edge), list_array(number[full].astype(np.int32), edge),
                pa.array(np.bincount(owners, minlength=n).astype(np.int32)),
            ],
            names=["doc", "hashes", "words", "numbers", "n_lines"],
        )

    key = _key(id_col, text_col)
    kind = "struct<no_id:boolean,id:bigint,digest:bigint>"
    schema = f"doc {kind}, hashes array<bigint>, words array<int>, numbers array<int>, n_lines int"
    return docs.select(key.alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(by_piece(work), schema)


def _key(id_col: str, text_col: str) -> F.Column:
    """Orders documents: by id, null ids last, then by a hash of the text."""
    ident = F.col(f"`{id_col}`").cast("bigint")
    return F.struct(
        ident.isNull().alias("no_id"), F.coalesce(ident, F.lit(0).cast("bigint")).alias("id"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("digest"),
    )


def deletions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_WORDS
) -> DataFrame:
    """``(doc, drop, n_dropped)``: for documents that lose lines, a flag per line."""
    lines = stored(_line_table(docs, id_col, text_col).dropDuplicates(["doc"]))
    placed = _keys(lines, min_words)
    held = placed.groupBy("h", "kind").agg(F.min("doc").alias("first"), F.count("*").alias("holders")).where("holders > 1")
    later = stored(placed.join(held, ["h", "kind"]).where("doc != first"))
    paired = (F.col("kind") == SHORT) | ((F.col("kind") == LONG) & (F.col("holders") <= rare))
    pairs = later.where(paired).select("doc", "first").distinct()
    own = lines.select("doc", F.col("hashes").alias("b"))
    earlier = lines.select(F.col("doc").alias("first"), F.col("hashes").alias("a"))

    def aligned(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([align(x, y) for x, y in zip(a, b)], pa.list_(pa.int32()))],
                names=["doc", "places"],
            )

    kind = lines.schema["doc"].dataType.simpleString()
    matched = pairs.join(earlier, "first").join(own, "doc").select("doc", "a", "b").mapInArrow(
        aligned, f"doc {kind}, places array<int>"
    ).select("doc", F.explode("places").alias("place")).groupBy("doc").agg(F.collect_set("place").alias("places"))
    exact = later.where(F.col("kind") != SHORT).groupBy("doc").agg(F.collect_set("h").alias("keys"))

    def flagged(batches):
        for batch in batches:
            docs_, drop, n = [], [], []
            for i, row in enumerate(batch.select(["places", "keys", "hashes", "words", "numbers", "n_lines"]).to_pylist()):
                hit = np.zeros(len(row["words"]) + 1, np.int64)
                hit[row["places"] or []] = 1
                found, starts, stops = windows(np.array(row["hashes"], np.int64), np.array(row["words"]), np.array([0, len(row["words"])]), min_words)
                known = np.isin(found, np.array(row["keys"] or [], np.int64))
                span = np.zeros(len(hit), np.int64)
                np.add.at(span, starts[known], 1)
                np.add.at(span, stops[known], -1)
                gone = blocks(np.flatnonzero(hit + np.cumsum(span)).tolist(), row["words"], min_words)
                if gone:
                    flags = np.zeros(row["n_lines"], bool)
                    flags[np.array(row["numbers"])[gone]] = True
                    docs_.append(i)
                    drop.append(flags.tolist())
                    n.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(pa.array(docs_, pa.int64())), pa.array(drop, pa.list_(pa.bool_())),
                    pa.array(n, pa.int64()),
                ],
                names=["doc", "drop", "n_dropped"],
            )

    return matched.join(exact, "doc", "full").join(lines, "doc").mapInArrow(
        flagged, f"doc {kind}, drop array<boolean>, n_dropped bigint"
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_WORDS
) -> DataFrame:
    """All columns of ``docs`` with repeated blocks cut from ``text``, and two more.

    ``n_lines_dropped``, and ``emptied``: the text had words and has none left.
    The earliest document by id keeps its lines (null ids come last; equal ids
    go by a hash of the text).  Rows of equal id and text are one document and
    keep or lose the same lines.  Null and empty texts stay as they are, and so
    does an empty table.  Lines are compared byte by byte; repeats within one
    document are not this operator's.  Columns ``_line_*`` are its own.
    """
    found, _ = small_side(deletions(docs, id_col, text_col, rare, min_words).select(
        F.col("doc").alias("_line_doc"), F.col("drop").alias("_line_drop"), F.col("n_dropped").alias("_line_n")
    ))
    keyed = docs.withColumn("_line_doc", _key(id_col, text_col)).join(found, "_line_doc", "left")
    kept = F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda _, i: ~F.get("_line_drop", i))
    text = F.when(F.col("_line_n").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    emptied = F.col("_line_n").isNotNull() & ~text.rlike(r"[^\x20\x09-\x0D]")
    own = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return keyed.select(
        *own, F.coalesce("_line_n", F.lit(0)).cast("bigint").alias("n_lines_dropped"),
        F.coalesce(emptied, F.lit(False)).alias("emptied"),
    )
