"""Phrase collocations, counted over a dictionary of repeated chunks.

Texts are parsed the prefix-free way: a run of three words whose hash meets a
condition is a trigger; a chunk reaches from one trigger to the end of the next
one, so neighbouring chunks overlap by three words.  Equal chunks become one
entry of a dictionary with the number of times they are met.  Phrases of up to
four words are then counted inside the distinct chunks, weighted; one that
starts in the overlap at a chunk's end belongs to the next chunk alone.

Counting goes from short phrases to long ones.  Of the phrases of each length
only 48-bit hashes are summed up first; those that reach the least frequency
mark a bitmap of fixed size, and a longer phrase is looked at only if both its
shorter parts are marked.  Bits that clash merely let more phrases through: the
counts that are used come from a last pass, by the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scale import small_side, stored
from .texts import Texts, bounds, mixed, pieces

LONGEST = 4
OVERLAP = LONGEST - 1
#: One run of three words in so many is a trigger.
TRIGGER = 32
#: A chunk without triggers is cut after so many words.
MOST_WORDS = 4096
LEAST = 30
INSIDE_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
PIECE_BYTES = 4 << 20
#: Bits of each bitmap, as a power of two: 8 MiB.
BITMAP_BITS = 26

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- the parse ----------------------------------------------------------------

class _Words:
    """Words of texts, and where a break between pieces stands before one."""

    def __init__(self, texts: Texts) -> None:
        texts.data = _LOWER[texts.data]
        gap = _GAP[texts.data]
        head = np.zeros(len(gap), bool)
        head[texts.offsets[:-1][texts.n_bytes > 0]] = True
        first = ~gap
        first[1:] &= gap[:-1] | head[1:]
        last = ~gap
        last[:-1] &= gap[1:] | head[1:]
        self.texts, self.starts, self.ends = texts, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.owner = texts.owner(self.starts)
        breaks = np.zeros(len(gap) + 1, np.int64)
        np.cumsum(_BREAK[texts.data], out=breaks[1:])
        before = breaks[self.starts]
        # A word opens a piece if a break mark or the text's head stands before it.
        self.opens = np.ones(len(before), bool)
        self.opens[1:] = (before[1:] != before[:-1]) | (self.owner[1:] != self.owner[:-1])


def _chunk_bounds(words: _Words, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of chunks, the words after their last, and how many overlap at the end."""
    n = len(words.starts)
    h = words.texts.hashes(words.starts, words.ends)
    first = np.ones(n, bool)
    first[1:] = words.owner[1:] != words.owner[:-1]
    if n > 2:
        with np.errstate(over="ignore"):
            run = mixed(mixed(mixed(h[:-2]) * _U(3) + h[1:-1]) * _U(5) + h[2:])
        same = words.owner[2:] == words.owner[:-2]
        first[:-2] |= same & (run % _U(trigger) == 0)
    at = np.flatnonzero(first)
    # Long stretches without a trigger are cut by length.
    size = np.diff(np.append(at, n))
    parts = -(-size // MOST_WORDS)
    if len(at) and parts.max() > 1:
        turn = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(at, parts) + turn * MOST_WORDS
    stop = np.append(at[1:], n)
    # The end of the text that a chunk is in, beyond which nothing overlaps.
    text_end = np.searchsorted(words.owner, words.owner[at], side="right") if n else stop
    end = np.minimum(stop + OVERLAP, text_end)
    return at, end, end - stop


def _joined(words: _Words, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Chunks as text: words with a blank between, or a line feed where pieces meet."""
    n = end - begin
    first = np.cumsum(n) - n
    of = np.repeat(begin - first, n) + np.arange(int(n.sum()))
    size = words.ends[of] - words.starts[of] + 1
    after = np.cumsum(size)
    source = np.repeat(words.starts[of] - (after - size), size) + np.arange(int(after[-1]) if len(after) else 0)
    mark = after - 1
    source[mark] = 0
    out = words.texts.data[source]
    following = np.append(words.opens[of[1:]], False)
    out[mark] = np.where(following, 10, 32)
    # The mark after a chunk's last word is left out.
    keep = np.ones(len(out), bool)
    ends = after[first + n - 1] if len(n) else after[:0]
    keep[ends - 1] = False
    edge = np.zeros(len(n) + 1, np.int64)
    edge[1:] = ends - np.arange(1, len(n) + 1)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(out[keep])))


def parse(docs: DataFrame, text_col: str = "text", part_col: str = "lang", trigger: int = TRIGGER) -> DataFrame:
    """The dictionary: ``(part, chunk, overlap, times)``."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                texts = Texts(piece.column(1))
                if not len(texts.data):
                    continue
                words = _Words(texts)
                begin, end, overlap = _chunk_bounds(words, trigger)
                if not len(begin):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0).take(pa.array(words.owner[begin])), _joined(words, begin, end).cast(pa.string()),
                        pa.array(overlap.astype(np.int32)),
                    ],
                    names=["part", "chunk", "overlap"],
                )

    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(UNKNOWN)).alias("part")
    text = F.col(f"`{text_col}`").alias("text")
    chunks = docs.select(part, text).mapInArrow(run, "part string, chunk string, overlap int")
    return chunks.groupBy("part", "chunk", "overlap").agg(F.count("*").alias("times"))


# -- phrases of chunks ----------------------------------------------------------

class _Phrases:
    """Phrases of ``1`` to ``LONGEST`` words in a batch of chunks, by their first word."""

    def __init__(self, parts: pa.Array, texts: Texts, overlap: np.ndarray) -> None:
        self.texts = texts
        self.starts, self.ends, self.owner = texts.words()
        n = len(self.starts)
        opens = np.ones(n, bool)
        opens[1:] = self.owner[1:] != self.owner[:-1]
        inner = self.starts[~opens] - 1
        opens[~opens] = texts.data[inner] == 10
        self.piece = np.cumsum(opens)
        edge = bounds(self.owner, len(texts))
        # Phrases that start in the overlap are the next chunk's.
        self.own = np.arange(n) < (edge[1:] - overlap)[self.owner]
        labels = Texts(parts)
        named = labels.hashes(labels.offsets[:-1], labels.offsets[1:])
        self.seed = named[self.owner]
        self.words = texts.hashes(self.starts, self.ends)

    def hashes(self, n: int, salt: int = 0) -> np.ndarray:
        """Hashes of the ``n`` words from each word on (the last ``n - 1`` words have none)."""
        count = max(0, len(self.words) - n + 1)
        with np.errstate(over="ignore"):
            out = mixed(self.seed[:count] + _U(salt + n))
            for k in range(n):
                out = mixed(out * _U(3) + self.words[k : k + count])
        return out

    def whole(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each word on are one piece's, starting in the chunk's own part."""
        count = max(0, len(self.words) - n + 1)
        return (self.piece[:count] == self.piece[n - 1 :][:count]) & self.own[:count]


class _Bitmap:
    """Marks of frequent phrases; never misses one."""

    def __init__(self, cells: np.ndarray, bits: np.ndarray, size: int) -> None:
        self.mask = _U((1 << size) - 1)
        self.bits = np.zeros(max(1, (1 << size) >> 6), np.uint64)
        self.bits[cells] = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> _U(16)) & self.mask
        return ((self.bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1)).astype(bool)


def _may_be_frequent(found: _Phrases, n: int, marks: list) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of phrases whose shorter parts are all marked."""
    good = found.whole(n)
    if n > 1:
        parts = marks[n - 2].value.has(found.hashes(n - 1))
        good &= parts[:-1] & parts[1:]
    at = np.flatnonzero(good)
    return at, found.hashes(n)[at]


def _groups(h: np.ndarray, other: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair of hashes, and the sum of its weights.

    Pairs may come twice if first hashes clash; sums over both are right.
    """
    order = np.argsort(h, kind="stable")
    h, other = h[order], other[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (other[1:] != other[:-1])
    first = np.flatnonzero(new)
    return order[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def _by_chunk(dictionary: DataFrame, work, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "chunk", PIECE_BYTES):
                texts = Texts(piece.column(1))
                found = _Phrases(piece.column(0), texts, piece.column(2).to_numpy())
                times = piece.column(3).to_numpy()
                yield from work(piece, found, times[found.owner])

    return dictionary.select("part", "chunk", "overlap", "times").mapInArrow(run, schema)


def _hash_counts(dictionary: DataFrame, n: int, marks: list, least: int) -> DataFrame:
    """``(h)``: 48-bit hashes of the phrases of ``n`` words that may be frequent."""

    def work(piece, found: _Phrases, times: np.ndarray):
        at, h = _may_be_frequent(found, n, marks)
        if len(at):
            h = h >> _U(16)
            first, total = _groups(h, h, times[at])
            yield pa.RecordBatch.from_arrays([pa.array(h[first].astype(np.int64)), pa.array(total)], names=["h", "times"])

    counts = _by_chunk(dictionary, work, "h bigint, times bigint")
    return counts.groupBy("h").agg(F.sum("times").alias("times")).where(F.col("times") >= least).select("h")


def _bitmap(frequent: DataFrame, size: int) -> _Bitmap:
    """The marks of ``frequent(h)``; at most ``2 ** size`` bits reach the driver."""
    cell = F.expr(f"cast(shiftright(h & {(1 << size) - 1}L, 6) as int)").alias("cell")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")
    rows = frequent.select(cell, bit).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    return _Bitmap(rows.column("cell").to_numpy(), rows.column("bits").to_numpy().view(np.uint64), size)


def frequent_phrases(dictionary: DataFrame, least: int = LEAST, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """``(part, n, phrase, times)`` of all phrases of 1 to 4 words that are met ``least`` times.

    ``dictionary`` is read once for each length and once more; have it stored.
    """
    context = dictionary.sparkSession.sparkContext
    marks: list = []
    for n in range(1, LONGEST + 1):
        marks.append(context.broadcast(_bitmap(_hash_counts(dictionary, n, marks, least), bitmap_bits)))

    def work(piece, found: _Phrases, times: np.ndarray):
        for n in range(1, LONGEST + 1):
            at, h = _may_be_frequent(found, n, marks)
            known = marks[n - 1].value.has(h)
            at, h = at[known], h[known]
            if not len(at):
                continue
            first, total = _groups(h, found.hashes(n, 1 << 20)[at], times[at])
            at = at[first]
            begin, size = found.starts[at], found.ends[at + n - 1] - found.starts[at]
            edge = np.zeros(len(at) + 1, np.int64)
            np.cumsum(size, out=edge[1:])
            source = np.repeat(begin - edge[:-1], size) + np.arange(int(edge[-1]))
            phrases = pa.LargeStringArray.from_buffers(
                len(at), pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(found.texts.data[source]))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).take(pa.array(found.owner[at])), pa.array(np.full(len(at), n, np.int32)),
                    phrases.cast(pa.string()), pa.array(total),
                ],
                names=["part", "n", "phrase", "times"],
            )

    counts = _by_chunk(dictionary, work, "part string, n int, phrase string, times bigint")
    counts = counts.groupBy("part", "n", "phrase").agg(F.sum("times").alias("times"))
    return counts.where(F.col("times") >= least)


def _word_total(dictionary: DataFrame) -> DataFrame:
    """``(part, total)``: all word occurrences."""
    words = F.size(F.split("chunk", "[ \n]")) - F.col("overlap")
    return dictionary.groupBy("part").agg(F.sum(words * F.col("times")).alias("total"))


# -- scores ---------------------------------------------------------------------

def _scored(phrases: DataFrame) -> DataFrame:
    """Candidates with the lowest score of their cuts: ``part, phrase, words, a, l, r, score``."""
    words = F.split("phrase", " ")
    longer = phrases.where("n > 1").select("part", "phrase", words.alias("words"), F.col("times").alias("a"))
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    rest = F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))
    cuts = cuts.select(
        "part", "phrase", "words", "a", "k", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("first"),
        F.concat_ws(" ", rest).alias("rest"),
    )
    # Both parts are at least as frequent as the phrase, so they are listed.
    known, _ = small_side(phrases.select("part", "phrase", "times"))
    left = known.select("part", F.col("phrase").alias("first"), F.col("times").alias("l"))
    right = known.select("part", F.col("phrase").alias("rest"), F.col("times").alias("r"))
    cuts = cuts.join(left, ["part", "first"]).join(right, ["part", "rest"])
    score = F.expr(f"(cast(a as decimal(20, 0)) * {SCALE}) div cast(l + r as decimal(20, 0))")
    best = cuts.withColumn("score", score).groupBy("part", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("best")
    )
    return best.select("part", "phrase", "best.words", "best.a", "best.l", "best.r", "best.score")


def _covered(scored: DataFrame, percent: int) -> DataFrame:
    """``(part, phrase, longest)``: how often the commonest longer candidate around a phrase is met."""
    inner = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), n -> "
        "transform(sequence(1, size(words) - n + 1), i -> concat_ws(' ', slice(words, i, n)))))"
    )
    longer = scored.where(F.size("words") > 2)
    return longer.select("part", F.explode(inner).alias("phrase"), "a").groupBy("part", "phrase").agg(
        F.max("a").alias("longest")
    )


def collocations(
    docs: DataFrame, text_col: str = "text", part_col: str = "lang", least: int = LEAST, top: int = TOP,
    inside_percent: int = INSIDE_PERCENT, trigger: int = TRIGGER, bitmap_bits: int = BITMAP_BITS,
) -> DataFrame:
    """The best phrases of two to four words of each language.

    Columns: the part, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.
    A phrase is met ``a`` times; cut where that gives the lowest score, its
    parts are met ``l`` and ``r`` times, and ``n`` is the part's number of words.
    Phrases that lie inside a longer one met ``inside_percent`` times as often
    (or more) are left out.

    Null and empty texts and texts of separators alone have no words; a null
    part is ``und``.  Repeated rows count each.  Ties in score and frequency
    are ranked by the phrase's bytes.  Other columns are left out.  An empty
    table, and one without frequent phrases, gives no rows.
    """
    dictionary = stored(parse(docs, text_col, part_col, trigger))
    scored = stored(_scored(stored(frequent_phrases(dictionary, least, bitmap_bits))))
    around, _ = small_side(_covered(scored, inside_percent))
    whole = F.col("longest").isNull() | (100 * F.col("longest") < inside_percent * F.col("a"))
    left = scored.join(around, ["part", "phrase"], "left").where(whole)
    order = Window.partitionBy("part").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    # One row a language: the totals are as few as the parts that have phrases.
    totals, _ = small_side(_word_total(dictionary))
    return ranked.join(totals, "part").select(
        F.col("part").alias(part_col), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r",
        F.col("total").cast("bigint").alias("n"), F.col("score").cast("bigint").alias("score"),
    )
