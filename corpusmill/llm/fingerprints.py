"""SimHash fingerprints and a search for those within a Hamming radius.

A document's terms are its distinct pairs of neighbouring words (a single word
counts as a term of its own), weighted by one plus the logarithm of their
count.  Each term's hash votes with its weight on every bit.

The search cuts a fingerprint into blocks.  Two fingerprints within ``radius``
bits agree on at least ``blocks - radius`` blocks, so with one table for each
choice of that many blocks (a permutation that puts these first) every such
pair meets in some table.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stored
from .texts import Texts, mixed, pieces, shingles

BITS = 128
BLOCKS = 7
RADIUS = 5


def votes(texts: Texts) -> np.ndarray:
    """Fingerprints, one row of ``BITS / 8`` bytes for each text."""
    starts, ends, owners = texts.words()
    h = texts.hashes(starts, ends, fold=True)
    n = len(texts)
    terms, of = shingles(h, owners, 2)
    n_words = np.bincount(owners, minlength=n)
    alone = n_words[owners] == 1
    if alone.any():
        terms, of = np.concatenate([terms, h[alone]]), np.concatenate([of, owners[alone]])
    out = np.zeros((n, BITS // 8), np.uint8)
    if not len(terms):
        return out
    order = np.lexsort((terms, of))
    terms, of = terms[order], of[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(terms)))
    terms, of = terms[at], of[at]
    weight = (1 + np.log2(counts)).astype(np.float32)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    with np.errstate(over="ignore"):
        wide = np.stack([mixed(terms), mixed(terms + np.uint64(0x5851F42D4C957F2D))], axis=1)
    # In slices: the votes of one term are BITS numbers.
    for a in range(0, len(first), 256):
        lo, hi = first[a], first[a + 256] if a + 256 < len(first) else len(terms)
        bits = np.unpackbits(wide[lo:hi].view(np.uint8).reshape(hi - lo, -1), axis=1)
        signed = (bits.astype(np.float32) * 2 - 1) * weight[lo:hi, None]
        sums = np.add.reduceat(signed, first[a : a + 256] - lo, axis=0)
        out[of[first[a : a + 256]]] = np.packbits(sums > 0, axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits of fingerprints in rows."""
    return 1.0 - np.unpackbits(a ^ b, axis=-1).sum(axis=-1) / BITS


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_STEP_SCHEMA = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, kind string, partition int, text string"
)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they are.

    The next document is the next row by (id, text), and the first one after
    the last.  Rows are range-partitioned by that order; each task walks its
    rows and keeps back the last one, which meets the first row of the next
    non-empty partition in a second, small step: a row or two per partition.

    A null text is an empty one (fingerprint all zero); null ids come first;
    repeated rows follow each other.  A single row is its own next document.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {_STEP_SCHEMA}"
    names = [id_col, *(c.split()[0] for c in _STEP_SCHEMA.split(", "))]

    def scored(ids: pa.Array, texts: list[str], following: list[str], kind: str = "row") -> pa.RecordBatch:
        changed = [edited(a, b) for a, b in zip(texts, following)]
        # One pass over texts, edits and the last row's successor.
        prints = votes(Texts(pa.array([*texts, following[-1]], pa.string())))
        own, nexts = prints[:-1], prints[1:]
        others = votes(Texts(pa.array(changed, pa.string())))
        n = len(texts)
        none = pa.nulls(n, pa.string())
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
                pa.array(_hex(own)), pa.array(_hex(others)), pa.array(likeness(own, others)),
                pa.array(likeness(own, nexts)), pa.array([kind] * n), pa.nulls(n, pa.int32()), none,
            ],
            names=names,
        )

    def kept_back(ids: pa.Array, text: str, kind: str, partition: int) -> pa.RecordBatch:
        empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays(
            [ids, *empty, pa.array([kind]), pa.array([partition], pa.int32()), pa.array([text])], names=names
        )

    def walk(batches):
        from pyspark import TaskContext

        partition, last_id, last_text = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for piece in pieces(batch, text_col):
                ids, texts = piece.column(0), [t or "" for t in piece.column(1).to_pylist()]
                if last_text is None:
                    yield kept_back(ids.slice(0, 1), texts[0], "first", partition)
                else:
                    yield scored(last_id, [last_text], [texts[0]])
                if len(texts) > 1:
                    yield scored(ids.slice(0, len(texts) - 1), texts[:-1], texts[1:])
                last_id, last_text = ids.slice(len(texts) - 1), texts[-1]
        if last_text is not None:
            yield kept_back(last_id, last_text, "last", partition)

    order = [F.col(f"`{id_col}`").asc_nulls_first(), F.col(f"`{text_col}`").asc_nulls_first()]
    ranged = (
        docs.select(id_col, text_col)
        .repartitionByRange(F.col(f"`{id_col}`").asc_nulls_first())
        .sortWithinPartitions(*order)
    )
    done = stored(ranged.mapInArrow(walk, schema))
    ends = done.where("kind != 'row'")
    # One or two rows per partition of the step above, so these windows are small.
    line = Window.orderBy("partition", "kind")
    heads = Window.orderBy("partition", "kind").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_first = F.col("kind") == "first"
    pairs = (
        ends.withColumn("following", F.coalesce(F.lead("text").over(line), F.first("text").over(heads)))
        .where(~is_first).select(id_col, "text", "following")
    )

    def finish(batches):
        for batch in batches:
            if batch.num_rows:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    yield scored(row.column(0), row.column(1).to_pylist(), row.column(2).to_pylist())

    tail = pairs.mapInArrow(finish, schema)
    return done.where("kind = 'row'").unionByName(tail).drop("kind", "partition", "text")


def permuted_keys(fingerprint: F.Column, blocks: int = BLOCKS, radius: int = RADIUS) -> F.Column:
    """An array of table keys: table number, then the bits of its blocks."""
    bits = F.concat(*[
        F.lpad(F.conv(F.substring(fingerprint, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(BITS // 32)
    ])
    cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
    block = [F.substring(bits, a + 1, b - a) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[
        F.xxhash64(F.lit(t), *[block[i] for i in chosen])
        for t, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ])


def distance(a: F.Column, b: F.Column) -> F.Column:
    total = F.lit(0)
    for i in range(BITS // 32):
        one, other = (F.conv(F.substring(x, 1 + 8 * i, 8), 16, 10).cast("bigint") for x in (a, b))
        total = total + F.bit_count(one.bitwiseXOR(other))
    return total


def near_fingerprints(
    prints: DataFrame, asked: F.Column, id_col: str = "doc_id", blocks: int = BLOCKS, radius: int = RADIUS,
) -> DataFrame:
    """For each asked row, how many other rows lie within ``radius`` bits.

    ``prints`` has an id and ``fingerprint``.  Equal fingerprints are one class
    with its number of rows, so copies cost one row; ``asked`` picks the query
    rows and the others are never paired with each other.  All tables together
    find every class within the radius.  Rows: ``fingerprint``, ``n_within``
    (the row itself not counted).  Null fingerprints are left out.
    """
    prints = prints.where("fingerprint is not null")
    classes = stored(prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max(asked).alias("asked")))
    keyed = classes.select("fingerprint", "n", "asked", F.explode(permuted_keys(F.col("fingerprint"), blocks, radius)).alias("key"))
    left = keyed.where("asked").select("key", F.col("fingerprint").alias("wanted"))
    right = keyed.select("key", "fingerprint", "n")
    found = (
        left.join(right, "key").where(distance(F.col("wanted"), F.col("fingerprint")) <= radius)
        .dropDuplicates(["wanted", "fingerprint"])
    )
    return found.groupBy(F.col("wanted").alias("fingerprint")).agg((F.sum("n") - 1).alias("n_within"))
