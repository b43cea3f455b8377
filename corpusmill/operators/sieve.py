"""A Bloom filter of fixed size, as a small table that is joined by broadcast.

A key belongs to one block and sets one bit in each of the block's four words,
so a test is one lookup and four masks, all of them native.  The table has at
most ``blocks`` rows however many keys it knows.  A key that was put in is
always found again; how many others seem known depends on the keys per block
(under 1 % for 6 million keys in the default 262,144 blocks).  With more keys
it lets more through, and whoever asks has to look those up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import stored

BLOCKS = 1 << 18
WORDS = 4


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks)).cast("int")


def _bits(name: str) -> list[Column]:
    """One bit in each word, from six bits of one hash."""
    return [F.expr(f"shiftleft(1L, cast(shiftright(xxhash64(2, `{name}`), {6 * i}) & 63 as int))") for i in range(WORDS)]


def build(keys: DataFrame, name: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter of ``keys[name]``: ``(block, w0, w1, w2, w3)``, stored."""
    bits = [b.alias(f"w{i}") for i, b in enumerate(_bits(name))]
    rows = keys.where(F.col(name).isNotNull()).select(_block(F.col(name), blocks).alias("block"), *bits)
    return stored(rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))


def with_maybe(rows: DataFrame, sieve: DataFrame, name: str, flag: str = "_maybe", blocks: int = BLOCKS) -> DataFrame:
    """Add ``flag``: false where ``rows[name]`` is certainly not among the keys.

    No row moves: the filter is broadcast, which its number of blocks bounds.
    A null key is not among the keys.
    """
    words = [f"_w{i}" for i in range(WORDS)]
    table = sieve.select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(w) for i, w in enumerate(words)])
    set_ = [F.col(w).bitwiseAND(b) != 0 for w, b in zip(words, _bits(name))]
    every = set_[0]
    for one in set_[1:]:
        every = every & one
    found = rows.withColumn("_block", _block(F.col(name), blocks)).join(F.broadcast(table), "_block", "left")
    return found.withColumn(flag, F.coalesce(every, F.lit(False)) & F.col(name).isNotNull()).drop("_block", *words)
