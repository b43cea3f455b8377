"""Language-model scoring by context-tree weighting over bytes.

The next byte is decided bit by bit; each of the 255 bit nodes has a context
tree of its own over the bytes before it, up to ``DEPTH``.  Every context keeps
a Krichevsky-Trofimov estimate, and contexts of all depths are mixed: a node
weighs its own estimate against the product of its children's, half and half
before any data, by how well each has coded the training text.

Counts of byte runs and of words are summed by Spark.  The tree is worked
bottom-up and then top-down inside groups that share their last two bytes; only
the levels above (256 contexts at most) meet on the driver.  Scores need one
number per distinct run: the most frequent ones are broadcast in a table of
bounded size, and all others are looked up by a join.  Words for the unigram
base are treated in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import stored
from .texts import Lookup, Texts, bounds, list_array, pieces

DEPTH = 4
FOLDS, HELD_OUT = 7, 2
#: Most entries of a broadcast table (16 bytes each, on the driver and per task).
FREQUENT = 1 << 19
_HELD = 1_500_000
_EDGE = 0xFF  # never a byte of UTF-8: stands before a text and ends it
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD, _RUN, _TEXTS = 0, 1, 2


def byte_runs(texts: Texts, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """One key per byte and end of text, and the texts they are of.

    From high to low: the last byte, the one before it and so on, then the byte
    to come, so that a context's keys begin with those of its suffixes.
    """
    n, sizes = len(texts), texts.n_bytes
    wide = np.full(len(texts.data) + n * (depth + 1), _EDGE, np.uint8)
    shift = np.arange(n) * (depth + 1) + depth
    wide[np.arange(len(texts.data)) + np.repeat(shift, sizes)] = _LOWER[texts.data]
    coded = np.zeros(len(wide), bool)
    at = np.arange(len(texts.data) + n) + np.repeat(shift - np.arange(n), sizes + 1)
    coded[at] = True
    key = np.zeros(len(at), np.uint64)
    for k in range(1, depth + 1):
        key = (key << np.uint64(8)) | wide[at - k]
    return (key << np.uint64(8)) | wide[at], np.repeat(np.arange(n), sizes + 1)


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, *[np.bincount(inverse, weights=c, minlength=len(unique)).astype(np.int64) for c in columns]


class _Counts:
    """Sums by key, kept until they are many."""

    def __init__(self, kind: int) -> None:
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, keys: np.ndarray, train: bool) -> None:
        if len(keys):
            unique, n = np.unique(keys, return_counts=True)
            self.parts.append((unique, n * train, n))
            self.size += len(unique)

    def taken(self, most: int) -> pa.RecordBatch | None:
        if not self.parts or self.size <= most:
            return None
        keys, train, total = _summed(*[np.concatenate(x) for x in zip(*self.parts)])
        self.parts, self.size = [(keys, train, total)], len(keys)
        if self.size <= most // 2:
            return None
        self.parts, self.size = [], 0
        n = len(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, self.kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(train), pa.array(total)],
            names=["kind", "key", "train", "total"],
        )


def corpus_counts(docs: DataFrame, text_col: str, train_col: str, depth: int) -> DataFrame:
    """``(kind, key, train, total)`` of words, byte runs and texts."""

    def run(batches):
        words, runs, n_train = _Counts(_WORD), _Counts(_RUN), 0
        for batch in batches:
            for piece in pieces(batch, text_col):
                flags = piece.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for train in (True, False):
                    part = piece.column(0).filter(pa.array(flags == train))
                    texts = Texts(part)
                    n_train += train * len(texts)
                    runs.add(byte_runs(texts, depth)[0], train)
                    if train:
                        starts, ends, _ = texts.words()
                        words.add(texts.hashes(starts, ends, fold=True), True)
                for counts in (words, runs):
                    if (out := counts.taken(_HELD)) is not None:
                        yield out
        for counts in (words, runs):
            if (out := counts.taken(0)) is not None:
                yield out
        one = lambda x, t: pa.array([x], t)
        yield pa.RecordBatch.from_arrays(
            [one(_TEXTS, pa.int8()), one(0, pa.int64()), one(n_train, pa.int64()), one(n_train, pa.int64())],
            names=["kind", "key", "train", "total"],
        )

    parts = docs.select(text_col, train_col).mapInArrow(run, "kind tinyint, key bigint, train bigint, total bigint")
    return parts.groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


# -- the tree ---------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers (Stirling's series)."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    low = x < 8
    y = np.where(low, x + 8, x)
    for k in range(8):
        shift += np.where(low, np.log(np.where(low, x + k, 1.0)), 0.0)
    inv = 1 / y
    series = inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 * (1 / 1260 - inv**2 / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that a Krichevsky-Trofimov estimator gives a sequence."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - np.log(np.pi)


class Level:
    """Bit nodes of the contexts of one depth; keys are context * 256 + node."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> None:
        self.keys, self.n0, self.n1 = keys, n0.astype(np.float64), n1.astype(np.float64)
        own = kt_log(self.n0, self.n1)
        self.log_weighted = own if below is None else np.logaddexp(own, below) + np.log(0.5)
        # The weight of the node's own estimate, after the training text.
        self.own_weight = np.ones_like(own) if below is None else np.exp(np.log(0.5) + own - self.log_weighted)

    @classmethod
    def above(cls, level: Level) -> Level:
        context, node = level.keys >> np.uint64(8), level.keys & np.uint64(255)
        keys, inverse = np.unique(((context >> np.uint64(8)) << np.uint64(8)) | node, return_inverse=True)
        sums = [np.bincount(inverse, weights=x, minlength=len(keys)) for x in (level.n0, level.n1, level.log_weighted)]
        return cls(keys, *sums)

    def mix(self, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probability of a one at these nodes; ``p`` is from below, NaN if nothing is there."""
        if not len(self.keys):
            return p
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = self.keys[at] == keys
        own = (self.n1[at] + 0.5) / (self.n0[at] + self.n1[at] + 1)
        w = self.own_weight[at]
        mixed = np.where(np.isnan(p), own, w * own + (1 - w) * p)
        return np.where(here, mixed, p)


def _bits(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and bits of the eight decisions of each byte, as two tables."""
    place = np.arange(8, dtype=np.uint64)
    s = symbols[:, None]
    node = (np.uint64(1) << place) | (s >> (np.uint64(8) - place))
    return node, (s >> (np.uint64(7) - place)) & np.uint64(1)


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels ``depth`` down to ``top`` over runs with their training counts."""
    seen = counts > 0
    keys, counts = keys[seen], counts[seen].astype(np.float64)
    node, bit = _bits(keys & np.uint64(255))
    flat = ((keys >> np.uint64(8) << np.uint64(8))[:, None] | node).ravel()
    unique, inverse = np.unique(flat, return_inverse=True)
    weight = np.repeat(counts, 8)
    ones = np.bincount(inverse, weights=weight * bit.ravel(), minlength=len(unique))
    both = np.bincount(inverse, weights=weight, minlength=len(unique))
    levels = [Level(unique, both - ones, ones, None)]
    for _ in range(depth - top):
        levels.append(Level.above(levels[-1]))
    return levels


def run_log10(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Log10 probability of each run's last byte; ``levels`` from the deepest to depth 0.

    A context that training never saw gives no estimate: the mixture then ends
    at the deepest one that was seen.
    """
    node, bit = _bits(keys & np.uint64(255))
    p = np.full(node.shape, np.nan)
    context = keys >> np.uint64(8)
    for level in levels:
        p = level.mix(((context << np.uint64(8))[:, None] | node).ravel(), p.ravel()).reshape(p.shape)
        context = context >> np.uint64(8)
    p = np.where(np.isnan(p), 0.5, p)
    return np.log10(np.where(bit == 1, p, 1 - p)).sum(axis=1)


def run_scores(runs: DataFrame, depth: int) -> DataFrame:
    """``(key, value)``: log10 probability of every run of ``(key, train)``."""
    grouped = runs.select("key", "train", F.shiftright("key", 8 * (depth - 1)).alias("_last"))
    top = 2

    def up(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(np.uint64)
        level = subtree(keys, table.column("train").to_numpy(), depth, top)[-1]
        return pa.table({
            "key": level.keys.view(np.int64), "n0": level.n0, "n1": level.n1, "weighted": level.log_weighted
        })

    second = grouped.groupBy("_last").applyInArrow(up, "key bigint, n0 double, n1 double, weighted double")
    # One more level: contexts of one byte, 256 times 255 nodes at most.
    one = F.shiftright("key", 16) * 256 + F.col("key") % 256
    first = second.groupBy(one.alias("key")).agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below")
    ).orderBy("key").toArrow()
    columns = [first[c].to_numpy() for c in ("n0", "n1", "below")]
    level_one = Level(first["key"].to_numpy().view(np.uint64), *columns)
    upper = [level_one, Level.above(level_one)]

    def down(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(np.uint64)
        levels = subtree(keys, table.column("train").to_numpy(), depth, top)
        return pa.table({"key": keys.view(np.int64), "value": run_log10(keys, [*levels, *upper])})

    return grouped.groupBy("_last").applyInArrow(down, "key bigint, value double")


# -- scoring ----------------------------------------------------------------

def _frequent(table: DataFrame, by: str, value: str, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and values of the most frequent entries, ``most`` at most, and the count from which they are."""
    step = F.floor(F.log2(by) * 4).cast("int")
    sizes = table.where(F.col(by) > 0).groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0), 1 << 62
    bound = next(c for c in range(max(1, int(2 ** (least / 4)) - 1), 1 << 62) if int(np.floor(np.log2(c) * 4)) >= least)
    # As Arrow: 16 bytes an entry, with no row objects on the way.
    found = table.where(F.col(by) >= bound).select("key", value).toArrow()
    return found["key"].to_numpy().view(np.uint64), found[value].to_numpy(), bound


def _grouped(keys: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each text with their counts, and where each text's begin."""
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))), bounds(owners[at], n)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, frequent: int = FREQUENT,
    folds: int = FOLDS, held_out: int = HELD_OUT,
) -> DataFrame:
    """Unigram base and context-tree score of every row.

    Columns: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` (log10 probability of the folded text and its
    end), ``bits_per_byte``.

    Learns from rows whose id (as text; null as '') has a CRC-32 that leaves
    another remainder than ``held_out``.  A null text is empty: one token, the
    end.  Repeated rows are counted and scored one by one.  With nothing to
    learn from, every bit has probability one half.  Other columns are left
    out; an empty table gives no rows.
    """
    crc = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    flagged = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"),
        (crc % folds != held_out).alias("_train"),
    )
    counts = stored(corpus_counts(flagged, "_text", "_train", depth))
    words = counts.where(F.col("kind") == _WORD).select("key", "train")
    runs = counts.where(F.col("kind") == _RUN).select("key", "train", "total")
    of_kind = {r["kind"]: r for r in counts.groupBy("kind").agg(F.count("*").alias("n"), F.sum("train").alias("train")).collect()}
    n_texts = of_kind[_TEXTS]["train"] if _TEXTS in of_kind else 0
    n_words, n_distinct = (of_kind[_WORD]["train"], of_kind[_WORD]["n"]) if _WORD in of_kind else (0, 0)
    n_all, distinct = n_words + n_texts, n_distinct + (n_texts > 0)
    if _RUN in of_kind:
        values = stored(run_scores(runs.select("key", "train"), depth).join(runs.select("key", "total"), "key"))
    else:
        values = stored(runs.select("key", F.lit(0.0).alias("value"), "total"))
    word_table = words.select("key", "train", F.log10(F.col("train") + 1.0).alias("value"))
    word_keys, word_values, word_bound = _frequent(word_table, "train", "value", frequent)
    run_keys, run_values, run_bound = _frequent(values, "total", "value", frequent)
    sc = docs.sparkSession.sparkContext
    tables = sc.broadcast((word_keys, word_values.astype(np.float64), run_keys, run_values.astype(np.float64)))
    id_type = flagged.schema["_id"].dataType.simpleString()
    end_value = float(np.log10(n_texts + 1))

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        keys_w, values_w, keys_r, values_r = tables.value
        known_words, known_runs = Lookup(keys_w, values_w), Lookup(keys_r, values_r)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                texts = Texts(piece.column(1))
                n = len(texts)
                starts, ends, owners = texts.words()
                h = texts.hashes(starts, ends, fold=True)
                found, hit = known_words.find(h)
                tokens = np.bincount(owners, minlength=n) + 1
                base = np.bincount(owners, weights=found, minlength=n) + end_value
                known = np.bincount(owners[hit], minlength=n) + (n_texts > 0)
                rare_w, count_w, edge_w = _grouped(h[~hit], owners[~hit], n)
                keys, of = byte_runs(texts, depth)
                found, hit = known_runs.find(keys)
                own = np.bincount(of, weights=found, minlength=n)
                rare_r, count_r, edge_r = _grouped(keys[~hit], of[~hit], n)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), pa.array(np.arange(uid, uid + n)), piece.column(2), pa.array(texts.n_bytes),
                        pa.array(tokens), pa.array(known), pa.array(base), pa.array(own),
                        list_array(rare_w.view(np.int64), edge_w), list_array(count_w, edge_w),
                        list_array(rare_r.view(np.int64), edge_r), list_array(count_r, edge_r),
                    ],
                    names=["_id", "uid", "_train", "n_bytes", "n_tokens", "known", "base", "own",
                           "words", "word_counts", "runs", "run_counts"],
                )
                uid += n

    schema = (
        f"_id {id_type}, uid bigint, _train boolean, n_bytes bigint, n_tokens bigint, known bigint, base double, "
        "own double, words array<bigint>, word_counts array<bigint>, runs array<bigint>, run_counts array<bigint>"
    )
    rows = stored(flagged.select("_id", "_text", "_train").mapInArrow(run, schema))

    def rest(keys: str, counted: str, table: DataFrame, name: str) -> DataFrame:
        pairs = rows.select("uid", F.explode(F.arrays_zip(keys, counted)).alias("z")).select(
            "uid", F.col(f"z.{keys}").alias("key"), F.col(f"z.{counted}").alias("n")
        )
        joined = pairs.join(table, "key", "left")
        return joined.groupBy("uid").agg(
            F.sum(F.col("n") * F.coalesce("value", F.lit(0.0))).alias(f"{name}_more"),
            F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias(f"{name}_known"),
        )

    more_words = rest("words", "word_counts", word_table.where(F.col("train") < word_bound).select("key", "value"), "base")
    more_runs = rest("runs", "run_counts", values.where(F.col("total") < run_bound).select("key", "value"), "own")
    out = rows.select("_id", "uid", "_train", "n_bytes", "n_tokens", "known", "base", "own")
    out = out.join(more_words, "uid", "left").join(more_runs, "uid", "left")
    total = F.col("own") + F.coalesce("own_more", F.lit(0.0))
    return out.select(
        F.col("_id").alias(id_col), (~F.col("_train")).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("base_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))
         - F.col("n_tokens") * F.lit(float(np.log10(n_all + distinct + 1)))).alias("base_score"),
        total.alias("score"), (-total / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
