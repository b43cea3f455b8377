"""Packing documents into sequences of at most ``CAPACITY`` tokens.

Only lengths are packed.  Pieces shorter than a sequence are dealt to groups of
bounded size; each group runs best-fit decreasing and compares its bin count
with a lower bound from dual-feasible functions.  Where count and bound differ,
the group gives up its emptiest bins; the documents in these meet those of
other groups and are packed again, and the new packing counts if it needs fewer
bins.  Certified groups give up only their last bin, as rounding up in every
group costs the whole as well.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import stored
from .texts import Lookup, Texts, pieces, released

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
GROUP_ITEMS = 100_000
ROUNDS = 3
CACHED_WORDS = 500_000
CACHED_IDS = 4_000_000
PIECE_BYTES = 1 << 20


# -- token ids --------------------------------------------------------------

class Encoder:
    """Ids of whole texts; each distinct pre-token is encoded once while cached.

    The boundaries of pre-tokens follow the vocabulary's own splitting pattern
    (contractions, letters, numbers, other characters, white space); classes of
    characters are asked from the tokenizer itself.
    """

    LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
    SHORT, LONG = "stmd", ("re", "ve", "ll")

    def __init__(self, path: str) -> None:
        # Spark runs as many tasks as there are cores already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.zeros(0x110000, np.uint8)
        self._forget()

    def _forget(self) -> None:
        """Start the cache of pre-tokens afresh: keys to numbers, numbers to ids."""
        if not hasattr(self, "ids"):
            self.first, self.size = np.zeros(CACHED_WORDS, np.int32), np.zeros(CACHED_WORDS, np.int32)
            self.ids = np.zeros(CACHED_IDS, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.known = Lookup(np.zeros(0, np.uint64), np.zeros(0, np.int32), CACHED_WORDS)
        self.n_ids = 0

    def _learn(self, texts: Texts, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encode distinct pre-tokens that are not known yet."""
        raw = texts.data.tobytes()
        sizes, ids = [], []
        for a in range(0, len(keys), 4096):
            words = [raw[i:j].decode() for i, j in zip(begin[a : a + 4096].tolist(), end[a : a + 4096].tolist())]
            for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
                sizes.append(len(e.ids))
                ids.extend(e.ids)
        sizes, a, b = np.array(sizes, np.int32), self.known.size, self.known.size + len(keys)
        # Room grows only for a single piece with more than is kept otherwise.
        if b > len(self.size):
            self.first, self.size = np.resize(self.first, b), np.resize(self.size, b)
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, self.n_ids + len(ids))
        self.known.add(keys, np.arange(a, b, dtype=np.int32))
        self.first[a:b], self.size[a:b] = self.n_ids + np.cumsum(sizes, dtype=np.int32) - sizes, sizes
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)

    def _classify(self, codes: np.ndarray) -> None:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for code in np.unique(codes[self.kind[codes] == 0]).tolist():
            c = chr(code)
            found = next(
                (k for k, x in ((self.LETTER, "a"), (self.NUMBER, "1"), (self.OTHER, "!")) if len(split(x + c + x)) == 1),
                self.SPACE,
            )
            self.kind[code] = found

    def starts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens start, in bytes, and the texts they are of."""
        data = texts.data
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        self._classify(codes)
        kind = self.kind[codes]
        n = len(codes)
        head = np.zeros(n, bool)
        head[np.searchsorted(place, texts.offsets[:-1][texts.n_bytes > 0])] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= head
        is_space = kind == self.SPACE
        # The last of several white-space characters stands apart from the others;
        # a plain space belongs to what follows.
        follows = np.zeros(n, bool)
        follows[:-1] = is_space[:-1] & ~is_space[1:] & ~head[1:]
        joined = np.zeros(n, bool)
        joined[1:] = (codes[:-1] == 32) & follows[:-1]
        start = (change | follows) & ~joined
        # 's, 't, 're and so on, where the apostrophe starts a pre-token.
        quote = np.flatnonzero((codes == 39) & start)
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == self.LETTER) & ~head[quote + 1]]
        if len(quote):
            one = codes[quote + 1]
            two = np.where(quote + 2 < n, codes[np.minimum(quote + 2, n - 1)], 0)
            two[(quote + 2 < n) & head[np.minimum(quote + 2, n - 1)]] = 0
            short = np.isin(one, [ord(c) for c in self.SHORT])
            long = np.zeros(len(quote), bool)
            for a, b in self.LONG:
                long |= (one == ord(a)) & (two == ord(b))
            for chosen, width in ((short, 2), (long & ~short, 3)):
                at = quote[chosen]
                start[at + 1] = False
                at = at[at + width < n] + width
                start[at] = True
        first = np.flatnonzero(start)
        begin = place[first]
        return begin, texts.owner(begin)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        texts = Texts(column)
        n = len(texts)
        if not len(texts.data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        begin, owner = self.starts(texts)
        end = np.append(begin[1:], len(texts.data))
        h = texts.hashes(begin, end)
        number, hit = self.known.find(h)
        if not hit.all():
            keys, first = np.unique(h[~hit], return_index=True)
            # An id stands for a byte at least.
            size = int((end - begin)[~hit][first].sum())
            if self.known.size + len(keys) > CACHED_WORDS or self.n_ids + size > CACHED_IDS:
                self._forget()
                hit[:] = False
                keys, first = np.unique(h, return_index=True)
                if len(keys) > CACHED_WORDS:
                    self.known = Lookup(np.zeros(0, np.uint64), np.zeros(0, np.int32), len(keys))
            self._learn(texts, keys, begin[~hit][first], end[~hit][first])
            number, _ = self.known.find(h)
        lens = self.size[number].astype(np.int64)
        stop = np.cumsum(lens)
        ids = self.ids[np.repeat(self.first[number] - (stop - lens), lens) + np.arange(int(stop[-1]))].astype(np.uint32)
        counts = np.bincount(owner, weights=lens, minlength=n).astype(np.int64)
        # Names of special tokens inside a text are that token to the library.
        raw = None
        for name in self.special:
            raw = texts.data.tobytes() if raw is None else raw
            if name.encode() in raw:
                listed = [t or "" for t in column.to_pylist()]
                ends = np.cumsum(counts)
                rows = [ids[e - c : e] for e, c in zip(ends, counts)]
                for i, t in enumerate(listed):
                    if any(s in t for s in self.special):
                        rows[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        return ids, counts


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process: a new one for each task would not give back the old one's memory."""
    return Encoder(path)


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of ``n`` tokens: whole ones, after a shorter first."""
    short = n % capacity
    return [0] * bool(short) + list(range(short, n, capacity))


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """Pieces of every document: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``uid``.

    ``uid`` numbers the pieces; it is fixed once the result is stored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(public_tokenizers.path(tokenizer)).encode
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch, text_col, PIECE_BYTES):
                ids, counts = encode(part.column(1))
                stops = np.cumsum(counts)
                row, number, start, length, crc = [], [], [], [], []
                for i, (stop, count) in enumerate(zip(stops.tolist(), counts.tolist())):
                    raw = ids[stop - count : stop].astype("<u4").tobytes() + end
                    points = cut_points(count + 1, capacity)
                    for k, (a, b) in enumerate(zip(points, [*points[1:], count + 1])):
                        row.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                        pa.array(np.arange(uid, uid + len(row))),
                    ],
                    names=[id_col, "piece", "start", "length", "ids_crc32", "uid"],
                )
                uid += len(row)

    schema = f"`{id_col}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, uid bigint"
    return docs.select(id_col, text_col).mapInArrow(released(run), schema)


# -- packing ----------------------------------------------------------------

def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """A bin for every item, and how many bins there are.

    Bins are kept by their free space; the set of free spaces is one integer's bits.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, n_bins = 0, 0
    out = np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        above = spaces >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            chosen = free[space].pop()
            if not free[space]:
                spaces &= ~(1 << space)
        else:
            space, chosen = capacity, n_bins
            n_bins += 1
        out[i] = chosen
        if space > size:
            free[space - size].append(chosen)
            spaces |= 1 << (space - size)
    return out, n_bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by two families of dual-feasible functions.

    One rounds sizes down to multiples of ``capacity / k`` unless they are such a
    multiple; the other counts items above ``capacity - e`` as full and drops
    those below ``e``.  Sums of either over a full bin never exceed 1.
    """
    counts = np.bincount(lengths, minlength=capacity + 1).astype(object)
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    for k in range(1, 101):
        # Values times k * capacity, to stay with integers.
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    n = np.cumsum(counts)
    total = np.cumsum(counts * sizes)
    for e in range(1, capacity // 2 + 1):
        big = int(n[capacity] - n[capacity - e])
        middle = int(total[capacity - e] - total[e - 1])
        best = max(best, big + -(-middle // capacity))
    return best


def _packed(lengths: np.ndarray, old: np.ndarray | None, capacity: int):
    """A packing no worse than ``old``, its bins, and which bins to give up."""
    bins, n = best_fit_decreasing(lengths, capacity)
    if old is not None:
        kept, again = np.unique(old, return_inverse=True)
        if len(kept) <= n:
            bins, n = again.astype(np.int64), len(kept)
    bound = lower_bound(lengths, capacity)
    fill = np.bincount(bins, weights=lengths, minlength=n)
    given = np.zeros(n, bool)
    if n > bound:
        # Enough bins that repacking could save the gap, at least a tenth.
        given[np.argsort(fill, kind="stable")[: max(2 * (n - bound), n // 10, 2)]] = True
    elif n:
        given[np.argmin(fill)] = True
    given &= fill < capacity
    return bins, n, bound, given


def _round(items: DataFrame, groups: int, first: bool, capacity: int) -> DataFrame:
    """Pack ``(uid, length[, bin])`` group by group; ``bin`` numbers are global."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("uid", "ascending")])
        lengths = table.column("length").to_numpy()
        old = None if first else table.column("bin").to_numpy()
        bins, _, _, given = _packed(lengths, old, capacity)
        # A bin is known by the smallest uid in it, so numbers never clash.
        uid = table.column("uid").to_numpy()
        name = np.full(len(given), np.iinfo(np.int64).max)
        np.minimum.at(name, bins, uid)
        return pa.table({"uid": uid, "length": lengths, "bin": name[bins], "given": given[bins]})

    by = "uid" if first else "bin"
    dealt = items.withColumn("_group", F.pmod(F.xxhash64(F.lit(int(first)), by), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(
        pack, "uid bigint, length bigint, bin bigint, given boolean"
    )


def pack_pieces(
    sized: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with ``uid`` and ``length``."""
    whole = sized.where(F.col("length") >= capacity).withColumn("sequence_id", F.col("uid") * 2 + 1)
    whole = whole.withColumn("offset", F.lit(0).cast("bigint"))
    items = sized.where(F.col("length") < capacity).select("uid", "length")
    count, first, done = items.count(), True, []
    for _ in range(rounds):
        if not count:
            break
        groups = max(1, -(-count // group_items))
        found = stored(_round(items, groups, first, capacity))
        done.append(found.where("not given").select("uid", "length", "bin"))
        items, first = found.where("given").select("uid", "length", "bin"), False
        count = items.count()
        if groups == 1:
            break
    if count:
        done.append(items)
    if not done:
        return whole
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)

    def offsets(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bin", "ascending"), ("length", "descending"), ("uid", "ascending")])
        bins, lengths = table.column("bin").to_numpy(), table.column("length").to_numpy()
        before = np.cumsum(lengths) - lengths
        head = np.append(True, bins[1:] != bins[:-1]) if len(bins) else np.zeros(0, bool)
        start = before[head][np.cumsum(head) - 1]
        return pa.table({"uid": table.column("uid"), "sequence_id": pa.array(bins * 2), "offset": pa.array(before - start)})

    total = sized.count()
    spread = F.pmod(F.xxhash64("bin"), F.lit(max(1, -(-total // group_items) * 8)))
    placed = placed.withColumn("_group", spread).groupBy("_group").applyInArrow(
        offsets, "uid bigint, sequence_id bigint, offset bigint"
    )
    return sized.where(F.col("length") < capacity).join(placed, "uid").unionByName(whole.select(*sized.columns, "sequence_id", "offset"))


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """Pack all documents; one row per piece.

    Columns: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    A null text is empty and still has its end token; null ids and repeated
    rows are packed like others, each row on its own; equal lengths are placed
    in the order of stored row numbers; an empty table gives no rows; other
    columns are left out.
    """
    sized = stored(token_pieces(docs, id_col, text_col, tokenizer, capacity, end_id))
    return pack_pieces(sized, capacity).drop("uid")
