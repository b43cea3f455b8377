"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped edges.

One hash of each shingle serves all bins of a signature: the hash range is cut
into bins and a bin keeps its least hash.  An empty bin takes the value of a
bin that a hash of (bin, attempt) points to, the first that is not empty
(optimal densification), so that equal places agree with probability equal to
the similarity.  Bands of such places are bucket keys.

Equal sets are one class from the start.  In a bucket, members are compared
with a few centres only: those that share most buckets with others.  Documents
of buckets that still span several components are joined exactly, by prefix
filtering, so no pair of a bucket is lost and none is listed in vain.

Links count only when the full sets confirm them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import small_side, spread_lookup, stored
from .components import components
from .texts import Texts, bounds, by_piece, list_array, mixed, shingles

BANDS = 40
ROWS = 6
CENTRES = 4
PERCENT = 80
#: Edges of one centre that a task confirms; a centre with more is copied.
HOT_EDGES = 2_000

_U = np.uint64


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their bounds.

    A text of fewer words than ``size`` has its whole sequence as one shingle;
    a text without words has none.
    """
    starts, ends, owners = texts.words()
    h = texts.hashes(starts, ends, fold=True)
    n = len(texts)
    found, of = shingles(h, owners, size)
    words = np.bincount(owners, minlength=n)
    edge = bounds(owners, n)
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        with np.errstate(over="ignore"):
            whole = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = words[short] > k
                whole[has] = mixed(whole[has] * _U(5) + h[edge[short[has]] + k] + _U(k + 1))
        found, of = np.concatenate([found, whole]), np.concatenate([of, short])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[new], of[new]
    return found, bounds(of, n)


def _donor(empty: np.ndarray, attempt: int, bins: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(empty.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(attempt)) >> _U(33)).astype(np.int64) % bins


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signature of a non-empty sorted set of hashes."""
    place = (((hashes >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[place[first]], full[place[first]] = hashes[first], True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        attempt += 1
        # Chance alone would do; past this, the next full bin in turn.
        donor = _donor(empty, attempt, bins) if attempt < 64 * bins else (empty + attempt) % bins
        hit = full[donor]
        out[empty[hit]] = out[donor[hit]]
        empty = empty[~hit]
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = values.reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for r in range(rows):
            key = mixed(key * _U(7) + grid[:, r])
    return key


def _linkable(n: int, percent: int) -> bool:
    """Whether a set of ``n`` can be linked with a different one."""
    return 100 * n >= percent * (n + 1) or 100 * (n - 1) >= percent * n


def _signed(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int, percent: int) -> DataFrame:
    """Per row: set size, two words that name the set, and its band keys."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(1))
        found, edge = shingle_sets(texts, size)
        n = len(texts)
        keys, at = [], np.zeros(n + 1, np.int64)
        names = np.zeros((n, 2), np.uint64)
        for i in range(n):
            own = found[edge[i] : edge[i + 1]]
            if len(own):
                with np.errstate(over="ignore"):
                    names[i] = own.sum(), mixed(own ^ _U(0xA0761D6478BD642F)).sum() + _U(len(own))
            if len(own) and _linkable(len(own), percent):
                keys.append(band_keys(signature(own, bands * rows), bands, rows))
            at[i + 1] = at[i] + (bands if keys and len(own) and _linkable(len(own), percent) else 0)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(np.diff(edge)), pa.array(names[:, 0].view(np.int64)),
                pa.array(np.ascontiguousarray(names[:, 1]).view(np.int64)) if n else pa.array([], pa.int64()),
                list_array(flat.view(np.int64), at),
            ],
            names=[id_col, "n_shingles", "name_a", "name_b", "bands"],
        )

    schema = f"`{id_col}` bigint, n_shingles bigint, name_a bigint, name_b bigint, bands array<bigint>"
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias(id_col), text_col).mapInArrow(
        by_piece(work, text_col), schema
    )


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(rep, elements)`` for the documents whose id is in ``wanted(rep)``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(batch.column(1))
        found, edge = shingle_sets(texts, size)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), list_array(found.view(np.int64), edge)], names=["rep", "elements"]
        )

    ids, _ = small_side(wanted)
    part = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("rep"), text_col).join(ids, "rep", "left_semi")
    # Rows that share an id are one document: its set is that of its least text.
    return part.mapInArrow(by_piece(work, text_col), "rep bigint, elements array<bigint>")


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``edges(a, b)`` whose sets are similar enough."""
    # Only the sets of these edges move.
    ids = edges.select(F.col("a").alias("rep")).unionByName(edges.select(F.col("b").alias("rep"))).distinct()
    sets = sets.join(small_side(ids)[0], "rep", "left_semi")
    members = sets.select(F.col("rep").alias("b"), F.col("elements").alias("y"))
    centres = sets.join(edges.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("edges")), "rep")
    centres = centres.select(F.col("rep").alias("a"), F.col("elements").alias("x"), "edges")
    # Members stay where their sets are; a centre of very many goes there in copies.
    joined = spread_lookup(edges.join(members, "b"), centres, ["a"], "b", "edges", HOT_EDGES)
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return joined.where(100 * shared >= percent * union).select("a", "b")


def _split(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that span several components, with these; stored."""
    placed = members.join(found, members["rep"] == found["node"], "left").select(
        "key", "rep", "n", "company", F.coalesce("component", "rep").alias("component")
    )
    spread = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return stored(placed.join(spread.where("low < high").select("key"), "key", "left_semi"))


def _prefix_pairs(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of ``docs(rep, n, component)`` that may be similar, of different components.

    Prefix filtering: with shingles in one order, rarest first, similar sets
    share one among the first few of each; fewer suffice for the smaller set.
    Where their first common shingle stands also bounds what they can share.
    A passage that very many documents hold comes late in this order.
    """
    parts = sets.join(docs, "rep").select("rep", "n", "component", F.explode("elements").alias("h"))
    common = parts.groupBy("h").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "h"))
    up = lambda x, by: F.floor((x + by - 1) / by)
    n = F.col("n")
    ranked = parts.join(common, "h").withColumn("pos", place).where("df > 1")
    prefix = stored(ranked.where(F.col("pos") <= n - up(percent * n, 100) + 1))
    small = prefix.where(F.col("pos") <= n - up(2 * percent * n, 100 + percent) + 1)
    left = small.select("h", *[F.col(c).alias(f"{c}_a") for c in ("rep", "n", "component", "pos")])
    right = prefix.select("h", *[F.col(c).alias(f"{c}_b") for c in ("rep", "n", "component", "pos")])
    need = up(percent * (F.col("n_a") + F.col("n_b")), 100 + percent)
    most = 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("rep_a") < F.col("rep_b")))
    fits = ordered & (F.col("component_a") != F.col("component_b"))
    fits = fits & (100 * F.col("n_a") >= percent * F.col("n_b")) & (most >= need)
    return left.join(right, "h").where(fits).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT,
    bands: int = BANDS, rows: int = ROWS, centres: int = CENTRES,
) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * shared >= ``percent`` * union of their sets
    of ``size``-word shingles (A-Z folded); ``component_id`` is the smallest id
    reachable and ``kept`` tells whether it is the row's own.

    Null or empty texts and texts without words have no shingles and stay
    alone.  Rows with a null id are kept, with a null component, and never
    linked.  Repeated rows fall into one class; rows of equal id count as one
    document (give ids that differ to documents that differ).  Other columns
    are left out.  An empty table gives no rows.
    """
    rows_ = stored(_signed(docs, id_col, text_col, size, bands, rows, percent))
    named = rows_.where(f"`{id_col}` is not null and n_shingles > 0")
    classes = stored(
        named.groupBy("name_a", "name_b").agg(
            F.min(id_col).alias("rep"), F.any_value("bands").alias("bands"), F.max("n_shingles").alias("n")
        )
    )
    placed = classes.select("rep", "n", F.explode("bands").alias("key"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(placed.join(sizes, "key"))
    # The text that others were made from meets more of them than they meet each
    # other, so members with most company are centres first.
    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    members = stored(members.drop("size").join(company, "rep"))
    first = members.groupBy("key").agg(F.max_by("rep", F.struct("company", -F.col("rep"))).alias("centre"))

    # First, each member meets the centre that it shares most buckets with.
    votes = members.join(first, "key").where("rep != centre").groupBy("rep", "centre").agg(F.count("*").alias("n"))
    edges = votes.groupBy("rep").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("centre"))
    edges = edges.select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    sets = stored(_sets(docs, members.select("rep").distinct(), id_col, text_col, size).dropDuplicates(["rep"]))
    links = stored(_confirmed(edges, sets, percent))
    tested, found = stored(edges), components(links)
    current = _split(members, found)
    if not current.isEmpty():
        # Then, what is still apart in a bucket meets some more centres.
        order = Window.partitionBy("key").orderBy(F.desc("company"), "rep")
        served = current.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= centres)
        served = served.select("key", F.col("rep").alias("a"), F.col("component").alias("of"), F.col("n").alias("m"))
        # Sets whose sizes differ too much cannot be similar.
        sized = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
        fresh = (
            current.join(served, "key").where(F.col("rep") != F.col("a")).where("component != of").where(sized)
            .select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
        )
        known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = stored(_confirmed(stored(fresh.join(known, ["a", "b"], "left_anti")), sets, percent))
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(links)
        current = _split(members, found)
    if not current.isEmpty():
        # Last, an exact join among the documents of crowded buckets.
        rest = current.select("rep", "n", "component").distinct()
        more = stored(_confirmed(stored(_prefix_pairs(rest, sets, percent)), sets, percent))
        if not more.isEmpty():
            found = components(links.unionByName(more))
    # Members of a class follow the class's least id.
    of_class = classes.join(found, classes["rep"] == found["node"], "left").select(
        "name_a", "name_b", F.coalesce("component", "rep").alias("component")
    )
    alone = F.col("n_shingles") == 0
    out = rows_.drop("bands").join(of_class, ["name_a", "name_b"], "left")
    component = F.when(F.col(id_col).isNull(), F.lit(None)).when(alone, F.col(id_col)).otherwise(F.col("component"))
    return out.select(
        id_col, "n_shingles", component.cast("bigint").alias("component_id"),
        F.coalesce(F.col(id_col) == component, F.lit(True)).alias("kept"),
    )
