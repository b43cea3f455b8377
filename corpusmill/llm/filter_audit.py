"""How filters overlap: what each order of applying them removes, and where.

Every document fails some of five filters; which ones is its mask.  Documents
are counted by part and mask, at most 32 cells a part.  A cell is then carried
through all 120 orders by higher-order functions: ``transform`` over the array
of orders, ``aggregate`` along each of them.  That gives 600 structs a cell,
which are weighted by the cell's counts and summed place by place.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
WORD = r"[^\x20\x09-\x0D]+"
FEWEST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
SYMBOLS = "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Rows without an id are dealt to so many keys when labels are joined.
NULL_SLOTS = 1024

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_mask(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words = F.size(words)
    few = n_words < FEWEST_WORDS
    repeats = 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n_words
    capitals = F.length(text) - F.length(F.translate(text, _LETTERS, ""))
    loud = 100 * capitals > MOST_CAPITALS_PERCENT * F.length(text)
    failed = (few, repeats, loud, text.rlike(SYMBOLS))
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)]
    return sum(bits[1:], bits[0])


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, true where any label of the id says so."""
    marks = labels.where(f"`{id_col}` is not null").groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    # Rows without an id have no label; the slot only keeps them apart.
    slot = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NULL_SLOTS))).otherwise(F.lit(0))
    found = rows.withColumn("slot", slot).join(marks.withColumn("slot", F.lit(0).cast("bigint")), ["id", "slot"], "left")
    return found.drop("slot").fillna(False, ["good", "toxic"])


def mask_cells(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """``(part, mask, n, good, toxic)``: how many documents fail just these filters.

    Filter E (bit 4) is that a smaller id has the same text.  Texts are told
    apart by SHA-256.  Copies are counted by id first and by text then, so the
    group of a text that very many documents share is a few rows when it meets.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        own_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    cell = ["digest", "part", "mask", "good", "toxic"]
    by_id = _labelled(rows, labels, id_col).groupBy(*cell, "id").agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    by_text = by_id.groupBy(*cell).agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(known, F.lit(0)).otherwise(F.col("n"))).alias("nameless"),
        F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"),
    )
    # Rows of the least id of all, and rows without one, have no smaller copy.
    least = F.min("low").over(Window.partitionBy("digest"))
    first = F.when(F.col("low") == least, F.col("n_low")).otherwise(0)
    split = by_text.withColumn("first", first).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), (F.col("first") + F.col("nameless")).alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
        )).alias("c"),
    )
    weighed = [F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return split.where("c.n > 0").groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), *weighed)


def _zeros() -> list[Column]:
    return [F.lit(0).cast("bigint").alias(c) for c in COUNTS]


def _walk(cell: Column, order: Column) -> Column:
    """What happens to a cell's documents at each step of one order."""
    fails_once = F.bit_count(cell["mask"]) == 1

    def step(state: Column, place: Column) -> Column:
        fails, gone = F.getbit(cell["mask"], place) == 1, state["gone"]
        here = fails & ~gone

        def counted(when: Column, what: str) -> Column:
            return F.when(when, cell[what]).otherwise(F.lit(0).cast("bigint"))

        values = (
            counted(~fails & ~gone, "n"), counted(here, "n"), counted(fails & gone, "n"),
            counted(fails & fails_once, "n"), counted(here, "good"), counted(here, "toxic"),
        )
        done = F.struct(*[v.alias(c) for c, v in zip(COUNTS, values)])
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(done)).alias("steps"))

    none = F.slice(F.array(F.struct(*_zeros())), 1, 0)
    start = F.struct(F.lit(False).alias("gone"), none.alias("steps"))
    return F.aggregate(order, start, step, lambda state: state["steps"])


def fold_orders(cells: DataFrame) -> DataFrame:
    """One row per part, order and step from ``(part, mask, n, good, toxic)``."""
    orders = F.array(*[F.array(*[F.lit(i) for i in o]) for o in ORDERS])
    width = len(FILTERS)

    def added(a: Column, b: Column) -> Column:
        return F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])

    def merged(total: Column, cell: Column) -> Column:
        return F.zip_with(total, F.flatten(F.transform(orders, lambda o: _walk(cell, o))), added)

    zero = F.array_repeat(F.struct(*_zeros()), width * len(ORDERS))
    # A part has at most 2 ** 5 cells, so its list is short whatever the table.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    summed = parts.select("part", F.aggregate("cells", zero, merged).alias("steps"))
    flat = F.flatten(orders)

    def over_orders(letter: Column) -> Column:
        own = F.filter(F.arrays_zip(F.col("steps").alias("s"), flat.alias("f")), lambda x: x["f"] == letter)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, x: total + x["s"]["removed"])

    shares = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), over_orders)
    names = F.array(*[F.lit("".join(FILTERS[i] for i in o)) for o in ORDERS])
    rows = summed.withColumn("shares", shares).select("part", "shares", F.posexplode("steps").alias("at", "s"))
    return rows.select(
        "part", F.get(names, (F.col("at") / width).cast("int")).alias("filter_order"),
        (F.col("at") % width + 1).cast("int").alias("step"), *[F.col(f"s.{c}").alias(c) for c in COUNTS],
        F.get("shares", F.get(flat, F.col("at"))).alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """Per part, order and step: what the filter there keeps, removes and shares.

    Columns: ``part``, ``filter_order``, ``step``, ``kept``, ``removed``,
    ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``
    (documents that the step's filter removes, summed over all orders).

    A null text is empty, a null part the empty string.  A row without an id
    has no label and no smaller copy; rows that repeat an id and a text are
    counted each, and none is the other's copy.  An id with several labels
    counts as good or toxic if any of them says so.  Other columns, whatever
    their names, are left out.  An empty table gives no rows.
    """
    return fold_orders(mask_cells(docs, labels, id_col, text_col, part_col))
