"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue, repeated ``epochs`` times.  A
document's virtual finish time is the number of tokens its source has sent up
to and with it, divided by the source's weight.  All queues together are cut
in the order of finish times where the total budget is used up, so a source
that runs dry leaves its share to the others by their weights.

Cumulative sums never run over a whole source: the shuffle key's first hex
digits cut a queue into ``16 ** digits`` blocks, block totals are summed first,
and a window runs inside each block.  The cut is found by narrowing an interval
of finish times: only totals of 4,096 buckets reach the driver at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
_CELLS = 4096
_FEW = 20_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Targets of ``(src, source_size)``, one row per source.

    Weights go round by the order of ``src``.  The budget, ``share`` times all
    sizes, is dealt by weight; a source takes ``epochs`` times its size at
    most and what it cannot take is dealt again.  That is: ``least(cap, level *
    weight)`` with the level that uses up the budget.  The table has one row
    per source, so its windows are small next to the documents.
    """
    order = Window.orderBy("src")
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(whole) * share)
        .withColumn("caps", F.sum("cap").over(by_ratio))
        .withColumn("rest", F.sum("weight").over(whole) - F.sum("weight").over(by_ratio))
    )
    full = F.col("caps") + F.col("cap") / F.col("weight") * F.col("rest") <= F.col("budget")
    ranked = ranked.withColumn("full", full)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    return ranked.withColumn(
        "target", F.when(F.col("full"), F.col("cap")).otherwise(left / open_weight * F.col("weight"))
    ).select("src", "source_size", "weight", "target", "place", "budget")


def queued(sized: DataFrame, digits: int = 3, **mix) -> DataFrame:
    """Rows of ``(src, size, key, tie)`` with ``finish``, the first copy's finish time."""
    rows = sized.withColumn("block", F.substring("key", 1, digits))
    totals = rows.groupBy("src", "block").agg(F.sum("size").alias("block_size"))
    targets = source_targets(totals.groupBy("src").agg(F.sum("block_size").alias("source_size")), **mix)
    before = F.sum("block_size").over(Window.partitionBy("src").orderBy("block")) - F.col("block_size")
    heads = totals.withColumn("before", before).drop("block_size").join(targets, "src")
    inside = Window.partitionBy("src", "block").orderBy("key", "tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        rows.withColumn("within", F.sum("size").over(inside))
        .join(heads, ["src", "block"])
        .withColumn("sent", F.col("before") + F.col("within"))
        .withColumn("finish", F.col("sent") / F.col("weight"))
    )


def _copies(rows: DataFrame, epochs: int) -> DataFrame:
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    return rows.where("size > 0").select(
        "src", "place", "key", "tie", "size", "sent", "source_size", "weight", "budget", epoch
    ).withColumn("finish", (F.col("sent") + F.col("epoch") * F.col("source_size")) / F.col("weight"))


def _cut(copies: DataFrame) -> tuple[float, int] | None:
    """The last finish time (and the source's place) that the budget covers."""
    top = copies.agg(F.max("finish"), F.max("budget")).first()
    if top[0] is None:
        return None
    low, high, used, budget = 0.0, math.nextafter(top[0], math.inf), 0, top[1]
    while True:
        width = (high - low) / _CELLS
        cell = F.least(F.floor((F.col("finish") - low) / width), F.lit(_CELLS - 1))
        part = copies.where((F.col("finish") >= low) & (F.col("finish") < high))
        found = part.groupBy(cell.alias("cell")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n"),
            F.min("finish").alias("first"), F.max("finish").alias("last"),
        ).orderBy("cell").collect()
        over = None
        for row in found:
            if used + row["size"] > budget:
                over = row
                break
            used += row["size"]
        if over is None:
            return math.inf, 0
        low, high = over["first"], math.nextafter(over["last"], math.inf)
        if over["n"] <= _FEW or over["first"] == over["last"]:
            break
    last, rows = (-1.0, 0), copies.where((F.col("finish") >= low) & (F.col("finish") < high))
    for row in rows.select("finish", "place", "size").orderBy("finish", "place").toLocalIterator():
        used += row["size"]
        if used > budget:
            break
        last = (row["finish"], row["place"])
    return last if last[0] >= 0 else (math.nextafter(low, -math.inf), 1 << 30)


def fair_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, keep_text: bool = False,
) -> DataFrame:
    """How often the mixture takes each document.

    Per row: id, ``size`` (words), ``source_size``, ``target``, ``taken`` (words
    taken, repeats counted), ``n_copies``, ``finish`` (of the first copy).  With
    ``keep_text`` all columns of ``docs`` come too.

    A null text has size 0 and is never taken; a null source is a source of its
    own, after all others; a null id is an id like another.  Repeated rows are
    taken one by one.  Ties in finish time go to the earlier source.  Reruns
    agree, as the shuffle key is a digest of seed and id.  An empty table gives
    no rows; other columns are ignored or, with ``keep_text``, passed through
    (names starting with ``_mix_`` are this operator's).
    """
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    source = F.col(f"`{source_col}`").cast("string")
    own = {
        # One key that sorts by code point with nulls last.
        "src": F.coalesce(F.concat(F.lit("0"), source), F.lit("1")),
        "size": word_count(F.col(f"`{text_col}`")),
        "key": F.md5(F.concat(F.lit(seed + ":"), ident).cast("binary")),
        "tie": ident,
    }
    if keep_text:
        carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row")
    else:
        carried = F.struct(F.col(f"`{id_col}`")).alias("_mix_row")
    mix = {"weights": weights, "share": share, "epochs": epochs}
    columns = [c.alias(n) for n, c in own.items()]
    # Sizes are counted once; texts stay where they are unless they are wanted.
    small = stored(docs.select(*columns) if keep_text else docs.select(*columns, carried))
    rows = stored(queued(small.select(*own), **mix).select("src", "place", "key", "tie", "size", "sent", "source_size", "weight", "budget"))
    cut = _cut(_copies(rows, epochs)) or (math.inf, 0)
    placed = queued(docs.select(*columns, carried) if keep_text else small, **mix)
    n = F.lit(0)
    for epoch in range(epochs):
        finish = (F.col("sent") + F.lit(epoch) * F.col("source_size")) / F.col("weight")
        inside = (finish < cut[0]) | ((finish == cut[0]) & (F.col("place") <= cut[1]))
        n = n + F.when((F.col("size") > 0) & inside, 1).otherwise(0)
    placed = placed.withColumn("n_copies", n)
    return placed.select(
        "_mix_row.*", "size", "source_size", "target",
        (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies", "finish",
    )
