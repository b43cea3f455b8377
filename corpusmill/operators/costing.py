"""Prices and limits of token counts against a catalogue of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv


def effective_tokens(current: Column, precalculated: Column) -> Column:
    """A count that was stored earlier wins over the current one."""
    return F.coalesce(precalculated, current)


def cost(tokens: Column, price_1k: Column) -> Column:
    """Tokens / 1000 x price; no tokens or no usable price cost nothing."""
    price = F.coalesce(price_1k.try_cast("double"), F.lit(0.0))
    return F.when(tokens > 0, tokens / 1000 * price).otherwise(F.lit(0.0))


def with_model(usage: DataFrame, models: DataFrame, model: str = "target_model") -> DataFrame:
    """Attach price and context limit of each row's model (left join).

    Used on counts that are already aggregated.  Neither side is forced into a
    broadcast: the planner knows the size of a stored catalogue.
    """
    looked_up = models.select(
        F.col("base_name").alias(model), "input_cost_1k", "context_window"
    )
    return usage.join(looked_up, model, "left").withColumn(
        "context_limit",
        F.coalesce("context_window", F.lit(fv.DEFAULT_CONTEXT_WINDOW)),
    ).drop("context_window")


def with_cost(usage: DataFrame, models: DataFrame, model: str = "target_model") -> DataFrame:
    """Add ``cost_usd``, ``context_limit`` and ``over_limit`` to counts."""
    return (
        with_model(usage, models, model)
        .withColumn("cost_usd", cost(F.col("n_tokens"), F.col("input_cost_1k")))
        .withColumn("over_limit", F.col("n_tokens") > F.col("context_limit"))
        .drop("input_cost_1k")
    )
