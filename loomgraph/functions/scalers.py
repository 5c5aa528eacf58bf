"""Scalers that are fitted batch by batch: states that merge in any order give what one pass over all rows gives.

A state is a row for each key: count, mean, sum of squared gaps (M2), least, greatest, and a quantile sketch for the
median. Batches of a stream add their own states to a table; merged() makes one of them, and scaled() applies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import stored
from .vectors import min_max, sigmoid, sigmoid_temperature, standard

SKETCH_SIZE = 400


def states(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A partial state of each key's values; nulls are left aside."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high"), F.kll_sketch_agg_double(x, F.lit(SKETCH_SIZE)).alias("sketch")
    )


def merged(parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One state a key: means weigh by their counts, squared gaps add up with those of the means, sketches merge.

    States are stored, so that Spark knows their size: a few are sent to the rows, which then aren't dealt by key.
    """
    whole = stored(parts.where("n > 0"))
    mean = whole.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    placed = whole.join(mean, list(keys)) if keys else whole.join(F.broadcast(mean))
    gap = F.col("mean") - F.col("_mean")
    states_ = placed.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("sketch")
    )
    return stored(states_)


def scaled(df: DataFrame, value: str, state: DataFrame, kind: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with `scaled`: kind is min_max, standard or sigmoid. A state is a row for each key; of one key it is broadcast."""
    x = F.col(value)
    how: dict[str, Column] = {
        "min_max": min_max(x, F.col("low"), F.col("high")),
        "standard": standard(x, F.col("mean"), F.sqrt(F.col("m2") / (F.col("n") - 1))),
        "sigmoid": sigmoid(x, F.col("low"), sigmoid_temperature(F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)))),
    }
    joined = df.join(state, list(keys), "left") if keys else df.join(F.broadcast(state))
    return joined.select(*df.columns, how[kind].alias("scaled"))


def unscaled(df: DataFrame, value: str, state: DataFrame, kind: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with `value` taken back from `scaled`; of min_max, for values inside the range only."""
    y = F.col("scaled")
    how: dict[str, Column] = {
        "min_max": F.col("low") + y * (F.col("high") - F.col("low")),
        "standard": F.col("mean") + y * F.sqrt(F.col("m2") / (F.col("n") - 1)),
        "sigmoid": F.col("low") + F.log(y / (1 - y)) * sigmoid_temperature(F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))),
    }
    joined = df.join(state, list(keys), "left") if keys else df.join(F.broadcast(state))
    return joined.select(*df.columns, how[kind].alias(value))
