"""Percentiles from logarithmic bins: values are cut to ten mantissa bits and counted, which bounds the error in value.

State: one row for each key and bin (count, least and greatest value). States merge by adding up. A key has some thousand bins
at most, however many rows it has, so ranking bins within a key is cheap even for a key that holds most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANTISSA_BITS = 10
#: The least exponent of a normal double.
LEAST_EXPONENT = -1022


def trim(value: Column, bits: int = MANTISSA_BITS) -> Column:
    """value with so many bits of mantissa, toward zero. Zero and infinities stay."""
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    two = F.lit(2.0)
    # The logarithm can be off by one near powers of two.
    exponent = F.when(F.pow(two, guess) > size, guess - 1).when(F.pow(two, guess + 1) <= size, guess + 1).otherwise(guess)
    unit = F.pow(two, F.greatest(exponent, F.lit(LEAST_EXPONENT).cast("long")) - bits)
    return F.when((value == 0) | (size == float("inf")), value).otherwise(F.signum(value) * F.floor(size / unit) * unit)


def states(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, bin, count, least, most. Nulls and NaN are left out, infinities kept."""
    v = F.col(f"`{value}`").cast("double")
    w = F.lit(1).cast("long") if weight is None else F.col(f"`{weight}`").cast("long")
    rows = df.select(*keys, v.alias("_v"), w.alias("_w")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return _added(rows.select(*keys, trim(F.col("_v")).alias("bin"), F.col("_w").alias("count"), F.col("_v").alias("least"), F.col("_v").alias("most")), keys)


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "bin").agg(F.sum("count").alias("count"), F.min("least").alias("least"), F.max("most").alias("most"))


def merge(*parts: DataFrame, keys: list[str]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return _added(whole, keys)


def finish(state: DataFrame, keys: list[str], percents: dict[str, float]) -> DataFrame:
    """keys and a column for each percent (0 to 100): the least value for 0, the greatest for 100, else the bin after the first one up to which so many percent of the weight lie, or the greatest value if there is none."""
    group = Window.partitionBy(*keys)
    ranked = group.orderBy("bin")
    placed = state.select(
        *keys,
        F.sum("count").over(ranked.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"), F.lead("bin").over(ranked).alias("_next"),
        F.sum("count").over(group).alias("_total"), F.min("least").over(group).alias("_least"), F.max("most").over(group).alias("_most"),
    )

    def at(percent: float) -> Column:
        if percent <= 0:
            return F.min("_least")
        if percent >= 100:
            return F.max("_most")
        return F.min(F.when(F.col("_cum") >= F.col("_total") * F.lit(float(percent)) / 100, F.coalesce("_next", "_most")))

    return placed.groupBy(*keys).agg(*(at(p).alias(name) for name, p in percents.items()))


def percentiles(df: DataFrame, keys: list[str], value: str, percents: dict[str, float], weight: str | None = None) -> DataFrame:
    return finish(states(df, keys, value, weight), keys, percents)
