"""Distinct counts: exact, by mergeable sketches, and weighted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers: a standard error of 1.04 / sqrt(2 ** 13) = 1.149 %.
PRECISION = 13


def exact(*columns: Column) -> Column:
    """Distinct values, or distinct tuples of several columns; a tuple with nulls counts, a single null doesn't."""
    return F.count_distinct(columns[0] if len(columns) == 1 else F.struct(*columns))


def _value(columns: tuple[Column, ...]) -> Column:
    return columns[0] if len(columns) == 1 else F.xxhash64(*columns)


def sketch(*columns: Column, precision: int = PRECISION) -> Column:
    """A mergeable sketch, exact while small. Columns must be of integers or texts; several are hashed together."""
    return F.hll_sketch_agg(_value(columns), F.lit(precision))


def merge(state: Column) -> Column:
    return F.hll_union_agg(state)


def estimate(state: Column) -> Column:
    return F.hll_sketch_estimate(state)


def distinct(*columns: Column, mode: str = "exact", precision: int = PRECISION) -> Column:
    """mode: exact or hll, chosen by the caller; there is no switch that depends on the order of rows."""
    if mode not in ("exact", "hll"):
        raise ValueError("mode must be exact or hll")
    return exact(*columns) if mode == "exact" else estimate(sketch(*columns, precision=precision))


def weighted(df: DataFrame, keys: list[str], items: list[str], weight: str, name: str = "weighted") -> DataFrame:
    """floor(sum over weights of weight * distinct items of that weight), by keys. An item with two weights counts in both."""
    item = exact(*(F.col(c) for c in items))
    by_weight = df.groupBy(*keys, weight).agg(item.alias("_n"))
    return by_weight.groupBy(*keys).agg(F.floor(F.sum(F.col("_n") * F.col(weight))).alias(name))


def weighted_states(df: DataFrame, keys: list[str], items: list[str], weight: str, name: str = "states", precision: int = PRECISION) -> DataFrame:
    """By keys, an array of (weight, sketch)."""
    by_weight = df.groupBy(*keys, F.col(weight).cast("double").alias("_w")).agg(sketch(*(F.col(c) for c in items), precision=precision).alias("_s"))
    return by_weight.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_w").alias("weight"), F.col("_s").alias("sketch")))).alias(name))


def merge_weighted(states: DataFrame, keys: list[str], name: str = "states") -> DataFrame:
    """States of equal keys as one."""
    rows = states.select(*keys, F.explode(name).alias("_x")).groupBy(*keys, F.col("_x.weight").alias("_w")).agg(merge(F.col("_x.sketch")).alias("_s"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_w").alias("weight"), F.col("_s").alias("sketch")))).alias(name))


def estimate_weighted(states: Column) -> Column:
    return F.floor(F.aggregate(states, F.lit(0.0), lambda total, x: total + x["weight"] * estimate(x["sketch"])))


def promote_plain(state: Column, name: str = "states") -> Column:
    """A plain sketch as a weighted state of weight 1."""
    return F.array(F.struct(F.lit(1.0).alias("weight"), state.alias("sketch"))).alias(name)


def precision_for_error(error: float) -> int:
    """The least precision, 4 to 18, whose standard error is error or less."""
    p = math.ceil(2 * math.log2(1.04 / error))
    if p > 18:
        raise ValueError("no precision up to 18 gives that error")
    return max(p, 4)


def error_for_precision(precision: int) -> float:
    return 1.04 / math.sqrt(1 << _checked(precision))


def bytes_for_precision(precision: int) -> int:
    """Bytes of the registers of a dense sketch at 6 bits each, five to a 32-bit word."""
    return -(-(1 << _checked(precision)) // 5) * 4


def _checked(precision: int) -> int:
    if not 4 <= precision <= 18:
        raise ValueError("precision must be 4 to 18")
    return precision
