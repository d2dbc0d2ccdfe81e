"""Order, limits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(by: list[str]) -> list[Column]:
    """Names, with a leading - for descending; nulls last either way."""
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in by]


def order_by(df: DataFrame, by: list[str], limit: int | None = None) -> DataFrame:
    """Sorted rows; with a limit, a top-k that no full sort is needed for."""
    rows = df.orderBy(*_ordered(by))
    return rows if limit is None else rows.limit(limit)


def first_n(df: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """n rows: the first in an order, or any, after which scanning stops."""
    return order_by(df, by, n) if by else df.limit(n)


def reservoir(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows, each with the same chance, as a top-k by a random number."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


def rates_by_row(df: DataFrame, rates: DataFrame, key: str, default: float, name: str = "rate", small_rates: int = 1_000_000) -> DataFrame:
    """df with its key's sampling rate: the greatest of the rates listed for the key, or the default.

    The table of rates is broadcast only if it has been counted to small_rates rows at most.
    """
    best = rates.groupBy(F.col("key").alias("_key")).agg(F.max("rate").cast("double").alias("_rate"))
    side = F.broadcast(best) if best.limit(small_rates + 1).count() <= small_rates else best
    return df.join(side, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(name, F.coalesce("_rate", F.lit(float(default)))).drop("_key", "_rate")


def rates_by_tags(df: DataFrame, rates: DataFrame, row_id: str, tags: Column, default: float, name: str = "rate") -> DataFrame:
    """(row_id, rate): the greatest rate of a row's tags; rows without tags have the default."""
    exploded = df.select(F.col(row_id), F.explode_outer(tags).alias("_tag"))
    return rates_by_row(exploded, rates, "_tag", default, name).groupBy(row_id).agg(F.max(name).alias(name))


def sample_by_rate(df: DataFrame, rate: str, by: list[str], salt: int = 0) -> DataFrame:
    """Rows whose hash of by falls under their rate: the same rows are kept wherever and whenever this runs."""
    unit = F.pmod(F.xxhash64(*by, F.lit(salt).cast("long")), F.lit(1 << 53)) / float(1 << 53)
    return df.filter(unit < F.col(rate))
