"""Histograms with fixed or data-driven bounds, and bins with explicit separators.

Results have one row for each key and bin: keys, bin, start, stop, count, and the key's total_min, total_max, left_count,
right_count, range_count and total_count. binned_struct makes one struct of a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import all_of

RESULT = ("bin", "start", "stop", "count", "left_count", "right_count", "range_count", "total_count", "total_min", "total_max")


def _finite(df: DataFrame, keys: list[str], value: str, weight: str | None) -> DataFrame:
    v = F.col(f"`{value}`").cast("double")
    w = F.lit(1).cast("long") if weight is None else F.col(f"`{weight}`").cast("long")
    return df.select(*keys, v.alias("_v"), w.alias("_w")).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))


def histogram(df: DataFrame, keys: list[str], value: str, size: int, low: float | None = None, high: float | None = None, width: float | None = None, weight: str | None = None, shared_range: bool = False) -> DataFrame:
    """size bins of equal width between low and high; a bound that isn't given comes from the data, of each key or (shared_range) of all.

    Values that aren't finite are left out; those below low or above high count left and right. The greatest value of the range
    is in the last bin. An explicit width must cover fixed bounds; with data-driven ones, what lies above size * width counts right.
    """
    if size < 1 or width is not None and width <= 0:
        raise ValueError("size and width must be positive")
    if low is not None and high is not None and width is not None and width * size < high - low:
        raise ValueError("width * size must cover the range")
    rows = _finite(df, keys, value, weight)
    inside = all_of([F.col("_v") >= low] * (low is not None) + [F.col("_v") <= high] * (high is not None))
    least, most = F.min(F.when(inside, F.col("_v"))), F.max(F.when(inside, F.col("_v")))
    if low is not None and high is not None:
        ranged = rows.withColumns({"_lo": F.lit(float(low)), "_hi": F.lit(float(high))})
    elif shared_range or not keys:
        bounds = rows.agg(least.alias("lo"), most.alias("hi"))  # one row, as two scalar subqueries
        ranged = rows.withColumns({"_lo": F.lit(float(low)) if low is not None else bounds.select("lo").scalar(), "_hi": F.lit(float(high)) if high is not None else bounds.select("hi").scalar()})
    else:
        bounds = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(least.alias("_lo"), most.alias("_hi"))
        same = all_of([F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        ranged = rows.join(bounds, same).select(*keys, "_v", "_w", *((F.lit(float(b)) if b is not None else F.col(n)).alias(n) for n, b in (("_lo", low), ("_hi", high))))
    step = F.lit(float(width)) if width is not None else (F.col("_hi") - F.col("_lo")) / size
    top = F.col("_hi") if width is None or low is not None and high is not None else F.least(F.col("_hi"), F.col("_lo") + float(width or 0) * size)
    ranged = ranged.withColumns({"_step": step, "_top": top})
    v = F.col("_v")
    place = F.least(F.lit(size - 1), F.floor(F.try_divide(v - F.col("_lo"), F.col("_step"))).cast("int"))
    b = F.when(v < F.col("_lo"), -1).when(v > F.col("_top"), size).when(v == F.col("_top"), size - 1).otherwise(place)
    if low is None or high is None:
        ranged = ranged.filter(F.col("_lo").isNotNull() & F.col("_hi").isNotNull())
    counts = ranged.groupBy(*keys, b.alias("_b")).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.first("_lo").alias("_lo"), F.first("_top").alias("_top"), F.first("_step").alias("_step"))
    start = F.col("_lo") + F.col("_i") * F.col("_step")
    stop = F.when(F.col("_i") == size - 1, F.col("_top")).otherwise(start + F.col("_step"))
    return _spread(counts, keys, size, start, stop, ["_lo", "_top", "_step"])


def _spread(counts: DataFrame, keys: list[str], size: int, start: Column, stop: Column, carried: list[str]) -> DataFrame:
    """One row a bin from rows (keys, _b, _n, _min, _max): the counts of a key are few, so they go into one map; keys without rows give none."""
    whole = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_counts"), F.min("_min").alias("total_min"), F.max("_max").alias("total_max"), F.sum("_n").alias("total_count"),
        *(F.first(c).alias(c) for c in carried),
    )
    none = F.lit(0).cast("long")
    count = lambda i: F.coalesce(F.try_element_at("_counts", i), none)
    outer = whole.withColumns({"left_count": count(F.lit(-1)), "right_count": count(F.lit(size))})
    outer = outer.withColumn("range_count", F.col("total_count") - F.col("left_count") - F.col("right_count"))
    bins = outer.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_i"))
    return bins.select(*keys, F.col("_i").alias("bin"), start.alias("start"), stop.alias("stop"), count(F.col("_i")).alias("count"), *RESULT[4:])


def explicit_bins(df: DataFrame, keys: list[str], value: str, separators: list[float], weight: str | None = None, strict_compat: bool = False) -> DataFrame:
    """Bins [s0, s1), [s1, s2), ... of which the last is closed. Outliers count left and right by weight.

    strict_compat: outliers count 1 whatever their weight, and a value equal to the last separator is in no bin.
    """
    if len(separators) < 2 or any(a >= b for a, b in zip(separators, separators[1:], strict=False)):
        raise ValueError("separators must be two or more, ascending")
    edges, size = [float(s) for s in separators], len(separators) - 1
    v = F.col("_v")
    b = F.when(v < edges[0], -1).when(v > edges[-1], size)
    b = b.when(v == edges[-1], None if strict_compat else size - 1)
    for i, edge in reversed(list(enumerate(edges[:-1]))):
        b = b.when(v >= edge, i)
    rows = _finite(df, keys, value, weight).withColumn("_b", b).filter("_b is not null")
    w = F.when(F.col("_b").isin(-1, size), 1).otherwise(F.col("_w")) if strict_compat else F.col("_w")
    counts = rows.groupBy(*keys, "_b").agg(F.sum(w).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    listed = F.array(*map(F.lit, edges))
    return _spread(counts, keys, size, F.element_at(listed, F.col("_i") + 1), F.element_at(listed, F.col("_i") + 2), [])


def value_states(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, value, count: a state that merges by adding up and of which histogram(..., "value", weight="count") can be made with any bounds, data-driven ones too. As many rows as there are distinct values."""
    return _finite(df, keys, value, weight).groupBy(*keys, F.col("_v").alias("value")).agg(F.sum("_w").alias("count"))


def merge_states(*parts: DataFrame, keys: list[str]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*keys, "value").agg(F.sum("count").alias("count"))


def merge(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms of the same bins as one. Bins that differ, as data-driven ones do, are an error when the result is computed: merge value_states then."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    sums = [F.sum(c).alias(c) for c in ("count", "left_count", "right_count", "range_count", "total_count")]

    def same(edge: str) -> Column:
        return F.when(F.min(edge) == F.max(edge), F.min(edge)).otherwise(F.raise_error(F.lit("histograms with different bins can't be merged"))).alias(edge)

    merged = whole.groupBy(*keys, "bin").agg(same("start"), same("stop"), *sums, F.min("total_min").alias("total_min"), F.max("total_max").alias("total_max"))
    return merged.select(*keys, *RESULT[:4], *RESULT[4:])


def binned_struct(rows: DataFrame, keys: list[str], name: str = "histogram") -> DataFrame:
    """One struct a key: bins (start, stop, count) in order, and the key's counts."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("bin", "start", "stop", "count"))), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["count"].alias("count")))
    whole = F.struct(listed.alias("bins"), *(F.max(c).alias(c) for c in RESULT[4:]))
    return rows.groupBy(*keys).agg(whole.alias(name))
