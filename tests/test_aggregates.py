"""Edge fixtures of distinct counts, percentiles, histograms and bins, with expectations worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import distinct, histogram, quantile
from quernstone.plans.spec import Bins, Distinct, Histogram, Percentiles, QuerySpec, Value, WeightedDistinct, count

NAN, INF = float("nan"), float("inf")


def numbers(spark, values, weights=None):
    return spark.createDataFrame([("g", v, w) for v, w in zip(values, weights or [1] * len(values), strict=True)], "g string, v double, w long")


def at(spark, values, *percents):
    row = quantile.percentiles(numbers(spark, values), [], "v", {f"p{i}": p for i, p in enumerate(percents)}).first()
    return [row[f"p{i}"] for i in range(len(percents))]


def test_percentiles(spark):
    assert at(spark, [], 50) == [None]
    assert at(spark, [7.0], 0, 50, 100) == [7, 7, 7]
    assert at(spark, [1.0, 1000.0], 50) == [1000]
    assert at(spark, [1.0, 2.0, 3.0, 4.0], 25, 50, 75) == [2, 3, 4]
    assert at(spark, [1.0, NAN, INF, None], 0, 100) == [1, INF]


def test_trim_equals_the_bits(spark):
    import struct

    rng = random.Random(3)
    values = [1025.9, 2049.9, -2049.9, 0.0, INF, -INF, 5e-324, 2.0**-1022, 1.0, 2.0**52, -3.7] + [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-300, 300) for _ in range(500)]

    def cut(v):
        bits = struct.unpack("<q", struct.pack("<d", v))[0]
        return struct.unpack("<d", struct.pack("<q", bits >> 42 << 42))[0] if math.isfinite(v) and abs(v) >= 2.0**-1022 else None

    rows = numbers(spark, values).select("v", quantile.trim(F.col("v")).alias("t")).collect()
    assert all(cut(r.v) is None or r.t == cut(r.v) for r in rows)
    assert {r.v: r.t for r in rows}[-2049.9] == -2048


def test_percentile_states_merge(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 50) for _ in range(400)]
    weights = [rng.randint(1, 5) for _ in values]
    whole, p = numbers(spark, values, weights), {"a": 10, "b": 50, "c": 99}
    parts = [quantile.states(whole.filter(F.pmod(F.hash("v"), F.lit(3)) == i), ["g"], "v", "w") for i in range(3)]
    merged = quantile.finish(quantile.merge(*parts, keys=["g"]), ["g"], p).first()
    assert merged == quantile.percentiles(whole, ["g"], "v", p, "w").first()
    assert merged.a <= merged.b <= merged.c


def bins(df):
    return [r["count"] for r in df.orderBy("bin").collect()]


def test_fixed_histogram(spark):
    rows = histogram.histogram(numbers(spark, [-1.0, 0.0, 1.9, 2.0, 9.99, 10.0, 11.0, NAN, INF]), [], "v", 5, 0, 10)
    first = rows.first()
    assert bins(rows) == [2, 1, 0, 0, 2]
    assert (first.left_count, first.right_count, first.range_count, first.total_count) == (1, 1, 5, 7)


def test_dynamic_histogram(spark):
    assert bins(histogram.histogram(numbers(spark, [0.0, 0.5, 10.0]), [], "v", 2)) == [2, 1]
    assert bins(histogram.histogram(numbers(spark, [5.0] * 3), ["g"], "v", 4)) == [0, 0, 0, 3]
    assert histogram.histogram(numbers(spark, [NAN]), ["g"], "v", 4).count() == 0


def test_histogram_widths(spark):
    with pytest.raises(ValueError):
        histogram.histogram(numbers(spark, [1.0]), [], "v", 5, 0, 10, width=1)
    rows = histogram.histogram(numbers(spark, [0.0, 1.0, 5.0, 9.0]), ["g"], "v", 2, width=2)
    assert bins(rows) == [2, 0] and rows.first().right_count == 2


def test_histograms_merge(spark):
    whole = numbers(spark, [float(i) for i in range(50)])
    parts = [histogram.histogram(whole.filter(F.col("v") % 2 == i), ["g"], "v", 5, 10, 40) for i in range(2)]
    assert sorted(map(tuple, histogram.merge(*parts, keys=["g"]).collect())) [0][:5] == sorted(map(tuple, histogram.histogram(whole, ["g"], "v", 5, 10, 40).collect()))[0][:5]
    assert sum(bins(histogram.merge(*parts, keys=["g"]))) + 10 + 9 == 50


def test_explicit_bins(spark):
    df = numbers(spark, [-1.0, 0.0, 5.0, 10.0, 11.0], [2] * 5)
    rows = histogram.explicit_bins(df, [], "v", [0, 5, 10], "w")
    first = rows.first()
    assert bins(rows) == [2, 4] and (first.left_count, first.right_count, first.total_count) == (2, 2, 10)
    rows = histogram.explicit_bins(df, [], "v", [0, 5, 10], "w", strict_compat=True)
    first = rows.first()
    assert bins(rows) == [2, 2] and (first.left_count, first.right_count, first.total_count) == (1, 1, 6)


def test_distinct(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "a", 20.0), (2, "a", 1.0)], "item long, s string, weight double")
    assert df.agg(distinct.exact(F.col("item"))).first()[0] == 2
    assert df.agg(distinct.exact(F.col("item"), F.col("s"))).first()[0] == 3
    assert distinct.weighted(df.groupBy("item", "weight").count(), [], ["item"], "weight").first()[0] == 22
    assert distinct.weighted(df.limit(1).withColumn("weight", F.lit(1.5)), [], ["item"], "weight").first()[0] == 1
    states = distinct.weighted_states(df, [], ["item"], "weight")
    assert distinct.merge_weighted(states.unionByName(states), []).select(distinct.estimate_weighted(F.col("states"))).first()[0] == 22
    plain = df.agg(distinct.sketch(F.col("item")).alias("s")).select(distinct.promote_plain(F.col("s")))
    assert plain.select(distinct.estimate_weighted(F.col("states"))).first()[0] == 2


def test_sketches(spark):
    df = spark.range(100_000)
    whole = df.agg(distinct.distinct(F.col("id"), mode="hll")).first()[0]
    halves = df.groupBy((F.col("id") % 2).alias("h")).agg(distinct.sketch(F.col("id")).alias("s")).agg(distinct.estimate(distinct.merge(F.col("s")))).first()[0]
    assert abs(whole - 100_000) < 3 * 1149 and abs(halves - 100_000) < 3 * 1149
    assert distinct.precision_for_error(0.0115) == 13 and distinct.bytes_for_precision(13) == 6556
    assert round(distinct.error_for_precision(13), 5) == 0.01149
    with pytest.raises(ValueError):
        distinct.distinct(F.col("id"), mode="other")


def test_spec_joins_its_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), (None, 5.0, 2)], "g string, v double, u long")
    spec = QuerySpec(
        keys={"g": "g"}, group_cap=5, order=["-n", "g"],
        aggregates=[count("n"), Value("s", "sum(v)"), Distinct("d", ("u",)), WeightedDistinct("w", ("u",), "v"), Percentiles("v", {"p50": 50}), Histogram("h", "v", 2), Bins("b", "v", (0.0, 2.0, 9.0))],
    )
    a, none = spec.compile(df).collect()
    assert (a.g, a.n, a.s, a.d, a.w, a.p50) == ("a", 2, 4, 2, 4, 3) and [x["count"] for x in a.h.bins] == [1, 1]
    assert none.g is None and none.p50 == 5 and [x["count"] for x in none.b.bins] == [0, 1]
    spec.group_cap = 1
    with pytest.raises(RuntimeError):
        spec.compile(df)
    assert QuerySpec(aggregates=[count("n")]).compile(df.limit(0)).first().n == 0
