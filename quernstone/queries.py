"""Registered queries over the driver's tables, with their DuckDB counterparts.

Sums of doubles are compared as decimals, as the order of additions differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fields as fl
from .functions import scalars as fn
from .operators import distinct, histogram, quantile, sample
from .plans.spec import Distinct, Percentiles, QuerySpec, Value, WeightedDistinct, count, special_count
from .plans.summary import State, Summary, build, read_hours, requery, write_by_hour
from .sources.readers import read_list, union_all
from .sources.scratch import scratch_path
from .sources.writers import json_rows, msgpack_rows
from .streaming.streams import stream_summary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Groups, plain aggregates, order.


@query("""
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(CAST(value AS DECIMAL(18,4))) AS total,
       min(value) AS least, max(value) AS most
FROM events GROUP BY 1, 2 ORDER BY n DESC, hour, event_type LIMIT 10
""")
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec(
        keys={"hour": "date_trunc('hour', ts)", "event_type": "event_type"},
        aggregates=[count("n"), Distinct("users", ("user_id",)), Value("total", "sum(cast(value as decimal(18,4)))"), Value("least", "min(value)"), Value("most", "max(value)")],
        order=["-n", "hour", "event_type"], limit=10,
    )
    return spec.compile(t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""
SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders
WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) > 2 ORDER BY spent DESC, o_custkey LIMIT 20
""")
def topk_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec(
        where="o_orderstatus <> 'P'", keys={"o_custkey": "o_custkey"}, aggregates=[count("n"), Value("spent", "sum(cast(o_totalprice as decimal(18,2)))")],
        having="n > 2", order=["-spent", "o_custkey"], limit=20,
    )
    return spec.compile(t(spark, sf_dir, "orders"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS price_int, l_discount <> 0 AS discounted, CAST(l_linenumber AS DOUBLE) AS line_float,
       CAST(l_partkey AS VARCHAR) AS part FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_quantity < 10
""")
def filter_project_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = QuerySpec(where="l_shipdate >= timestamp_ntz'1996-01-01 00:00:00' and l_quantity < 10").compile(t(spark, sf_dir, "lineitem"))
    return rows.select(
        "l_orderkey", "l_linenumber", fn.coerce(F.col("l_extendedprice"), "int").alias("price_int"), fn.coerce(F.col("l_discount"), "bool").alias("discounted"),
        fn.coerce(F.col("l_linenumber"), "float").alias("line_float"), fn.coerce(F.col("l_partkey"), "string").alias("part"),
    )


@query("SELECT event_id, event_type, user_id FROM events ORDER BY event_id LIMIT 100")
def first_n_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.first_n(t(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), 100, ["event_id"])


@query("SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_events FROM events")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows the sample has, and how many different events of the table."""
    events = t(spark, sf_dir, "events")
    drawn = sample.reservoir(events, 100, 7).select(F.col("event_id").alias("_id"))
    return drawn.join(events.select("event_id"), F.col("_id") == F.col("event_id"), "left").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_events"))


@query("""
SELECT event_type, count(*) AS n, avg(value) AS mean, CAST(sum(event_id % 3) AS BIGINT) AS events, CAST(sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS with_value FROM events GROUP BY 1
""")
def special_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec(
        keys={"event_type": "event_type"},
        aggregates=[count("n"), Value("mean", "avg(value)"), special_count("events", "event_id % 3"), special_count("with_value", "int(value is not null)")],
    )
    return spec.compile(t(spark, sf_dir, "events"))


@query("""
SELECT o_orderkey, o_orderkey | 32 AS set_5, o_orderkey & ~4 AS cleared_2, o_orderkey & 1 = 1 AS has_0, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey | 8 ELSE o_orderkey & ~8 END AS assigned_3,
       true AS in_stratum FROM orders
""")
def bits_and_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("long")
    stratum = fn.stratum(7, key, salt=1)
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", fn.set_bit(key, 5).alias("set_5"), fn.clear_bit(key, 2).alias("cleared_2"), fn.test_bit(key, 0).alias("has_0"),
        fn.assign_bit(key, 3, F.col("o_custkey") % 2 == 0).alias("assigned_3"), ((stratum >= 0) & (stratum < 7)).alias("in_stratum"),
    )


@query("SELECT n_nationkey, n_name, n_regionkey, source FROM nation, (VALUES ('csv'), ('json'), ('parquet')) AS s(source)")
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table read from compressed JSON, CSV and Parquet files that a list names, one of them rotated meanwhile and one missing."""
    rows, path = t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), scratch_path(spark, "sources")
    schema = rows.schema.add("source", "string")
    for kind, suffix in (("csv", "csv.rotated"), ("json", "json.gz"), ("parquet", "parquet")):
        writer = rows.withColumn("source", F.lit(kind)).coalesce(1).write.format(kind)
        (writer.option("header", "true") if kind == "csv" else writer.option("compression", "gzip")).save(f"{path}/nation.{suffix}")
    names = [f"{path}/nation.{x}" for x in ("csv", "json.gz", "parquet")] + [f"{path}/missing.json"]
    spark.createDataFrame([(x,) for x in names], "value string").coalesce(1).write.text(f"{path}/list")
    return read_list(spark, f"{path}/list", schema=schema).select("n_nationkey", "n_name", "n_regionkey", "source")


@query("""
SELECT 'customer' AS side, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2
UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2
""")
def implicit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [t(spark, sf_dir, name).select(F.lit(name).alias("side"), F.col(key).alias("nation")) for name, key in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return union_all(*sides).groupBy("side", "nation").agg(F.count("*").alias("n"))


# Distinct counts.


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def ucount_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QuerySpec(keys={"event_type": "event_type"}, aggregates=[Distinct("users", ("user_id",))]).compile(t(spark, sf_dir, "events"))


@query("SELECT l_returnflag, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY 1")
def ucount_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QuerySpec(keys={"l_returnflag": "l_returnflag"}, aggregates=[Distinct("pairs", ("l_partkey", "l_suppkey"))]).compile(t(spark, sf_dir, "lineitem"))


@query("""
WITH w AS (SELECT event_type, (event_id % 4) * 0.75 AS weight, count(DISTINCT user_id) AS n FROM events GROUP BY ALL)
SELECT event_type, CAST(floor(sum(n * weight)) AS BIGINT) AS weighted FROM w GROUP BY 1
""")
def weighted_ucount(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec(keys={"event_type": "event_type"}, columns={"weight": "double(event_id % 4) * double(0.75)"}, aggregates=[WeightedDistinct("weighted", ("user_id",), "weight")])
    return spec.compile(t(spark, sf_dir, "events"))


def _close(estimate: Column, exact: Column) -> Column:
    """Whether an estimate is within three standard errors of the exact count."""
    return F.abs(estimate - exact) <= F.lit(3 * distinct.error_for_precision(distinct.PRECISION)) * exact


_HLL = "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, true AS close FROM lineitem GROUP BY 1"


@query(_HLL)
def ucount_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's estimate beside the exact count of the same plan."""
    spec = QuerySpec(keys={"l_returnflag": "l_returnflag"}, aggregates=[Distinct("orders", ("l_orderkey",)), Distinct("estimate", ("l_orderkey",), "hll")])
    return spec.compile(t(spark, sf_dir, "lineitem")).select("l_returnflag", "orders", _close(F.col("estimate"), F.col("orders")).alias("close"))


@query(_HLL)
def ucount_hll_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem")
    states = rows.groupBy("l_returnflag", "l_linestatus").agg(distinct.sketch(F.col("l_orderkey")).alias("s"))
    merged = states.groupBy("l_returnflag").agg(distinct.estimate(distinct.merge(F.col("s"))).alias("estimate"))
    exact = rows.groupBy("l_returnflag").agg(distinct.exact(F.col("l_orderkey")).alias("orders"))
    return exact.join(merged, "l_returnflag").select("l_returnflag", "orders", _close(F.col("estimate"), F.col("orders")).alias("close"))


@query("""
WITH w AS (SELECT event_type, event_id % 4 AS weight, count(DISTINCT user_id) AS n FROM events GROUP BY ALL)
SELECT event_type, CAST(sum(n * weight) AS BIGINT) AS weighted, true AS close FROM w GROUP BY 1
""")
def weighted_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").withColumn("weight", F.col("event_id") % 4)
    halves = [distinct.weighted_states(rows.filter(F.col("event_id") % 2 == i), ["event_type"], ["user_id"], "weight") for i in (0, 1)]
    merged = distinct.merge_weighted(union_all(*halves), ["event_type"]).select("event_type", distinct.estimate_weighted(F.col("states")).alias("estimate"))
    exact = distinct.weighted(rows, ["event_type"], ["user_id"], "weight")
    return exact.join(merged, "event_type").select("event_type", "weighted", _close(F.col("estimate"), F.col("weighted")).alias("close"))


# Percentiles.


def _trimmed(v: str) -> str:
    guess = f"floor(log2(abs({v})))"
    e = f"greatest(CASE WHEN pow(2.0, {guess}) > abs({v}) THEN {guess} - 1 WHEN pow(2.0, {guess} + 1) <= abs({v}) THEN {guess} + 1 ELSE {guess} END, -1022)"
    return f"CASE WHEN {v} = 0 THEN {v} ELSE sign({v}) * floor(abs({v}) / pow(2.0, {e} - 10)) * pow(2.0, {e} - 10) END"


def percentile_sql(table: str, value: str, weight: str, percents: dict[str, float], key: str | None = None) -> str:
    k, on = (f"{key}, ", f"PARTITION BY {key}") if key else ("", "")
    ends = {0: "min(lo)", 100: "max(hi)"}
    columns = ", ".join(f"{ends.get(p) or f'min(CASE WHEN cum >= tot * {p}::DOUBLE / 100 THEN coalesce(nxt, hi_all) END)'} AS {n}" for n, p in percents.items())
    return f"""
WITH v AS (SELECT {k}{value} AS v, {weight} AS w FROM {table} WHERE {value} IS NOT NULL AND NOT isnan({value}::DOUBLE)),
b AS (SELECT {k}{_trimmed("v")} AS bin, sum(w) AS c, min(v) AS lo, max(v) AS hi FROM v GROUP BY {k}bin),
p AS (SELECT {k}lo, hi, sum(c) OVER ({on} ORDER BY bin) AS cum, lead(bin) OVER ({on} ORDER BY bin) AS nxt, sum(c) OVER ({on}) AS tot, max(hi) OVER ({on}) AS hi_all FROM b)
SELECT {k}{columns} FROM p {f"GROUP BY {key}" if key else ""}"""


PERCENTS = {"p0": 0, "p50": 50, "p90": 90, "p99": 99, "p100": 100}


@query(percentile_sql("lineitem", "l_extendedprice", "1", PERCENTS, "l_returnflag"))
def ntile_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QuerySpec(keys={"l_returnflag": "l_returnflag"}, aggregates=[Percentiles("l_extendedprice", PERCENTS)]).compile(t(spark, sf_dir, "lineitem"))


@query(percentile_sql("lineitem", "l_extendedprice", "CAST(l_quantity AS BIGINT)", PERCENTS, "l_linestatus"))
def ntile_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile.percentiles(t(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", PERCENTS, "l_quantity")


@query(percentile_sql("lineitem", "l_extendedprice", "1", PERCENTS))
def ntile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem")
    parts = [quantile.states(rows.filter(F.col("l_orderkey") % 3 == i), [], "l_extendedprice") for i in range(3)]
    return quantile.finish(quantile.merge(*parts, keys=[]), [], PERCENTS)


@query(percentile_sql("events", "value", "1", PERCENTS, "event_type"))
def ntile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile.percentiles(t(spark, sf_dir, "events"), ["event_type"], "value", PERCENTS)


# Histograms.


def histogram_sql(table: str, value: str, size: int, low: str, high: str, key: str, weight: str = "1", width: str | None = None, bounds: str = "per_key") -> str:
    """low and high: numbers, or lo and hi for data-driven ones."""
    inside = " AND ".join(["TRUE", *([f"v >= {low}"] if low != "lo" else []), *([f"v <= {high}"] if high != "hi" else [])])
    by = f"PARTITION BY {key}" if bounds == "per_key" else ""
    step = width or f"((hi - lo) / {size})"
    top = "hi" if width is None or (low != "lo" and high != "hi") else f"least(hi, lo + {width} * {size})"
    lo = f"{low}::DOUBLE" if low != "lo" else f"min(CASE WHEN {inside} THEN v END) OVER ({by})"
    hi = f"{high}::DOUBLE" if high != "hi" else f"max(CASE WHEN {inside} THEN v END) OVER ({by})"
    return f"""
WITH v AS (SELECT {key}, {value} AS v, {weight} AS w FROM {table} WHERE isfinite({value}::DOUBLE)),
r AS (SELECT *, {lo} AS lo, {hi} AS hi FROM v),
s AS (SELECT *, {step}::DOUBLE AS step, {top} AS top FROM r WHERE lo IS NOT NULL AND hi IS NOT NULL),
b AS (SELECT *, CASE WHEN v < lo THEN -1 WHEN v > top THEN {size} WHEN v = top THEN {size - 1} ELSE least({size - 1}, CAST(floor((v - lo) / step) AS INT)) END AS b FROM s),
k AS (SELECT {key}, any_value(lo) AS lo, any_value(top) AS top, any_value(step) AS step, sum(CASE WHEN b = -1 THEN w ELSE 0 END) AS l, sum(CASE WHEN b = {size} THEN w ELSE 0 END) AS r,
      sum(w) AS tot, min(v) AS total_min, max(v) AS total_max FROM b GROUP BY {key}),
c AS (SELECT {key}, b, sum(w) AS n FROM b GROUP BY {key}, b)
SELECT k.{key}, i::INT AS bin, k.lo + i * k.step AS start, CASE WHEN i = {size - 1} THEN k.top ELSE k.lo + i * k.step + k.step END AS stop, coalesce(n, 0)::BIGINT AS count,
       l::BIGINT AS left_count, r::BIGINT AS right_count, (tot - l - r)::BIGINT AS range_count, tot::BIGINT AS total_count, total_min, total_max
FROM k CROSS JOIN range(0, {size}) AS x(i) LEFT JOIN c ON c.{key} IS NOT DISTINCT FROM k.{key} AND c.b = x.i"""


@query(histogram_sql("events", "value", 5, "10", "110", "event_type"))
def hist_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(t(spark, sf_dir, "events"), ["event_type"], "value", 5, 10, 110)


@query(histogram_sql("events", "value", 6, "10", "50", "event_type", width="10.0"))
def hist_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(t(spark, sf_dir, "events"), ["event_type"], "value", 6, 10, 50, width=10)


@query(histogram_sql("lineitem", "l_extendedprice", 7, "lo", "hi", "l_returnflag", "CAST(l_quantity AS BIGINT)"))
def hist_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 7, weight="l_quantity")


@query(histogram_sql("lineitem", "l_extendedprice", 4, "lo", "hi", "l_returnflag", width="9000.0"))
def hist_dynamic_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 4, width=9000)


@query(histogram_sql("events", "value", 8, "lo", "hi", "event_type", bounds="all"))
def hist_shared_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(t(spark, sf_dir, "events"), ["event_type"], "value", 8, shared_range=True)


@query(histogram_sql("events", "value", 8, "20", "hi", "event_type"))
def hist_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(t(spark, sf_dir, "events"), ["event_type"], "value", 8, low=20)


@query(histogram_sql("events", "value", 5, "10", "110", "event_type"))
def hist_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events")
    return histogram.merge(*(histogram.histogram(rows.filter(F.col("event_id") % 2 == i), ["event_type"], "value", 5, 10, 110) for i in (0, 1)), keys=["event_type"])


@query(histogram_sql("lineitem", "l_extendedprice", 7, "lo", "hi", "l_returnflag", "CAST(l_quantity AS BIGINT)"))
def hist_dynamic_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = t(spark, sf_dir, "lineitem"), ["l_returnflag"]
    parts = [histogram.value_states(rows.filter(F.col("l_orderkey") % 2 == i), keys, "l_extendedprice", "l_quantity") for i in (0, 1)]
    return histogram.histogram(histogram.merge_states(*parts, keys=keys), keys, "value", 7, weight="count")


_BINS = """
WITH v AS (SELECT l_linestatus, l_quantity AS v, l_linenumber::BIGINT AS w, CASE WHEN l_quantity < 5 THEN -1 WHEN l_quantity > 40 THEN 3 WHEN l_quantity >= 30 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS b FROM lineitem),
k AS (SELECT l_linestatus, sum(CASE WHEN b = -1 THEN w ELSE 0 END) AS l, sum(CASE WHEN b = 3 THEN w ELSE 0 END) AS r, sum(w) AS tot, min(v) AS total_min, max(v) AS total_max FROM v GROUP BY 1),
c AS (SELECT l_linestatus, b, sum(w) AS n FROM v GROUP BY 1, 2)
SELECT k.l_linestatus, i::INT AS bin, [5.0, 10.0, 30.0, 40.0][i + 1]::DOUBLE AS start, [5.0, 10.0, 30.0, 40.0][i + 2]::DOUBLE AS stop, coalesce(n, 0)::BIGINT AS count,
       l::BIGINT AS left_count, r::BIGINT AS right_count, (tot - l - r)::BIGINT AS range_count, tot::BIGINT AS total_count, total_min, total_max
FROM k CROSS JOIN range(0, 3) AS x(i) LEFT JOIN c ON c.l_linestatus = k.l_linestatus AND c.b = x.i
"""


@query(_BINS)
def bins_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem")
    return histogram.merge(*(histogram.explicit_bins(rows.filter(F.col("l_orderkey") % 2 == i), ["l_linestatus"], "l_quantity", [5, 10, 30, 40], "l_linenumber") for i in (0, 1)), keys=["l_linestatus"])


@query(_BINS)
def bins_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.explicit_bins(t(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_quantity", [5, 10, 30, 40], "l_linenumber")


# Fields and scalars.


@query("""
SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS value FROM orders
UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders
""")
def unpivot_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.unpivot(t(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') WHEN event_id % 3 = 1 THEN NULL WHEN event_type = 'click' THEN 'user' || (user_id % 7) END AS k,
       CASE WHEN event_type = 'click' AND user_id % 5 <> 0 THEN 'web' END AS os
FROM events
""")
def local_over_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three events one has k, one has it with null, and one has none and takes the batch's if it is a click."""
    rows = t(spark, sf_dir, "events")
    own = F.from_json("props", "map<string,string>")
    local = F.when(F.col("event_id") % 3 == 0, own).when(F.col("event_id") % 3 == 1, F.transform_values(own, lambda k, v: F.lit(None).cast("string")))
    shared = F.create_map(F.lit("k"), F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")), F.lit("os"), F.when(F.col("user_id") % 5 != 0, "web"))
    star = F.when(F.col("event_type") == "click", fl.resolve(shared, local, ["k", "os"])).otherwise(fl.resolve(shared, local, []))
    return rows.select("event_id", star.alias("star")).select("event_id", fl.field_of(F.col("star"), "k").alias("k"), fl.field_of(F.col("star"), "os").alias("os"))


@query("SELECT p_partkey, tag FROM (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(replace(p_name, ' ', ';') || ',,' || p_brand, '[,;]'), lambda x: x <> '')) AS tag FROM part)")
def tagset_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagset = F.concat(F.replace("p_name", F.lit(" "), F.lit(";")), F.lit(",,"), F.col("p_brand"))
    return t(spark, sf_dir, "part").select("p_partkey", F.explode(fn.tags(tagset)).alias("tag"))


@query("""
WITH r(key, rate) AS (SELECT event_type, max(CASE event_type WHEN 'click' THEN 0.25 ELSE 0.5 END) FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT event_id, coalesce(rate, 0.125)::DOUBLE AS rate FROM events LEFT JOIN r ON event_type = key
""")
def stratified_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame([("click", 0.25), ("click", 0.1), ("view", 0.5)], "key string, rate double")
    return sample.rates_by_row(t(spark, sf_dir, "events"), rates, "event_type", 0.125).select("event_id", "rate")


@query("""
WITH x AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(replace(p_name, ' ', ';'), '[,;]'), lambda x: x <> '')) AS tag FROM part)
SELECT p_partkey, max(CASE WHEN tag LIKE '%1' THEN 0.75 ELSE 0.125 END)::DOUBLE AS rate FROM x GROUP BY 1
""")
def tag_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t(spark, sf_dir, "part")
    tags = fn.tags(F.replace("p_name", F.lit(" "), F.lit(";")))
    rates = parts.select(F.explode(tags).alias("key")).distinct().filter("key like '%1'").withColumn("rate", F.lit(0.75))
    return sample.rates_by_tags(parts, rates, "p_partkey", tags, 0.125)


@query("SELECT event_type, count(*) AS n, true AS as_many_as_the_rate FROM events GROUP BY 1")
def sample_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sample of each type has as many rows as its rate says, within five standard deviations."""
    rates = spark.createDataFrame([("click", 0.5)], "key string, rate double")
    rated = sample.rates_by_row(t(spark, sf_dir, "events"), rates, "event_type", 0.1)
    drawn = sample.sample_by_rate(rated, "rate", ["event_id"]).groupBy("event_type").agg(F.count("*").alias("drawn"))
    whole = rated.groupBy("event_type").agg(F.count("*").alias("n"), F.max("rate").alias("p"))
    off = F.abs(F.coalesce("drawn", F.lit(0)) - F.col("n") * F.col("p"))
    return whole.join(drawn, "event_type", "left").select("event_type", "n", (off <= 5 * F.sqrt(F.col("n") * F.col("p") * (1 - F.col("p")))).alias("as_many_as_the_rate"))


@query("""
SELECT event_id, strftime(ts + INTERVAL 19800 SECOND, '%Y-%m-%d %H:%M:%S') AS full_time, strftime(ts, '%Y-%m-%d %H') AS by_hour, strftime(ts, '%Y') AS by_year,
       strftime(TIMESTAMP '1970-01-01' + to_seconds(event_id * 1000000), '%Y-%m-%d %H:%M') AS epoch
FROM events
""")
def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    return t(spark, sf_dir, "events").select(
        "event_id", fn.time_format(ts, "S", 19800).alias("full_time"), fn.time_format(ts, "H").alias("by_hour"), fn.time_format(ts, "y").alias("by_year"),
        fn.epoch_format(F.col("event_id") * 1000000, "M").alias("epoch"),
    )


_PACKED = "(shiftleft((o_orderkey % 3), 56) | shiftleft((o_orderkey % 200), 48) | shiftleft((o_custkey % 60000), 32) | shiftleft((o_orderkey % 50000), 16) | (o_custkey % 1000))"
_PLATFORM = "CASE o_orderkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'ios' ELSE '2' END"


@query(f"""
SELECT o_orderkey, {_PLATFORM} AS r0, {_PLATFORM} || '/' || (o_orderkey % 200) || '.' || (o_custkey % 60000) AS r2,
       {_PLATFORM} || '/' || (o_orderkey % 200) || '.' || (o_custkey % 60000) || '.' || (o_orderkey % 50000) || '.' || (o_custkey % 1000) AS r4 FROM orders
""")
def version_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, names = F.expr(_PACKED), {0: "web", 1: "ios"}
    return t(spark, sf_dir, "orders").select("o_orderkey", *(fn.version_format(packed, names, r).alias(f"r{r}") for r in (0, 2, 4)))


@query("SELECT o_orderkey, (o_orderkey % 200) * 1000000000000000 + (o_custkey % 60000) * 10000000000 + (o_orderkey % 50000) * 100000 + (o_custkey % 1000) AS version FROM orders")
def decimal_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", fn.decimal_version(F.expr(_PACKED)).alias("version"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE CAST(o_orderkey % 4 AS VARCHAR) END AS name FROM orders")
def enum_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", fn.enum_decode(F.col("o_orderkey") % 4, ["a", "b"]).alias("name"))


@query("SELECT '[' || n_nationkey || ',\"' || n_name || '\",' || n_regionkey || ']' AS record FROM nation")
def json_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("""
SELECT upper('93' || lpad(to_hex(n_nationkey), 2, '0') || to_hex(160 + strlen(n_name)) || hex(n_name) || lpad(to_hex(n_regionkey), 2, '0')) AS record FROM nation
""")
def msgpack_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msgpack_rows(t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")).select(F.hex("record").alias("record"))


@query("""
SELECT '[' || n_nationkey || ',"' || n_name || '<0x7f>",[' || CASE WHEN n_nationkey % 2 = 0 THEN 'null' ELSE '0.5' END || ',1.5],{"x":' || CASE WHEN n_nationkey % 3 = 0 THEN 'null' ELSE '2.5' END || '},"a<0xff>b"]' AS record FROM nation
""")
def json_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles that aren't finite, inside an array and a struct, a control character, and bytes that aren't UTF-8."""
    key, nan = F.col("n_nationkey"), F.lit(float("nan"))
    rows = t(spark, sf_dir, "nation").select(
        key, F.concat("n_name", F.lit("\x7f")).alias("name"), F.array(F.when(key % 2 == 0, nan).otherwise(0.5), F.lit(1.5)).alias("list"),
        F.struct(F.when(key % 3 == 0, F.lit(float("inf"))).otherwise(2.5).alias("x")).alias("inner"), F.unhex(F.lit("61FF62")).alias("raw"),
    )
    return json_rows(rows)


@query("""
SELECT event_id // 5 AS buffer_id, event_id, 9007199254740993 + event_id AS big, CASE WHEN event_id % 2 = 0 THEN value ELSE CAST(event_id AS DOUBLE) END AS amount,
       CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 2 THEN 'shared' END AS label FROM events
""")
def cells_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of cells and back: 64-bit integers, floats kept as integers, texts of the event, null there, or of its buffer."""
    rows = t(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 5).alias("buffer_id"), "event_id", "event_type", "value")
    no, none = F.lit(False), lambda kind: F.lit(None).cast(kind)

    def cell(field: int, is_null: Column = no, is_float: Column = no, i: Column | None = None, f: Column | None = None, text: Column | None = None, event: Column | None = None) -> Column:
        values = (("event_id", event, "long"), ("int_value", i, "long"), ("float_value", f, "double"), ("str_value", text, "string"))
        return F.struct(F.lit(field).alias("field_id"), is_null.alias("is_null"), is_float.alias("is_float"), *((none(k) if v is None else v.cast(k)).alias(n) for n, v, k in values))

    event, even = F.col("event_id"), F.col("event_id") % 2 == 0
    own = [
        cell(1, i=event + 9007199254740993, event=event),
        cell(2, is_float=even, i=F.when(~even, event), f=F.when(even, F.col("value")), event=event),
        F.when(event % 3 != 2, cell(3, is_null=event % 3 == 1, text=F.when(event % 3 == 0, F.col("event_type")), event=event)),
    ]
    cells = rows.select("buffer_id", F.explode(F.filter(F.array(*own), lambda c: c.isNotNull())).alias("c"))
    shared = rows.select("buffer_id").distinct().select("buffer_id", cell(3, text=F.lit("shared")).alias("c"))
    stream = cells.unionByName(shared).select("buffer_id", "c.*").withColumn("is_field", F.lit(True))
    return fl.rows_from_cells(stream, {1: ("big", "int"), 2: ("amount", "float"), 3: ("label", "string")})


# Summaries.

_KEYS = {"ts": "cast(date_trunc('hour', ts) as timestamp_ntz)", "event_type": "event_type"}
_STATES = [State("n", "count"), State("users", "distinct", "user_id"), State("least", "min", "value"), State("most", "max", "value")]
_DAILY = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1"
_DAY = {"day": "cast(date_trunc('day', ts) as timestamp_ntz)"}


def _summary_of_parts(spark: SparkSession, sf_dir: str, again: bool) -> Summary:
    events, path = t(spark, sf_dir, "events"), scratch_path(spark, "summary")
    summary = Summary(spark, f"{path}/summary")
    parts = []
    for i in range(3):
        build(events.filter(F.col("event_id") % 3 == i), _KEYS, _STATES).write.parquet(f"{path}/part{i}_x")
        parts.append(f"{path}/part{i}_x")
    summary.merge(parts[:2], list(_KEYS), _STATES)
    summary.merge(parts[1:] if again else parts[2:])
    if again:
        summary.merge([*parts, f"{path}/nowhere_1"])
    return summary


@query(_DAILY)
def summary_requery(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = build(t(spark, sf_dir, "events"), _KEYS, _STATES)
    return requery(hourly, _DAY, [s for s in _STATES if s.kind != "distinct"])


@query(_DAILY)
def summary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary_of_parts(spark, sf_dir, False).query(_DAY, ["n", "least", "most"])


@query(_DAILY)
def summary_merge_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary_of_parts(spark, sf_dir, True).query(_DAY, ["n", "least", "most"])


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1")
def summary_hour_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "hours")
    write_by_hour(build(t(spark, sf_dir, "events"), _KEYS, [_STATES[0]]), "ts", path)
    some = read_hours(spark, path, datetime(2024, 1, 10), datetime(2024, 1, 12))
    return requery(some, {"event_type": "event_type"}, [_STATES[0]])


@query(_DAILY)
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events whose micro-batches are merged into a summary."""
    schema, path = t(spark, sf_dir, "events").schema, scratch_path(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").load(f"{sf_dir}/events.parquet*")
    stream_summary(stream, f"{path}/summary", _KEYS, _STATES, f"{path}/checkpoint").awaitTermination()
    return Summary(spark, f"{path}/summary").query(_DAY, ["n", "least", "most"])
