"""Fields, scalars, orders and samples."""

from pyspark.sql import functions as F

from quernstone.functions import fields, scalars
from quernstone.operators import sample


def test_local_over_global(spark):
    rows = [(1, {"os": "ios"}, {}, ["os"]), (2, {"os": "ios"}, {"os": "web"}, ["os"]), (3, {"os": "ios"}, {"os": None}, ["os"]), (4, {"os": None}, {}, ["os"]), (5, {"os": "ios"}, {}, []), (6, None, None, ["os"])]
    expected = {1: {"os": "ios"}, 2: {"os": "web"}, 3: {"os": None}, 4: {}, 5: {}, 6: {}}
    for n, shared, local, allowed in rows:
        df = spark.createDataFrame([(shared, local)], "a map<string,string>, b map<string,string>")
        assert df.select(fields.resolve(F.col("a"), F.col("b"), allowed).alias("m")).first().m == expected[n]


def test_explode_events(spark):
    df = spark.createDataFrame([(1, {"os": "ios"}, [("click", {"x": "1"}), ("view", {})])], "buffer_id long, attrs map<string,string>, events array<struct<event:string,fields:map<string,string>>>")
    rows = fields.explode_events(df, {"click": ["os"]}).orderBy("event_no").collect()
    assert [(r.event, r.star) for r in rows] == [("click", {"os": "ios", "x": "1"}), ("view", {})]
    local = df.select(fields.local_fields(F.col("attrs"), ["no"]).alias("m"), fields.field_of(F.col("attrs"), "none").alias("f")).first()
    assert local.m == {} and local.f is None


def test_cells(spark):
    schema = "buffer_id long, event_id long, is_field boolean, field_id int, is_null boolean, is_float boolean, int_value long, float_value double, str_value string"
    cells = [
        (1, None, False, 1, False, False, None, None, "ios"), (1, 10, True, 2, False, True, None, -2.9, None), (1, 10, True, 3, False, False, -4, None, None),
        (1, 11, True, 1, True, False, None, None, None), (1, 11, True, 2, False, False, 7, None, None), (2, 12, True, 3, False, False, 5, None, None),
    ]
    rows = fields.rows_from_cells(spark.createDataFrame(cells, schema), {1: ("os", "string"), 2: ("n", "int"), 3: ("x", "float")}).orderBy("event_id").collect()
    assert [(r.os, r.n, r.x) for r in rows] == [("ios", -2, -4.0), (None, 7, None), (None, None, 5.0)]


def test_versions_and_enums(spark):
    packed = (1 << 56) | (2 << 48) | (3 << 32) | (4 << 16) | 5
    df = spark.createDataFrame([(packed,)], "p long")
    row = df.select(*(scalars.version_format(F.col("p"), {1: "ios"}, r).alias(f"r{r}") for r in range(5)), scalars.decimal_version(F.col("p")).alias("d")).first()
    assert list(row) == ["ios", "ios/2", "ios/2.3", "ios/2.3.4", "ios/2.3.4.5", 2000030000400005]
    codes = spark.createDataFrame([(0,), (1,), (9,), (-1,), (None,)], "c int").select(scalars.enum_decode(F.col("c"), ["a", "b"]).alias("n")).collect()
    assert [r.n for r in codes] == ["a", "b", "9", "-1", None]


def test_times(spark):
    row = spark.range(1).select(
        scalars.epoch_format(F.lit(0), "S", 3600).alias("a"), scalars.epoch_format(F.lit(4_102_444_800), "y").alias("b"), scalars.time_format(F.expr("timestamp_ntz'2024-03-31 23:30:00'"), "d", 3600).alias("c")
    ).first()
    assert list(row) == ["1970-01-01 01:00:00", "2100", "2024-04-01"]


def test_tags_coercion_bits(spark):
    row = spark.createDataFrame([("a,b;;c", -2.9, 5)], "t string, v double, b long").select(
        scalars.tags(F.col("t")).alias("tags"), scalars.coerce(F.col("v"), "int").alias("i"), scalars.coerce(F.col("v"), "unknown").alias("u"), scalars.coerce(F.col("b"), "bool").alias("o"),
        scalars.set_bit(F.col("b"), 1).alias("s"), scalars.clear_bit(F.col("b"), 0).alias("c"), scalars.test_bit(F.col("b"), 2).alias("t"), scalars.assign_bit(F.col("b"), 3, F.lit(True)).alias("a"),
    ).first()
    assert list(row) == [["a", "b", "c"], -2, None, True, 7, 4, True, 13]
    # All tags, or those of the original's buffer: 100, of 4096 bytes.
    wide = spark.createDataFrame([(",".join(map(str, range(300))),), (",".join("é" * 100 for _ in range(40)),)], "t string")
    counts = wide.select(F.size(scalars.tags(F.col("t"))), F.size(scalars.tags(F.col("t"), strict_compat=True))).collect()
    assert list(map(tuple, counts)) == [(300, 100), (40, 21)]


def test_order_and_samples(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "i long, s string")
    assert [r.i for r in sample.order_by(df, ["-s"]).collect()] == [2, 3, 1]
    assert [r.i for r in sample.order_by(df, ["s"], 2).collect()] == [3, 2]
    assert "TakeOrderedAndProject" in sample.order_by(df, ["s"], 2)._jdf.queryExecution().executedPlan().toString()
    assert sample.reservoir(df, 2, 1).count() == 2 and sample.first_n(df, 2).count() == 2


def test_rates(spark):
    rates = spark.createDataFrame([("a", 0.1), ("a", 0.5), (None, 0.9)], "key string, rate double")
    df = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "i long, k string")
    assert {r.i: r.rate for r in sample.rates_by_row(df, rates, "k", 0.2).collect()} == {1: 0.5, 2: 0.2, 3: 0.9}
    tagged = spark.createDataFrame([(1, "x;a"), (2, ""), (3, None)], "i long, t string")
    assert {r.i: r.rate for r in sample.rates_by_tags(tagged, rates.filter("key is not null"), "i", scalars.tags(F.col("t")), 0.2).collect()} == {1: 0.5, 2: 0.2, 3: 0.2}
    many = spark.range(10_000).withColumn("r", F.lit(0.3))
    kept = sample.sample_by_rate(many, "r", ["id"])
    assert abs(kept.count() - 3000) < 200 and sorted(r.id for r in kept.collect()) == sorted(r.id for r in sample.sample_by_rate(many.repartition(7), "r", ["id"]).collect())


def test_cells_keep_all_bits(spark):
    cells = spark.createDataFrame([(1, 1, True, 7, False, False, 2**53 + 1, None, None), (1, 2, True, 7, False, True, None, 2.9, None), (1, None, True, 8, False, False, 72620556876513285, None, None)], "buffer_id long, event_id long, is_field boolean, field_id int, is_null boolean, is_float boolean, int_value long, float_value double, str_value string")
    rows = fields.rows_from_cells(cells, {7: ("n", "int"), 8: ("v", "version")}).orderBy("event_id").collect()
    assert [(r.n, r.v) for r in rows] == [(2**53 + 1, 72620556876513285), (2, 72620556876513285)]
