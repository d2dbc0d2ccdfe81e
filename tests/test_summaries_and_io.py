"""Summaries, sources, sinks and streams."""

import json
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quernstone.operators import histogram
from quernstone.plans import summary
from quernstone.plans.spec import QuerySpec
from quernstone.plans.summary import State, Summary, build, merge, part_id
from quernstone.sources import readers, writers
from quernstone.streaming.streams import stream_rows, stream_summary

KEYS = {"k": "k"}
STATES = [State("n", "count"), State("total", "sum", "v"), State("users", "distinct", "u")]


def data(spark, n=60):
    return spark.range(n).select((F.col("id") % 4).alias("k"), F.col("id").alias("u"), (F.col("id") % 7).alias("v"))


def test_part_ids():
    assert part_id("x:/d/f.wms") == ("x", "/d/f.wms")
    assert part_id("/d/abc_1.wms")[0] == part_id("/d/abc.wms")[0] == part_id("/d/abc")[0] == "abc"
    assert part_id("hdfs://host/d/abc_2") == ("abc", "hdfs://host/d/abc_2")


def test_merge_is_idempotent(spark, tmp_path):
    df = data(spark)
    paths = []
    for i in range(3):
        build(df.filter(F.col("u") % 3 == i), KEYS, STATES).write.parquet(f"{tmp_path}/p{i}_x")
        paths.append(f"{tmp_path}/p{i}_x")
    s = Summary(spark, f"{tmp_path}/s")
    with pytest.raises(FileNotFoundError):
        s.read()
    assert s.merge([*paths[:2], f"{tmp_path}/gone_1"], ["k"], STATES)["parts"] == ["p0", "p1"]
    assert s.merge(paths)["generation"] == 2
    assert s.merge(paths)["generation"] == 2
    with pytest.raises(ValueError):
        s.merge([paths[0], f"p0:{paths[1]}"])
    got = {r.k: (r.n, r.total, r.users) for r in s.query(KEYS, ["n", "total", "users"]).collect()}
    assert got == {r.k: (r.n, r.t, r.n) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("t")).collect()}
    assert s.query({}, ["n"]).first().n == 60
    assert s.merge([f"{tmp_path}/gone_1"], strict_compat=True)["parts"] == ["gone", "p0", "p1", "p2"]
    build(df, KEYS, STATES).write.parquet(f"{tmp_path}/q")
    s.merge([f"{tmp_path}/q"], delete_inputs=True)
    assert not (tmp_path / "q").exists() and s.query({}, ["n"]).first().n == 120


def test_a_crash_leaves_the_generation_before(spark, tmp_path):
    s = Summary(spark, f"{tmp_path}/s")
    s.create(build(data(spark), KEYS, STATES), ["k"], STATES, ["a"])
    build(data(spark, 5), KEYS, STATES).write.parquet(f"{tmp_path}/s/gen=2")  # a writer that ended before its manifest
    assert s.query({}, ["n"]).first().n == 60
    build(data(spark, 8), KEYS, STATES).write.parquet(f"{tmp_path}/b")
    s.merge([f"{tmp_path}/b"])
    assert s.query({}, ["n"]).first().n == 68
    with pytest.raises(RuntimeError):
        s.folder.publish("manifests/0000000002.json", "{}")
    with pytest.raises(FileExistsError):
        s.create(build(data(spark), KEYS, STATES), ["k"], STATES)


def test_other_keys_are_null(spark):
    a = build(data(spark), KEYS, STATES[:2])
    b = build(data(spark).withColumn("j", F.lit("x")), {"k": "k", "j": "j"}, STATES[:2])
    rows = merge([a, b], ["k", "j"], STATES[:2]).groupBy("j").agg(F.sum("n").alias("n")).collect()
    assert {r.j: r.n for r in rows} == {None: 60, "x": 60}


def test_reading(spark, tmp_path):
    data(spark, 4).write.parquet(f"{tmp_path}/a.parquet")
    (tmp_path / "b.json").write_text('{"k": 9, "w": 1}\n')
    (tmp_path / "c.log.rotated").write_text('{"k": 8}\n')
    rows = readers.read_any(spark, f"{tmp_path}/a.parquet", f"{tmp_path}/b.json", f"{tmp_path}/c.log", f"{tmp_path}/none.json")
    assert sorted(r.k for r in rows.collect()) == [0, 1, 2, 3, 8, 9] and "w" in rows.columns
    with pytest.raises(FileNotFoundError):
        readers.read_any(spark, f"{tmp_path}/none.json", missing_ok=False)
    assert readers.read_any(spark, f"{tmp_path}/none.json", schema="k long").count() == 0
    (tmp_path / "list.txt").write_text(f"{tmp_path}/b.json\n")
    assert readers.read_list(spark, f"{tmp_path}/list.txt").first().k == 9
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_any(spark, f"{tmp_path}/bad.json", schema="k long").collect()
    with pytest.raises(ValueError):
        readers.format_of("x.exe")


def unpack(raw, at=0):
    """A small MessagePack reader for what pack writes."""
    c = raw[at]
    if c < 0x80 or c >= 0xE0:
        return (c if c < 0x80 else c - 256), at + 1
    if 0xA0 <= c < 0xC0:
        return raw[at + 1 : at + 1 + (c & 31)].decode(), at + 1 + (c & 31)
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], at + 1
    numbers = {0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q", 0xCB: ">d"}
    if c in numbers:
        return struct.unpack_from(numbers[c], raw, at + 1)[0], at + 1 + struct.calcsize(numbers[c])
    strings = {0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}
    if c in strings:
        n, at = struct.unpack_from(strings[c], raw, at + 1)[0], at + 1 + struct.calcsize(strings[c])
        return raw[at : at + n].decode(), at + n
    n, at = (c & 15, at + 1) if c < 0xA0 else (struct.unpack_from(">H" if c in (0xDC, 0xDE) else ">I", raw, at + 1)[0], at + (3 if c in (0xDC, 0xDE) else 5))
    is_map = 0x80 <= c < 0x90 or c in (0xDE, 0xDF)
    items = []
    for _ in range(n * (2 if is_map else 1)):
        x, at = unpack(raw, at)
        items.append(x)
    return (dict(zip(items[::2], items[1::2], strict=True)) if is_map else items), at


def test_msgpack(spark):
    for value in [None, True, False, 0, 127, 128, 255, 256, 65535, 65536, 2**32, 2**64 - 1, -1, -32, -33, -128, -129, -32769, -(2**63), 1.5, "", "a" * 31, "é" * 40, "x" * 70000, list(range(20)), {"a": [1, {"b": None}]}]:
        assert unpack(writers.pack(value)) == (value, len(writers.pack(value)))
    rows = writers.msgpack_rows(spark.createDataFrame([(1, "a", None, [1, 2])], "i long, s string, n double, l array<long>"), length_prefixed=True).collect()
    raw = bytes(rows[0].record)
    assert struct.unpack(">I", raw[:4])[0] == len(raw) - 4 and unpack(raw[4:])[0] == [1, "a", None, [1, 2]]


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q"\n\\', float("inf"), True, None), (2, "é", 0.1, None, {"a": 1})], "i long, s string, d double, b boolean, m map<string,long>")
    rows = [json.loads(r.record) for r in writers.json_rows(df).orderBy("record").collect()]
    assert rows == [[1, 'q"\n\\', None, True, None], [2, "é", 0.1, None, {"a": 1}]]
    writers.write_json_rows(df, f"{tmp_path}/out", 1)
    assert spark.read.text(f"{tmp_path}/out/rows").count() == 2
    assert json.loads(spark.read.text(f"{tmp_path}/out/header").first().value)["columns"] == ["i", "s", "d", "b", "m"]


def test_escaped_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xff\x7f\xc3\xa9"),), (None,)], "raw binary")
    assert [r.t for r in writers.escaped(df, "raw", "t").collect()] == ["a<0xff><0x7f>é", None]


def test_observed(spark):
    df, seen = writers.observed(spark.range(10), total=F.sum("id"))
    df.collect()
    assert seen.get == {"rows": 10, "total": 45}


def test_streams(spark, tmp_path):
    data(spark).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(data(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_summary(stream, f"{tmp_path}/s", KEYS, STATES, f"{tmp_path}/c").awaitTermination()
    s = Summary(spark, f"{tmp_path}/s")
    assert s.query({}, ["n"]).first().n == 60 and s.manifest()["parts"] == ["batch-0", "batch-1", "batch-2"]
    stream_rows(stream, QuerySpec(where="k = 1", columns={"u": "u"}), f"{tmp_path}/rows", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.text(f"{tmp_path}/rows").count() == 15


def _states(spark, n):
    return summary.build(spark.range(n).selectExpr("id % 2 as k"), {"k": "k"}, [summary.State("n", "count")])


def test_two_writers_of_one_generation(spark, tmp_path, monkeypatch):
    """The second one finishes while the first is about to publish, or to write: one of them fails, and what the manifest names is the winner's."""
    for step in ("publish", "write"):
        path = f"{tmp_path}/{step}"
        for name, n in (("a", 10), ("b", 100), ("base", 2)):
            _states(spark, n).write.parquet(f"{path}/{name}_x")
        states = [summary.State("n", "count")]
        summary.Summary(spark, f"{path}/s").merge([f"{path}/base_x"], ["k"], states)
        first, second, done = summary.Summary(spark, f"{path}/s"), summary.Summary(spark, f"{path}/s"), []
        real = summary.Folder.publish if step == "publish" else summary.merge

        def between(*args, real=real, second=second, path=path, done=done):
            if not done:
                done.append(1)
                second.merge([f"{path}/b_x"])
            return real(*args)

        monkeypatch.setattr(*((summary.Folder, "publish") if step == "publish" else (summary, "merge")), between)
        with pytest.raises(RuntimeError, match="faster"):
            first.merge([f"{path}/a_x"])
        monkeypatch.undo()
        assert first.manifest()["parts"] == ["b", "base"] and first.read().agg({"n": "sum"}).first()[0] == 102
        first.merge([f"{path}/a_x"])  # its part is still open
        assert first.manifest()["parts"] == ["a", "b", "base"] and first.read().agg({"n": "sum"}).first()[0] == 112
        folders = {x for x in first.folder.names(".") if x.startswith("gen=")}
        assert len(folders) == 2 and len(first.folder.names("manifests")) == 2 and first.manifest()["data"] in folders


def test_nothing_is_written_without_rows(spark, tmp_path):
    s = summary.Summary(spark, f"{tmp_path}/s")
    assert s.create(_states(spark, 0), ["k"], [summary.State("n", "count")]) == {} and s.manifest() is None
    assert not [x for x in s.folder.names(".") if x.startswith("gen=")]
    assert s.create(_states(spark, 4), ["k"], [summary.State("n", "count")])["generation"] == 1


def test_hours_that_are_not_there(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-01 05:30:00' as ts, 1 as n")
    summary.write_by_hour(rows, "ts", f"{tmp_path}/h")
    found = summary.read_hours(spark, f"{tmp_path}/h", datetime(2024, 1, 2), datetime(2024, 1, 3))
    assert found.count() == 0 and set(found.columns) == {"ts", "n", "hour"}
    assert summary.read_hours(spark, f"{tmp_path}/h", datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 6)).count() == 1


def test_histograms_of_other_bins_are_not_merged(spark):
    parts = [spark.createDataFrame([(float(x),) for x in values], "v double") for values in ((0, 1, 2, 3, 4), (100, 104))]
    with pytest.raises(Exception, match="different bins"):
        histogram.merge(*(histogram.histogram(p, [], "v", 2) for p in parts), keys=[]).collect()
    merged = histogram.merge_states(*(histogram.value_states(p, [], "v") for p in parts), keys=[])
    assert [r["count"] for r in histogram.histogram(merged, [], "value", 2, weight="count").orderBy("bin").collect()] == [5, 2]
