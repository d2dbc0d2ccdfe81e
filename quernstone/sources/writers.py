"""Sinks: rows as JSON arrays or MessagePack, with a header, and run statistics."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite_or_null


def _plain(column: Column, kind: T.DataType) -> Column:
    """A value of which each part can be JSON: doubles that aren't finite are null, also inside arrays, structs and maps; 0x7f in texts is <0x7f>."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return finite_or_null(column)
    if isinstance(kind, T.StringType):
        return F.replace(column, F.lit("\x7f"), F.lit("<0x7f>"))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: _plain(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(_plain(column[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return column


def _json_value(df: DataFrame, name: str) -> Column:
    """A column as JSON text."""
    column = _plain(F.col(f"`{name}`"), df.schema[name].dataType)
    whole = F.to_json(F.array(column), {"ignoreNullFields": "false"})
    return whole.substr(F.lit(2), F.length(whole) - 2)


def json_rows(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON array. Binary columns are texts of unknown encoding: what isn't UTF-8 is written as <0xNN>."""
    for field in df.schema.fields:
        if isinstance(field.dataType, T.BinaryType):
            order = df.columns
            df = escaped(df, field.name, f"{field.name}_text_").select(*(F.col(f"`{c}_text_`" if c == field.name else f"`{c}`").alias(c) for c in order))
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *(_json_value(df, c) for c in df.columns)), F.lit("]")).alias(name))


def json_header(df: DataFrame) -> str:
    """The record that goes before rows: their columns' names and types."""
    import json

    return json.dumps({"columns": df.columns, "types": [t for _, t in df.dtypes]})


def write_json_rows(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """JSON arrays, one a line, in text files; at most rows_per_file in each if that is given. The header lies beside them in _header."""
    json_rows(df).write.option("maxRecordsPerFile", rows_per_file).text(f"{path}/rows")
    df.sparkSession.createDataFrame([(json_header(df),)], "value string").coalesce(1).write.text(f"{path}/header")


def pack(value: Any) -> bytes:
    """value as MessagePack with the smallest integers and lengths."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if value >= 0:
            if value < 128:
                return bytes([value])
            for top, code, form in ((1 << 8, 0xCC, ">BB"), (1 << 16, 0xCD, ">BH"), (1 << 32, 0xCE, ">BI"), (1 << 64, 0xCF, ">BQ")):
                if value < top:
                    return struct.pack(form, code, value)
        elif value >= -32:
            return struct.pack("b", value)
        else:
            for top, code, form in ((1 << 7, 0xD0, ">Bb"), (1 << 15, 0xD1, ">Bh"), (1 << 31, 0xD2, ">Bi"), (1 << 63, 0xD3, ">Bq")):
                if value >= -top:
                    return struct.pack(form, code, value)
        raise OverflowError(value)
    if isinstance(value, float):
        return struct.pack(">Bd", 0xCB, value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(len(raw), 32, 0xA0, ((1 << 8, 0xD9, ">BB"), (1 << 16, 0xDA, ">BH"), (1 << 32, 0xDB, ">BI"))) + raw
    if isinstance(value, bytes | bytearray):
        return _head(len(value), 0, 0, ((1 << 8, 0xC4, ">BB"), (1 << 16, 0xC5, ">BH"), (1 << 32, 0xC6, ">BI"))) + bytes(value)
    if isinstance(value, dict):
        return _head(len(value), 16, 0x80, ((1 << 16, 0xDE, ">BH"), (1 << 32, 0xDF, ">BI"))) + b"".join(pack(x) for item in value.items() for x in item)
    if isinstance(value, list | tuple):
        return _head(len(value), 16, 0x90, ((1 << 16, 0xDC, ">BH"), (1 << 32, 0xDD, ">BI"))) + b"".join(map(pack, value))
    return pack(str(value))


def _head(n: int, small: int, base: int, wide: tuple) -> bytes:
    if n < small:
        return bytes([base | n])
    for top, code, form in wide:
        if n < top:
            return struct.pack(form, code, n)
    raise OverflowError(n)


def msgpack_rows(df: DataFrame, name: str = "record", length_prefixed: bool = False) -> DataFrame:
    """Each row as a MessagePack array; length_prefixed: with its bytes' number (32 bits, big-endian) in front. Times are texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                packed = [pack(list(row.values())) for row in batch.slice(i, 1024).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([struct.pack(">I", len(p)) + p if length_prefixed else p for p in packed], pa.binary())], names=[name])

    positions = df.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns)))  # names may repeat
    return positions.mapInArrow(run, T.StructType([T.StructField(name, T.BinaryType())]))


def escape_bytes(raw: bytes | None) -> str | None:
    """UTF-8 as it is; bytes that aren't, and 0x7f, as <0xNN>."""
    if raw is None:
        return None
    return "".join(f"<0x{ord(c) - 0xDC00:02x}>" if "\udc80" <= c <= "\udcff" else "<0x7f>" if c == "\x7f" else c for c in raw.decode("utf-8", "surrogateescape"))


def escaped(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a binary column as text: built-in decoding where it is valid, in Arrow batches where it isn't."""
    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name != name] + [T.StructField(name, T.StringType())]
    base = df.select(*(F.col(f"`{f.name}`") for f in fields[:-1]))
    at = base.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([escape_bytes(x) for x in batch.column(at).to_pylist()], pa.string())], names=[f.name for f in fields])

    return base.mapInArrow(run, T.StructType(fields))


def observed(df: DataFrame, name: str = "run", **metrics: Column) -> tuple[DataFrame, Observation]:
    """df and what will have been seen of it once an action has run: rows and any metrics given."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(n) for n, m in metrics.items())), seen
