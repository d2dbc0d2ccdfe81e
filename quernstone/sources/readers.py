"""Sources: Parquet, JSON, CSV, ORC and text files, by suffix, alone or as lists, with missing and rotated files tolerated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Formats by suffix; a codec's suffix behind it is left to Spark.
FORMATS = {"parquet": "parquet", "pq": "parquet", "json": "json", "jsonl": "json", "log": "json", "csv": "csv", "orc": "orc", "txt": "text"}
CODECS = ("gz", "bz2", "lz4", "snappy", "zst", "deflate", "rotated")


def format_of(path: str) -> str:
    parts = path.rstrip("/").rsplit("/", 1)[-1].split(".")[1:]
    while parts and parts[-1] in CODECS:
        parts.pop()
    if not parts or parts[-1] not in FORMATS:
        raise ValueError(f"no format for {path}")
    return FORMATS[parts[-1]]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def candidates(path: str) -> list[str]:
    """Where a file may be: a log that was rotated meanwhile has .rotated behind its name."""
    return [path] if path.endswith(tuple(f".{c}" for c in CODECS)) else [path, f"{path}.rotated"]


def read_any(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None, missing_ok: bool = True, tolerate_corrupt: bool = False) -> DataFrame:
    """All rows of all paths (each of any supported format) as one DataFrame, columns by name; what a file lacks is null.

    Paths of one format are read in one scan. Missing paths are skipped if missing_ok, as are files that vanish while reading. A
    corrupt record ends the query unless tolerate_corrupt.
    """
    by: dict[str, list[str]] = {}
    for path in paths:
        place = next((c for c in candidates(path) if _exists(spark, c)), None)
        if place is None:
            if not missing_ok:
                raise FileNotFoundError(path)
            continue
        by.setdefault(format_of(path), []).append(place)
    if not by:
        if schema is None:
            raise FileNotFoundError("none of the paths exists, and no schema is given")
        return spark.createDataFrame([], schema)
    frames = []
    for kind, places in by.items():
        reader = spark.read.option("ignoreMissingFiles", str(missing_ok).lower()).option("mode", "PERMISSIVE" if tolerate_corrupt else "FAILFAST")
        if schema is not None:
            reader = reader.schema(schema)
        if kind == "csv":
            reader = reader.option("header", "true")
        frames.append(reader.format(kind).load(places))
    return union_all(*frames)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_list(spark: SparkSession, listing: str, **options) -> DataFrame:
    """read_any over the paths that a text file lists, one a line (a list of files, not of rows: it is read by the driver)."""
    return read_any(spark, *(r.value for r in spark.read.text(listing).collect() if r.value.strip()), **options)
