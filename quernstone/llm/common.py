"""What the operators share: folders all executors see, Arrow batches by bytes, bounded word caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that an Arrow function takes at a time.
SLICE_BYTES = 4 << 20
#: The same for functions that work on distinct words, which larger slices have fewer of.
WORD_SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, set here to a temporary one only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        made = context._jsc.sc().getCheckpointDir()
        if made.isDefined():
            base = made.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            base = f"file://{tempfile.mkdtemp(prefix='quernstone-')}"
        else:
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
    """The same rows from a table written in the shared folder, which cuts their lineage; and the table's path, for removed()."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    return stored(df)[0]


def nullable(fields: Iterable[T.StructField]) -> list[T.StructField]:
    return [T.StructField(f.name, f.dataType, True) for f in fields]


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about limit bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            floor = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, floor + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return strings(pc.fill_null(column, ""))


def strings(column: pa.Array) -> list[str]:
    """Python strings of a column without nulls, in less time than to_pylist takes."""
    return column.to_numpy(zero_copy_only=False).tolist()


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str]], list[pa.Array]]], limit: int = SLICE_BYTES) -> DataFrame:
    """df with the columns that make()(texts) returns for each slice of texts. A column of df that has the name of a new one is replaced."""
    names = {f.name for f in fields}
    base = df.select([df[f"`{c}`"] for c in df.columns if c not in names])
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, at, limit):
            yield pa.RecordBatch.from_arrays([*part.columns, *work(texts_of(part.column(at)))], names=[*part.schema.names, *(f.name for f in fields)])

    return base.mapInArrow(run, T.StructType(nullable([*base.schema.fields, *fields])))


class WordCache:
    """Values by word in two generations of about limit bytes each: memory is bounded by bytes, frequent words stay. Words of over LONG characters are worked out each time."""

    LONG = 64
    #: What an entry takes beside the characters and the value's own bytes.
    ENTRY = 200

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = 24 << 20):
        self.compute, self.limit, self.now, self.old, self.held = compute, limit, {}, {}, 0

    def values(self, words: list[str]) -> list:
        """The values of words, in their order."""
        found = list(map(self.now.get, words))
        if None not in found:
            return found
        places = [i for i, v in enumerate(found) if v is None]
        missing = [words[i] for i in places]
        if self.old:
            got = list(map(self.old.get, missing))
            new = iter(self.compute([w for w, v in zip(missing, got, strict=True) if v is None]))
            got = [next(new) if v is None else v for v in got]
        else:
            got = list(self.compute(missing))
        for i, v in zip(places, got, strict=True):
            found[i] = v
        self._keep(missing, got)
        return found

    def value(self, word: str) -> object:
        return value if (value := self.now.get(word)) is not None else self.values([word])[0]

    def _keep(self, words: list[str], values: list) -> None:
        """Add what is new, in pieces, so that it is never much more than limit."""
        for i in range(0, len(words), 1 << 14):
            some, their = words[i : i + (1 << 14)], values[i : i + (1 << 14)]
            if max(map(len, some)) > self.LONG:
                kept = [(w, v) for w, v in zip(some, their, strict=True) if len(w) <= self.LONG]
                some, their = [w for w, _ in kept], [v for _, v in kept]
            self.held += self.ENTRY * len(some) + 2 * sum(map(len, some)) + (sum(map(len, their)) if their and isinstance(their[0], bytes) else 0)
            self.now.update(zip(some, their, strict=True))
            if self.held > self.limit:
                self.old, self.now, self.held = self.now, {}, 0


def in_groups(texts: list[str], chunks: Callable[[str], Iterator[str]], limit: int = SLICE_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, long ones in chunks, in groups of about limit characters: the places of the texts that the parts are of, and the parts."""
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for owner, text in enumerate(texts):
        for part in chunks(text):
            owners.append(owner)
            parts.append(part)
            size += len(part)
            if size >= limit:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def coded(lists: pa.ListArray, cache: WordCache, key: Callable[[str], str] | None = None) -> tuple[list, np.ndarray]:
    """The values of the distinct words of lists, each looked up once (as key(word)), and for all words in a row the place of its value."""
    words = lists.flatten().dictionary_encode()
    distinct = strings(words.dictionary)
    return cache.values(list(map(key, distinct)) if key else distinct), words.indices.to_numpy()


def gathered(lists: pa.ListArray, cache: WordCache, key: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The values (bytes of u32 numbers) of all words of lists in a row, and where each list's begin, with the end last."""
    values, index = coded(lists, cache, key)
    numbers, ends = runs(values, index)
    return numbers, ends[lists.offsets.to_numpy()]


def runs(values: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The u32 numbers of values[index[0]], values[index[1]] ... in a row, and where each one's begin, with the end last."""
    lengths = np.fromiter(map(len, values), np.int64, len(values)) >> 2
    numbers = np.frombuffer(b"".join(values), "<u4")
    counts = lengths[index]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    at = np.repeat(((np.cumsum(lengths) - lengths)[index] - ends[:-1]).astype(np.int32), counts)
    at += np.arange(len(at), dtype=np.int32)
    return numbers[at], ends


def sums(values: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """The sum of the values of each list's words."""
    offsets = lists.offsets.to_numpy()
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def removed(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate data that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
