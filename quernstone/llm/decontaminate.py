"""Benchmark decontamination: short test items found inside long documents by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles into sizes up to 2, 4, 8, ... Each item keeps its bottom-k MinHash
sketch, with k from the partition's upper bound u: more than u less the shingles that the threshold asks of u. So a document
that holds enough of an item's shingles holds one of the sketch at least, whatever the document's length: no item is missed.
Documents are probed with all their shingles; what they hit is verified by exact containment of all the item's shingles.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, shared_path
from .segments import chunks

WORD = re.compile(r"[^\W_]+")
WORDS, THRESHOLD = 5, 0.8
#: Items, and code points of their texts, that are broadcast at a time; documents are read once for each such block of items.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8 << 20

Shingle = tuple[str, ...]
LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType())])


def words_of(text: str) -> Iterator[list[str]]:
    """Lower-cased runs of letters and digits of a whole text, a chunk at a time."""
    for part in chunks(text):
        yield WORD.findall(part.lower())


def shingles(parts: Iterable[list[str]], n: int) -> Iterator[Iterable[Shingle]]:
    """All runs of n words, a chunk at a time; of a text with fewer words, all its words; of none, nothing."""
    tail: list[str] = []
    whole = True
    for part in parts:
        words = tail + part
        if len(words) >= n:
            whole = False
            yield zip(*(words[i:] for i in range(n)), strict=False)
            tail = words[len(words) - n + 1 :] if n > 1 else []
        else:
            tail = words
    if whole and tail:
        yield [tuple(tail)]


def item_shingles(text: str, n: int) -> frozenset[Shingle]:
    return frozenset(s for part in shingles(words_of(text), n) for s in part)


def least_shared(total: int, threshold: float) -> int:
    """The fewest of total shingles whose share reaches threshold."""
    m = max(1, math.floor(threshold * total) - 1)
    while m / total < threshold:
        m += 1
    return m


def sketch(item: frozenset[Shingle], threshold: float) -> list[Shingle]:
    """The bottom-k MinHash sketch of an item, k by its size partition."""
    upper = 1 << max(0, (len(item) - 1).bit_length())
    k = upper - least_shared(upper, threshold) + 1
    return sorted(item, key=lambda s: (xxhash.xxh64_intdigest("\x1f".join(s)), s))[:k]


@dataclass
class Block:
    """Items that are searched together."""

    texts: list[tuple[int | None, str]]
    n: int
    threshold: float

    def index(self) -> Searcher:
        """Made once in each worker, as that keeps what was broadcast."""
        if "_index" not in self.__dict__:
            self._index = Searcher(self)
        return self._index

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_index"}


class Searcher:
    def __init__(self, block: Block):
        self.n, self.threshold = block.n, block.threshold
        self.items = [(i, item_shingles(t, block.n)) for i, t in block.texts]
        self.by_shingle: dict[Shingle, list[int]] = {}
        for place, (_, item) in enumerate(self.items):
            for s in sketch(item, block.threshold):
                self.by_shingle.setdefault(s, []).append(place)

    def leaks(self, text: str) -> list[dict]:
        """The items of which text holds enough, in order of their ids."""
        hit: set[Shingle] = set()
        for part in shingles(words_of(text), self.n):
            hit.update(self.by_shingle.keys() & part)
        if not hit:
            return []
        places = sorted({p for s in hit for p in self.by_shingle[s]})
        wanted = frozenset().union(*(self.items[p][1] for p in places))
        held: set[Shingle] = set()
        for part in shingles(words_of(text), self.n):
            held.update(wanted.intersection(part))
        found = []
        for p in places:
            item_id, item = self.items[p]
            shared = len(item & held)
            if shared / len(item) >= self.threshold:
                found.append({"item_id": item_id, "n_shared": shared, "n_item": len(item)})
        return sorted(found, key=lambda x: (x["item_id"] is not None, x["item_id"]))


def blocks_of(benchmark: DataFrame, item_id: str, text: str, n: int, threshold: float) -> Iterator[Block]:
    """The benchmark's items in blocks of bounded size, of which the driver holds one at a time."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).filter(F.length("t") > 0)
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        if held and (len(held) >= BLOCK_ITEMS or size + len(row.t) > BLOCK_CHARS):
            yield Block(held, n, threshold)
            held, size = [], 0
        held.append((row.i, row.t))
        size += len(row.t)
    if held:
        yield Block(held, n, threshold)


def mark_leaks(docs: DataFrame, block: Block, text: str = "text") -> DataFrame:
    """docs with leaks: of one block of items, those (item_id, n_shared, n_item) of whose shingles the whole text holds enough."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_ITEMS and BLOCK_CHARS
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())]))

    def make():
        searcher = shared.value.index()
        return lambda texts: [pa.array([searcher.leaks(x) for x in texts], kind)]

    return add_columns(docs, text, [T.StructField("leaks", T.ArrayType(LEAK))], make)


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_item, containment): documents that hold threshold or more of an item's distinct shingles.

    Shingles are n lower-cased words (runs of letters and digits); a text of fewer words is one shingle, so a short item only
    matches an equally short document. Null and empty texts have none and match nothing. Each repeated row of documents or
    benchmark has its own pairs; null ids stay null. Empty tables give no pairs. Long texts go through in chunks. Other columns don't matter. The benchmark is taken
    in blocks of bounded size; with more than one, each block's pairs are written to the shared folder.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def pairs(block: Block) -> DataFrame:
        found = mark_leaks(chosen, block).filter(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("leak"))
        return found.select("doc_id", "leak.*", (F.col("leak.n_shared") / F.col("leak.n_item")).alias("containment"))

    blocks = blocks_of(benchmark, item_id, text, n, threshold)
    first, second = next(blocks, Block([], n, threshold)), next(blocks, None)
    if second is None:
        return pairs(first)
    path = shared_path(spark, "leaks")
    for block in chain((first, second), blocks):
        pairs(block).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, by find_leaks' rules, with their columns as they are (one called leaks is kept)."""
    original = docs.columns
    kept = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(original)))
    at = f"_{original.index(text)}"
    for block in blocks_of(benchmark, item_id, text, n, threshold):
        kept = mark_leaks(kept, block, at).filter(F.size("leaks") == 0).drop("leaks")
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(original)))


ORACLE = r"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
    UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark
), shingles AS (
    SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE kind = 'b' GROUP BY id
), shared AS (
    SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
    FROM shingles d JOIN shingles b ON d.s = b.s AND d.kind = 'd' AND b.kind = 'b' GROUP BY ALL
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes ON item_id = sizes.id WHERE n_shared / n_item >= 0.8
"""
