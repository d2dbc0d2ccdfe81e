"""Token counts: Arrow functions that encode in batches and return lengths only."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_SLICE_BYTES, WordCache, add_columns, coded, in_groups, sums
from .segments import WHITE, WITH_SPACE, chunks

#: Characters of the segments that the library is given at a time.
BATCH_CHARS = 1 << 18
_counters: dict[str, WordCache] = {}


def segment_counter(tokenizer: str) -> WordCache:
    """Ids by segment, found by the library's encode_batch in batches of like size. One for each worker and tokenizer."""
    if tokenizer not in _counters:
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(tokenizer)
        library.no_truncation()
        library.no_padding()

        def lengths(segments: list[str]) -> list[int]:
            found: list[int] = []
            ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
            while (i := len(found)) < len(segments):
                stop = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_CHARS, side="right")))
                found += map(len, library.encode_batch(segments[i:stop], add_special_tokens=False))
            return found

        _counters.clear()
        _counters[tokenizer] = WordCache(lengths)
    return _counters[tokenizer]


#: A space beside other white space: then a segment isn't one space and what is up to the next.
_MIXED = re.compile(f"[{WHITE}] | [{WHITE}]")


def count_texts(texts: list[str], cache: WordCache) -> np.ndarray:
    """Tokens of whole texts. Byte-level patterns never join a character and the white space behind it, so segments (white space and what follows it) are counted apart."""
    total = np.zeros(len(texts), np.int64)
    for owners, parts in in_groups(texts, chunks, WORD_SLICE_BYTES):
        mixed = np.fromiter((_MIXED.search(p) is not None for p in parts), bool, len(parts))
        plain = [p for p, m in zip(parts, mixed, strict=True) if not m]
        lists = pc.split_pattern(pa.array(plain, pa.string()), " ")
        values, index = coded(lists, cache, " ".__add__)
        counts = sums(np.array(values, np.int64)[index], lists)
        firsts = [p.partition(" ")[0] for p in plain]  # those have no space before them
        counts += np.array(cache.values(firsts), np.int64) - np.array(cache.values([f" {x}" for x in firsts]), np.int64)
        odd = pa.array([WITH_SPACE.findall(p) for p, m in zip(parts, mixed, strict=True) if m], pa.list_(pa.string()))
        values, index = coded(odd, cache)
        all_counts = np.zeros(len(parts), np.int64)
        all_counts[~mixed], all_counts[mixed] = counts, sums(np.array(values, np.int64)[index], odd)
        np.add.at(total, owners, all_counts)
    return total


def read_tokenizer(path: str) -> str:
    """The tokenizer file's content, read once on the driver and sent along with the function, so that executors need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    The tokenizer must be byte-level with the usual pattern that puts one space before a word (kind ByteLevel). Special strings
    inside a text count as the library's default does; no begin, end or added tokens, truncation or padding.
    Null and empty texts: 0 bytes, 0 tokens, false. Repeated rows each get their own result. Columns of df that have one of
    these names are replaced; all others pass through. An empty table gives an empty table. Memory: one slice of rows by bytes,
    chunks of a long text, and a cache bounded by bytes. A text of any
    length without white space, signs and digits is one segment for the library.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))  # the size of one vocabulary file

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = segment_counter(shared.value)
        return lambda texts: [pa.array(count_texts(texts, cache))]

    counted = add_columns(df, text, [T.StructField("n_tokens", T.LongType())], make, WORD_SLICE_BYTES)
    n_bytes = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    return counted.withColumn("n_bytes", n_bytes).withColumn("over_limit", F.col("n_tokens") > limit)
