"""Token-ID output: blocks of separately compressed documents with a shared zstandard dictionary and an offset index.

A block is one binary value; blocks lie in Parquet files in ascending doc_id order, beside a one-row table with the dictionary,
so that any store Spark can write will do and a lost task is simply written again. Layout of a block, little-endian:

    magic "QTB1" | u8 bytes an id (2 or 4) | 3 zero bytes | 32 bytes SHA-256 of the dictionary (zeros: none)
    u64 n documents | u64 ids before this block within its part
    n x i64 doc_id | n x u8 doc_id is null | n x u64 ids of the document | (n + 1) x u64 offsets into what follows | frames

Each frame is one document's ids, compressed alone; so one document is read with its index entry and its own frame only.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_SLICE_BYTES, WordCache, in_groups, removed, runs, shared_path, slices, strings, texts_of
from .segments import WITHOUT_SPACE, chunks
from .token_counts import read_tokenizer

MAGIC, HEAD = b"QTB1", struct.Struct("<4sB3x32sQQ")
#: Bytes of frames after which a block ends.
BLOCK_BYTES = 1 << 20
#: The dictionary's size; training takes this many documents at most, and of each so many bytes of ids at one place at most.
DICTIONARY_BYTES, TRAIN_DOCUMENTS, TRAIN_BYTES = 64 << 10, 1000, 4 << 10

#: Bytes of the units, and of the words that are none, that are kept.
UNITS_KEPT, OTHERS_KEPT = 48 << 20, 16 << 20
_encoders: dict[str, WordEncoder] = {}

BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("doc_lo", T.LongType()),
    T.StructField("doc_hi", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("block", T.BinaryType()),
])


def _letters() -> dict[int, str]:
    """Byte-level tokenizers write each byte as a character: printable Latin-1 as itself, the others from U+0100 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}


def splits_letters(tokenizer: str) -> bool:
    """Whether a tokenizer composes, lower-cases and then takes runs of letters as units of a byte-level vocabulary, without added tokens of letters. Then the library's model can be given a word of letters directly."""
    spec = json.loads(tokenizer)
    normalizers = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        normalizers == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        and [x["type"] for x in before] == ["Split", "ByteLevel"] and before[0]["pattern"] == {"Regex": _UNITS} and before[0]["invert"] and before[0]["behavior"] == "Removed"
        and not before[1]["use_regex"] and not before[1]["add_prefix_space"] and not any(x["content"].isalpha() for x in spec["added_tokens"])
    )


# Fixed value: the pattern of units in such a tokenizer's file.
_UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Fixed value: ASCII's signs without the apostrophe. A unit ends between a letter and a sign, and a run of signs is one unit.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below U+0180: they are composed already and, but for one, have one lower-case letter.
_LETTERS = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c != "\u0130")


class WordEncoder:
    """Ids of words by the library: a word of Latin letters, with signs behind them or not, is one or two units for its model; any other is encoded as a text."""

    def __init__(self, tokenizer: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        library = Tokenizer.from_str(tokenizer)
        library.no_truncation()
        library.no_padding()
        tokenize, shown = library.model.tokenize, _letters()
        packers = [struct.Struct(f"<{n}I").pack for n in range(65)]

        def packed(ids: list[int]) -> bytes:
            return packers[len(ids)](*ids) if len(ids) < 65 else struct.pack(f"<{len(ids)}I", *ids)

        def by_model(units: list[str]) -> list[bytes]:
            return [packed([t.id for t in tokenize(u if u.isascii() else u.encode().decode("latin-1").translate(shown))]) for u in units]

        def by_library(words: list[str]) -> list[bytes]:
            return [packed(library.encode(w, add_special_tokens=False).ids) for w in words]

        self.has_units = splits_letters(tokenizer)
        self.units, self.others = WordCache(by_model, UNITS_KEPT), WordCache(by_library, OTHERS_KEPT)

    def ids(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids (u32) of all words of lists in a row, and where each list's begin, with the end last."""
        coded = lists.flatten().dictionary_encode()
        words, index, offsets = coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy()
        if not self.has_units:
            ids, ends = runs(self.others.values(strings(words)), index)
            return ids, ends[offsets]
        stem = pc.utf8_rtrim(words, characters=_SIGNS)
        known = pc.equal(pc.utf8_ltrim(stem, characters=_LETTERS), "").to_numpy(zero_copy_only=False)
        # Two units a word, the second one often empty. Other words are taken whole as the first.
        first, second = (x.dictionary_encode() for x in (pc.utf8_lower(stem.filter(known)), pc.utf8_ltrim(words.filter(known), characters=_LETTERS)))
        values = [b"", *self.units.values(strings(first.dictionary)), *self.units.values(strings(second.dictionary)), *self.others.values(strings(words.filter(~known)))]
        places = np.zeros((len(words), 2), np.int64)
        places[known, 0] = 1 + first.indices.to_numpy()
        places[known, 1] = 1 + len(first.dictionary) + second.indices.to_numpy()
        places[~known, 0] = np.arange(len(values) - int((~known).sum()), len(values))
        ids, ends = runs(values, places[index].ravel())
        return ids, ends[2 * offsets]


def word_encoder(tokenizer: str) -> WordEncoder:
    """One for each worker and tokenizer."""
    if tokenizer not in _encoders:
        _encoders.clear()
        _encoders[tokenizer] = WordEncoder(tokenizer)
    return _encoders[tokenizer]


def forget_words() -> None:
    _encoders.clear()


_OTHER_BLANKS = re.compile("[\x1c-\x1f]")


def words_of(texts: list[str]) -> pa.ListArray:
    """Words between Unicode's white space, some of them empty; Arrow also splits at four separators that aren't."""
    if any(map(_OTHER_BLANKS.search, texts)):
        return pa.array(list(map(WITHOUT_SPACE.findall, texts)), pa.list_(pa.string()))
    return pc.utf8_split_whitespace(pa.array(texts, pa.string()))


def encode_texts(texts: list[str], words: WordEncoder, end_id: int | None) -> list[np.ndarray]:
    """Whole texts' ids as u32. For tokenizers that drop white space; then words are encoded apart."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for owners, parts in in_groups(texts, chunks, WORD_SLICE_BYTES):
        ids, ends = words.ids(words_of(parts))
        for owner, a, b in zip(owners, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            found[owner].append(ids[a:b])
    end = np.array([] if end_id is None else [end_id], "<u4")
    return [np.concatenate([*x, end]) for x in found]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary over serialized ids; empty where the samples are too few for one."""
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < 16 or sum(map(len, samples)) < 16 * 256:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:  # samples without anything in common
        return b""


def pack(docs: list[tuple[int | None, int, bytes]], dictionary: bytes, width: int, before: int) -> bytes:
    """A block of (doc_id, ids, frame)."""
    n = len(docs)
    offsets = np.concatenate([[0], np.cumsum([len(f) for _, _, f in docs])]).astype("<u8")
    digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    return b"".join([
        HEAD.pack(MAGIC, width, digest, n, before), np.array([d or 0 for d, _, _ in docs], "<i8").tobytes(), bytes(d is None for d, _, _ in docs),
        np.array([c for _, c, _ in docs], "<u8").tobytes(), offsets.tobytes(), *(f for _, _, f in docs),
    ])


class Block:
    """A reader of one block; ids(i) touches the index and one frame."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, self.width, digest, n, self.before = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        if digest != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError("the block was written with another dictionary")
        at = HEAD.size
        raw, at = np.frombuffer(data, "<i8", n, at), at + 8 * n
        null, at = data[at : at + n], at + n
        self.counts, at = np.frombuffer(data, "<u8", n, at), at + 8 * n
        self.offsets, self.base = np.frombuffer(data, "<u8", n + 1, at), at + 8 * (n + 1)
        self.doc_ids = [None if null[i] else int(raw[i]) for i in range(n)]
        self.data = memoryview(data)
        self.codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        frame = self.data[self.base + int(self.offsets[i]) : self.base + int(self.offsets[i + 1])]
        return np.frombuffer(self.codec.decompress(frame), f"<u{self.width}").astype("<u4")


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 1) -> None:
    """Encode every whole text, append end_id, and write the blocks in ascending doc_id order under path.

    Null and empty texts have end_id alone. Null ids come first; rows that share an id keep one entry each, ordered by their
    text's hash. Other columns are not stored. An empty table gives a store without documents. Texts are read once: their ids go
    to the shared folder, and what is sorted is ids. The range partitions are of doc_id and the text's hash, so a repeated id can
    be split over tasks. The dictionary is trained on a bounded sample, TRAIN_BYTES at one place of the ids of TRAIN_DOCUMENTS documents,
    those of smallest hash; it has an effect on the size only. Memory: one slice of rows by bytes, chunks of a long text, one
    text's ids, caches bounded by bytes. A text of any length without white space, signs and digits is one unit for the library.
    """
    spark = df.sparkSession
    tokenizer = spark.sparkContext.broadcast(content := read_tokenizer(tokenizer_path))  # the size of one vocabulary file
    width = 2 if _largest_id(content, end_id) < 1 << 16 else 4
    kinds = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_encoder(tokenizer.value)
        for some in slices(batches, 2, WORD_SLICE_BYTES):
            ids = [x.astype(f"<u{width}").tobytes() for x in encode_texts(texts_of(some.column(2)), words, end_id)]
            for place, last in _runs(ids):
                yield pa.RecordBatch.from_arrays([some.column(0)[place:last], some.column(1)[place:last], pa.array(ids[place:last], pa.binary())], schema=kinds)

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    aside = shared_path(spark, "ids")
    rows.mapInArrow(encode, "doc_id long, h long, ids binary").write.option("compression", "zstd").parquet(aside)
    encoded = spark.read.schema("doc_id long, h long, ids binary").parquet(aside)
    dictionary = train_dictionary(_training_ids(encoded, width))
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()  # a worker that has encoded keeps them no longer
        codec = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        part, seq, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def block() -> pa.RecordBatch:
            known = [d for d, _, _ in held if d is not None]
            row = {"part": part, "seq": seq, "doc_lo": min(known, default=None), "doc_hi": max(known, default=None), "n_ids": sum(c for _, c, _ in held), "block": pack(held, dictionary, width, before)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_lo", pa.int64()), ("doc_hi", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())]))

        for some in batches:
            for key, value in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                ids = value.as_py()
                frame = codec.compress(ids)
                held.append((key, len(ids) // width, frame))
                size += len(frame)
                if size >= BLOCK_BYTES or len(held) >= 8192:
                    yield block()
                    before, seq, held, size = before + sum(c for _, c, _ in held), seq + 1, [], 0
        if held:
            yield block()

    ordered = encoded.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    removed(spark, aside)


def _runs(ids: list[bytes], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Places from which and up to which ids have about limit bytes."""
    start, size = 0, 0
    for i, x in enumerate(ids):
        size += len(x)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(ids):
        yield start, len(ids)


def _training_ids(encoded: DataFrame, width: int) -> list[bytes]:
    """A piece of the ids of TRAIN_DOCUMENTS documents at most, which bounds what comes to the driver. Pieces begin at a place that the hash chooses."""
    chosen = encoded.select(F.xxhash64("doc_id", "h").alias("r")).orderBy("r").limit(TRAIN_DOCUMENTS)
    room = F.greatest(F.octet_length("ids") - TRAIN_BYTES, F.lit(0))
    start = F.pmod(F.col("r"), (room / width).cast("long") + 1) * width + 1
    mine = encoded.withColumn("r", F.xxhash64("doc_id", "h")).join(F.broadcast(chosen.distinct()), "r")  # TRAIN_DOCUMENTS numbers
    pieces = mine.select("r", F.substring("ids", start.cast("int"), F.lit(TRAIN_BYTES)).alias("piece"))
    # Equal rows have equal hashes: one piece of each.
    return [bytes(x.piece) for x in pieces.groupBy("r").agg(F.max("piece").alias("piece")).orderBy("r").collect()]


def _largest_id(tokenizer: str, end_id: int | None) -> int:
    from tokenizers import Tokenizer

    return max([end_id or 0, *Tokenizer.from_str(tokenizer).get_vocab(with_added_tokens=True).values()])


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """The blocks and the dictionary (at most DICTIONARY_BYTES), whose hash is checked."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != row.sha256:
        raise ValueError("the dictionary does not have its hash")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), dictionary


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as u32) and, if asked for, ids.

    The ids before a part are a running sum over one row for each part; the parts are the write's tasks, few against the documents.
    """
    blocks, dictionary = open_store(spark, path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    from pyspark.sql import Window

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, base in zip(batch.column("block"), batch.column("base").to_pylist(), strict=True):
                block = Block(data.as_py(), dictionary)
                starts = base + block.before + np.concatenate([[0], np.cumsum(block.counts.astype(np.int64))[:-1]]) if block.doc_ids else []
                for lo in range(0, len(block.doc_ids), 512 if with_ids else 1 << 30):
                    hi = min(lo + (512 if with_ids else 1 << 30), len(block.doc_ids))
                    ids = [block.ids(i) for i in range(lo, hi)] if with_ids else (block.ids(i) for i in range(lo, hi))
                    pairs = [(len(x), zlib.crc32(x.tobytes())) for x in ids]
                    columns = [block.doc_ids[lo:hi], starts[lo:hi], [n for n, _ in pairs], [c for _, c in pairs], *([ids] if with_ids else [])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.name for f in fields])

    # The bases have one row for each task of the write, which the writer's partition number bounds.
    return blocks.join(F.broadcast(bases), "part").select("block", "base").mapInArrow(run, T.StructType(fields))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each row with this doc_id: Parquet's statistics leave the blocks whose range has it, and of those one frame each is decompressed."""
    blocks, dictionary = open_store(spark, path)
    found = []
    for row in blocks.filter((F.col("doc_lo") <= doc_id) & (F.col("doc_hi") >= doc_id)).orderBy("part", "seq").select("block").toLocalIterator():
        block = Block(bytes(row.block), dictionary)
        found += [block.ids(i).tolist() for i, d in enumerate(block.doc_ids) if d == doc_id]
    return found
