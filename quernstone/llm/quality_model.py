"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of learned vectors: its own and those of the character n-grams of "<word>", all hashed to a fixed
number of rows. A document's vector is the sum of its words' and of its word bigrams' vectors, which are hashed to as many rows more,
divided by its words. A softmax over the classes follows. Rows and softmax weights are trained together by stochastic gradient descent
in numpy. As everything is linear up to the softmax, scoring a word needs one number, kept by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_SLICE_BYTES, WordCache, add_columns, in_groups, removed, shared_path, slices, strings, sums, texts_of

# Fixed value: the white space that ends words.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_GAP = re.compile(f"[{BLANKS}]+")
#: Characters of words that are hashed at a time; characters of a text after which it is cut at the next white space.
CHUNK, PART = 1 << 16, 1 << 20
#: Odd multipliers of the hashes.
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_WORD = np.dtype([("score", "<f8"), ("hash", "<u8")])


@dataclass(frozen=True)
class Settings:
    """sample: labelled documents that are trained on at most, those of smallest hash; sample_bytes: of their sparse rows. rows: of the table of words and n-grams, and of that of bigrams. row_rate: rows move this much faster than the softmax weights, as each has a small weight in a document's mean."""

    sample: int = 5000
    sample_bytes: int = 96 << 20
    rows: int = 1 << 16
    width: int = 8
    n_grams: tuple[int, int] = (3, 4)
    epochs: int = 8
    rate: float = 0.5
    row_rate: float = 20.0
    batch: int = 32
    seed: int = 1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _powers(n: int, first: int = 0) -> np.ndarray:
    """Powers first + 1 ... of a multiplier, over 64 bits."""
    return np.cumprod(np.full(n, _A, np.uint64)) * np.uint64(pow(_A, first, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_B)
    return h ^ (h >> np.uint64(32))


def _windows(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters from each place."""
    return _mixed(sum(codes[at + i] * p for i, p in enumerate(_powers(n))) + np.uint64(n))


def hashed(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of words and of all their n-grams, repeats included; for each row the place of its word; and the words' hashes."""
    framed = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    codes = _codes("".join(framed))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    hashes = _mixed(np.add.reduceat(codes * _powers(int(lengths.max()))[place], starts))
    rows, owners = [hashes], [np.arange(len(words))]
    for n in range(settings.n_grams[0], settings.n_grams[1] + 1):
        at = np.nonzero(place + n <= lengths[owner])[0]
        rows.append(_windows(codes, at, n))
        owners.append(owner[at])
    return (np.concatenate(rows) % np.uint64(settings.rows)).astype(np.int64), np.concatenate(owners), hashes


def long_hash(word: str) -> int:
    """The hash of a word of any length, a piece at a time."""
    framed, total = f"<{word}>", np.zeros(1, np.uint64)
    for at in range(0, len(framed), CHUNK):
        codes = _codes(framed[at : at + CHUNK])
        total += (codes * _powers(len(codes), at)).sum(dtype=np.uint64)
    return int(_mixed(total)[0])


def long_rows(word: str, settings: Settings) -> Iterator[np.ndarray]:
    """The rows of a word of any length, a piece at a time."""
    framed = f"<{word}>"
    yield np.array([long_hash(word) % settings.rows])
    for at in range(0, len(framed), CHUNK):
        for n in range(settings.n_grams[0], settings.n_grams[1] + 1):
            codes = _codes(framed[at : at + CHUNK + n - 1])
            if len(codes) >= n:
                yield (_windows(codes, np.arange(len(codes) - n + 1), n) % np.uint64(settings.rows)).astype(np.int64)


def row_count(word: str, settings: Settings) -> int:
    return 1 + sum(max(0, len(word) + 3 - n) for n in range(settings.n_grams[0], settings.n_grams[1] + 1))


def bigram_rows(first: np.ndarray, second: np.ndarray, settings: Settings) -> np.ndarray:
    """Rows, behind those of words, of pairs of words by their hashes."""
    mixed = _mixed(first * np.uint64(_A) + second)
    return (mixed % np.uint64(settings.rows)).astype(np.int64) + settings.rows


def batches_of(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places from which and up to which words have about CHUNK characters together; a longer word is alone."""
    start = size = 0
    for i, w in enumerate(words):
        if i > start and size + len(w) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(w)
    if start < len(words):
        yield start, len(words)


def parts_of(text: str) -> Iterator[str]:
    """A text's words in parts of about PART characters; all but the first part begin with the last word of the part before."""
    text = text.strip(BLANKS)
    start = cut = 0
    while len(text) - cut > PART and (gap := _GAP.search(text, cut + PART)):
        yield text[start : gap.start()]
        start, cut = max(text.rfind(b, cut, gap.start()) for b in BLANKS) + 1, gap.start()
    if text:
        yield text[start:]


class Words:
    """The words of a group of parts: their places among the distinct ones, which part each is of, which are counted (not a part's repeated first word), and the pairs of neighbours."""

    def __init__(self, parts: list[str], leads: np.ndarray, cache: WordCache):
        self.lists = pc.ascii_split_whitespace(pa.array(parts, pa.string()))
        words = self.lists.flatten().dictionary_encode()
        self.distinct, self.index = strings(words.dictionary), words.indices.to_numpy()
        self.known = np.frombuffer(b"".join(cache.values(self.distinct)), _WORD)
        starts = self.lists.offsets.to_numpy()
        self.counted = np.ones(len(self.index))
        self.counted[starts[:-1][leads]] = 0.0
        self.paired = np.ones(len(self.index), bool)
        self.paired[starts[1:] - 1] = False  # a part's last word has none behind it

    def bigrams(self, settings: Settings) -> np.ndarray:
        """Rows of each word with the one behind it, where there is one."""
        at, hashes = np.nonzero(self.paired)[0], self.known["hash"]
        return bigram_rows(hashes[self.index[at]], hashes[self.index[at + 1]], settings)


def words_of(texts: list[str], cache: WordCache) -> Iterator[tuple[np.ndarray, Words]]:
    """The words of texts in groups of bounded size, with the places of the texts that a group's parts are of."""
    last = -1
    for owners, parts in in_groups(texts, parts_of, WORD_SLICE_BYTES):
        own = np.array(owners)
        leads = np.r_[last, own[:-1]] == own
        last = owners[-1]
        yield own, Words(parts, leads, cache)


def document_rows(texts: list[str], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows of documents and their weights in the documents' vectors: sparse and at most as long as the tables."""
    out = []
    cache = word_cache(None, settings)
    for text in texts:
        table, n_words = np.zeros(2 * settings.rows), 0.0
        for _, group in words_of([text], cache):
            n_words += group.counted.sum()
            counts = np.bincount(group.index, group.counted, len(group.known))
            words = group.distinct
            for a, b in batches_of(words):
                if len(words[a]) > CHUNK:
                    for rows in long_rows(words[a], settings):
                        table += np.bincount(rows, minlength=len(table)) * (counts[a] / row_count(words[a], settings))
                else:
                    rows, owner, _ = hashed(words[a:b], settings)
                    table += np.bincount(rows, (counts[a:b] / np.bincount(owner, minlength=b - a))[owner], len(table))
            table += np.bincount(group.bigrams(settings), minlength=len(table))
        at = np.nonzero(table)[0]
        out.append((at.astype(np.int32), (table[at] / max(n_words, 1.0)).astype(np.float32)))
    return out


def word_cache(values: np.ndarray | None, settings: Settings) -> WordCache:
    """By word, as bytes, the mean of its rows' values (0 without values) and its hash."""

    def compute(words: list[str]) -> list[bytes]:
        found = np.zeros(len(words), _WORD)
        for a, b in batches_of(words):
            if len(words[a]) > CHUNK:
                found["hash"][a] = long_hash(words[a])
                if values is not None:
                    found["score"][a] = sum(float(values[r].sum()) for r in long_rows(words[a], settings)) / row_count(words[a], settings)
            else:
                rows, owner, found["hash"][a:b] = hashed(words[a:b], settings)
                if values is not None:
                    found["score"][a:b] = np.bincount(owner, values[rows], b - a) / np.bincount(owner, minlength=b - a)
        raw = found.tobytes()
        return [raw[i : i + _WORD.itemsize] for i in range(0, len(raw), _WORD.itemsize)]

    return WordCache(compute)


@dataclass
class Model:
    """Per row, the difference that it makes between the two classes' logits; and their bias."""

    logits: np.ndarray
    bias: float
    settings: Settings

    def scorer(self) -> WordCache:
        """Made once in each worker, as that keeps what was broadcast."""
        if "_scorer" not in self.__dict__:
            self._scorer = word_cache(self.logits, self.settings)
        return self._scorer

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_scorer"}

    def score(self, texts: list[str], cache: WordCache) -> np.ndarray:
        """Softmax of class 1. A text without words has the bias alone."""
        total, n_words = np.zeros(len(texts)), np.zeros(len(texts))
        for own, group in words_of(texts, cache):
            value = group.known["score"][group.index] * group.counted
            value[group.paired] += self.logits[group.bigrams(self.settings)]
            np.add.at(total, own, sums(value, group.lists))
            np.add.at(n_words, own, sums(group.counted, group.lists))
        logit = self.bias + total / np.maximum(n_words, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def gradients(vectors: np.ndarray, output: np.ndarray, bias: np.ndarray, some: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The summed cross-entropy of documents (rows, weights, label), none of them empty, and its gradients by vectors, output and bias."""
    y = np.array([d[2] for d in some])
    rows, weights = np.concatenate([d[0] for d in some]), np.concatenate([d[1] for d in some]).astype(np.float64)
    lengths = np.array([len(d[0]) for d in some])
    owner = np.repeat(np.arange(len(some)), lengths)
    hidden = np.add.reduceat(vectors[rows] * weights[:, None], np.r_[0, np.cumsum(lengths)[:-1]], axis=0)
    z = hidden @ output + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -float(np.log(p[np.arange(len(some)), y]).sum())
    p[np.arange(len(some)), y] -= 1
    back = p @ output.T
    by_vectors = np.stack([np.bincount(rows, weights * back[owner, k], len(vectors)) for k in range(vectors.shape[1])], axis=1)
    return loss, by_vectors, hidden.T @ p, p.sum(0)


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """Stochastic gradient descent over small batches of (rows, weights, label), with a rate that falls to zero. Without documents, or with one class only, the bias alone is learned."""
    labels = np.array([y for _, _, y in docs], np.int64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = np.array([0.0, np.log(share / (1 - share))])
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1, 1, (2 * settings.rows, settings.width)) / settings.width
    output = np.zeros((settings.width, 2))
    if len(set(labels.tolist())) == 2:
        steps = settings.epochs * -(-len(docs) // settings.batch)
        step = 0
        for _ in range(settings.epochs):
            shuffled = rng.permutation(len(docs))
            for i in range(0, len(docs), settings.batch):
                some = [docs[j] for j in shuffled[i : i + settings.batch] if len(docs[j][0])]
                rate = settings.rate * (1 - step / steps)
                step += 1
                if some:
                    _, by_vectors, by_output, by_bias = gradients(vectors, output, bias, some)
                    vectors -= rate * settings.row_rate * by_vectors
                    output -= rate * by_output
                    bias -= rate * by_bias / len(some)
    logits = vectors @ (output[:, 1] - output[:, 0])
    return Model(logits, float(bias[1] - bias[0]), settings)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of label 1 against label 0, learned from rows whose crc32(doc_id as text) mod 3 is not 1.

    Of those, settings.sample at most are used, of smallest hash of their id, and of these the first whose sparse rows
    have settings.sample_bytes together: the bounds of training and of what comes to the driver. Labels other than 0 and 1, null ids and ids with contrary labels are not used; of
    rows with the same id one text is used, the greatest. Labels, and columns besides id and text, are never inputs of a score.
    """
    ids = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    agreed = ids.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")
    there = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id")).distinct()
    chosen = agreed.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(settings.sample)
    # settings.sample rows at most are broadcast.
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = document_rows(texts_of(part.column(1)), settings)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())], names=["id", "y", "at", "weight"])

    path, h = shared_path(docs.sparkSession, "sample"), F.xxhash64("id").alias("h")
    rows.mapInArrow(run, "id long, y int, at binary, weight binary").write.parquet(path)
    sparse = docs.sparkSession.read.schema("id long, y int, at binary, weight binary").parquet(path)
    sizes = sorted(tuple(r) for r in sparse.select(h, (F.octet_length("at") + F.octet_length("weight")).cast("long")).collect())
    inside = int(np.searchsorted(np.cumsum([n for _, n in sizes]), settings.sample_bytes, side="right"))
    found = sorted(sparse.filter(h <= sizes[inside - 1][0]).collect(), key=lambda r: r.id) if inside else []
    removed(docs.sparkSession, path)
    return train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["weight"], np.float32), r["y"]) for r in found], settings)


def held_out(doc_id: str):
    """Whether a row is kept from training: crc32(doc_id as text) mod 3 is 1. A null id is not."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 3 == 1, F.lit(False))


def score_quality(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score (0 to 1, higher: label 1 likelier) of every whole text and predicted (1 if score >= 0.5).

    Null and empty texts have the score of the bias alone; equal texts have equal scores. Columns named score or predicted are
    replaced, others pass through; an empty table gives an empty table. Long texts and long words are taken in pieces, so memory
    is one slice of rows by bytes and a cache bounded by bytes.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 * settings.rows numbers

    def make():
        cache = shared.value.scorer()
        return lambda texts: [pa.array(shared.value.score(texts, cache))]

    scored = add_columns(df, text, [T.StructField("score", T.DoubleType())], make, WORD_SLICE_BYTES)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
