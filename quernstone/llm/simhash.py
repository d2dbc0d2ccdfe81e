"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie's join with itself.

Fingerprints within k differing bits agree in one of k + 1 blocks of their bits. Those that share a block's bits are one group;
a group that is still large is dealt again by blocks of its other bits, and so on until it is small. The groups of a task are subtrees of one binary
trie, a sorted array with that block's bits in front: pairs of nodes are walked together from the groups' roots, differing bits
are added up, and a pair is dropped as soon as they are more than k. Of the links found, a spanning forest is handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, cut, removed, shared_path, stored
from .components import components

SEED, SHINGLE, ERRORS = 42, 3, 2
#: Fingerprints of one block's bits from which a group is dealt again.
LARGE_GROUP = 20_000
#: Pairs of nodes walked at a time, fingerprints whose groups are joined at a time.
PAIRS, RUN = 1 << 18, 1 << 18
_HASHES = 1 << 16
#: Bits of a set's fingerprint.
WIDE = 256
_STRETCH = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def fingerprint(text: str, n: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text: a bit is 1 if it is set in over half of the hashes of its n-word shingles, repeats included."""
    words = text.encode().lower().split()  # bytes: only A-Z are lower-cased, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    span = min(n, len(words))
    first, last = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(first), _HASHES):
        some = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[i : i + _HASHES], last[i : i + _HASHES], strict=True)])
        counts += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(first)).tobytes(), "big")


def set_fingerprint(own: np.ndarray) -> bytes:
    """WIDE bits of a set of shingles' hashes by the same rule: each hash is stretched to so many bits."""
    counts = np.zeros(WIDE, np.int64)
    for i in range(0, len(own), 255):  # so many that a byte holds the sums
        wide = (own[i : i + 255, None] + _STRETCH) * _MIX
        wide ^= wide >> np.uint64(32)
        wide *= _MIX
        wide ^= wide >> np.uint64(29)
        counts += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own)).tobytes()


def add_fingerprints(df: DataFrame, text: str = "text", column: str = "fp", n: int = SHINGLE) -> DataFrame:
    """df with the fingerprint of every whole text as a signed long; null and empty texts have 0."""

    def work(texts: list[str]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(x, n) for x in texts], np.uint64).astype(np.int64))]

    return add_columns(df, text, [T.StructField(column, T.LongType())], lambda: work)


def blocks(bits: int, k: int) -> list[tuple[int, int]]:
    """k + 1 ranges (lowest bit, width) of so many bits."""
    edges = [bits * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _front(values: np.ndarray, bits: int, low: int, width: int) -> np.ndarray:
    """Numbers of so many bits, turned so that the range (low, width) is in front."""
    turn = bits - low - width
    if not turn:
        return values
    mask = np.uint64((1 << bits) - 1)
    return ((values << np.uint64(turn)) | (values >> np.uint64(bits - turn))) & mask


def steps(code: int, k: int) -> list[tuple[int, int, int]]:
    """What a group shares, as ranges (bits they are among, lowest bit, width): the first one of all bits, the next ones of the rest each. code: 1 followed by the numbers of the blocks, as digits to the base k + 1."""
    digits = []
    while code > 1:
        code, digit = divmod(code, k + 1)
        digits.append(digit)
    out, rest = [], 64
    for digit in reversed(digits):
        low, width = blocks(rest, k)[digit]
        out.append((rest, low, width))
        rest -= width
    return out


def arranged(values: np.ndarray, code: int, k: int) -> tuple[np.ndarray, int]:
    """Fingerprints with the bits that their group shares in front, and the number of those."""
    shared = 0
    for rest, low, width in steps(code, k):
        tail = values if rest == 64 else values & np.uint64((1 << rest) - 1)
        values = (values ^ tail) | _front(tail, rest, low, width)
        shared += width
    return values, shared


def dealt_again(codes: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, keys and fingerprints of the smaller groups, one for each further block, that large groups are dealt into."""
    out = []
    for code in np.unique(codes).tolist():
        own = values[codes == code]
        for digit in range(k + 1):
            inner = code * (k + 1) + digit
            turned, shared = arranged(own, inner, k)
            out.append((np.full(len(own), inner), (turned >> np.uint64(64 - shared)).view(np.int64), own))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Label components by their smallest place, with links i - j added."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def trie_pairs(n_bits: int, lo: np.ndarray, hi: np.ndarray, depth: int, k: int, split: Callable, differing: Callable, label: np.ndarray | None = None, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i, j of the pairs within the same range (lo, hi) of a sorted array, all of whose values have so many first bits (depth) in common, that are within k differing ones of the first n_bits bits.

    split(lo, hi, depth) gives where in ranges the next bit becomes 1, differing(i, j) the number of differing bits. Bits after n_bits only tell
    equal ones apart. With label, pairs of nodes that have one label throughout are left out, so that no pair with different labels is.
    """
    several = hi - lo > 1
    lo, hi = lo[several], hi[several]
    change = None if label is None else np.r_[0, np.cumsum(label[1:] != label[:-1])]
    limit = limit or PAIRS
    waiting = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while waiting:
        depth, lo1, hi1, lo2, hi2, off = waiting.pop()
        if len(lo1) > limit:
            half = len(lo1) // 2
            waiting += [(depth, *(x[half:] for x in (lo1, hi1, lo2, hi2, off))), (depth, *(x[:half] for x in (lo1, hi1, lo2, hi2, off)))]
            continue
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        i, j = lo1[leaf], lo2[leaf]
        near = differing(i, j) <= k
        yield i[near], j[near]
        lo1, hi1, lo2, hi2, off = (x[~leaf] for x in (lo1, hi1, lo2, hi2, off))
        if change is not None and len(lo1):
            apart = (change[hi1 - 1] != change[lo1]) | (change[hi2 - 1] != change[lo2]) | (label[lo1] != label[lo2])
            lo1, hi1, lo2, hi2, off = (x[apart] for x in (lo1, hi1, lo2, hi2, off))
        if not len(lo1):
            continue
        mid1, mid2 = split(lo1, hi1, depth), split(lo2, hi2, depth)
        itself = lo1 == lo2  # two nodes of one depth are the same or apart
        more = int(depth < n_bits)
        made = []
        for a, b, c, d, error, keep in ((lo1, mid1, lo2, mid2, 0, True), (mid1, hi1, mid2, hi2, 0, True), (lo1, mid1, mid2, hi2, more, off + more <= k), (mid1, hi1, lo2, mid2, more, (off + more <= k) & ~itself)):
            keep = keep & (b > a) & (d > c) & ((a != c) | (b - a > 1))
            made.append((a[keep], b[keep], c[keep], d[keep], off[keep] + error))
        waiting.append((depth + 1, *(np.concatenate(x) for x in zip(*made, strict=True))))


def wide_pairs(values: np.ndarray, names: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, label: np.ndarray | None = None, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """trie_pairs of wide fingerprints (rows of 64-bit words) in ranges that are sorted by them and then by names, which are distinct in a range."""
    words = [*values.T, names.view(np.uint64)]

    def split(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        word, shift = words[depth >> 6], np.uint64(63 - (depth & 63))
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            one = (word[np.minimum(mid, len(word) - 1)] >> shift & np.uint64(1)).astype(bool)
            lo, hi = np.where(open_ & ~one, mid + 1, lo), np.where(open_ & one, mid, hi)
        return lo

    def differing(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(values[i] ^ values[j]).sum(1, dtype=np.int64)

    return trie_pairs(64 * values.shape[1], lo, hi, 0, k, split, differing, label, limit)


def trie_join(values: np.ndarray, shared: int, k: int) -> np.ndarray:
    """For sorted distinct numbers, the smallest place of each one's component among those with the same first shared bits, linked at k or fewer differing bits."""
    n = len(values)
    label = np.arange(n)
    front = values >> np.uint64(64 - shared)
    first = np.nonzero(np.r_[True, front[1:] != front[:-1]])[0] if n else np.zeros(0, np.int64)

    def split(lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        shift = np.uint64(63 - depth)
        return np.searchsorted(values, ((values[lo] >> shift) | np.uint64(1)) << shift)

    for i, j in trie_pairs(64, first, np.r_[first[1:], n] if n else first, shared, k, split, lambda i, j: np.bitwise_count(values[i] ^ values[j])):
        _joined(label, i, j)
    return label


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def forest(codes: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of whole groups: codes and fingerprints, one code's groups at a time."""
    us, vs = [], []
    for code in np.unique(codes).tolist():
        own = np.unique(values[codes == code])
        turned, shared = arranged(own, code, k)
        order = np.argsort(turned)
        label = trie_join(turned[order], shared, k)
        linked = np.nonzero(label != np.arange(len(label)))[0]
        us.append(own[order[linked]])
        vs.append(own[order[label[linked]]])
    return (np.concatenate(us), np.concatenate(vs)) if us else (values[:0], values[:0])


def _bits(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND((1 << width) - 1)


_GROUPS = "code long, key long, fp long"


def _smaller(groups: DataFrame, k: int, large: int) -> tuple[DataFrame, list[str]]:
    """Groups (code, key, fp) none of which has more than large fingerprints, and what was stored for them. Large ones are dealt by further blocks of their other bits until they are small or have too few bits left to be large."""
    paths: list[str] = []
    parts, code = [], k + 1  # the first of this level's codes, whose groups share the fewest bits
    while True:
        left = 64 - sum(width for _, _, width in steps(code, k))
        if 1 << left <= large or left <= k + 1:  # a group's fingerprints are distinct
            break
        crowded, path = stored(groups.groupBy("code", "key").count().filter(F.col("count") > large).select("code", "key"), "crowded")
        paths.append(path)
        if crowded.isEmpty():
            break
        parts.append(groups.join(crowded, ["code", "key"], "left_anti"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    codes, _, values = (batch.column(i).to_numpy() for i in range(3))
                    inner, keys, own = dealt_again(codes, values.view(np.uint64), k)
                    yield pa.RecordBatch.from_arrays([pa.array(inner), pa.array(keys), pa.array(_signed(own))], names=["code", "key", "fp"])

        groups, path = stored(groups.join(crowded, ["code", "key"], "left_semi").mapInArrow(run, _GROUPS), "groups")
        paths.append(path)
        code *= k + 1
    whole = groups
    for part in parts:
        whole = whole.unionByName(part)
    return whole, paths


def links(fingerprints: DataFrame, k: int = ERRORS, large: int = LARGE_GROUP) -> DataFrame:
    """Links (u, v) that connect all of fingerprints (fp: distinct longs) that are within k differing bits, and no others: a spanning forest of each group."""
    if not 1 <= k <= 4:
        raise ValueError("k must be 1 to 4")
    fp = F.col("fp")
    dealt = fingerprints.select("fp", F.explode(F.array(*(F.struct(F.lit(k + 1 + i).cast("long").alias("code"), _bits(fp, *r).alias("key")) for i, r in enumerate(blocks(64, k))))).alias("g")).select("g.code", "g.key", "fp")
    groups, paths = _smaller(dealt, k, large)
    ordered = groups.repartition("code", "key").sortWithinPartitions("code", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups in runs of RUN fingerprints or more, so a task holds one run and a batch."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links_of(parts: list) -> pa.RecordBatch:
            u, v = forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]).view(np.uint64), k)
            return pa.RecordBatch.from_arrays([pa.array(_signed(u)), pa.array(_signed(v))], names=["u", "v"])

        for batch in batches:
            code, key, value = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            if not len(code):
                continue
            held.append((code, key, value))
            if sum(len(p[0]) for p in held) >= RUN:
                code, key, value = (np.concatenate([p[i] for p in held]) for i in range(3))
                edge = np.nonzero((code != code[-1]) | (key != key[-1]))[0]
                cut_at = edge[-1] + 1 if len(edge) else 0  # the last group may go on
                if cut_at:
                    yield links_of([(code[:cut_at], key[:cut_at], value[:cut_at])])
                held = [(code[cut_at:], key[cut_at:], value[cut_at:])]
        if held:
            yield links_of(held)

    found, _ = stored(ordered.mapInArrow(run, "u long, v long"), "links")
    removed(fingerprints.sparkSession, *paths)
    return found


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = ERRORS, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row of df: its text's fingerprint, and of what is reachable over links of k or fewer differing bits the smallest doc_id and the smallest fingerprint.

    Null and empty texts have fingerprint 0 and are linked like any other. Equal fingerprints are one node, however many rows
    have it; repeated rows each stay. A null doc_id is no smallest id; where all of a component are null, component_id is null.
    Other columns don't matter; an empty table gives no rows. The fingerprints, worked out once, lie in the shared folder, as do
    the nodes' components; what came between is removed. A text's words are needed together: the longest single text bounds the memory.
    """
    path = shared_path(df.sparkSession, "simhash")
    add_fingerprints(df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), n=n).drop("text").write.parquet(path)
    base = df.sparkSession.read.schema("doc_id long, fp long").parquet(path)
    nodes, nodes_path = stored(base.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    linked = components(links(nodes.select("fp"), k)).withColumnRenamed("node", "fp")
    roots = linked.join(nodes, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    merged = linked.join(roots, "root").select("fp", "component_id", "root")
    # Cut, so that the last join has a plain exchange on either side and a fingerprint that many rows have can be split.
    known = cut(nodes.join(merged, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    removed(df.sparkSession, nodes_path)
    return base.join(known, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = ERRORS, n: int = SHINGLE) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id, with df's columns.

    Of equal rows with that doc_id one stays. A group without any doc_id keeps one row, of its smallest fingerprint.
    """
    return keep_rows(df, cut(near_duplicates(df, doc_id, text, k, n)), lambda rows, body: add_fingerprints(rows, body, "_fp", n), doc_id, text)


def keep_rows(df: DataFrame, found: DataFrame, add: Callable[[DataFrame, str], DataFrame], doc_id: str, text: str) -> DataFrame:
    """The rows that keep_one leaves of groups found (doc_id, fp, component_id, root); add(rows, text column) adds their fp as _fp."""
    columns = df.columns
    mine = df.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)))
    key, body = F.col(f"_{columns.index(doc_id)}").cast("long"), f"_{columns.index(text)}"
    ids = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    # What goes is stored, so that its size is known: while it is small the texts don't have to move.
    gone = cut(ids.filter("doc_id is not null and not (rows = 1 and stays)").select(F.col("doc_id").alias("_id")))
    kept = mine.filter(key.isNotNull()).join(gone, key == F.col("_id"), "left_anti")
    odd = ids.filter("doc_id is null or rows > 1")
    if not odd.isEmpty():  # ids that don't name one row: their rows are told apart by fingerprint
        rows = add(mine.join(odd.select(F.col("doc_id").alias("_id")), key.eqNullSafe(F.col("_id"))), body)
        stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("doc_id").isNotNull() | (F.col("fp") == F.col("root")))).select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), F.col("root").alias("_r")).distinct()
        rows = rows.join(stay, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_fp") == F.col("_f"))).dropDuplicates(["_d", "_r"])
        kept = kept.unionByName(rows.select(*kept.columns))
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(columns)))
