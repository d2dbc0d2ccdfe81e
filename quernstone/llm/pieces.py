"""SentencePiece encoding and decoding for merge-type (BPE) models with byte fallback.

Encoding doesn't replay merges. For every prefix of a word it stores the one token that the prefix's encoding ends with: of
the tokens that an automaton finds to end there, the one whose predecessor's table entry is compatible with it. Ids are then
read backwards from the last entry. Two neighbours are compatible if merging their joined text gives just the two back, which
is tested by undoing their merges along the seam.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD_SLICE_BYTES, WordCache, add_columns, gathered, in_groups

# The escaped space, and the piece types of the model file's format.
SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6

#: A unit that no piece crosses: escaped spaces with the word behind them; newlines are never part of a piece.
_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")
_CHUNK = 1 << 20
#: Pairs of tokens whose compatibility is kept; bytes of the words that are kept.
_PAIRS, WORDS_KEPT = 1 << 18, 40 << 20


@dataclass
class PieceModel:
    """A model's tables, built once for each worker."""

    pieces: list[tuple[str, float, int]]
    ids: dict[str, int] = field(init=False)
    unknown: int = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        inner = [p for p in self.ids if SPACE in p[1:] and p.strip(SPACE)]
        if inner or any("\n" in p for p in self.ids):
            raise ValueError("pieces that cross word starts or newlines are not supported")
        self.rank = {p: -self.pieces[i][1] for p, i in self.ids.items()}
        blank = {p for p in self.ids if not p.strip(SPACE) and len(p) > 1}
        words = [p for p in self.ids if p not in blank]
        if blank and min(self.rank[p] for p in blank) <= max(self.rank[p] for p in words if len(p) > 1):
            raise ValueError("blank pieces must merge last")
        # By id: rank, and the two ids of the last merge that makes the piece (None: a single character). Pieces that merging
        # their own text doesn't give are never in an encoding.
        self.ranks = [-score for _, score, _ in self.pieces]
        self.halves: list[tuple[int, int] | None] = [None] * len(self.pieces)
        self.matcher = ahocorasick.Automaton()
        for p in sorted(words, key=len):
            if len(p) > 1:
                tokens, last = self.merged(p)
                if len(tokens) > 1:
                    continue
                self.halves[self.ids[p]] = (self.ids[last[0]], self.ids[last[1]])
            self.matcher.add_word(p, (self.ids[p], len(p)))
        self.matcher.make_automaton()
        # Rank of what two neighbours would merge to, by both ids.
        self.seams = {self.ids[p[:k]] << 32 | self.ids[p[k:]]: self.rank[p] for p in words for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.known: dict[int, bool] = {}
        self.blanks: dict[int, list[int]] = {}
        # What decoding puts for each id.
        self.surface = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() if kind == NORMAL else " ⁇ ".encode() if kind == UNKNOWN else b""
            for p, _, kind in self.pieces
        ]
        self.is_byte = [kind == BYTE for _, _, kind in self.pieces]
        self.cache = WordCache(self.encode_words, WORDS_KEPT)

    def merged(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """Tokens that merging text gives, best rank first and then leftmost; and the last merge's two sides."""
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        waiting: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (rank := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(waiting, (rank, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        last = ("", "")
        while waiting:
            _, i, whole = heapq.heappop(waiting)
            if parts[i] is None or (j := after[i]) < 0 or parts[i] + parts[j] != whole:
                continue
            last = (parts[i], parts[j])
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None], last

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two tokens gives just the two. From the end, the later of the two sides' last merges is undone; a merge over the seam that would have come before it means no."""
        ranks, halves, seams = self.ranks, self.halves, self.seams
        limit, tie = float("inf"), False
        while True:
            over = seams.get(left << 32 | right)
            if over is not None and (over < limit or tie and over == limit):
                return False
            a, b = halves[left], halves[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and ranks[left] > ranks[right]:
                limit, tie, left = ranks[left], False, a[1]
            else:  # of equal ranks the left one merges first, so the right one is undone first; a seam left of it goes before it
                limit, tie, right = ranks[right], True, b[0]

    def last_tokens(self, word: str) -> list[tuple[int, int] | None]:
        """For each prefix of word, from one character on, the token that its encoding ends with, as id and length; None for a character that is in no piece."""
        last: list[tuple[int, int] | None] = [None] * len(word)
        known = self.known
        for end, token in self.matcher.iter(word):  # the longest first
            if last[end] is None:
                i, n = token
                if n <= end and (before := last[end - n]) is not None:
                    pair = before[0] << 32 | i
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) >= _PAIRS:
                            known.clear()
                        fits = known[pair] = self.compatible(before[0], i)
                    if not fits:
                        continue
                last[end] = token
        return last

    def word_ids(self, word: str) -> list[int]:
        """A word's ids, read backwards from the last prefix's token."""
        last, ids, at = self.last_tokens(word), [], len(word)
        while at > 0:
            token = last[at - 1]
            if token is None:
                ids += self.token_ids(word[at - 1])[::-1]
                at -= 1
            else:
                ids.append(token[0])
                at -= token[1]
        ids.reverse()
        return ids

    def token_ids(self, token: str) -> list[int]:
        if (i := self.ids.get(token)) is not None:
            return [i]
        return [self.bytes[b] for b in token.encode()] if self.bytes else [self.unknown]

    def blank_ids(self, n: int) -> list[int]:
        if n not in self.blanks:
            if len(self.blanks) > 4096:
                self.blanks.clear()
            self.blanks[n] = [i for token in self.merged(SPACE * n)[0] for i in self.token_ids(token)]
        return self.blanks[n]

    def encode_unit(self, unit: str) -> list[int]:
        """Blank pieces merge after all others, so of the spaces before a word only the last one can join it."""
        word = unit.lstrip(SPACE)
        n = len(unit) - len(word)
        if not word:
            return self.blank_ids(n)
        if word[0] == "\n":
            return self.token_ids("\n") * len(word)
        ids = self.word_ids(SPACE + word if n else word)
        if n < 2:
            return ids
        # Only the last space has joined the word, or it stands with the others.
        return [*self.blank_ids(n), *ids[1:]] if ids[0] == self.ids.get(SPACE) else [*self.blank_ids(n - 1), *ids]

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words, which begin at word starts, as u32 bytes."""
        for word in words:
            units = (word,) if "\n" not in word and SPACE not in word[1:] else _UNIT.findall(word)
            yield array("I", chain.from_iterable(map(self.encode_unit, units))).tobytes()

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as the library's encode without begin and end ids."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for owners, parts in in_groups([SPACE + x.replace(" ", SPACE) if x else "" for x in texts], _chunks, WORD_SLICE_BYTES):
            plain = [p[0] == SPACE and SPACE * 2 not in p for p in parts]  # every word has one space before it
            lists = pc.split_pattern(pa.array([p[1:] for p, easy in zip(parts, plain, strict=True) if easy], pa.string()), SPACE)
            odd = pa.array([_UNIT.findall(p) for p, easy in zip(parts, plain, strict=True) if not easy], pa.list_(pa.string()))
            runs = {True: _split(*gathered(lists, self.cache, SPACE.__add__)), False: _split(*gathered(odd, self.cache))}
            for owner, easy in zip(owners, plain, strict=True):
                found[owner].append(next(runs[easy]))
        return [np.concatenate(x) if x else np.zeros(0, "<u4") for x in found]

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, as the library's decode: one leading space goes, bytes that aren't UTF-8 become U+FFFD each."""
        ids = list(ids)
        raw = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        return text[1:] if ids and text[:1] == " " and self.pieces[ids[0]][0][:1] == SPACE else text

    def _decode_runs(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for n in (4, 3, 2, 1):
                    try:
                        char = bytes(run[:n]).decode()
                    except UnicodeDecodeError:
                        continue
                    if len(char) == 1:
                        break
                else:
                    n, char = 1, "�"
                out.append(char)
                del run[:n]
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


def _split(numbers: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    return (numbers[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


_EDGE, _LINE = re.compile(f"(?<=[^{SPACE}])(?={SPACE})"), re.compile("(?<=\n)(?=[^\n])")


def _chunks(text: str, limit: int = _CHUNK) -> Iterator[str]:
    """Parts of about limit characters, cut only at a space that follows another character, or where there is none for limit characters more, behind newlines."""
    start = 0
    while len(text) - start > limit:
        edge = _EDGE.search(text, start + limit, start + 2 * limit + 1) or _LINE.search(text, start + limit) or _EDGE.search(text, start + limit)
        if edge is None:
            break
        yield text[start : edge.start()]
        start = edge.start()
    if start < len(text):
        yield text[start:] if start else text


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """The pieces of a merge-type model file without normalization rules, with a leading space added and inner spaces kept."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rules = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with identity normalization, a leading space and kept spaces are supported")
    if any(p.type in (4, 5) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    return [(p.piece, p.score, p.type) for p in model.pieces]


_models: dict[str, PieceModel] = {}


def encode_decode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """df with ids (array of int) of every whole text and decoded (the text those ids give).

    Null and empty texts have no ids and decode to the empty text; repeated rows each get their own result. Columns named ids or
    decoded are replaced, all others pass through; an empty table gives an empty table. The model is read on the driver and
    broadcast (the size of its vocabulary). Memory: one slice of rows by bytes, chunks of a long text, one
    text's ids, a cache bounded by bytes. A text of any length without spaces and newlines is one word, in time in proportion.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_pieces(model_path))

    def make():
        if model_path not in _models:
            _models.clear()
            _models[model_path] = PieceModel(shared.value)
        model = _models[model_path]

        def work(texts: list[str]) -> list[pa.Array]:
            ids = model.encode_texts(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
            return [listed, pa.array([model.decode(x.tolist()) for x in ids], pa.string())]

        return work

    return add_columns(df, text, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], make)
