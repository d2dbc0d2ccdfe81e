"""Quality rules: repetition within a text from a suffix array over its words.

The words of a slice of documents are numbered apart for each document and sorted as suffixes by prefix doubling, which only
sorts again what is still tied. Common prefixes of neighbours come from the ranks kept at each doubling. Intervals of the
array whose common prefix has min_repeat words or more, and whose suffixes have different words before them, are the maximal repeated
substrings; the spans of all their occurrences are joined, and limits on the covered fraction and on the longest repeat give the verdict.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

# The white space that ends words, and the characters counted as symbols.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Base rules: fewer words fail; words in 8-word windows found twice or more may be this share in percent.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
#: The method's own limits: words of a repeat, share in percent of words in repeats, words of the longest one.
MIN_REPEAT, COVERED_PERCENT, LONGEST = 3, 30, 50
#: Words up to which the ranks of all doublings are kept; longer lists take the common prefixes one by one.
KEPT_RANKS = 1 << 20


def suffix_array(symbols: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order and the ranks after each doubling. symbols are dense numbers that no two documents share; limit is the end of each suffix's document."""
    n = len(symbols)
    keep = n <= KEPT_RANKS
    order = np.argsort(symbols, kind="stable")
    at = np.arange(n)
    new = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    levels = [rank.astype(np.int32)] if keep else []
    tied = at[~(new & np.r_[new[1:], True])]
    step = 1
    while len(tied):
        who = order[tied]
        nxt = who + step
        key = rank[who] * (n + 1) + np.where(nxt < limit[who], rank[np.minimum(nxt, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[tied] = who
        new = np.r_[True, key[1:] != key[:-1]]
        rank[who] = tied[np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))]
        if keep:
            levels.append(rank.astype(np.int32))
        tied = tied[~(new & np.r_[new[1:], True])]
        step *= 2
    return order, levels


def common_prefixes(symbols: np.ndarray, limit: np.ndarray, order: np.ndarray, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places r of order where suffixes r and r + 1 share least words or more, and how many they share."""
    n = len(symbols)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if levels:
        low = min(least.bit_length() - 1, len(levels))  # at this level all pairs that share enough are still tied
        if low >= len(levels):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.nonzero(levels[low][order[:-1]] == levels[low][order[1:]])[0]
        a, b = order[where], order[where + 1]
        shared = np.zeros(len(where), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + shared, b + shared
            shared += ((x < limit[a]) & (y < limit[b]) & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])).astype(np.int64) << k
    else:  # by text position, each at least its left neighbour's less one
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        words, ends, suffixes, places = symbols.tolist(), limit.tolist(), order.tolist(), place.tolist()
        found = np.zeros(n - 1, np.int64)
        h = 0
        for i, r in enumerate(places):
            if r == n - 1:
                h = 0
                continue
            j = suffixes[r + 1]
            if ends[j] != ends[i]:
                h = 0
                continue
            most = ends[i] - max(i, j)
            while h < most and words[i + h] == words[j + h]:
                h += 1
            found[r] = h
            h = max(h - 1, 0)
        where = np.nonzero(found)[0]
        shared = found[where]
    enough = shared >= least
    return where[enough], shared[enough]


def maximal_repeats(where: np.ndarray, shared: np.ndarray, order: np.ndarray, before: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Maximal repeats as intervals (first place, last place, words) of the array, and for each place the words of the longest one that starts there.

    where and shared are as of common_prefixes; before is the word before each suffix, which no two starts of documents share. An
    interval is closed when the common prefix falls below its own; inner ones come before outer ones. If all its suffixes have the same
    word before them, the repeat goes on to the left and is part of a longer one, which covers it.
    """
    longest = np.zeros(len(order), np.int64)
    found: list[tuple[int, int, int]] = []
    # Of an interval from place a to b, the changes of the word before among its neighbours are changes[b] - changes[a].
    changes = np.concatenate([[0], np.cumsum(before[order[1:]] != before[order[:-1]])]).tolist()
    opened: list[tuple[int, int]] = []
    free: list[int] = []  # places that no maximal repeat has yet

    def close(least: int, place: int) -> int:
        """End the intervals with more words than least at place; where the outermost of them began."""
        start = place
        while opened and opened[-1][1] > least:
            start, words = opened.pop()
            if changes[place] > changes[start]:
                found.append((start, place, words))
                while free and free[-1] >= start:
                    longest[free.pop()] = words
        return start

    last = -1
    for place, words in zip(where.tolist(), shared.tolist(), strict=True):
        if place != last + 1 and opened:  # the places between share too little
            free.append(last + 1)
            close(0, last + 1)
            free.clear()
        free.append(place)
        start = close(words, place)
        if not opened or opened[-1][1] < words:
            opened.append((start, words))
        last = place
    if opened:
        free.append(last + 1)
        close(0, last + 1)
    return found, longest


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def repeats(docs: list[list[str]], min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
    """For each list of words: words in windows found twice, words in maximal repeats, words of the longest one, how many maximal repeats there are, and their joined spans."""
    counts = np.array([len(d) for d in docs], np.int64)
    n, zeros = int(counts.sum()), np.zeros(len(docs), np.int64)
    spans: list[list[dict]] = [[] for _ in docs]
    if not n:
        return zeros, zeros, zeros, zeros, spans
    owner = np.repeat(np.arange(len(docs)), counts)
    ends = np.cumsum(counts)
    limit = ends[owner]
    codes = pa.array([w for d in docs for w in d]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = owner * (int(codes.max()) + 1) + codes
    order, levels = suffix_array(symbols, limit)
    where, shared = common_prefixes(symbols, limit, order, levels, min(WINDOW, min_repeat))
    enough = shared >= WINDOW
    longest = np.zeros(n, np.int64)  # of the repeats that start at each word
    np.maximum.at(longest, order[where[enough]], shared[enough])
    np.maximum.at(longest, order[where[enough] + 1], shared[enough])
    start = np.nonzero(longest)[0]
    in_window = _covered(n, start, longest[start])
    enough = shared >= min_repeat
    before = np.r_[-1, symbols[:-1]]
    before[ends[:-1][counts[1:] > 0]] = -1  # of a document's first word; documents don't meet in an interval
    found, by_place = maximal_repeats(where[enough], shared[enough], order, before)
    place = np.nonzero(by_place)[0]
    start, length = order[place], by_place[place]
    in_repeat = _covered(n, start, length)
    n_window, n_covered, most, n_repeats = (zeros.copy() for _ in range(4))
    np.add.at(n_window, owner[in_window], 1)
    np.add.at(n_covered, owner[in_repeat], 1)
    np.maximum.at(most, owner[start], length)
    np.add.at(n_repeats, owner[order[[a for a, _, _ in found]]], 1)
    if len(start):
        same = np.r_[False, in_repeat[1:] & in_repeat[:-1] & (owner[1:] == owner[:-1])]
        first = np.nonzero(in_repeat & ~same)[0]
        end = np.nonzero(in_repeat & ~np.r_[same[1:], False])[0] + 1
        base = ends - counts
        for o, a, b in zip(owner[first].tolist(), first.tolist(), end.tolist(), strict=True):
            spans[o].append({"start": a - int(base[o]), "end": b - int(base[o])})
    return n_window, n_covered, most, n_repeats, spans


def line_copies(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def apply_rules(df: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_covered_percent: int = COVERED_PERCENT, max_longest: int = LONGEST) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_covered, longest_repeat, n_maximal, repeat_spans and kept.

    Words are runs of anything but ASCII white space. n_repeat_words counts words in 8-word windows found twice or more in the
    text. base_failed: fewer than 20 words, or more than 30 % such words. n_covered counts words in maximal repeats of min_repeat words
    or more, repeat_spans are these as joined spans of word numbers, longest_repeat is the longest one's words (0: none), n_maximal how many there are.
    kept is false if base_failed, or if more than max_covered_percent of the words are covered, or if longest_repeat is over
    max_longest. Null and empty texts have no words and fail the base rules. Repeated rows each get the same result; columns
    with one of these names are replaced, others pass through; an empty table gives an empty table. Documents go through in
    slices by bytes and a document's words are needed together, so the longest single text bounds the memory.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_maximal")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [*(T.StructField(n, T.LongType()) for n in names), T.StructField("base_failed", T.BooleanType()), T.StructField("repeat_spans", span), T.StructField("kept", T.BooleanType())]

    def work(texts: list[str]) -> list[pa.Array]:
        docs = [WORD.findall(x) for x in texts]
        n_words = np.array([len(d) for d in docs], np.int64)
        n_window, n_covered, longest, n_maximal, spans = repeats(docs, min_repeat)
        word_chars = [len(x) - sum(map(x.count, BLANKS)) for x in texts]
        symbols = [sum(map(x.count, SYMBOLS)) for x in texts]
        failed = (n_words < LEAST_WORDS) | (100 * n_window > REPEAT_PERCENT * n_words)
        kept = ~failed & (100 * n_covered <= max_covered_percent * n_words) & (longest <= max_longest)
        numbers = (n_words, word_chars, symbols, list(map(line_copies, texts)), n_window, n_covered, longest, n_maximal)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return [*(pa.array(x, pa.int64()) for x in numbers), pa.array(failed), pa.array(spans, kind), pa.array(kept)]

    return add_columns(df, text, fields, lambda: work)
