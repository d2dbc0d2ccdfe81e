"""Operators 2, 5 and 10 against the libraries."""

import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quernstone.llm import queries, token_store
from quernstone.llm.common import WordCache, shared_path
from quernstone.llm.pieces import PieceModel, encode_decode, read_pieces
from quernstone.llm.segments import chunks
from quernstone.llm.token_counts import count_texts, count_tokens, read_tokenizer, segment_counter

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0   　​̣́ΣςAİKſŉ▁ab1!é漢'.,?😀"


def noise(rng, n=14):
    text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, n)))
    return text[:5] + "<|endoftext|>" + text[5:] if rng.random() < 0.2 else text


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@pytest.fixture(scope="module")
def pieces():
    return PieceModel(read_pieces(PIECE)), sentencepiece.SentencePieceProcessor(model_file=PIECE)


def test_counts_of_noise(library):
    rng, cache = random.Random(1), segment_counter(read_tokenizer(BYTE))
    for _ in range(4000):
        text = noise(rng)
        assert count_texts([text], cache)[0] == len(library[BYTE].encode(text, add_special_tokens=False).ids), repr(text)


def test_word_ids_of_noise(library):
    rng, cache = random.Random(2), token_store.word_encoder(read_tokenizer(WORD))
    assert token_store.splits_letters(read_tokenizer(WORD)) and not token_store.splits_letters(read_tokenizer(BYTE))
    for _ in range(4000):
        text = noise(rng)
        assert token_store.encode_texts([text], cache, None)[0].tolist() == library[WORD].encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_of_noise(pieces):
    mine, theirs = pieces
    rng, known = random.Random(3), list(mine.ids)
    for i in range(6000):
        text = noise(rng, 20) if i % 2 else "".join(rng.choice(known) for _ in range(rng.randint(0, 5))).replace("▁", rng.choice([" ", "", "▁"]))
        ids = theirs.encode(text)
        assert mine.encode(text) == ids, repr(text)
        assert mine.decode(ids) == theirs.decode(ids)
    for n in range(70):
        assert mine.encode(" " * n) == theirs.encode(" " * n) and mine.encode(" " * n + "x") == theirs.encode(" " * n + "x")
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert mine.decode(ids) == theirs.decode(ids)


def test_pairs_are_compatible_as_merging_says(pieces):
    mine, _ = pieces
    rng, reached = random.Random(4), [p for p, i in mine.ids.items() if mine.halves[i]]
    for _ in range(3000):
        a, b = rng.choice(reached), rng.choice(reached)
        if a.strip("▁") and b[0] != "▁":
            assert mine.compatible(mine.ids[a], mine.ids[b]) == (mine.merged(a + b)[0] == [a, b]), (a, b)


def test_long_texts_are_cut_safely(library, pieces):
    rng = random.Random(5)
    text = "".join(noise(rng) + rng.choice([" ", "\n", "x"]) for _ in range(3000))
    assert "".join(chunks(text, 100)) == text and len(list(chunks(text, 100))) > 50
    cache = segment_counter(read_tokenizer(BYTE))
    assert count_texts(list(chunks(text, 100)), cache).sum() == len(library[BYTE].encode(text, add_special_tokens=False).ids)
    long = "word " * 300_000 + "x" * 5000
    assert pieces[0].encode(long) == pieces[1].encode(long)


def test_op5_and_op2(spark, sf, docs, library, pieces):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op5_token_counts(spark, sf).collect():
        n = len(library[BYTE].encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 1024)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op2_piece_tokens(spark, sf).collect():
        ids = pieces[1].encode(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(pieces[1].decode(ids)))


def stored(rows, tokenizer, end=1):
    """What read_tokens must give for (doc_id, text) in order."""
    start, out = 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op10(spark, sf, docs, library):
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert sorted(map(tuple, queries.op10_token_store(spark, sf).collect())) == stored(rows, library[WORD])


def test_store_reads_one_document(spark, docs, library, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 4000)
    path = shared_path(spark, "tokens")
    token_store.write_tokens(docs, path, WORD)
    r = docs.orderBy("doc_id").take(5)[4]
    ids = library[WORD].encode(r.text, add_special_tokens=False).ids + [1]
    assert token_store.read_document(spark, path, r.doc_id) == [ids] and token_store.read_document(spark, path, -5) == []
    assert token_store.read_tokens(spark, path, with_ids=True).filter(f"doc_id = {r.doc_id}").first().ids == ids
    blocks, dictionary = token_store.open_store(spark, path)
    assert dictionary and blocks.count() > 5
    with pytest.raises(ValueError):
        token_store.Block(bytes(blocks.first().block), dictionary + b"x")


def test_odd_texts(spark, odd, library, pieces):
    counted = count_tokens(odd, BYTE).collect()
    assert all(r.n_tokens == len(library[BYTE].encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode()) and r.score == "mine" for r in counted)
    assert all(r.ids == pieces[1].encode(r.text or "") and r.decoded == pieces[1].decode(r.ids) and r.kept == "mine" for r in encode_decode(odd, PIECE).collect())
    path = shared_path(spark, "tokens")
    token_store.write_tokens(odd, path, WORD)
    got = token_store.read_tokens(spark, path).collect()
    expected = [(r.doc_id, len(library[WORD].encode(r.text or "", add_special_tokens=False).ids) + 1) for r in odd.collect()]
    key = lambda x: (x[0] is not None, *(y or 0 for y in x))
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(expected, key=key)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:i]) for i in range(len(order))]
    assert [r.doc_id for r in order if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    empty = odd.limit(0)
    assert count_tokens(empty, BYTE).count() == encode_decode(empty, PIECE).count() == 0
    path = shared_path(spark, "tokens")
    token_store.write_tokens(empty, path, WORD)
    assert token_store.read_tokens(spark, path).count() == 0


def test_letters_and_signs(library):
    words = [a + b for a in map(chr, range(0x180)) for b in ("", "x", ".", "$.", "'s", "́")] + ["x" + chr(i) for i in range(0x180)] + ["", "A.b", "..", "É,,"]
    words = [w for w in words if len(w.split()) < 2]
    cache = token_store.word_encoder(read_tokenizer(WORD))
    for w in words:
        assert token_store.encode_texts([f"ab {w} c"], cache, None)[0].tolist() == library[WORD].encode(f"ab {w} c", add_special_tokens=False).ids, repr(w)


def test_texts_without_white_space(library, pieces):
    """Cut at seams of letters, digits and signs, they give what the libraries give; what is kept is bounded by bytes."""
    rng = random.Random(8)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    texts = ["".join(han(rng.randint(1, 60)) + rng.choice("。，！.,!?19ab'が") for _ in range(200)) for _ in range(12)] + [han(20_000)]
    assert all("".join(chunks(x, 100)) == x for x in texts) and len(list(chunks(texts[0], 100))) > 20
    counter, encoder = segment_counter(read_tokenizer(BYTE)), token_store.word_encoder(read_tokenizer(WORD))
    for text in texts:
        parts = list(chunks(text, 100))
        assert count_texts(parts, counter).sum() == count_texts([text], counter)[0] == len(library[BYTE].encode(text, add_special_tokens=False).ids)
        ids = library[WORD].encode(text, add_special_tokens=False).ids
        assert np.concatenate(token_store.encode_texts(parts, encoder, None)).tolist() == token_store.encode_texts([text], encoder, None)[0].tolist() == ids
        assert pieces[0].encode(text) == pieces[1].encode(text)
    for _ in range(40):
        many = [han(30) + " " + han(2000) for _ in range(500)]
        count_texts(many, counter), token_store.encode_texts(many, encoder, 1)
    for cache in (counter, encoder.units, encoder.others, pieces[0].cache):
        for generation in (cache.now, cache.old):
            assert sum(sys.getsizeof(w) + (sys.getsizeof(v) if isinstance(v, bytes) else 0) for w, v in generation.items()) < 2 * cache.limit and max(map(len, generation), default=0) <= 64


def test_no_more_is_kept_than_the_limit():
    cache = WordCache(lambda words: [w.encode() for w in words], 1 << 20)
    for i in range(100):
        words = [f"word {i} {j}" for j in range(3000)] + ["x" * 65]
        assert cache.values(words) == [w.encode() for w in words] and cache.value("x") == b"x"
    assert len(cache.now) + len(cache.old) < 2 * ((1 << 20) // 200 + (1 << 14))
