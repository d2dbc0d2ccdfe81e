"""Operators 3 and 9."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import quality_model, quality_rules, queries


def windows(words, n):
    at: dict = {}
    for i in range(len(words) - n + 1):
        at.setdefault(tuple(words[i : i + n]), []).append(i)
    return {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + n)}


def longest(words):
    best = 0
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            k = 0
            while j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
    return best


def maximal(words, least):
    """Repeats of least words or more that differ in the word before and in the word behind, with their places."""
    at: dict = {}
    for n in range(least, len(words)):
        for i in range(len(words) - n + 1):
            at.setdefault(tuple(words[i : i + n]), []).append(i)
    word = lambda i: words[i] if 0 <= i < len(words) else f"\x00{i}"
    return {w: p for w, p in at.items() if len(p) > 1 and len({word(i - 1) for i in p}) > 1 and len({word(i + len(w)) for i in p}) > 1}


@pytest.mark.parametrize("kept_ranks", [1 << 20, 0])
def test_repeats(kept_ranks, monkeypatch):
    monkeypatch.setattr(quality_rules, "KEPT_RANKS", kept_ranks)
    rng = random.Random(0)
    docs = [[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(150)] + [["x"] * n for n in range(40)]
    for least in (3, 8, 11):
        w, r, l, many, spans = quality_rules.repeats(docs, least)
        assert many.tolist() == [len(maximal(d, least)) for d in docs]
        assert r.tolist() == [len({j for x, p in maximal(d, least).items() for i in p for j in range(i, i + len(x))}) for d in docs]
        assert w.tolist() == [len(windows(d, 8)) for d in docs] and r.tolist() == [len(windows(d, least)) for d in docs]
        assert l.tolist() == [x if (x := longest(d)) >= least else 0 for d in docs]
        assert [{j for s in x for j in range(s["start"], s["end"])} for x in spans] == [windows(d, least) for d in docs]
    assert quality_rules.repeats([], 8)[0].tolist() == [] and quality_rules.repeats([[], []], 8)[0].tolist() == [0, 0]


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(windows(words, 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), n, len(words) < 20 or 100 * n > 30 * len(words)


def test_op3(spark, sf, docs, odd):
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op3_quality_rules(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text[r.doc_id])
        words = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])
        covered = len(windows(words, 3))
        assert r.n_covered == covered and r.kept == (not r.base_failed and 100 * covered <= 30 * r.n_words and r.longest_repeat <= 50)
        assert not windows(words, max(3, r.longest_repeat + 1)) and (not r.longest_repeat or windows(words, r.longest_repeat))
    for r in quality_rules.apply_rules(odd).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text) and r.score == "mine"
    assert quality_rules.apply_rules(odd.limit(0)).count() == 0


def test_long_text(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    words[50_000:50_040] = words[10:50]
    r = quality_rules.apply_rules(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (r.n_words, r.n_repeat_words, r.longest_repeat, r.kept) == (120_000, 80, 40, True)


def test_what_the_method_adds(spark):
    """A long repeat, and short ones that no 8-word window has, are rejected though the base rules let them pass."""
    rng = random.Random(1)
    other = [str(rng.random()) for _ in range(3000)]
    short = [w for i in range(0, 300, 5) for w in (*other[i : i + 5], "one", "two", "three")]
    texts = [other[:60] + other, other[:45] + other, short, other[:300]]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert [rows[i].kept for i in range(4)] == [False, True, False, True] and (rows[2].n_repeat_words, rows[2].n_covered) == (0, 180)


def test_op9_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op9_quality_classifier(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 100 and sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.95


def test_held_out_labels_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} words {i}") for i in range(300)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    changed = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    a, b = quality_model.fit(docs, labels), quality_model.fit(docs, changed)
    assert np.array_equal(a.logits, b.logits) and a.bias == b.bias


def test_odd_labels_and_texts(spark, odd):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (5, 2), (6, None), (99, 1)], "doc_id long, quality int")
    rows = quality_model.score_quality(odd, quality_model.fit(odd, labels)).collect()
    assert len(rows) == 15 and len({r.score for r in rows if not (r.text or "").strip()}) == 1 and rows[0].kept == "mine"
    scored = quality_model.score_quality(odd.limit(0), quality_model.fit(odd.limit(0), labels.limit(0)))
    assert scored.count() == 0
    one = quality_model.train([(np.array([1], np.int32), np.array([1.0], np.float32), 1)], quality_model.Settings())
    assert 0.5 < one.score([""], one.scorer())[0] < 1


def plain_rows(text, settings):
    """Row and weight of each word, n-gram and bigram of a text, by plain loops over integers."""
    a, b, top = quality_model._A, quality_model._B, 1 << 64
    mixed = lambda h: (x := ((h ^ (h >> 29)) * b) % top) ^ (x >> 32)
    whole = lambda x, more: mixed((sum(ord(c) * pow(a, i + 1, top) for i, c in enumerate(x)) + more) % top)
    words, weights = re.findall(r"[^\x20\x09-\x0D]+", text), Counter()
    for w in words:
        framed = f"<{w}>"
        rows = [whole(framed, 0)] + [whole(framed[i : i + n], n) for n in (3, 4) for i in range(len(framed) - n + 1)]
        for r in rows:
            weights[r % settings.rows] += 1 / len(rows) / len(words)
    for x, y in zip(words, words[1:], strict=False):
        weights[settings.rows + mixed((whole(f"<{x}>", 0) * a + whole(f"<{y}>", 0)) % top) % settings.rows] += 1 / len(words)
    return weights


@pytest.mark.parametrize(("chunk", "part"), [(1 << 16, 1 << 20), (7, 30)])
def test_rows_and_scores_by_plain_loops(monkeypatch, chunk, part):
    monkeypatch.setattr(quality_model, "CHUNK", chunk)
    monkeypatch.setattr(quality_model, "PART", part)
    settings = quality_model.Settings()
    rng = random.Random(5)
    texts = ["", " ", "a", "a a a  b\n", "x" * 64, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300)), "one\ttwo " * 30 + "é😀" * 20 + "\x0c three", "y" * 40 + " " + "z" * 40 + " z z"]
    values = np.random.default_rng(0).normal(size=2 * settings.rows)
    model = quality_model.Model(values, 0.25, settings)
    scores = model.score(texts, model.scorer())
    for text, (at, weights), score in zip(texts, quality_model.document_rows(texts, settings), scores, strict=True):
        expected = plain_rows(text, settings)
        assert dict(zip(at.tolist(), weights.tolist(), strict=True)) == pytest.approx(expected, rel=1e-4)
        assert score == pytest.approx(1 / (1 + np.exp(-0.25 - sum(values[r] * w for r, w in expected.items()))))


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(1)
    vectors, output, bias = rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    some = [(np.array([0, 2, 5]), np.array([0.5, 0.2, 0.3], np.float32), 1), (np.array([1, 2]), np.array([0.9, 0.4], np.float32), 0)]
    _, *found = quality_model.gradients(vectors, output, bias, some)
    for k, grad in enumerate(found):
        for place in np.ndindex(grad.shape):
            loss = []
            for step in (1e-6, -1e-6):
                moved = [vectors.copy(), output.copy(), bias.copy()]
                moved[k][place] += step
                loss.append(quality_model.gradients(*moved, some)[0])
            assert grad[place] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-6)


def test_the_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} words {i} " * 5) for i in range(300)], "doc_id long, text string")
    labels, seen = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), []
    real = quality_model.train
    quality_model.train = lambda found, settings: seen.append(found) or real(found, settings)
    try:
        quality_model.fit(docs, labels, quality_model.Settings(sample_bytes=6000))
        quality_model.fit(docs, labels, quality_model.Settings(sample_bytes=0))
    finally:
        quality_model.train = real
    assert 0 < sum(a.nbytes + w.nbytes for a, w, _ in seen[0]) <= 6000 and len(seen[0]) > 10 and seen[1] == []


def test_the_middle_of_a_long_word_is_learned(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(n))
    docs = spark.createDataFrame([(i, noise(40) + ("良文" if i % 2 else "悪文") * 100 + noise(40)) for i in range(300)], "doc_id long, text string")
    model = quality_model.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    held = [r for r in quality_model.score_quality(docs, model).withColumn("held", quality_model.held_out("doc_id")).collect() if r.held]
    assert len(held) > 50 and all(r.predicted == r.doc_id % 2 for r in held)
