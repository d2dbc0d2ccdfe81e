"""Operators 4, 6, 7 and 8."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import components, decontaminate, licenses, near_copies, queries, sharding, simhash


def brute(numbers, k):
    parent = {v: v for v in numbers}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    listed = list(numbers)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= k:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in numbers}


def near(rng, n):
    out = {rng.getrandbits(64) for _ in range(n // 8)} | {0, 1, 3, 2**64 - 1, 2**63}
    while len(out) < n:
        x = rng.choice(sorted(out))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return out


@pytest.mark.parametrize(("k", "large"), [(1, 20_000), (2, 20_000), (2, 4), (3, 4)])
def test_links(spark, k, large):
    numbers = near(random.Random(k), 300)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in numbers], "fp long")
    linked = components.components(simhash.links(df, k, large)).collect()
    got = {r.node % 2**64: r.root % 2**64 for r in linked}
    groups: dict = {}
    for v, root in brute(numbers, k).items():
        groups.setdefault(root, set()).add(v)
    mine: dict = {}
    for v in numbers:
        mine.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_trie_in_small_steps(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 3)
    numbers = np.array(sorted(x >> 24 for x in near(random.Random(9), 200)), np.uint64)
    numbers = np.unique(numbers)
    label = simhash.trie_join(numbers, 24, 2)  # the first 24 bits are zero
    expected = brute([int(x) for x in numbers], 2)
    assert {int(v): int(numbers[i]) for v, i in zip(numbers, label, strict=True)} == expected


def test_groups_are_dealt_until_they_are_small(spark):
    """300 numbers that agree in 50 bits and more."""
    numbers = sorted({(random.Random(1).randrange(1 << 63) >> 14 << 14) + x for x in random.Random(2).sample(range(1 << 12), 300)})
    df = spark.createDataFrame([(x,) for x in numbers], "fp long")
    dealt = df.select(F.lit(5).cast("long").alias("code"), simhash._bits(F.col("fp"), 42, 22).alias("key"), "fp")
    groups, _ = simhash._smaller(dealt, 2, 20)
    deep = [r.code for r in groups.select("code").distinct().collect()]
    assert max(deep) >= 27 and all(r["count"] <= 300 for r in groups.groupBy("code", "key").count().collect())
    linked = components.components(simhash.links(df, 2, 20)).collect()
    expected = brute(numbers, 2)
    assert {r.node: r.root for r in linked} == {n: r for n, r in expected.items() if list(expected.values()).count(r) > 1}


def test_components_of_a_star(spark):
    df = spark.createDataFrame([(5000, i) for i in range(3000)], "u long, v long")
    assert {(r.node, r.root) for r in components.components(df).collect()} == {(i, 0) for i in [*range(3000), 5000]}


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(df.limit(0)).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(rows):
    """component_id by fingerprint of (doc_id, text)."""
    prints = {fingerprint(x) for _, x in rows}
    root, low = brute(prints, 2), {}
    for doc_id, text in rows:
        r = root[fingerprint(text)]
        low[r] = min((x for x in (low.get(r), doc_id) if x is not None), default=None)
    return {p: low[root[p]] for p in prints}


def test_op4(spark, sf, docs, odd):
    for df, found in ((docs, queries.op4_simhash_groups(spark, sf)), (odd, simhash.near_duplicates(odd).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        known = groups_of(rows)
        key = lambda x: tuple(str(y) for y in x)
        assert sorted(map(tuple, found.collect()), key=key) == sorted(((d, f"{fingerprint(x):016x}", known[fingerprint(x)]) for d, x in rows), key=key)


def test_keep_one(spark, docs, odd):
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted(set(groups_of([(r.doc_id, r.text) for r in docs.collect()]).values()))
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (2, "a b c d", "z"), (None, "q w e r t y", "n"), (None, "q w e r t y", "n"), (3, None, "e"), (4, "", "e"), (None, "a b c d", "z"), (7, "k l m n", "u"), (7, "other words are here now", "u")]
    left = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _fp string"))
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == [("1", "a b c d"), ("3", ""), ("7", "k l m n"), ("7", "other words are here now"), ("None", "q w e r t y")]
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(odd.limit(0)).count() == 0


def against_sql(spark, rows_of, sql, tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    columns = sorted(rows_of.columns)
    mine = sorted(tuple(r[c] for c in columns) for r in rows_of.collect())
    assert mine == sorted(tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()) and mine


@pytest.mark.parametrize("name", ["op6_decontamination", "op8_license_scan"])
def test_against_sql(spark, sf, name):
    against_sql(spark, queries.QUERIES[name](spark, sf), queries.ORACLE[name], {t: f"{sf}/{t}.parquet" for t in ("documents", "benchmark")})


def contained(rows, items, n=5, threshold=0.8):
    def shingles(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())

    return sorted((d, i) for d, x in rows for i, y in items if shingles(y) and len(shingles(x) & shingles(y)) / len(shingles(y)) >= threshold)


def test_leaks_by_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    letters = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 5, 6, 9, 14, 40])))) for i in range(60)] + [(99, None), (98, "")]
    rows = []
    for d in range(80):
        words = [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            piece = (rng.choice(items)[1] or "").split()
            if piece and rng.random() < 0.5:
                piece[rng.randrange(len(piece))] = "other"
            words += piece
        rows.append((d, " ".join(words).upper() if d % 2 else ", ".join(words)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = contained(rows, items)
    for size in (20_000, 7):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", size)
        found = decontaminate.find_leaks(docs, bench)
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == expected and len(expected) > 30
        assert sorted(r.doc_id for r in decontaminate.remove_leaks(docs, bench).collect()) == sorted({d for d, _ in rows} - {d for d, _ in expected})


def test_long_documents_in_chunks(monkeypatch):
    words = [f"w{i % 97}" for i in range(500)]
    whole = {s for part in decontaminate.shingles([words], 5) for s in part}
    assert {s for part in decontaminate.shingles([words[i : i + 3] for i in range(0, 500, 3)], 5) for s in part} == whole


def test_leaks_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (3, "the quick brown fox jumps over the lazy dog"), (None, "A")], "item_id long, text string")
    found = decontaminate.find_leaks(odd, bench).collect()
    assert sorted(str(r.item_id) for r in found) == ["1", "1", "1", "3", "3", "None"]
    left = decontaminate.remove_leaks(odd, bench)
    assert left.columns == odd.columns and left.count() == 9
    assert decontaminate.remove_leaks(odd, bench.limit(0)).count() == 15 and decontaminate.find_leaks(odd.limit(0), bench).count() == 0 and decontaminate.find_leaks(odd, bench.limit(0)).count() == 0


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jumps(spark):
    keys = [0, 1, 2, -1, -5, 10**18, 2**63 - 1, -(2**63)] + list(range(1000, 1100))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 300):
        assert all(r.s == jump(r.k, n) for r in df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect())
    with pytest.raises(ValueError):
        sharding.jump_shard(F.col("k"), 0)


def check_shards(rows, expected):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d), len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for d, x in expected)
    slots: dict = {}
    for r in rows:
        assert (r.law, r.shard, r.grown_shard) == ("key", jump(r.doc_id or 0, 16), jump(r.doc_id or 0, 17)) and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append((r.slot, r.doc_id if r.doc_id is not None else -1))
    for x in slots.values():
        x.sort()
        assert [s for s, _ in x] == list(range(len(x))) and [d for _, d in x] == sorted(d for _, d in x)


def test_op7(spark, sf, docs, odd, tmp_path):
    check_shards(queries.op7_sharding(spark, sf).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    check_shards(sharding.shard_documents(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert sharding.shard_documents(odd.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "x"), ("b", None), ("a", "x")], "doc_id string, text string")
    assert len({r.shard for r in sharding.shard_documents(named).filter("doc_id = 'a'").collect()}) == 1
    sharding.write_shards(docs.select("doc_id", "text"), f"{tmp_path}/out", 4)
    assert {r.doc_id: r.shard for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {r.doc_id: jump(r.doc_id, 4) for r in docs.collect()}


def test_license_windows(spark, odd):
    rng = random.Random(2)
    filler = lambda n: " ".join(f"x{rng.randrange(500)}" for _ in range(n))
    rows, expected = [], set()
    for i, (name, (_, text)) in enumerate(licenses.TEMPLATES.items()):
        rows.append((i, f"{filler(rng.randint(0, 400))} {text.upper()} {filler(rng.randint(0, 50))}"))
        expected.add((i, name))
    rows += [(100, "license " * 300), (101, None), (102, ""), (103, "the software is provided")]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert expected <= {(r.doc_id, r.template) for r in found} and not [r for r in found if r.doc_id >= 100]
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(odd.limit(0)).count() == 0


def test_anchors_lose_no_match():
    for group in licenses.groups_of(licenses.TEMPLATES):
        for name in group.names:
            shingles = set(licenses.shingles_of(licenses.TEMPLATES[name][1]))
            without = [s for s in shingles if not set(group.anchors) & set(s.split())]
            assert len(without) < licenses.least_shared(len(shingles), licenses.PIECE)


def test_interrupted_licenses(spark):
    """Words put into the middle of a template, at all offsets to the windows."""
    rows = []
    for name in ("MIT-grant", "MIT-warranty", "ISC-grant"):
        words = licenses.TEMPLATES[name][1].split()
        for n in (0, 20, 40, 100):
            for offset in range(0, 64, 3):
                rows.append((len(rows), " ".join([*(f"a{i}" for i in range(offset)), *words[: len(words) // 2], *(f"b{i}" for i in range(n)), *words[len(words) // 2 :], "end"]), name))
    rows.append((None, rows[0][1], "MIT-grant"))
    rows.append((None, rows[0][1], "MIT-grant"))
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, template string").repartition(8)).collect()
    assert sorted((str(r.doc_id), r.template) for r in found) == sorted((str(d), name) for d, _, name in rows)


def five_word_groups(rows):
    """The smallest doc_id of each doc_id's group, linked at 5-word Jaccard 0.8 or more, by brute force."""

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets, low = {d: shingles(x) for d, x in rows}, {d: d for d, _ in rows}
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and low[a] != low[b] and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((low[a], low[b]))
                low = {d: x if r == y else r for d, r in low.items()}
    return low


def test_chances_to_miss():
    """Of a pair of similarity 0.8: that no band is equal, and that too few values are."""
    p, n = 0.8, near_copies.BANDS * near_copies.ROWS
    assert (1 - p**near_copies.ROWS) ** near_copies.BANDS < 1e-9
    assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(near_copies.AGREE)) < 1e-12


def test_minhashes_agree_as_sets_are_similar():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8):
        agree = []
        for _ in range(60):
            n = int(rng.integers(20, 4000))
            both = rng.integers(0, 1 << 63, n, np.uint64)
            k = int(n * (1 - share) / 2)
            agree.append((near_copies.minhashes(both[k:]) == near_copies.minhashes(both[: n - k])).mean())
        assert abs(np.mean(agree) - share) < 0.02


@pytest.mark.parametrize(("large", "step", "chunk"), [(16, 1 << 20, 4000), (2, 7, 4000), (1, 7, 2)])
def test_near_copies(spark, docs, odd, monkeypatch, large, step, chunk):
    for name, value in (("LARGE_GROUP", large), ("NEXT", 1), ("_STEP", step), ("CHUNK", chunk)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A\tb"), (4, "a b c")]
    for i in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 9, 20, 60, 150]))] if i % 3 else [f"s{j}" for j in range(120)]
        for _ in range(rng.randint(1, 4)):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            words = words[rng.randint(0, len(words) // 15) :] + ["end"] * rng.randint(0, 1)
    known = five_word_groups(rows)
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == known and len(found) == len(rows)
    assert 20 < len(set(known.values())) < len(set(groups_of(rows).values()))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in near_copies.keep_one_copy(docs).collect()) == sorted(set(five_word_groups(rows).values()))
    assert near_copies.keep_one_copy(odd).columns == odd.columns and near_copies.keep_one_copy(odd.limit(0)).count() == 0


def test_the_stage_drops_near_copies(spark, sf):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:p] + [f"x{i}"] + words[p + 1 :])) for i, p in enumerate((20, 60, 100, 140))] + [(9, " ".join(words[:150]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, df, sf).collect())
    assert left == sorted(set(five_word_groups(rows).values())) == [0, 9]


def test_the_stage_takes_pairs_from_the_trie(spark, sf, monkeypatch):
    """With another budget of differing bits the trie's join, and so the stage, finds other pairs."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:p] + [f"x{i}"] + words[p + 1 :])) for i, p in enumerate((20, 60, 100, 140))]
    df = spark.createDataFrame([*rows, (8, rows[0][1]), (9, rows[1][1].upper())], "doc_id long, text string")
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, df, sf).collect())
    assert kept() == [0]
    monkeypatch.setattr(near_copies, "ERRORS", 0, raising=False)
    assert kept() == [0, 1, 2, 3]


@pytest.mark.parametrize("limit", [None, 3])
def test_wide_pairs(limit):
    """Three groups of wide fingerprints, equal ones too, with and without labels."""
    rng = random.Random(4)
    rows = []
    for group in range(3):
        base = [rng.getrandbits(128) for _ in range(4)]
        for _ in range(40):
            x = rng.choice(base)
            for _ in range(rng.randint(0, 9)):
                x ^= 1 << rng.randrange(128)
            rows.append((group, x, rng.getrandbits(63) - 2**62))
    rows += [(2, rows[-1][1], 5), (2, rows[-1][1], -5)]
    rows.sort(key=lambda r: (r[0], r[1], r[2] % 2**64))
    values = np.array([[x >> 64, x % 2**64] for _, x, _ in rows], np.uint64)
    names, label = np.array([r[2] for r in rows]), np.array([rng.randrange(2) if r[0] else 7 for r in rows])
    group = [r[0] for r in rows]
    lo = np.array([group.index(g) for g in range(3)])
    hi = np.r_[lo[1:], len(rows)]
    for k in (0, 3, 10):
        expected = {(i, j) for j in range(len(rows)) for i in range(j) if group[i] == group[j] and (rows[i][1] ^ rows[j][1]).bit_count() <= k}
        found = [tuple(sorted(map(int, p))) for x in simhash.wide_pairs(values, names, lo, hi, k, None, limit) for p in zip(*x, strict=True)]
        assert sorted(found) == sorted(expected) and len(expected) > 2
        apart = lambda pairs: {(i, j) for i, j in pairs if label[i] != label[j]}
        found = [tuple(sorted(map(int, p))) for x in simhash.wide_pairs(values, names, lo, hi, k, label, limit) for p in zip(*x, strict=True)]
        assert apart(found) == apart(expected) and len(set(found)) == len(found) and set(found) <= expected


def test_budget_of_differing_bits():
    """The likeliest difference of a bit, over sizes of sets of similarity 0.8, and the chance that more than the budget differ."""

    def over(n, need):  # more than need of n
        return sum(math.comb(n, i) for i in range(max(0, need + 1), n + 1)) / 2**n

    worst = 0.0
    for a in range(1, 60):
        for b in range(a, 5 * a // 4 + 1):
            both = -(-4 * (a + b) // 9)
            if both <= a:
                chances = [(math.comb(both, c) / 2**both, over(a - both, a // 2 - c), over(b - both, b // 2 - c)) for c in range(both + 1)]
                worst = max(worst, sum(p * (x * (1 - y) + y * (1 - x)) for p, x, y in chances))
    assert 0.18 < worst < 0.19
    n, k = simhash.WIDE, near_copies.ERRORS
    assert sum(math.comb(n, i) * worst**i * (1 - worst) ** (n - i) for i in range(k + 1, n + 1)) < 1e-12
    assert sum(math.comb(n, i) for i in range(k + 1)) / 2**n < 1e-4  # of unlike sets


def test_wide_fingerprints_differ_as_sets_do():
    rng, differ = np.random.default_rng(5), []
    for n in (5, 9, 90, 700, 3000):
        for _ in range(40):
            every = rng.integers(0, 1 << 63, n, np.uint64)
            a, b = (every[n // 10 :], every[: n - n // 10]) if n > 5 else (every, every[1:])
            assert near_copies.similar(np.sort(a), np.sort(b))
            x, y = (int.from_bytes(simhash.set_fingerprint(s), "big") for s in (a, b))
            assert simhash.set_fingerprint(a) == simhash.set_fingerprint(a[::-1])
            differ.append((x ^ y).bit_count())
    assert max(differ) <= near_copies.ERRORS and 20 < np.mean(differ) < 60
    unlike = [int.from_bytes(simhash.set_fingerprint(rng.integers(0, 1 << 63, 101, np.uint64)), "big") for _ in range(60)]
    assert min((x ^ y).bit_count() for i, x in enumerate(unlike) for y in unlike[:i]) > 80


def test_near_copies_of_odd_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "q w e r t y"), (None, "q w e r t y"), (3, None), (4, ""), (7, "k l m n"), (7, "other words are here now")]
    left = near_copies.keep_one_copy(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == [("1", "a b c d"), ("3", ""), ("7", "k l m n"), ("7", "other words are here now"), ("None", "q w e r t y")]
