import random
from collections import Counter

import xxhash

from mnemospark.llm import simhash


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = {}
    for i, t in rows:
        fps.setdefault(brute_fingerprint(t), []).append(i)
    left, out = set(fps), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            todo += near
        ids = [i for x in group for i in fps[x] if i is not None]
        out |= {x: min(ids, default=None) for x in group}
    return sorted(((i, x, out[x]) for x, ids in fps.items() for i in ids), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, simhash string")
    return sorted(((r.doc_id, r.simhash & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(1, 6)):
            words = list(base)
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, "  \t"), (903, "A b"), (903, "a B"), (None, "w1 w2 w3"), (None, "solo null"), (904, "x" * 50_000), (905, "many words " * 30_000)]
    assert got(spark, rows) == brute_components(rows)


def test_every_pair_within_radius_meets_in_a_cell():
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for flips in (1, 2, 3):
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, flips, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        at, cells, own = simhash.half_cells(np.concatenate((a, b)))
        where = {}
        for i, c, o in zip(at, cells, own, strict=True):
            where.setdefault(c, []).append((i, o))
        met = {tuple(sorted((i % 300 + 300 * (i >= 300), j))) for g in where.values() for i, o in g for j, p in g if i < j and (o or p)}
        assert all((i, i + 300) in met for i in range(300))


def test_large_dense_group_is_one_component(spark):
    text = " ".join(f"t{i}" for i in range(400))
    rows = [(i, text.replace(f"t{i % 390} ", "zz ", 1)) for i in range(600)]
    assert got(spark, rows) == brute_components(rows)


def test_empty_table_and_stage(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).columns == ["doc_id", "text", "lang"]
    docs = spark.createDataFrame([(3, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (7, "other words here entirely different ones", "w")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [2, 7]


def test_edited_copies_leave_one(spark):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(3000)]
    rows, groups = [], []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(120, 500))]
        groups.append([])
        for k in range(rng.choice([2, 3, 6])):
            words = list(base)
            for _ in range(0 if k == 0 else max(1, len(words) // 120)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            groups[-1].append(len(rows))
            rows.append((len(rows), " ".join(words), "x"))
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    clean = []
    for _ in range(60):
        clean.append(len(rows))
        rows.append((len(rows), " ".join(rng.choice(vocab) for _ in range(200)) + " " + shared, "y"))
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()}
    assert set(clean) <= kept
    wrong = 0
    for g in groups:
        # those at least 0.8 similar to the group's first text must go with it
        near = [i for i in g if simhash.similarity(rows[g[0]][1], rows[i][1]) >= 0.8]
        assert g[0] in kept
        wrong += len(kept & set(near[1:]))
    assert wrong == 0


def test_similarity_counts_repeats():
    assert simhash.similarity("a b c d e f", "a b c d e f") == 1.0
    assert simhash.similarity("a b c d e f", "x b c d e f") == 1 / 3
    assert simhash.similarity(None, "") == 1.0


def test_signatures_rule_out_only_pairs_below(spark):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", "a", "a b c d e f"]
    for n in (3, 12, 40, 150, 700, 3000):
        base = [rng.choice(vocab) for _ in range(n)]
        notice = [rng.choice(vocab) for _ in range(n // 3)]
        texts += [" ".join(w) for w in (base, base[:-1], base[: n * 9 // 10], edited(rng, vocab, base, 60), notice + base, base + base, ["x"] * n)]
        texts += [" ".join(notice + [rng.choice(vocab) for _ in range(n)]) for _ in range(3)]  # share a notice only
    rows = list(enumerate(texts))
    signs = [simhash.signature(t) for t in texts]
    pairs = [(a, b, a, b) for a, _ in rows for b, _ in rows if a < b]
    for a, b, *_ in pairs:
        assert simhash.similarity(texts[a], texts[b]) <= simhash.most_similar(*signs[a], *signs[b]) + 1e-9
    docs = spark.createDataFrame(rows, "row long, text string")
    ask = spark.createDataFrame(pairs, "a long, b long, root_a long, root_b long").repartition(3)
    left = {(r.a, r.b) for r in simhash.likely_pairs(ask, simhash.signatures(docs), 0.8).collect()}
    near = {(a, b) for a, b, *_ in pairs if simhash.similarity(texts[a], texts[b]) >= 0.8}
    assert near <= left and len(left - near) < 0.05 * len(pairs)


def brute_kept(rows):
    """The least id of each component by fingerprints and similarity, every pair compared."""
    fps = [brute_fingerprint(t, simhash.WIDTH) for _, t in rows]
    counts = [Counter(simhash.shingle_digests(t, simhash.WIDTH)) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if top(i) != top(j):
                both, both_not = (counts[i] & counts[j]).total(), (counts[i] | counts[j]).total()
                if (fps[i] ^ fps[j]).bit_count() <= 3 or both >= 0.8 * both_not:
                    root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted(least.values())


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(r.doc_id for r in simhash.one_of_each(df).collect())


def edited(rng, vocab, base, every):
    words = list(base)
    for i in range(0, len(words), every):
        words[rng.randrange(i, min(i + every, len(words)))] = rng.choice(vocab)
    return " ".join(words)


def test_copies_around_a_base_leave_one(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(5000)]
    rows = []
    for copies, every in ((12, 75), (12, 75), (12, 75), (60, 60)):
        base = [rng.choice(vocab) for _ in range(300)]
        texts = [edited(rng, vocab, base, every) for _ in range(copies)]
        texts.insert(copies // 2, " ".join(base))
        rows += [(len(rows) + i, t) for i, t in enumerate(texts)]
    assert kept(spark, rows) == brute_kept(rows)
    assert len(kept(spark, rows)) == 4


def test_short_texts_and_shared_notices_lose_no_pair(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(5000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = ["one", "one", "one two", None, ""]
    for n in [1, 4, 5, 9, 15, 25, 40] * 12:
        base = some(n)
        texts += [" ".join(base), " ".join([*base, "end"])]
    notice = some(150)
    texts.append(" ".join([*some(40), *notice]))
    for n in [20, 30, 60] * 12:
        base = some(n)
        texts += [" ".join([*base, *notice]), edited(rng, vocab, base, n) + " " + " ".join(notice)]
    texts.append(" ".join([*some(40), *notice]))
    texts += [" ".join(["again and"] * 40), " ".join(["again and"] * 44), " ".join(["again and"] * 60)]
    rows = list(enumerate(texts))
    assert kept(spark, rows) == brute_kept(rows)


def test_rounds_without_all_pairs_agree(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 0)
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(200)]
    rows = [(i, edited(rng, vocab, base, every)) for i, every in enumerate([25, 40, 50, 60, 80] * 8)]
    assert kept(spark, rows) == brute_kept(rows)


def test_edited_copies_that_are_not_similar_are_hardly_compared(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(150)]
    rows = [(i, edited(rng, vocab, base, every)) for i, every in enumerate([24, 30, 36, 50] * 40)]
    rows.insert(70, (500, " ".join(base)))
    compared = []
    likely = simhash.likely_pairs
    monkeypatch.setattr(simhash, "likely_pairs", lambda pairs, *more: compared.append(pairs.count()) or likely(pairs, *more))
    assert kept(spark, rows) == brute_kept(rows)
    assert sum(compared) < len(rows) * 5  # of 12,880 pairs


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(2, "a b c d e f g h i j k l m n o p q r s t", 1, 2, 3, 4), (1, "a b c d e f g h i j k l m n o p q r s t", 5, 6, 7, 8), (None, "a b c d e f g h i j k l m n o p q r s t", 0, 0, 0, 0), (3, "x " * 40_000, 9, 9, 9, 9), (4, None, 1, 1, 1, 1), (5, " ", 2, 2, 2, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __fp int, __row int, `a.b` int, row int")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r["__fp"], r["__row"], r["a.b"], r.row) for r in got.collect()) == [(1, 5, 6, 7, 8), (3, 9, 9, 9, 9), (4, 1, 1, 1, 1)]
