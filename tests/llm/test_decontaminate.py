import random
import re
from collections import Counter

from mnemospark.llm import decontaminate


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(ws, width):
    return [tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)]


def brute(docs, items):
    out = {}
    for i, t in docs:
        dw = words(t)
        for k, it in items:
            iw = words(it)
            if not iw:
                continue
            width, top = min(5, len(iw)), 0
            b, grams, best = Counter(shingles(iw, width)), shingles(dw, width), None
            a = sum(b.values())
            for s in range(len(grams)):
                w = Counter(grams[s : s + a])
                both = sum((w & b).values())
                sim = both / (a + sum(w.values()) - both)
                top = max(sim, top)
                if sim >= 0.8 and grams[s] in b and (best is None or sim > best[0]):
                    best = (sim, s)
            # no window anywhere is more similar than one that starts at a shared shingle
            assert (top >= 0.8) == bool(best) and (not best or best[0] == top)
            if best:
                out[(i, t, k)] = (best[1], len(iw), round(best[0], 9))
    return sorted(((i, k, *v) for (i, _, k), v in out.items()), key=str)


def got(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int").repartition(3)
    b = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    return sorted(((r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in decontaminate.find_leaks(d, b).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([6, 9, 14, 30, 55])))) for k in range(25)]
    items += [(90, None), (91, "..."), (92, "only three words"), (93, "a a a a a a a a"), (94, items[0][1]), (None, "null item id with some words here")]
    docs = []
    for i in range(150):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            item = words(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                if item:
                    j = rng.randrange(len(item))
                    item[j : j + 1] = rng.choice([[], ["edit"], [item[j], "edit"]])
            cut = rng.choice([0, 0, 1, 3])
            at = rng.randint(0, len(ws))
            ws[at:at] = item[: len(item) - cut]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in ws)))
    docs += [(500, None), (501, ""), (502, "Only, THREE words!"), (503, "a " * 3000), (None, items[3][1]), (504, items[4][1]), (504, items[4][1]), (504, items[4][1] + " tail"), (505, "x" * 90_000)]
    want = brute(docs, items)
    assert len(want) > 60
    assert got(spark, docs, items) == want


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b c d e f")]) == []
    assert got(spark, [(1, "a b c d e f")], []) == []


def test_stage_keeps_clean_rows(spark):
    d = spark.createDataFrame([(1, "x a b c d e f g y", "p", 1, 7), (2, "all clean here and there", "q", 1, 8), (None, None, "r", 1, 9), (2, "all clean here and there", "q", 1, 8)], "doc_id long, text string, `a.b` string, __key int, doc_key int")
    b = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    kept = decontaminate.without_leaks(d, b)
    assert kept.columns == d.columns and sorted((str(r.doc_id), r["__key"], r.doc_key) for r in kept.collect()) == [("2", 1, 8), ("2", 1, 8), ("None", 1, 9)]


def test_only_built_in_functions(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plan = decontaminate.find_leaks(d, b)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("PythonRDD", ""))


def test_blocks_cover_all_bits():
    masks = [m & (2**64 - 1) for m in decontaminate._masks(24)]
    assert sum(masks) == 2**64 - 1 and len(masks) == 25


def test_fingerprints_in_lanes(spark):
    rng = random.Random(5)
    for most in (200, 300, 70_000):
        rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (1, 2, 3, 50, 255 if most > 255 else 199, 300 if most > 300 else 4)]
        got = decontaminate._with_print(spark.createDataFrame(rows, "h array<long>"), "h", most, "p").collect()
        for r in got:
            want = sum((1 << b) for b in range(64) if 2 * sum((x >> b) & 1 for x in r.h) > len(r.h))
            assert r.p & (2**64 - 1) == want


def test_joins_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", -1)
    docs, items = [(1, "x a b c d e f g y"), (2, "a b c d e f q")], [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "p q")]
    assert got(spark, docs, items) == brute(docs, items)
