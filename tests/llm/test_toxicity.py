import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from mnemospark.llm import toxicity


def dictionary(v):
    return dict(zip(v[0].tolist(), v[1].tolist(), strict=True))


def test_index_finds_the_exact_neighbours():
    rng = random.Random(8)
    vectors = []
    for _ in range(1500):
        # the first terms are frequent, the others rare
        held = sorted({f for f in range(12) if rng.random() < 0.4} | set(rng.sample(range(12, 400), rng.randint(0, 6)))) if rng.random() < 0.97 else []
        w = np.asarray([rng.random() for _ in held])
        vectors.append((np.asarray(held, np.int32), w / np.sqrt((w * w).sum()) if held else w))
    vectors += vectors[:140]
    index = toxicity.Index(vectors, 400)
    assert index.blocks == 4 and index.dense.shape[1] > 5
    flat = [dictionary(v) for v in vectors]
    own = list(range(0, len(vectors), 7))
    for skip in (False, True):
        cosines, which = index.nearest([vectors[i] for i in own], 15, [i if skip else -1 for i in own])
        for r, i in enumerate(own):
            cos = [(-round(sum(w * v.get(f, 0) for f, w in flat[i].items()), 10), j) for j, v in enumerate(flat) if not skip or j != i]
            want = sorted(c for c in cos if c[0] < 0)[:15]
            n = len(want)
            assert which[r, :n].tolist() == [j for _, j in want] and (which[r, n:] == -1).all()
            assert np.allclose(cosines[r, :n], [-s for s, _ in want]) and not cosines[r, n:].any()


def test_terms_by_hand():
    text = "Stupid stupider words, words"
    assert toxicity.terms(text) == {"stupid", "stupider", "words", "^stup", "^stupi"}
    space = toxicity.Space(["stupid", "^stupi", "absent", "words"])
    assert dict(zip(*(x.tolist() for x in space.counts(text)), strict=True)) == {0: 1, 1: 1, 3: 2}
    assert toxicity.terms(None) == toxicity.terms("") == set()


def test_counts_of_many_texts(monkeypatch):
    """Against the plain definition, while words are forgotten and texts are counted some at a time."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abÄß_1") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["Σίσυφος", "x" * 50, "x" * 51]
    texts = [None, "", " \x1c\u3000", "--"] + ["".join(rng.choice(words) + rng.choice([" ", "-", "\n", ", ", "\u2003", "\x1f"]) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    names = sorted({f for t in texts[::2] for f in toxicity.terms(t)})
    monkeypatch.setattr(toxicity, "WORDS", 500)
    for remembered in (5, 10_000):
        monkeypatch.setattr(toxicity, "REMEMBERED", remembered)
        space = toxicity.Space(names)
        for t, got in zip(texts * 2, space.counts_of(texts * 2), strict=True):
            found = Counter(toxicity.WORD.findall((t or "").lower()))
            want = {**found, **{"^" + p: n for p, n in toxicity.shared_beginnings(found).items()}}
            assert {names[f]: n for f, n in dictionary(got).items()} == {f: n for f, n in want.items() if f in set(names)}


def test_building_an_index_takes_little_beside_it():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(4000):
        t = np.unique((3000 * rng.random(300) ** 3).astype(np.int32))
        vectors.append((t, np.full(len(t), len(t) ** -0.5)))
    tracemalloc.start()
    index = toxicity.Index(vectors, 3000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray))
    entries = sum(len(t) for t, _ in vectors)
    assert most < 1.2 * held + 24 * entries


def test_document_frequencies(spark):
    texts = ["stupid words", "Stupid stupider", "", None, "nothing stupidest stupids"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    n, counts = toxicity.term_df(df, ["stupid", "^stup", "absent", "words"])
    assert (n, counts.tolist()) == (5, [2, 2, 0, 1])


def test_scores_are_those_of_all_cosines(spark):
    """Selection, weights, neighbours and votes against plain dictionaries; only the curve is the model's."""
    rows = corpus()[:300]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    held = {i: toxicity.terms(t) for i, t, _ in rows}
    examples = [(i, y) for i, _, y in rows if i % 3]
    names = {f for i, _ in examples for f in held[i]}
    names = {f for f in names if sum(f in held[i] for i, _ in examples) >= max(2, 0.002 * len(examples))}
    assert names == set(model.names)
    df = {f: sum(f in x for x in held.values()) for f in names}

    def vector(text):
        words = toxicity.WORD.findall(text.lower())
        tf = {f: words.count(f) for f in names if f in words}
        for f in names:
            begun = {w for w in words if len(w) > len(f) - 1 and w.startswith(f[1:])}
            if f[0] == "^" and len(begun) > 1:
                tf[f] = len(begun) - 1
        v = {f: (1 + np.log(n)) * np.log(len(rows) / df[f]) ** 1.5 for f, n in tf.items()}
        size = sum(w * w for w in v.values()) ** 0.5
        return {f: w / size for f, w in v.items() if w}

    known = [(i, y, vector(rows[i][1])) for i, y in examples]
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    a, b = model.curve
    for i, t, _ in rows[::5]:
        q = vector(t)
        near = sorted(((round(sum(w * v.get(f, 0) for f, w in q.items()), 10), -j, y) for j, y, v in known if j != i), reverse=True)[:15]  # 200 examples
        near = [x for x in near if x[0] > 0]
        vote = sum(s * y for s, _, y in near) / (sum(s for s, *_ in near) + toxicity.FAR)
        assert abs(got[i]["__score"] - 1 / (1 + np.exp(-(a * vote + b)))) < 1e-6, i
        assert got[i]["__evidence"] == ",".join(f"{-j}:{y}:{s:.3f}" for s, j, y in near[:3])


def test_the_own_label_has_no_say(spark):
    rows = corpus()[:200]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    for r in toxicity.score(docs, model).collect():
        assert f"{r.doc_id}:" not in ["".join(x.partition(":")[:2]) for x in r["__evidence"].split(",")]


def corpus():
    rng = random.Random(9)
    clean = ["".join(rng.choice(["th", "an", "er", "ing", "on"]) for _ in range(3)) for _ in range(200)]
    rows = []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(rng.randint(1, 60))]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(len(words)) :] = [rng.choice(["vile", "vilemouth", "vilest", "crude"]) for _ in range(3)]
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    extra = [(None, "vile crude vilest", 0), (9001, None, 0), (9002, "", 0), (9003, "word " * 30_000 + "vile crude vilest", 0), (9004, "vile crude vilest", 0), (9004, "vile crude vilest", 0)]
    docs = spark.createDataFrame([(i, t, 0.5, 7) for i, t, _ in rows + extra], "doc_id long, text string, score double, `a.b` int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(77777, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.learnable(labels))
    assert not {i for i in model.ids if zlib.crc32(str(i).encode()) % 3 == 1}
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "a.b", "__score", "__evidence"]
    assert toxicity.score(got, model, score="s", evidence="e").columns == [*got.columns, "s", "e"]
    scores = {}
    for r in got.collect():
        assert 0 <= r["__score"] <= 1
        scores.setdefault(r.doc_id, []).append(r["__score"])
    held = [(scores[i][0] >= 0.7, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p == y for p, y in held]) > 0.98
    assert len(scores[9004]) == 2 and min(scores[9004] + scores[None] + scores[9003]) >= 0.7
    assert max(scores[9001] + scores[9002]) < 0.3


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["__score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r["__score"] for r in toxicity.score(docs, toxicity.train(docs, one)).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), one)).count() == 0
