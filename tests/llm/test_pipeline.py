import random

import corpus_pipeline


def test_stages_on_planted_rows(spark, tmp_path):
    rng = random.Random(3)
    vocab = ["".join(rng.choice(["th", "an", "er", "ing", "on", "st"]) for _ in range(3)) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        docs.append((i, text(60) + (" vile vilemouth crude vilest" if bad else ""), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    item = text(40)
    docs += [(1000, docs[1][1], "en", "s", 0), (1001, text(20) + " " + item + " " + text(10), "en", "s", 0), (1002, text(30) + " joe.b@site.org", "en", "s", 0), (1003, None, "en", "s", 0), (None, text(50), None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(d + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    clean = {i for i in range(300) if i % 6}
    assert set(out) == clean | {1002, 1003, None}
    assert "joe.b" not in out[1002].text and "[EMAIL]" in out[1002].text and out[1002].n_chars == len(out[1002].text)
    assert all(out[i].text == docs[i][1] for i in clean)
    assert out[1003].n_tokens == 0 and all(out[i].n_tokens == len(out[i].ids) > 0 for i in clean)


def test_stages_keep_the_columns(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == docs.columns and got.count() == 1
        assert stage(spark, docs.limit(0), d).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "personal_data", "encoding"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Clashing and dotted names, null ids and texts, very long texts, ties and repeated rows."""
    rng = random.Random(7)
    d = str(tmp_path)
    names = ["__score", "__evidence", "__fp", "__row", "__key", "__spans", "__near", "__clean", "__terms", "a.b", "ids", "n_tokens", "row", "root", "window"]
    words = [f"w{i}" for i in range(3000)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(30)]
    texts += [(50, texts[0][1]), (50, texts[0][1]), (0, texts[0][1]), (None, texts[1][1]), (60, None), (61, ""), (None, None), (70, " ".join(rng.choice(words) for _ in range(150_000)) + " me@here.org")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(names))) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)).repartition(3)
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(30)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame([(1, texts[5][1]), (None, None), (2, "")], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    docs.write.parquet(d + "/documents.parquet")
    read = spark.read.parquet(d + "/documents.parquet")
    key = lambda r: (str(r.doc_id), r.text or "")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, read, d)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert all([r[n] for n in names] == list(range(len(names))) for r in rows), name
        left = sorted(map(key, rows))
        if name == "near_copies":
            assert left == sorted([(str(i), t) for i, t in texts[:30]] + [("60", ""), ("70", texts[-1][1])])
        elif name == "decontamination":
            assert left == sorted((str(i), t or "") for i, t in texts if t != texts[5][1])
        elif name == "personal_data":
            assert left == sorted((str(i), (t or "").replace("me@here.org", "[EMAIL]")) for i, t in texts)
    last = corpus_pipeline.encode(spark, read, d)
    assert set(docs.columns) <= set(last.columns) and sorted(map(key, last.collect())) == sorted((str(i), t or "") for i, t in texts)
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in out} <= {*range(30), 60, 70, None} and all(r.n_tokens == len(r.ids) for r in out)
