"""Operators on small frames, with the cases that a guess would get wrong."""

import datetime as dt
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import geo, score, text, vector
from mnemospark.functions import time as tm
from mnemospark.operators import forecast, graph, mentions, mining, recommend, topk, trajectories, windows
from mnemospark.operators.components import connected_components
from mnemospark.operators.joins import band_join, following_first, grid_pairs, interval_pairs
from mnemospark.plans.memory_query import MemoryQuery, page
from mnemospark.sources import importers, stores
from mnemospark.streaming.events import fold_memory


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert value(spark, vector.cosine(a(1, 0), a(1, 1))) == pytest.approx(2**-0.5)
    assert value(spark, vector.cosine(a(0, 0), a(1, 1))) == 0.0
    assert value(spark, vector.cosine(a(1), a(1, 1))) == 0.0
    assert value(spark, vector.normalised(a(0, 0))) == [0.0, 0.0]
    assert value(spark, vector.euclidean(a(0, 0), a(3, 4))) == 5.0


def test_places(spark):
    d = value(spark, geo.haversine(F.lit(39.9042), F.lit(116.4074), F.lit(39.915), F.lit(116.415)))
    assert d == pytest.approx(1364.7, abs=0.5)
    assert value(spark, geo.degrees(F.lit(10), F.lit(30), F.lit(0), F.lit("S"))) == -10.5
    ring = [(0, 0), (0, 4), (4, 4), (4, 0)]
    assert value(spark, geo.in_polygon(F.lit(1.0), F.lit(1.0), ring)) and not value(spark, geo.in_polygon(F.lit(5.0), F.lit(1.0), ring))


def test_times(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    for hour, want in ((4, "night"), (5, "morning"), (11, "morning"), (12, "noon"), (14, "afternoon"), (18, "evening"), (22, "night")):
        assert value(spark, tm.time_of_day(at(f"2024-01-15 {hour:02d}:00:00"))) == want
    assert value(spark, tm.day_type(at("2024-01-14 00:00:00"))) == "weekend"
    i = lambda x: F.lit(x)
    cases = {"before": (0, 1, 2, 3), "meets": (0, 1, 1, 2), "overlaps": (0, 2, 1, 3), "starts": (0, 1, 0, 3), "during": (1, 2, 0, 3), "finishes": (2, 3, 0, 3), "equals": (0, 3, 0, 3)}
    inverse = {"before": "after", "meets": "met_by", "overlaps": "overlapped_by", "starts": "started_by", "during": "contains", "finishes": "finished_by", "equals": "equals"}
    for name, (a, b, c, d) in cases.items():
        assert value(spark, tm.allen(i(a), i(b), i(c), i(d))) == name
        assert value(spark, tm.allen(i(c), i(d), i(a), i(b))) == inverse[name]
    today = F.lit("2024-01-15").cast("date")
    assert [value(spark, tm.relative_day(F.lit(w), today)) for w in ("今天", "后天", "前天")] == ["2024-01-15", "2024-01-17", "前天"]


def test_texts(spark):
    assert value(spark, text.masked_email(F.lit("alice@x.org"))) == "a***e@x.org"
    assert value(spark, text.masked_email(F.lit("al@x.org"))) == "**@x.org"
    assert value(spark, text.masked_mobile(F.lit("13812345678"))) == "138*****678"
    assert value(spark, text.complexity(F.lit("zow " + "x" * 300))) == "COMPLEX"
    assert value(spark, text.complexity(F.lit("now " + "x" * 300))) == "SIMPLE"  # prefixes alone count
    assert value(spark, text.complexity(F.lit("hi " + "x" * 300))) == "SIMPLE"
    assert value(spark, text.language(F.lit("今天去公司 ok"))) == "zh" and value(spark, text.language(F.lit(""))) == "en"
    assert value(spark, text.without_tags(F.lit("<p>a</p>\n <b>b</b>"))) == "a b"
    assert value(spark, text.title(F.lit("x" * 50))) == "x" * 50 and value(spark, text.title(F.lit("x" * 51))) == "x" * 50 + "..."


def test_scores(spark):
    assert value(spark, score.activation(F.lit(1.0), F.lit(0), F.lit(20))) == 1.0
    assert value(spark, score.importance(F.lit(200), F.lit(0))) == pytest.approx(1.0)
    assert value(spark, score.regularity(F.lit(None).cast("double"), F.lit(1))) == 0.5
    assert value(spark, score.capped(F.lit(20), 10.0, 0.9)) == 0.9


MEM = "memory_id long, memory_type string, content string, event_time timestamp_ntz, lat double, lon double, tags array<string>, confidence double, entity_id long, k int"


def mem(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    return spark.createDataFrame([(1, "a", "Big news", t(1), 1.0, 1.0, ["x", "y"], 0.5, 7, 1), (2, "a", "none", t(2), None, None, ["News"], 0.9, 7, 2), (3, "b", "none", t(3), 9.0, 9.0, [], 0.1, 8, 3), (4, "b", "z", t(3), 1.0, 2.0, ["x"], 0.1, 8, 3)], MEM)


@pytest.mark.parametrize(
    ("q", "want"),
    [
        (MemoryQuery(keyword="ews"), [2, 1]),
        (MemoryQuery(keyword="news"), [1]),
        (MemoryQuery(box=(0, 2, 0, 2)), [4, 2, 1]),
        (MemoryQuery(tags=["x", "y"]), [1]),
        (MemoryQuery(since="2024-01-02", until="2024-01-03", sort="time_asc"), [2, 3, 4]),
        (MemoryQuery(entity_id=8, limit=1), [3]),
        (MemoryQuery(sort="importance", limit=2, offset=1), [1, 3]),
    ],
)
def test_memory_queries(spark, q, want):
    assert [r.memory_id for r in q.plan(mem(spark)).collect()] == want


def test_page_has_the_whole_total(spark):
    assert {r.total for r in page(mem(spark), MemoryQuery(limit=2)).collect()} == {4}


def test_sessions_split_after_more_than_the_gap(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 7200.0), (1, 14401.0), (2, 5.0)], "u int, t double")
    got = {(r.u, r.t): r.session for r in windows.sessions(df, ["u"], "t", [F.asc("t")], 7200.0).collect()}
    assert got == {(1, 0.0): 0, (1, 7200.0): 0, (1, 14401.0): 1, (2, 5.0): 0}


def test_joins_match_brute_force(spark):
    rng = np.random.default_rng(1)
    a = [(int(i), float(x)) for i, x in enumerate(rng.uniform(-50, 50, 60))]
    b = [(int(i), float(x)) for i, x in enumerate(rng.uniform(-50, 50, 60))]
    left, right = spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double")
    got = {(r.i, r.j) for r in band_join(left, right, "x", "y", 3.0).collect()}
    assert got == {(i, j) for i, x in a for j, y in b if abs(x - y) <= 3}
    spans = [(i, x, x + float(rng.uniform(0, 20)), 1) for i, x in a]
    df = spark.createDataFrame(spans, "i int, s double, e double, g int")
    pairs = [(r.i, r.other_i) for r in interval_pairs(df, "i", "s", "e", 4.0, ["g"]).collect()]
    want = [(i, j) for i, s, e, _ in spans for j, s2, e2, _ in spans if i < j and s <= e2 and s2 <= e]
    assert sorted(pairs) == sorted(want)
    pts = spark.createDataFrame([(i, x, y, 0) for (i, x), (_, y) in zip(a, b, strict=True)], "i int, x double, y double, g int")
    near = {(r.i, r.other_i) for r in grid_pairs(pts, "i", "x", "y", 5.0, 5.0, ["g"]).collect()}
    close = {(i, j) for (i, x), (_, y) in zip(a, b, strict=True) for (j, x2), (_, y2) in zip(a, b, strict=True) if i < j and abs(x - x2) <= 5 and abs(y - y2) <= 5}
    assert close <= near
    c = left.withColumn("g", F.lit(0))
    e = right.withColumn("g", F.lit(0))
    got = {r.i: r.j for r in following_first(c, e, "x", "y", 10.0, ["g"], ["i"], [F.asc("y"), F.asc("j")]).collect()}
    assert got == {i: min((y, j) for j, y in b if 0 < y - x < 10)[1] for i, x in a if any(0 < y - x < 10 for _, y in b)}


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 5)], "src long, dst long")
    u = graph.undirected(e)
    assert u.count() == 8
    ranks = {r.node: r["rank"] for r in graph.pagerank(u, 12).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks[1] == pytest.approx(ranks[2])
    closed = {(r.src, r.dst) for r in graph.closure(e).collect()}
    assert (1, 1) in closed and (1, 3) in closed and (1, 4) not in closed
    assert graph.closure(graph.closure(e)).count() == len(closed)
    hops = {r.node: r.hops for r in graph.reach(e, spark.createDataFrame([(1,)], "node long"), 5).collect()}
    assert hops == {1: 0, 2: 1, 3: 2}
    assert {r.node: r.label for r in graph.communities(u, 4).collect()}[5] in (4, 5)
    merged = graph.merged(e.withColumn("confidence", F.lit(0.5)), "1", "2")
    assert ("1", "1") not in {(r.src, r.dst) for r in merged.collect()}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_patterns(spark):
    rows = [["a", "b", "c"], ["a", "c"], ["b", "a"], ["a", "x", "b"]]
    df = spark.createDataFrame([(r,) for r in rows], "seq array<string>")
    got = {r.pattern: (r.n, round(r.support, 3), round(r.confidence, 3)) for r in mining.frequent_sequences(df, 2, 3).collect()}
    assert got == {"a>b": (2, 0.5, 0.5), "a>c": (2, 0.5, 0.5)}
    pre = {r.prefix: (r.n, r.confidence) for r in mining.prefixes(df, 2).collect()}
    assert pre["a"] == (3, 1.0) and pre["a>b"] == (1, pytest.approx(1 / 3))


def test_forecast_of_a_line(spark):
    df = spark.createDataFrame([("s", i, 2.0 * i + 1) for i in range(48)], "series string, t int, value double")
    parts = forecast.decomposed(forecast.numbered(df, "series", "t"))
    nxt = {r.step: r.value for r in forecast.forecast(parts, 2).collect()}
    assert nxt[1] == pytest.approx(97.0) and nxt[2] == pytest.approx(99.0)
    short = forecast.numbered(df.where("t < 19"), "series", "t")
    assert forecast.lag_weights(short).count() == 0


def test_recommendation(spark):
    r = spark.createDataFrame([(1, "a", 5.0), (1, "b", 3.0), (2, "a", 5.0), (2, "c", 4.0), (3, "z", 1.0)], "user_id int, item_id string, rating double")
    got = {(x.user_id, x.item_id) for x in recommend.user_based(r).collect()}
    assert got == {(1, "c"), (2, "b")}
    assert {(x.user_id, x.item_id) for x in recommend.item_based(r).collect()} == got
    assert recommend.similarities(r, "user_id", "item_id", "pearson").count() == 0
    a = recommend.assigned(r, "e", {"x": 0.5, "y": 0.5}).select("user_id", "variant").distinct()
    assert a.count() == 3


@pytest.mark.parametrize("metric", ["cosine", "pearson"])
def test_users_as_a_matrix(spark, metric, monkeypatch):
    """Copies, multiples and constant rows included, the neighbours are those of the join of users by items."""
    rng = np.random.default_rng(3)
    own = [{i: int(rng.integers(1, 4)) for i in rng.choice(6, int(rng.integers(1, 6)), replace=False)} for _ in range(30)]
    own += own[:8] * 3 + [{i: 2 * n for i, n in x.items()} for x in own[:8]] + [{0: 2, 1: 2}] * 5
    rows = [(u, f"i{i}", float(n)) for u, x in enumerate(own) for i, n in x.items()]
    df = spark.createDataFrame(rows, "user_id long, item_id string, rating double")
    joined = recommend.user_based(df.withColumn("user_id", F.format_string("%04d", "user_id")), 5, metric)
    want = {(int(r.user_id), r.item_id): round(r.score, 6) for r in joined.collect()}
    monkeypatch.setattr(recommend, "PART", 64)  # several parts
    monkeypatch.setattr(recommend, "similarities", None)  # no pairs of users for each item
    got = {(r.user_id, r.item_id): round(r.score, 6) for r in recommend.user_based(df, 5, metric).collect()}
    assert want and got == pytest.approx(want)


def test_rounding_of_similarities():
    assert recommend.rounded(np.asarray([1 / 1024, 0.1234567894999, 1.0]), 9).tolist() == [976563, 123456789, 10**9]


def test_search_ranks(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in topk.bm25(docs, ["red", "fox"]).collect()}
    assert set(s) == {1, 2} and s[1] > s[2]
    v = spark.createDataFrame([(1, 0.5), (3, 0.9)], "doc_id long, score double")
    t = spark.createDataFrame([(1, 2.0)], "doc_id long, score double")
    assert [r.doc_id for r in topk.hybrid(v, t, 2, "doc_id").collect()] == [3, 1]


def test_trajectories():
    assert trajectories.dtw(np.asarray([1.0, 2, 3]), np.asarray([1.0, 1, 2, 3])) == 0.0
    assert trajectories.dtw(np.asarray([0.0]), np.asarray([3.0])) == 3.0


def test_mentions(spark):
    found = {(t, label) for _, _, _, t, label in mentions.find("今天早晨8点在星巴克和李医生讨论, mail a.b@x.org, Tom 13812345678")}
    assert {("今天", "DATE"), ("早晨", "TIME"), ("8点", "TIME"), ("星巴克", "BRAND"), ("李医生", "PERSON"), ("a.b@x.org", "EMAIL"), ("Tom", "PERSON"), ("13812345678", "PHONE")} <= found
    assert mentions.find(None) == [] and not [m for m in mentions.find("The Monday end") if m[4] == "PERSON"]
    df = spark.createDataFrame([(1, "林医生"), (2, "")], "id int, text string")
    rows = mentions.mentions(df, "id", "text").collect()
    assert [(r.id, r.text) for r in rows] == [(1, "林医生")]


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        # titles keep their own confidence, the longer one wins
        ("跟女朋友和同事吃饭", [("女朋友", "PERSON", 0.95), ("同事", "PERSON", 0.85)]),
        ("爸妈在家", [("爸妈", "PERSON", 0.9), ("家", "PLACE", 0.9)]),
        # a surname with one or two characters, less particles at its end; a title after it adds trust
        ("郝建国到了", [("郝建国", "PERSON", 0.7)]),
        ("钱多的", [("钱多", "PERSON", 0.7)]),
        ("龚平经理", [("龚平经", "PERSON", 0.7)]),
        ("吴和平", [("吴和平", "PERSON", 0.7)]),
        # no name ends in a character of time, and common words are none
        ("周日", [("周日", "DATE", 0.92)]),
        ("2024年3月5号", [("2024年3月5号", "DATE", 0.95), ("3月5号", "DATE", 0.9)]),
        ("2024/3/5 14:30", [("2024/3/5", "DATE", 0.95), ("14:30", "TIME", 0.95)]),
        ("下周三7点半", [("下周三", "DATE", 0.9), ("周三", "DATE", 0.92), ("7点半", "TIME", 0.88)]),
        ("010-12345678", [("010-12345678", "PHONE", 0.95)]),
        ("飞往西班牙", [("西班牙", "GPE", 0.95)]),
        ("腾飞科技公司", [("腾飞科技公司", "ORG", 0.85), ("腾飞科技公司", "PLACE", 0.82), ("公司", "PLACE", 0.9)]),
        ("用知乎", [("知乎", "PRODUCT", 0.95)]),
        ("发布会和答辩", [("发布会", "EVENT", 0.88), ("答辩", "EVENT", 0.87)]),
    ],
)
def test_mentions_by_hand(sentence, want):
    got = {(t, label, -neg) for _, neg, _, t, label in mentions.find(sentence)}
    best = {}
    for t, label, conf in want:
        if t not in best or conf > best[t][1]:
            best[t] = (label, conf)
    assert {(t, *best[t]) for t in best} <= got


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("how do they compare and why, say, is that so", "COMPLEX"),
        ("please analyze the weekly numbers", "MODERATE"),
        ("what is on the table over there today", "SIMPLE"),
        ("now then, what if they evaluate it again", "SIMPLE"),
        ("goodbye and explain and compare all of it", "SIMPLE"),
        ("该方案到底怎么样？预算够吗？请都说一说看一看", "COMPLEX"),
        ("how?", "SIMPLE"),
    ],
)
def test_complexity_by_hand(spark, said, want):
    assert value(spark, text.complexity(F.lit(said))) == want


@pytest.mark.parametrize(
    ("said", "level"),
    [
        ("card 4111111111111111 here", "RESTRICTED"),
        ("id 110101199003070000", "RESTRICTED"),
        ("the KEY is under the mat", "RESTRICTED"),
        ("salary and health", "PUBLIC"),
        ("call 13812345678 please", "CONFIDENTIAL"),
        ("write to a.b@x.org", "CONFIDENTIAL"),
        ("my address", "CONFIDENTIAL"),
        ("a note for you", "INTERNAL"),
        ("1234567890123456789012", "PUBLIC"),
    ],
)
def test_classification_by_hand(spark, said, level):
    assert value(spark, text.classification(F.lit(said))) == level


def test_redaction_by_hand(spark):
    keys = ["password", "user_email", "CREDIT_CARD", "key", "credential", "Phone", "locations", "name"]
    df = spark.createDataFrame([({k: "v" for k in keys},)], "m map<string,string>").select(text.redacted(F.col("m")).alias("m"))
    assert {k for k, v in df.first().m.items() if v == "v"} == {"key", "credential", "name"}


def test_linked_by_parts(spark):
    from mnemospark.queries.upkeep import linked

    names = ["a", "ab", "abc", "xabcy", "zz", "", "long name here"]
    said = ["b", "abc", "xabcyz", "name", "q", "", "the long name here too"]
    c = spark.createDataFrame(list(enumerate(names)), "concept_id int, name string")
    m = spark.createDataFrame([(s,) for s in said], "mention string")
    got = {r.mention: r.concept_id for r in linked(m, c, spark.createDataFrame([], "synonym string, concept_id int")).collect()}
    for s in said:
        exact = [i for i, n in enumerate(names) if n == s]
        part = [i for i, n in enumerate(names) if n and s and (n in s or s in n)]
        assert got[s] == (exact[0] if exact else min(part, default=None)), s


def test_photo_blocks():
    entry = lambda tag, kind, n, v: struct.pack("<HHI4s", tag, kind, n, v)
    made = b"Canon\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + entry(0x010F, 2, len(made), struct.pack("<I", 26)) + struct.pack("<I", 0) + made
    assert importers.exif(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff)["make"] == "Canon"
    assert importers.exif(b"\xff\xd8 no block") == {} and importers.exif(b"") == {}


def test_photo_and_mail_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8 none")
    (tmp_path / "b.txt").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = importers.photos(files).collect()
    assert len(rows) == 1 and rows[0].taken_time is not None and rows[0].lat is None
    assert importers.parse_mail(b"")[1] == "无主题"


def test_working_memory_rules():
    items, out = fold_memory({}, [(float(i), i, f"i{i}") for i in range(8)], 7, 1000.0, 0.1)
    assert len(items) == 7 and out == [(7.0, "i0", "evicted", True)]
    items, out = fold_memory({"a": [1.0, 0.0, 1], "b": [1.0, 0.0, 0]}, [(100.0, 1, "c")], 7, 10.0, 0.1)
    assert {(n, r, c) for _, n, r, c in out} == {("a", "faded", True), ("b", "faded", False)}
    items, _ = fold_memory({"a": [0.95, 0.0, 0]}, [(0.0, 1, "a")], 7, 10.0, 0.1)
    assert items["a"][0] == pytest.approx(min(1.0, 0.95 + 0.1)) and math.isclose(items["a"][2], 1)


def test_settings_merge():
    base, more = {"db": {"host": "a", "port": 1}, "on": False}, {"db": {"host": "b"}}
    got = stores.merged_settings(base, more, environment={"MEMO_DB__PORT": "7", "MEMO_ON": "true", "MEMO_NEW": "x", "OTHER": "y"})
    assert got == {"db": {"host": "b", "port": 7}, "on": True, "new": "x"}


def test_photo_events_and_embeddings(spark):
    p = spark.createDataFrame([("/a/b.jpg", dt.datetime(2024, 1, 1), 1.5, -2.25), ("/c.png", None, None, None)], "path string, taken_time timestamp_ntz, lat double, lon double")
    got = {r.title: r.location for r in stores.photos_as_events(p).collect()}
    assert got == {"b.jpg": "(1.5000, -2.2500)", "c.png": None}
    docs = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "")], "id int, text string")
    v = {r.id: r.embedding for r in stores.hashed_embeddings(docs, "id", "text").collect()}
    assert v[1] == v[2] and sum(x * x for x in v[1]) == pytest.approx(1.0) and set(v[3]) == {0.0}


def test_pagerank_stops_when_settled(spark):
    edges = spark.createDataFrame([(a, b) for a, b in ((1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3), (2, 4), (4, 2))], "src long, dst long")
    got = {r.node: r["rank"] for r in graph.pagerank(edges, 100, least=1e-6).collect()}
    links, ranks = {1: [2], 2: [1, 3, 4], 3: [2, 4], 4: [3, 2]}, dict.fromkeys((1, 2, 3, 4), 0.25)
    for _ in range(200):
        ranks = {n: 0.15 / 4 + 0.85 * sum(ranks[m] / len(links[m]) for m in links if n in links[m]) for n in links}
    assert all(abs(got[n] - ranks[n]) < 1e-5 for n in links)


def test_reach_through_some_edges(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (2, 4, "a")], "src long, dst long, kind string")
    start = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.hops) for r in graph.reach(edges, start, 3, F.col("kind") == "a").collect()} == {(1, 0), (2, 1), (4, 2)}


def test_plugged_in_models(spark):
    from mnemospark.operators import models

    docs = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "abc")], "id int, text string")
    out, cache = models.embedded(docs, "id", "text", lambda ts: [[float(len(t))] for t in ts], "len")
    assert {r.id: r.embedding for r in out.collect()} == {1: [2.0], 2: [2.0], 3: None, 4: [3.0]} and cache.count() == 2
    more = docs.unionByName(spark.createDataFrame([(5, "q")], docs.schema))
    out, cache = models.embedded(more, "id", "text", lambda ts: [[-1.0] for _ in ts], "len", cache)
    assert {r.id: r.embedding for r in out.collect()} == {1: [2.0], 2: [2.0], 3: None, 4: [3.0], 5: [-1.0]} and cache.count() == 3
    said = spark.createDataFrame([(1, "Alice met friends of the Old Town club"), (2, None), (3, "妈妈今天在上海")], "id int, text string")
    got = {(r.id, r.text, r.label) for r in models.hybrid_mentions(said, "id", "text").collect()}
    assert (1, "Alice", "PERSON") in got and (3, "妈妈", "PERSON") in got and not any(i == 2 for i, *_ in got)
    only = models.hybrid_mentions(said, "id", "text", lambda ts: [[(0, len(t), "ALL", 0.99)] for t in ts]).collect()
    assert [r.text for r in only if r.id == 1] == ["Alice met friends of the Old Town club"] and all(r.label != "ALL" for r in only if r.id == 3)
