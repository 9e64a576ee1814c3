import hashlib
import math
import random
import re

from mnemospark.llm import pii


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        s = sum((2 * int(c) - 9 * (2 * int(c) > 9)) if i % 2 else int(c) for i, c in enumerate(d[::-1]))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_patterns_match_brute_force():
    rng = random.Random(2)
    bits = ["a", "b.c", "@", "@x.y", ".", "1", "22", "255", "256", "+", "-", " ", "(", ")", "4111111111111111", "é", "\n", "1.2.3.4", "+1 (555) 010-2233", "x@y.zz"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t), t
    for t in ["1" * 100_000, "a" * 100_000 + "@b.c", "+1" + "(" * 100_000, "1." * 50_000, "a@" * 50_000, "1" * 5000 + ".1.1.1"]:
        pii.base_spans(t)


def docs():
    rng = random.Random(4)
    common = [f"common{chr(97 + i)}" for i in range(20)]
    out = []
    for i in range(60):
        words = [rng.choice(common) for _ in range(30)]
        if i % 10 == 0:
            words[15:15] = ["boss@castle.org", "Gamekeeper"]
            words[0:0] = ["gamekeeper", "user77x"]
        if i % 15 == 1:
            words[3:3] = ["+1 (555) 010-2233"]
        if i in (7, 10, 20, 30, 40):
            # told by most, but not all, texts of the entity, and by one without it
            words.append("Castellan" if i % 20 else "castellan9")
        if i == 33:
            words.append("user77x")
        out.append((i, " ".join(words), 5))
    return [*out, (100, None, 5), (100, "", 5), (None, "boss@castle.org gamekeeper", 5), (101, "x" * 100_000, 5), (59, out[59][1], 5), (102, "İİİ common boss@castle.orgtail abc1.2.3.4def", 5)]


def brute_terms(rows, generalise=pii.GENERALISE):
    texts = [t or "" for _, t, _ in rows]
    found = [brute_spans(t) for t in texts]
    words = [[m for m in re.finditer(r"[^\W_]{3,}", t) if not any(a < m.end() and m.start() < b for _, a, b in s)] for t, s in zip(texts, found, strict=True)]
    held = [{m[0].lower() for m in w} for w in words]
    entities = [{(k, t[a:b]) for k, a, b in s} for t, s in zip(texts, found, strict=True)]
    n, share = len(texts), {}
    for e in set().union(*entities):
        de = sum(e in x for x in entities)
        for w in set().union(*(h for h, x in zip(held, entities, strict=True) if e in x)):
            co = sum(w in h and e in x for h, x in zip(held, entities, strict=True))
            if co >= 3 and de < n:
                value = math.log(co * n / (sum(w in h for h in held) * de)) / -math.log(de / n)
                share[w] = max(share.get(w, -9), value)
    share = {w: x for w, x in share.items() if x >= generalise}
    return [s + sorted(("term", *m.span()) for m in w if m[0].lower() in share) for s, w in zip(found, words, strict=True)], share


def test_terms_match_brute_force(spark):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, __near2 int").repartition(4)
    want, share = brute_terms(rows)
    assert {"gamekeeper", "user77x"} <= share.keys() and share["user77x"] < pii.REMOVE <= share["gamekeeper"]
    got = sorted((str(r.doc_id), r.text or "", str([(s.kind, s.start, s.end) for s in r["__spans"]])) for r in pii.sanitise(df).collect())
    assert got == sorted((str(i), t or "", str(s)) for (i, t, _), s in zip(rows, want, strict=True))


def test_clean_text(spark):
    rows = docs()
    got = {r.doc_id: r["__clean"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()}
    assert got[2] == rows[2][1]
    assert "castle.org" not in got[0] and "[EMAIL]" in got[0] and "amekeeper" not in got[0]
    assert "[PHONE]" in got[1]
    # also where the entity itself doesn't stand
    assert "user77x" not in got[33] and "[NUMBER]" in got[33]
    assert pii.sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [pii.mark(w) for w in ("abc", "Abc", "Ab1")] == ["[WORD]", "[NAME]", "[NUMBER]"]


def test_few_terms_need_no_join(spark, monkeypatch):
    df = spark.createDataFrame(docs(), "doc_id long, text string, n int").repartition(4)
    shown = lambda: sorted((str(r.doc_id), str(r["__clean"]), str(r["__spans"])) for r in pii.sanitise(df).collect())
    with monkeypatch.context() as m:
        m.setattr(pii, "find", None)  # no table of texts, no second scan
        once = shown()
    monkeypatch.setattr(pii, "SENT", -1)
    assert once == shown()


def test_names_of_columns_are_kept(spark):
    rows = [(i, "write to me@here.org or askforjohn", "s", 1, 2, 3, 4, 5) for i in range(4)] + [(9, "plain", "s", 1, 2, 3, 4, 5)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, __spans string, __near int, __clean int, __row int, __terms int, `a.b` int")
    got = pii.sanitise(df, spans="s", clean="c")
    assert got.columns == [*df.columns, "s", "c"]
    assert sorted({(r.c, r["__spans"], r["__near"], r["__clean"], r["__row"], r["__terms"], r["a.b"]) for r in got.collect()}) == [("plain", "s", 1, 2, 3, 4, 5), ("write to [EMAIL] or ", "s", 1, 2, 3, 4, 5)] or "write" not in got.first().c
    assert pii.sanitise(df).columns == ["doc_id", "text", "__near", "__row", "__terms", "a.b", "__spans", "__clean"]


def test_query_digest(spark, tmp_path):
    from mnemospark.llm.queries import QUERIES

    spark.createDataFrame([(1, "mail a.b@c.de or 10.0.0.1"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    a, b = QUERIES["op3_pii"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (a.n_email, a.n_ip, a.n_card, a.n_phone, a.spans) == (1, 1, 0, 0, "email:5:13,ip:17:25")
    assert a.base_sha256 == hashlib.sha256(a.spans.encode()).hexdigest()
    assert (b.spans, b.base_sha256) == ("", hashlib.sha256(b"").hexdigest())
