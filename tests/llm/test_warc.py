import hashlib

import pytest

from mnemospark.llm import warc
from mnemospark.llm.files import read_file

LONG = "<p>é" + "x" * 1000


def rows():
    out = [(i, f"http://e/{i}", LONG) for i in (3, 9, 4)] + [(1, "u", "short"), (2, "u", "short"), (5, None, None), (6, "bad\r\nX: y", ""), (None, "n", LONG)]
    out += [(9, "http://e/9", LONG), (20, "z", "y" * 996 + "é"), (21, "z", "y" * 996 + "é"), (22, "z", "y" * 998 + "é"), (23, "z", "y" * 998 + "é"), (None, "a", "q" * 2000), (None, "b", "q" * 2000), (30, "big", "b" * 3_000_000)]
    return [(*r, "extra") for r in out]


def brute(data):
    best = {}
    for i, _, h, _ in data:
        if len((h or "").encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h, _ in data:
        p = (h or "").encode()
        revisit = h in best and best[h] != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", best[h] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, digest string")
    files = warc.write_archives(df)
    got = warc.read_archives(files)
    assert sorted((tuple(r[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()), key=str) == brute(rows())
    assert sum(r.n_records for r in files.collect()) == len(rows())
    assert "bad%0D%0AX:%20y" in {r.url for r in got.collect()}
    stored = [p for f in files.collect() for h, _, p in warc.records(read_file(f.path)) if h["WARC-Type"] == "revisit"]
    assert stored and not any(stored)


def test_damage_is_seen(spark):
    df = spark.createDataFrame([(1, "u", "short", "")], "page_id long, url string, html string, x string")
    data = read_file(warc.write_archives(df).first().path)
    with pytest.raises(ValueError):
        list(warc.records(data[:-20]))


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
