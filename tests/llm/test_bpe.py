import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemospark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.Vocabulary(PATH)
ODD = ["", " \n\t", "\x1cab\x1db c", "a\x85b", "ΑΣ ΣΑΣ", "İstanbul", "éa", "a<|endoftext|>b<|EndOfText|>", "<|startoftext|> x", "it's DON'T 'Sun can'tt",
       "x​b", "１２³Ⅷ", "K Å ẞ ﬁ", "x" * 5000, "ab" * 3000, "!?!" * 2000, "日本語 текст", "́ a", "hello, world. (x) a_b 12.5%", "𝔘𝔫𝔦 👩‍👧"]


def wanted(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def mine(e, text):
    return [int.from_bytes(x, "little") for x in zip(*[iter(e.encode(text))] * 2)]


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text(alphabet="aAbé'st <|>endofxt,.19́\x1c\xa0Σ"))
def test_same_ids_as_the_library(text):
    assert mine(bpe.Encoder(VOCABULARY), text) == wanted(text)[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBzéßÿ'sdmltİŉ 1²ª,.!?;-()@\n\t\xb5") | st.lists(st.sampled_from(["word", "Word,", "x" * 31, "y" * 33, "zé" * 20, "q" * 60, "it's", "3.14", "a@b.c", "end."])).map(" ".join)))
def test_whole_texts_at_once(texts):
    e = bpe.Encoder(VOCABULARY)
    for _ in range(2):  # new pieces, then remembered ones
        assert [list(memoryview(x).cast("H")) for x in e.encode_all(texts)] == [wanted(t)[0] for t in texts]


def test_every_low_character_before_a_mark():
    e = bpe.Encoder(VOCABULARY)
    texts = [f"{a}{chr(c)}{m}{b}" for c in range(0x260) for a in ("", "x") for m in ".," for b in ("", "y", ".")]
    got = e.encode_all(texts)
    for t, x in zip(texts, got, strict=True):
        assert list(memoryview(x).cast("H")) == wanted(t)[0], repr(t)
        assert list(memoryview(e.encode(t)).cast("H")) == wanted(t)[0], repr(t)


def test_many_words_at_once():
    import random

    rng = random.Random(7)
    words = ["".join(rng.choice(["th", "e", "ing", "q", "é", "ß", "an", "x"]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert VOCABULARY.merge_all(words) == [b"".join(bpe._PACKED[i] for i in VOCABULARY.merge(w)) for w in words]
    assert VOCABULARY.merge_all([]) == []


def test_lexicon_is_exact_and_shares_suffixes(tmp_path):
    words = {w: VOCABULARY.merge(w) for w in ["working", "walking", "talking", "talk", "worked", "é", "élan", "a"]}
    (tmp_path / "l").write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(tmp_path / "l"))
    for w, ids in words.items():
        assert lexicon.find(w) == b"".join(bpe._PACKED[i] for i in ids)
    for w in ["", "wor", "talkin", "walkings", "z", "è"]:
        assert lexicon.find(w) is None
    assert len(lexicon.finals) < sum(map(len, words))
    (tmp_path / "e").write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(tmp_path / "e")).find("a") is None


def test_round_trip_on_frames(spark):
    texts = [*ODD, None, *ODD[:2]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r for r in bpe.encode_decode(df, PATH).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids, decoded = wanted(t)
        assert (rows[i].ids, rows[i].decoded, rows[i].n_tokens) == (ids, decoded, len(ids))
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_summary_keeps_heavy_words():
    from collections import Counter

    c = Counter({f"r{i}": 1 for i in range(1000)} | {"the": 500, "of": 300})
    kept = bpe._reduce(c, 10)
    assert len(kept) <= 10 and kept["the"] == 499 and kept["of"] == 299


def test_lexicon_holds_the_most_counted_words(spark, monkeypatch):
    texts = ["the the the the of of of a a b c d", "the of a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    seen = {}
    monkeypatch.setattr(bpe, "compile_lexicon", lambda words: seen.update(words) or b"LEX1")
    for size, want in ((1, {"the"}), (2, {"the", "of"}), (3, {"the", "of", "a"}), (100, {"the", "of", "a", "b", "c", "d"})):
        seen.clear()
        bpe.deliver_lexicon(df, PATH, size=size)
        assert set(seen) == want
