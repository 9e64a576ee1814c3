import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemospark.llm import wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("alphabet", [1, 2, 3, 700, 49408])
def test_shard_answers(alphabet):
    rng = np.random.default_rng(alphabet)
    ids = rng.integers(0, alphabet, 200_000 if alphabet == 700 else 3000).astype("<u2")
    shard = wavelet.Shard(wavelet.build([5, None], np.asarray([len(ids) - 1, 1]), ids))
    assert (shard.tokens() == ids).all() and shard.doc_ids == [5, None]
    for i in rng.integers(0, len(ids), 20).tolist():
        t = int(ids[i])
        where = np.flatnonzero(ids == t)
        assert shard.access(i) == t
        assert shard.rank(t, i) == (where < i).sum()
        assert shard.select(t, len(where) - 1) == where[-1]
    assert shard.rank(alphabet, 10) == 0
    with pytest.raises(IndexError):
        shard.select(alphabet, 0)


def test_files_match_the_library(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "betas", "x,", "ünï"]) for _ in range(rng.randint(0, 40))), "e") for i in rng.sample(range(1000), 80)]
    rows += [(2000, None, "e"), (2001, "", "e"), (None, "null id", "e"), (2002, "word " * 20_000, "e"), (7000, "same", "e"), (7000, "same", "e")]
    t = Tokenizer.from_file(PATH)
    want, start = [], 0
    for i, x, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    files = wavelet.write_shards(df, PATH, limit=500)
    assert files.count() > 3
    assert sorted(map(tuple, wavelet.read_shards(files).collect()), key=lambda r: r[1]) == want


def test_empty_table(spark):
    assert wavelet.read_shards(wavelet.write_shards(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0
