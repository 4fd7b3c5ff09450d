import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tilespan.llm import byte_bpe


def plain(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.RANKS), "rb"))}
    ids = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 1024), (40, 12), (7, 5)])
def test_encode_decode(spark, chunk, overlap):
    rng = random.Random(3)
    bits = ["it's ", "we'll", "'re", "   ", "\n\n", "12345", "ñandú ", "語", "🙂", "!!!", " '", "a" * 30, " ", "\t x", "é", "<|endoftext|>"]
    texts = [None, "", " ", "a", "x" * 200, " " * 100, "'" * 50, "word " * 40] + ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(40)]
    rows = [(i, t, "extra", 1) for i, t in enumerate(texts)] + [(7, "word " * 40, "again", 2), (None, "no id " * 20, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, rid int")
    got = sorted(map(repr, (tuple(r) for r in byte_bpe.encode_decode(docs, chunk=chunk, overlap=overlap).collect())))
    assert got == sorted(repr((d, *plain(t))) for d, t, *_ in rows)
    assert byte_bpe.encode_decode(docs.limit(0)).count() == 0
