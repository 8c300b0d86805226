"""Sentence vectors are made slab by slab, and are those of a plain dictionary of n-grams."""

import hashlib

import numpy as np

from ragweave.config import ChunkConfig
from ragweave.operators import chunking


def plain(sentences, cfg):
    out = np.zeros((len(sentences), cfg.dimensions))
    for row, s in enumerate("".join(s.casefold().split()) for s in sentences):
        for n in range(cfg.ngram_low, cfg.ngram_high + 1):
            for i in range(len(s) - n + 1):
                out[row, int.from_bytes(hashlib.blake2b(s[i : i + n].encode(), digest_size=8).digest(), "big") % cfg.dimensions] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def test_hashed_ngrams():
    many = ["".join(map(chr, range(k, k + 900))) for k in range(0x4E00, 0x7000, 900)]  # more characters than places
    odd = ["", "a", "ab", "abc", "ẞtraße İ", "日本語の文 字", "  ", "x" * 3000, "😀😃😄 😀", "the cat sat on the mat"]
    for cfg in (ChunkConfig(), ChunkConfig(ngram_low=1, ngram_high=7), ChunkConfig(dimensions=31)):
        model = chunking.HashedNgrams(cfg)
        for some in (odd, odd + many, [*many[:4], "abc"], [*many[4:8], "abc"], []):
            assert np.array_equal(model(some), plain(some, cfg))


def test_similarities_by_slab(spark):
    def embed(sentences):
        assert len(sentences) <= 1024 and (len(sentences) == 1 or sum(map(len, sentences)) <= 1 << 18), len(sentences)
        return chunking.HashedNgrams()(sentences)

    lists = [[], ["one alone"], None, [f"sentence {k % 7} of {k % 11}" for k in range(3000)], ["x" * 300_000, "x" * 5, ""], ["a b c d", "a b c d"]]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, s array<string>").coalesce(1)
    got = {r["id"]: r["near"] for r in df.select("id", chunking.similarities(embed)("s").alias("near")).collect()}
    for i, s in enumerate(lists):
        assert got[i] == (None if s is None else chunking.next_to(chunking.HashedNgrams()(s)).tolist() if s else [])
