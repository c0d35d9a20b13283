"""Packing of texts that hold a special token of the tokenizer."""

import zlib

import numpy as np
import pytest

from quillspark.llm import packing

TEXTS = ["abc <|endoftext|> def", "<|startoftext|>Abc def", "A<|endoftext|>b <|startoftext|><|endoftext|>", "abc <|ENDOFTEXT|> def", "abc <|endoftext| > def", "<|endoftext|>"]


@pytest.mark.parametrize("order", [1, -1])
def test_special_tokens(spark, order):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = TEXTS[::order]
    ids = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]
    assert 49407 in ids[texts.index(TEXTS[0])] and 49407 not in ids[texts.index(TEXTS[3])]
    got = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert sorted(tuple(r[:5]) for r in got) == [(i, 0, len(x), zlib.crc32(x.tobytes()), len(x)) for i, x in enumerate(ids)]
