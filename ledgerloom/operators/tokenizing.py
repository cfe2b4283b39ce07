"""Texts to tokens of a vocabulary file and back, in Arrow batches; the file is read once a task.

The path is a parameter; every executor must be able to read it. Null stays null, an empty text has no tokens, and
strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=4)
def tokenizer(path: str = DEFAULT_FILE):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def encoded(c: Column, path: str = DEFAULT_FILE) -> Column:
    """Numbers of a text's tokens."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        out = pd.Series([None] * len(texts), dtype=object)
        for i, e in zip(known.nonzero()[0].tolist(), tokenizer(path).encode_batch(texts[known].tolist(), add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    return encode(c)


def decoded(c: Column, path: str = DEFAULT_FILE) -> Column:
    """Text of a list of tokens."""

    @F.pandas_udf("string")
    def decode(lists: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return pd.Series([None if x is None else t.decode([int(i) for i in x], skip_special_tokens=False) for x in lists], dtype=object)

    return decode(c)
