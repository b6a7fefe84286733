"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql import functions as F

#: Where the vocabulary (token in base64, rank) is if no path is given.  It must be there on every executor.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how text is cut before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(ranks_path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, ranks_path: str = RANKS) -> Column:
    """Tokens of a text; 0 for NULL and empty ones.  Strings of special tokens count as ordinary text."""

    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(ranks_path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return F.pandas_udf(count, T.LongType())(text)
