"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a path on every machine.
TOKENIZERS = "/opt/tokenizers"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The byte-level BPE of a rank file."""
    import base64

    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | None, path: str) -> int:
    """Tokens of a text; null has none."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


def with_tokens(docs: DataFrame, text: str, column: str, tokenizer: str = "byte_bpe_multi_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``docs`` with ``column``, the number of tokens of ``text``; a null or empty text has 0. Whole texts are encoded."""
    path = f"{folder}/{tokenizer}"

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: n_tokens(t, path))

    return docs.withColumn(column, count(F.col(text)))
