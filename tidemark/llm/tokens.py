"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = os.environ.get("TIDEMARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the vocabulary's public pre-tokenisation pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: str):
    """The encoder of a rank file, loaded once per worker process: it is kept on the library, as functions come by value."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_kept_encoders", {})
    if vocabulary not in kept:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[vocabulary]


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a whole text, 0 for null and empty ones. ``vocabulary`` is a path that every executor can read.
    Strings of special tokens are ordinary text."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(vocabulary).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
