"""Token counts with a public tokenizer; its vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Vocabulary of a public byte-level BPE as ranks.  It has to be at this path on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-tokenizer of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    """One encoder per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str = VOCABULARY):
    """Bytes of each token id."""
    import numpy as np

    enc = encoder(path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], dtype=np.int64)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens; null for null."""
    ship(SparkSession.active())

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count.asNondeterministic()(text)  # so that no optimiser rule evaluates it twice


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, no outer blanks, hyphens for underscores and inner blanks."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_]+", "-")
