"""Sizes of texts in tokens of a public byte-level BPE vocabulary, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("FOLIOFORGE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The published pre-tokenisation pattern of that vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer, loaded once a worker process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text: null for null, 0 for empty."""

    @F.pandas_udf("int")
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in it:
            yield pd.Series([None if x is None else len(enc.encode_ordinary(x)) for x in s], dtype="Int32")

    return count(text)
