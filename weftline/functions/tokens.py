"""Exact token counts by a byte-pair vocabulary, where its file is at hand."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import token_estimate

#: How texts are split before pairs are merged, unless a vocabulary has its own pattern.
PATTERN = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""


def exact_tokens(text: Column | str, ranks: str | None, pattern: str = PATTERN) -> Column:
    """Tokens of a text by a file of ranks that every executor has; the estimate by characters where there is none."""
    if not ranks or not os.path.exists(ranks):
        return token_estimate(text)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        with open(ranks) as f:
            table = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        return texts.map(lambda t: len(encoding.encode_ordinary(t or "")))

    return count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
