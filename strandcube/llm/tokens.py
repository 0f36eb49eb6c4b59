"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcube.session import spread

#: Vocabulary file; a parameter of every operator that counts tokens.
TOKENIZER = os.environ.get("STRANDCUBE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Fixed value: the usual splitting pattern of byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def load(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in ``out`` instead of the text; NULL and empty texts have 0.

    Whole texts are counted; strings of special tokens are ordinary text.
    """
    keep = [c for c in df.columns if c not in (text, out)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load(tokenizer)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["__text"]]
            yield pdf.drop(columns="__text").assign(__n=pd.Series(n, index=pdf.index, dtype="int64"))

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["__n bigint"])
    rows = spread(df.select(*keep, F.col(text).alias("__text")))
    return rows.mapInPandas(count, schema).withColumnRenamed("__n", out)
