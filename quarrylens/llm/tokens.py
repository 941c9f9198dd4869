"""Token counts of a public byte-pair vocabulary; its file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Folder of the vocabulary files on every node; the files are not part of this repository.
TOKENIZER_DIR = os.environ.get("QUARRYLENS_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the pre-splitting pattern that belongs to this public vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a .tiktoken rank file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> list[int]:
    return encoder(path).encode_ordinary(text)


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                 vocabulary: str | None = None) -> DataFrame:
    """`id_col`, the `keep` columns and n_tokens of each row; null texts have 0 tokens."""
    path = vocabulary or os.path.join(TOKENIZER_DIR, VOCABULARY)

    slim = documents.select(id_col, *keep, F.col(text_col).alias("_text"))
    kinds = dict(slim.dtypes)
    names = [id_col, *keep]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in batch["_text"]]
            yield batch[names].assign(n_tokens=n)

    return slim.mapInPandas(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "n_tokens long"]))
