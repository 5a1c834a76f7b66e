"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabulary lies by default; pass another path for another vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits a text before byte pairs are merged, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str):
    """The tokenizer of a rank file; one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = encoding(path)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        sizes = [None if t is None else len(own.encode_ordinary(t)) for t in texts]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sizes, pa.int64())], names=[*(batch.schema.names[i] for i in keep), "tokens"])


def with_tokens(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Replaces the column ``text`` by ``tokens``, its number of tokens; null stays null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text") + ", tokens long"
    return df.mapInArrow(lambda it: _count(it, path), schema)
