"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of vocabulary files on every machine, and the file to use; byte-level BPE for many languages.
TOKENIZER_DIR = os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
# --- fixed values: how the vocabulary's tokenizer cuts a text before it merges bytes
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# --------------------------------------------------------------------------


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    import tiktoken

    with open(path, encoding="ascii") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def count(text: str, encode: Callable[[str], list[int]]) -> int:
    """Tokens of ``text``, taken whole: cuts would split tokens at the seams."""
    return len(encode(text))


def token_counts(docs: DataFrame, text: str = "text", folder: str | None = None, name: str = TOKENIZER) -> DataFrame:
    """``docs`` without ``text``, with ``tokens``; null and empty texts have 0."""
    path = os.path.join(folder or TOKENIZER_DIR, name)
    kept = [f for f in docs.schema.fields if f.name not in (text, "tokens")]
    cols = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            n = [count(t, encode) if t else 0 for t in b.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(cols))), pa.array(n, pa.int64())], names=[*cols, "tokens"])

    from pyspark.sql import types as T

    return docs.select(*cols, text).mapInArrow(run, T.StructType([*kept, T.StructField("tokens", T.LongType())]))
