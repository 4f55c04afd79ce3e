"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level BPE vocabulary as ranks; the path is a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_LOADED: dict[str, object] = {}


def encoding(path: str = VOCABULARY, pattern: str | None = None):
    """The tokenizer of a rank file, loaded once per worker process."""
    if path not in _LOADED:
        import tiktoken

        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            at = b.schema.get_field_index("_text")
            sizes = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(at).to_pylist()]
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(sizes, pa.int64())], names=[*(b.schema.names[i] for i in keep), "tokens"])

    return count


def token_counts(docs: DataFrame, columns: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The named columns and ``tokens`` BIGINT, the size of the whole text; null and empty texts have 0 tokens."""
    rows = docs.select(*columns, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(_counter(path), f"{kinds}, tokens long")
