"""Token counts of texts with public byte-level BPE vocabularies, which are read from a path given as a parameter."""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.arrow import map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def with_tokens(docs: DataFrame, columns: list[str], text_col: str = "text", path: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The named columns of docs and each text's number of tokens (null texts: 0)."""
    source = docs.select(*[F.col(f"`{c}`").alias(f"_{i}_") for i, c in enumerate(columns)], F.col(f"`{text_col}`").cast("string").alias("_text_"))
    fields = [*(source.schema[f"_{i}_"] for i in range(len(columns))), T.StructField("_count_", T.LongType())]

    kept = len(columns)

    def run(batch: pa.RecordBatch) -> dict:
        made = [count(t.as_py(), path) for t in batch.column(kept)]
        return {f"_{i}_": batch.column(i) for i in range(kept)} | {"_count_": made}

    return map_batches(source, run, fields).toDF(*columns, name)
