"""Token counts of texts by a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.runtime import worker_cache

#: Vocabulary file (token ranks) of a public byte-level tokenizer; a parameter of every operator here.
VOCABULARY = os.environ.get("TOKENIZER_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Splitting pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(path: str):
    """The tokenizer of a vocabulary file, loaded once for each Python worker."""
    cache = worker_cache()
    if ("bpe", path) not in cache:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        cache["bpe", path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache["bpe", path]


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; a null or empty text has none. Lone surrogates count as replacement characters."""
    enc = encoder(path)
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, and n_tokens of each document; a narrow step that ships no text on. The vocabulary is
    sent along with the job, for workers that don't have it at its path."""
    if os.path.exists(vocabulary):
        documents.sparkSession.sparkContext.addFile(vocabulary)
    docs = documents.select("doc_id", *keep, F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array(count_tokens(b.column(b.num_columns - 1).to_pylist(), vocabulary), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*b.schema.names[:-1], "n_tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes[:-1])
    return docs.mapInArrow(run, f"{schema}, n_tokens long")
