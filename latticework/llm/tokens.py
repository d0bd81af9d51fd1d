"""Sizes of texts in tokens of a byte-level vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only the driver needs this file; it is sent to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's own tokenizer cuts a text before merging bytes (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sent(spark: SparkSession, path: str) -> Callable:
    """A function for tasks that gives the vocabulary's encoding, from the copy that Spark sends to every executor."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: encoding(SparkFiles.get(name))


def token_counts(df: DataFrame, text: str, keep: Sequence[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """df's columns ``keep`` and n_tokens, the tokens of the whole text: 0 for a null or empty one.

    A narrow pass; texts go to Python in Arrow batches and only their sizes come back.
    """
    picked = df.select(*keep, F.col(text).alias("text_"))
    vocabulary_of = sent(df.sparkSession, vocabulary)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary_of().encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return picked.mapInArrow(run, f"{fields}, n_tokens bigint")
