"""Token counts of texts with a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from viewlake.session import spread

#: Setting of a session with the path of the rank file.
SETTING = "spark.viewlake.vocabulary"
#: Rank file of a byte-level BPE; a parameter everywhere, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern published with that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(vocabulary: str, pattern: str):
    """Loaded once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, *, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``df`` without its text column and with n_tokens (bigint); a null or empty text has 0 tokens. Whole texts are encoded. ``vocabulary`` defaults to the session's SETTING, and that to VOCABULARY."""
    vocabulary = vocabulary or df.sparkSession.conf.get(SETTING, VOCABULARY)
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(vocabulary, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            counts = np.fromiter((len(own.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in texts)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(counts)], names=[*keep, "n_tokens"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "n_tokens bigint"])
    return spread(df.select(*keep, text)).mapInArrow(run, schema)
