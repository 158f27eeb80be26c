"""Token counts of whole texts by rank-synchronous array merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import long_field, map_texts
from .bpe import cache


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``path`` is a word-end BPE file every executor can read.  The distinct
    chunks of a batch of texts are merged together as ragged arrays
    (:mod:`.bpe`); a text's count is the sum over its chunks.  No shuffle, and
    rows never meet, so a hot key cannot matter.

    A null or empty text has 0 bytes and 0 tokens.  Special strings inside a
    text count as one token each, as the library does by default.  Repeated
    rows, ties and null ids give one output row each; an empty table an empty
    result; columns besides doc_id and text are not read.
    """
    def count(texts: list[str], _) -> list[pa.Array]:
        known = cache(path)
        lists = known.chunked(texts)
        n = [sum(map(len, map(known.__getitem__, chunks))) // 4 for chunks in lists]
        return [pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_())]

    return map_texts(docs, ["doc_id"], count, [
        long_field("n_bytes"), long_field("n_tokens"), T.StructField("over_limit", T.BooleanType())])
