"""Token counts of whole texts without their ids: distinct pre-tokens, their piece counts, a join, a sum.

Within each slice of texts (about 8 MB) the pre-tokens are dictionary-encoded: that gives every distinct
pre-token once and, as codes, each text's occurrences. sentencepiece counts the pieces of each distinct pre-token
once (a bounded table in the worker keeps them from slice to slice), the counts are joined to the codes by
position, and summed by text. The join stays in the slice, because over the whole corpus it would shuffle one row for
each text and distinct pre-token: two thirds of all words in invented prose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_slices
from .pretokens import Cache, split

_counters: dict[str, Cache] = {}


def _counter(model: str) -> Cache:
    if model not in _counters:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model)

        def count(words: list[str]) -> list[int]:
            # the library puts one blank before a text: it stands for the first blank of a pre-token, or counts as one piece before a line feed
            texts = [w[1:] if w[:1] == " " else w for w in words]
            sizes = map(len, own.encode(texts, num_threads=1))
            return [0 if w == "" else 1 if w == " " else n if w[0] == " " else n - 1 for w, n in zip(words, sizes, strict=True)]

        _counters[model] = Cache(count)
    return _counters[model]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    A null text is the empty text, of 0 tokens. Rows without a ``doc_id``, repeated rows and further columns don't matter.
    """

    def make():
        cache = _counter(model)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, offsets, words = split(batch.column("text"), "piece")
            pieces = np.fromiter(cache.get(words), np.int64, len(words))
            sums = np.concatenate([[0], np.cumsum(pieces[codes])])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(batch.column("text")).cast(pa.int64()), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])], ["doc_id", "n_bytes", "n_tokens"])

        return run

    return map_slices(id_and_text(docs), make, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
