"""Token counts by the whole-token shortcut (operator 6).

Pre-tokens which the vocabulary proves to be one token are counted directly;
only the rest is merged, each distinct pre-token once per worker.  No shuffle:
one pass over the text column, which never leaves Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row.

    tokenizer: path of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file.
    Null text counts as empty: 0 bytes, 0 tokens (a tokenizer that gives ids for
    an empty text keeps them).  Null ids and repeated rows give a row each, an
    empty table gives none; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import bpe

        tok = bpe.load(tokenizer)
        for batch in batches:
            sizes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in bpe.blocks(batch.column(1)):
                sizes.append(np.diff(offsets))
                counts.append(tok.counts(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(counts))], ["doc_id", "n_bytes", "n_tokens"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
