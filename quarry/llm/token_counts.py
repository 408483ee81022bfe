"""Token counts of whole texts: Arrow batches, cut at safe boundaries by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import words


def token_counts(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every row of ``df``.

    Only lengths leave the workers. A null or empty text has 0 bytes and 0
    tokens; null ids stay null; repeated rows give repeated results; an empty
    table gives an empty table. Other columns are not read.

    The plan is one scan and one Arrow function: no shuffle, so no key can be
    hot. Inside a batch the work is cut into pieces of about 16 MB of bytes,
    whatever the number or the length of its texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = words.text_bytes(batch.column(1))
            n, _ = words.encoded(batch.column(1), tokenizer, keep_ids=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
