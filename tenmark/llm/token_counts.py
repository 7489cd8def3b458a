"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts
from .wordbpe import segmenter


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id", limit: int = 2048) -> DataFrame:
    """Counts the tokens of every whole text with the vocabulary file ``vocabulary``.

    One narrow pass; nothing is shuffled. Returns the id, ``n_bytes``, ``n_tokens`` and ``over_limit``
    (more than ``limit`` tokens), one row for each input row. A null text counts as empty: 0 bytes, 0
    tokens. Null ids, repeated rows and any other columns are allowed; other columns are dropped.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(it):
        counts = segmenter(vocabulary).counts
        for b in it:
            found = texts(b.column(1))
            n = counts(found)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in found], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_column, docs[text].cast("string").alias("text")).mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
