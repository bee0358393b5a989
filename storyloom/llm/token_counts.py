"""Token counts by the whole-token shortcut (operator 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import encoders
from .common import kept, map_text

LIMIT = 4096


def count(
    docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` of each row's whole text.

    Strings of the vocabulary that the library encodes alone as one token count 1 without any
    merge (see ``encoders.Pieces``); the rest is merged by the library, once for each distinct
    string in a worker's memo. A null or empty text has 0 bytes and 0 tokens; a very long one is
    counted whole, in a slice of its own. Rows are kept as they are, repeated ones and null ids
    too; columns other than the id are left out, whatever their names. There is no shuffle.
    """

    # The proof is made once, here; it holds a part of the vocabulary, so its broadcast is bounded.
    single = docs.sparkSession.sparkContext.broadcast(encoders.single_tokens(vocabulary))

    def function():
        counter = kept((encoders.Pieces, vocabulary), lambda: encoders.Pieces(vocabulary, single.value))
        return lambda texts: ([len(t.encode()) if t else 0 for t in texts], counter.count(texts))

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    counted = map_text(docs, function, fields, text_col, [id_col])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
