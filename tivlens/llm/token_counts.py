"""Token counts without token ids.

A text's pre-tokens are counted, each distinct pre-token's pieces are counted once by the
library, and the document's frequencies are joined with those counts and summed. The join
is made inside the tasks: a worker keeps the counts of the pre-tokens it has met in a bounded
dictionary, so only texts go in and one number per row comes out, and nothing is shuffled.
A shuffled join of (document, pre-token, frequency) rows would move several times the input.

Exact for piece models whose merges never cross a space marker (checked by ``pieces``).

Defined cases: null text counts as empty, with 0 bytes and 0 tokens; rows that repeat are
counted each; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tivlens.llm.piece_codec import model_bytes
from tivlens.llm.pieces import MARK, as_text, encoder, pretokens, processor

MEMORY = 400_000  # pre-tokens a worker remembers
LONGEST = 64  # code points of a remembered pre-token


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row."""
    model = model_bytes(model_path)
    encoder(model)  # refuses models that this split doesn't hold for
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = processor(model).encode
        counts = {MARK: 1}  # a lone marker is the one pre-token that no text of its own encodes to
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py()
                freq = Counter(pretokens(text))
                new = [t for t in freq if t not in counts]
                fresh = dict(zip(new, map(len, encode([as_text(t) for t in new], num_threads=1)), strict=True)) \
                    if new else {}
                n_tokens.append(sum(n * (counts[t] if t in counts else fresh[t]) for t, n in freq.items()))
                n_bytes.append(len(text.encode()))
                if len(counts) + len(fresh) > MEMORY:
                    counts = {MARK: 1}
                counts.update((t, n) for t, n in fresh.items() if len(t) <= LONGEST)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
