"""Row-level rules on a stream of portfolio records.

The rules that look at one record only need no
state, so the same expressions run unchanged on ``readStream``; rules about
groups, totals or polygons stay with the batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tivlens.operators.detect import References, row_flags
from tivlens.operators.rules import local_rules


def flag_stream(records: DataFrame, refs: References) -> DataFrame:
    """Findings of the row-level rules and the frozen thresholds."""
    only = set(local_rules(refs.as_of_year)) | {"X-005", "X-007", "P-001"}
    return row_flags(records, refs, only)


def write_flags(flags: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append findings to a parquet table, exactly once, until the input is used up."""
    return (
        flags.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
