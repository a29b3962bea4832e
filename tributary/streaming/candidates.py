"""Candidate look-up for a stream of S1 records against static sources (not a reference operator).

The sources' postings are written once, before the stream begins. Each micro-batch asks them for its own tokens, so it reads
the folders that hold these, not all sources. No state is needed: a record comes in one micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from tributary.operators.blocking import Blocks, prepare


def stream_candidates(s1_stream: DataFrame, targets: DataFrame, path: str, checkpoint: str, index: str, trigger: dict | None = None) -> StreamingQuery:
    """Write (s1_id, candidate_id) of every streamed record to ``path``; ``targets`` is prepared, their postings go to ``index``.

    A batch that is run again after a failure replaces its own rows, as they lie in a folder of its own.
    """

    Blocks.of(targets).write(index)

    def block(batch: DataFrame, number: int) -> None:
        Blocks.pairs(prepare(batch), batch.sparkSession, index).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = s1_stream.writeStream.foreachBatch(block).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
