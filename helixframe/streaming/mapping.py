"""Mapping of reads as they arrive.

Each micro-batch is mapped by the batch plan and written to a folder named after its id, which a batch that is run again after a
failure replaces: every read is placed once. References and their index are static tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.mapping import map_reads


def map_stream(reads: DataFrame, refs: DataFrame, ix: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Start mapping a stream of (read_id, mate, qname, seq, qual); placements go to ``out``/batch=N as Parquet.

    ``checkpoint`` and ``out`` are folders that the driver and all executors share. ``trigger`` as of writeStream, by default all that
    is there, then an end. ``options`` go to :func:`map_reads`. An empty batch gives an empty folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        map_reads(batch, refs, ix, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
