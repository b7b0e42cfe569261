"""Cost-balanced packing of token ids into sequences of bounded length.

The cost of a piece is estimated as linear plus quadratic (attention) in its length. Documents are dealt in blocks of bounded
size, each block within one task. In a block, whole sequences are cut from long documents; what remains is placed in
order of descending cost, each piece into the lowest-cost sequence that has room; pieces that fit nowhere are cut over the room
that is left, so that every sequence is full but for less than ``grain`` ids a block. There is no exchange, and a
retried task numbers its sequences as before, since its rows and their order are those of its input split.

With ``in_order`` a block holds documents that were written one after the other, to one file, and its sequences carry the ``place`` of its first document:
sequences read by place are then trained in the order in which an earlier stage wrote the documents, to within a block.

Defined results: null text counts as empty, and an empty document is just its end id; null ids and repeated rows are documents
of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .tokens import chunk_table

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def capacities(total: int, size: int, grain: int) -> np.ndarray:
    """Room of the sequences for ``total`` ids: full ones, then powers of two for the rest, the last rounded up to ``grain``."""
    rest = -(-(total % size) // grain) * grain
    tail = []
    bit = size
    while rest and bit >= grain:
        if rest >= bit:
            tail.append(bit)
            rest -= bit
        bit //= 2
    return np.array([size] * (total // size) + tail, np.int64)


def place(lengths: np.ndarray, size: int, grain: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int]], np.ndarray, int]:
    """Pieces (item, start in item, length, sequence) in order of placement, cost of each sequence, number of sequences."""
    total = int(lengths.sum())
    room = capacities(total, size, grain)
    cost = np.zeros(len(room))
    out: list[tuple[int, int, int, int]] = []
    later: list[int] = []
    big = np.inf
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        if not n:
            continue
        open_cost = np.where(room >= n, cost, big)
        s = int(open_cost.argmin())
        if open_cost[s] == big:
            later.append(int(i))
            continue
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
        out.append((int(i), 0, n, s))
    for i in later:
        at, n = 0, int(lengths[i])
        while at < n:
            # the largest room first: fewest cuts
            s = int(room.argmax())
            take = min(int(room[s]), n - at)
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            out.append((i, at, take, s))
            at += take
    return out, cost, len(room)


def pack_block(ids: list[bytes], size: int, grain: int, linear: float, quadratic: float) -> Iterator[tuple[int, int, int, int, int, int, float]]:
    """(document, start, length, crc32, sequence, offset, sequence's cost) of a block's documents; ids are 4 bytes each."""
    n = np.array([len(x) // 4 for x in ids], np.int64)
    seq = 0
    full_cost = linear * size + quadratic * size * size
    for d, x in enumerate(ids):
        for start in range(0, int(n[d]) // size * size, size):
            yield d, start, size, zlib.crc32(x[4 * start : 4 * (start + size)]), seq, 0, full_cost
            seq += 1
    base = n // size * size
    pieces, cost, _ = place(n - base, size, grain, linear, quadratic)
    fill = np.zeros(len(cost), np.int64)
    for d, at, length, s in pieces:
        start = int(base[d]) + at
        yield d, start, length, zlib.crc32(ids[d][4 * start : 4 * (start + length)]), seq + s, int(fill[s]), float(cost[s])
        fill[s] += length


#: Bits of a place that number rows within a file.
ROW_BITS = 36


def as_written(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, place) of documents read from Parquet files that Spark wrote; place is their order: part, file of the part, row.

    Null where rows don't come from such files.
    """
    try:
        d = docs.select(F.col(id_col), F.col(text_col), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return tidy(docs, id_col, text_col).withColumn("place", F.lit(None).cast("long"))
    number = lambda pattern: F.regexp_extract("_file", pattern, 1).cast("long")
    file = F.shiftleft(number(r"part-(\d+)"), 6) + F.least(F.lit(63), F.coalesce(number(r"-c(\d+)\."), F.lit(0)))
    place = F.when(F.col("_file").rlike(r"^part-\d+"), F.shiftleft(file, ROW_BITS) + F.col("_row"))
    return d.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), place.alias("place"))


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, grain: int = 32, linear: float = 1.0, quadratic: float = 1.0 / 4096, block_ids: int = 1 << 22, in_order: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. ``block_ids``: ids a task holds at once (a longer document is a block of its own).

    With ``in_order`` there is a column ``place``; to be read by (place, sequence_id, offset).
    """
    if size & (size - 1) or grain & (grain - 1) or grain > size:
        raise ValueError("size and grain are powers of two, grain at most size")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(path)
        first = TaskContext.get().partitionId() << 40
        keys: list = []
        ids: list[bytes] = []
        held = 0
        start = file = None

        def flush() -> pa.RecordBatch:
            nonlocal first, keys, ids, held
            rows = list(pack_block(ids, size, grain, linear, quadratic))
            d, begin, length, crc, seq, off, cost = zip(*rows, strict=True)
            columns = [pa.array([keys[i] for i in d], pa.int64()), *(pa.array(x, pa.int64()) for x in (begin, length, crc, [len(ids[i]) // 4 for i in d], [first + s for s in seq], off)), pa.array(cost, pa.float64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
            if in_order:
                columns, names = [*columns, pa.array([start] * len(d), pa.int64())], [*names, "place"]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            first += max(seq) + 1
            keys, ids, held = [], [], 0
            return out

        for b in batches:
            places = b.column(2).to_pylist() if in_order else [None] * b.num_rows
            for k, t, place in zip(b.column(0).to_pylist(), b.column(1), places, strict=True):
                own = None if place is None else place >> ROW_BITS
                if keys and own != file:
                    yield flush()
                if not keys:
                    start, file = place, own
                x = table.encode(t.as_py()) + end
                keys.append(k)
                ids.append(x)
                held += len(x) // 4
                if held >= block_ids:
                    yield flush()
        if keys:
            yield flush()

    if in_order:
        return as_written(docs, id_col, text_col).mapInArrow(run, f"{OUT}, place long")
    return tidy(docs, id_col, text_col).mapInArrow(run, OUT)
