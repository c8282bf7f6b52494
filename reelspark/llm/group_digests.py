"""SHA-256 of the comma-joined numbers of each group, in ascending order, without holding a group together.

Rows are sorted by range over all partitions, so a group may span many. Each task joins the numbers of a group that lies inside its
partition and digests them at once; of the first and the last group of a partition, and of long ones, it hands on pieces of at
most ``PIECE`` numbers, which one stream per group digests in order: SHA-256 is sequential by its definition, the stream holds one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import stored

PIECE = 1 << 15
PIECES = "node string, digest string, part long, seq long, text string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "digest", "part", "seq", "text"])


def _joined(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, node, seq, first = TaskContext.get().partitionId(), None, 0, True
        numbers: list[str] = []
        out: list[tuple] = []

        def piece(inside: bool) -> tuple:
            text = ",".join(numbers)
            whole = inside and seq == 0
            return node, hashlib.sha256(text.encode()).hexdigest() if whole else None, part, seq, None if whole else text

        for batch in batches:
            for key, number in zip(batch.column("node").to_pylist(), batch.column("number").to_pylist()):
                if key != node:
                    if node is not None:
                        out.append(piece(not first))
                        first = False
                    node, seq, numbers = key, 0, []
                elif len(numbers) == most:
                    out.append(piece(False))
                    seq, numbers = seq + 1, []
                numbers.append(str(number))
            yield _batch(out)
            out = []
        if node is not None:
            out.append(piece(False))
        yield _batch(out)

    return run


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    done: list[tuple] = []
    for batch in batches:
        for key, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
            if key != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_pylist([{"node": n, "digest": d} for n, d in done], pa.schema([("node", pa.string()), ("digest", pa.string())]))
        done = []
    if node is not None:
        yield pa.RecordBatch.from_pylist([{"node": node, "digest": state.hexdigest()}])


def digests(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node, digest) of ``rows`` (node string, number long); numbers are not null."""
    laid = rows.select("node", "number").repartitionByRange("node", "number").sortWithinPartitions("node", "number")
    pieces = stored(laid.mapInArrow(_joined(piece), PIECES), "digests")
    whole = pieces.filter("digest is not null").select("node", "digest")
    parts = pieces.filter("digest is null").select("node", "part", "seq", "text")
    streamed = parts.repartition("node").sortWithinPartitions("node", "part", "seq").mapInArrow(_digested, "node string, digest string")
    return whole.unionByName(streamed)
