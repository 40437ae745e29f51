"""Blocks of documents, and the exchange of hashes between them.

A block is a bounded number of text bytes of one input partition, packed into
one row and written once to the shared folder, bucketed by block number. Later
passes meet a block with what the others know about its hashes without
shuffling texts again.

A block sends each hash once. Hashes are dealt by range to parts; what a block
sends to a part is one row of sorted, difference-coded hashes, so there are at
most as many rows as hashes, and a hash that every document has costs a few
bytes a block. The answer holds no hashes: values in the order in which the
block has sent its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrowtext import by_bytes
from .common import Shelf, partitions

#: Text bytes of a block; a longer text is one by itself.
BLOCK_BYTES = 8 << 20
#: Spark's own bound on the buckets of a table.
MOST_BUCKETS = 100_000
#: The block number of rows that carry sums instead of answers.
NOBODY = -1


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers of one length as compressed byte planes."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(b"".join(planes), asbytes=True)


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n, widths = int.from_bytes(blob[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], n * sum(widths)), np.uint8)
    out, at = [], 0
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted hashes as differences; ``np.cumsum`` undoes it."""
    return np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each stands first in some order, and the number of each entry's key."""
    order = np.argsort(keys)
    in_order = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = in_order[1:] != in_order[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(first) - 1
    return in_order[first], order[first], number


SENT = "part int, block long, blob binary"
ANSWER = "block long, part int, blob binary, sums array<long>"


def sent(block: int, parts: int, keys: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """A row for each part that gets some of the sorted ``keys``, with the columns beside them."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    cuts = np.r_[0, np.searchsorted(keys, bounds), len(keys)]
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    blobs = [packed(steps(keys[a:b]), *(c[a:b] for c in columns)) for a, b in zip(cuts[full], cuts[full + 1], strict=True)]
    return sent_rows(full.tolist(), block, blobs)


def sent_rows(parts: list[int], block: int, blobs: list[bytes]) -> pa.Table:
    return pa.table({"part": pa.array(parts, pa.int32()), "block": pa.array([block] * len(parts), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def arrived(rows: pa.Table, *kinds: type) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Of one part: the block of each row, how many hashes it has, and all hashes and columns one after the other."""
    found = [unpacked(x.as_buffer().to_pybytes(), np.uint64, *kinds) for x in rows.column("blob")]
    for x in found:
        x[0] = np.cumsum(x[0], dtype=np.uint64)
    columns = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, k) for i, k in enumerate((np.uint64, *kinds))]
    return rows.column("block").to_pylist(), [len(x[0]) for x in found], columns


def answers(part: int, blocks: list[int], sizes: list[int], values: np.ndarray, sums: np.ndarray | None = None) -> pa.Table:
    """The values given back to each block, and a row of sums."""
    cuts = np.cumsum([0, *sizes])
    blobs = [packed(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    own = [None] * len(blocks)
    if sums is not None:
        blocks, blobs, own = [*blocks, NOBODY], [*blobs, None], [*own, sums.tolist()]
    return pa.table({
        "block": pa.array(blocks, pa.int64()), "part": pa.array([part] * len(blocks), pa.int32()), "blob": pa.array(blobs, pa.binary()), "sums": pa.array(own, pa.list_(pa.int64())),
    })


def answered(rows: pa.Table, kind: type) -> np.ndarray:
    """All answers to one block, in the order of the hashes that it has sent."""
    blobs = rows.sort_by("part").column("blob") if rows.num_rows else []
    return np.concatenate([np.zeros(0, kind), *(unpacked(x.as_buffer().to_pybytes(), kind)[0] for x in blobs)])


class Blocks:
    """The blocks of a table: ``rows`` has their numbers and what ``pack`` makes of the rows of each."""

    def __init__(self, docs: DataFrame, shelf: Shelf, pack: Callable[[list[pa.RecordBatch]], dict[str, bytes]], names: list[str], *, text: int = 1, block_bytes: int | None = None) -> None:
        self.spark: SparkSession = docs.sparkSession
        total = docs.agg(F.sum(F.octet_length(docs.columns[text]))).first()[0] or 0
        # Small tables are cut finer, so that all cores have work.
        limit = block_bytes or min(BLOCK_BYTES, max(1 << 20, total // (2 * self.spark.sparkContext.defaultParallelism)))
        expected = max(1, -(-total // limit))
        self.parts = max(partitions(self.spark), expected)

        def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32

            def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                found = pack(held)
                return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([found[c]], pa.binary()) for c in names)], ["block", *names])

            held, size = [], 0
            for b in by_bytes(batches, min(limit, 2 << 20), text):
                now = b.column(text).nbytes
                if held and size + now > limit:
                    yield block(held)
                    number, held, size = number + 1, [], 0
                held.append(b)
                size += now
            if held:
                yield block(held)

        blocks = docs.mapInArrow(filled, ", ".join(["block long", *(f"{c} binary" for c in names)]))
        self.rows = shelf.bucketed(blocks, "blocks", "block", min(expected, MOST_BUCKETS))

    def each(self, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """``f`` of each block."""

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    yield from f(pa.Table.from_batches([b.slice(i, 1)])).to_batches()

        return self.rows.mapInArrow(apply, schema)

    def met(self, answer: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType | str) -> DataFrame:
        """``f`` of each block and the answers to it; only blocks that exist have any."""
        answer = answer.filter(F.col("block") != NOBODY)
        return self.rows.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(f, schema)


def packed_table(held: list[pa.RecordBatch]) -> bytes:
    """Rows as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in held:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def table_of(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()
