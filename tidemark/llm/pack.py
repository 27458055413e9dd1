"""Best-fit packing with a fixed number of open bins."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import default_path, encoder
from tidemark.session import materialize

CAPACITY = 2048
END_ID = 0
#: Bins held open by a task. A full set closes its fullest bin for a new one.
OPEN_BINS = 1 << 16
#: Pieces packed by one task: enough that its last, part-filled bins hardly count.
PIECES_PER_TASK = 250_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins in a bitset keyed by their free space: bit f is set while a bin with f free places is open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.bits, self.count, self.next = capacity, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) in the open bin that is left with the least free space, else in a new one."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, chosen = self.capacity, self.next
            self.next += 1
        if left := free - length:
            self.by_free[left].append(chosen)
            self.bits |= 1 << left
            self.count += 1
        return chosen, self.capacity - free

    def _take(self, free: int) -> int:
        chosen = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.count -= 1
        return chosen


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID,
                 capacity: int = CAPACITY, with_ids: bool = False, by_word: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked, ids (little-endian unsigned 32-bit).

    A document is its token ids, then ``end_id``; only one longer than ``capacity`` is cut, into pieces of that
    length and a rest. A null or empty text is the end id alone.
    """
    path = path or default_path()
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([end_id], "<u4").tobytes()
        for part in parts:
            for at in range(0, part.num_rows, 1000):
                some = part.slice(at, 1000)
                rows = []
                for key, ids in zip(some.column(0).to_pylist(), encoder(path, by_word).encode(some.column(1).to_pylist()), strict=True):
                    ids += end
                    for k in range(0, len(ids), 4 * capacity):
                        cut = ids[k : k + 4 * capacity]
                        rows.append((key, k // (4 * capacity), k // 4, len(cut) // 4, zlib.crc32(cut), cut))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of at most ``capacity``.

    The pieces are dealt evenly by hash to tasks of about ``per_task``; each task goes through its pieces from
    the longest to the shortest and puts each into the open bin that it fills best. Read ``pieces`` from storage:
    they are counted first. Ties go by doc_id and piece, so a task that runs again packs alike.
    """
    tasks = max(1, math.ceil(pieces.count() / per_task))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for part in parts:
            placed = [bins.place(x) for x in part.column(part.schema.get_field_index("length")).to_pylist()]
            made = [pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "sequence_id", "offset"])

    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece").mapInArrow(run, f"{columns}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, **settings) -> DataFrame:
    """Tokenizes ``docs`` and packs the pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked).

    The pieces are written once to the shared folder and read again. Rows that repeat a doc_id are packed each; a null doc_id
    stays null; an empty table gives no row. Other columns are ignored.
    """
    return pack(materialize(token_pieces(docs, **settings), "pieces"), settings.get("capacity", CAPACITY))
