"""Token ids in binary files of bit planes.

A file holds the ids of its documents one after the other in blocks of ``BLOCK`` ids. Every block is transposed into bit planes
(plane k has bit k of every id), each compressed with zstandard. The document table (ids and lengths as 64-bit planes of
the same kind) follows, then the chunk index as JSON, its length as 8 bytes, and the mark. A reader needs the end of
the file and the blocks that it wants.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import default_path, encoder
from tidemark.session import scratch_path

BLOCK = 1 << 16
MARK = b"BITPLANE"
END_ID = 2
MANIFEST = "shard int, file string, n_docs long, n_tokens long"


def to_planes(values: np.ndarray, level: int = 3) -> list[bytes]:
    """The bit planes of unsigned integers, lowest first, as many as the largest needs."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    bits = int(values.max()).bit_length() if len(values) else 0
    one = values.dtype.type(1)
    return [press.compress(np.packbits(((values >> values.dtype.type(k)) & one).astype(np.uint8)).tobytes()) for k in range(bits)]


def from_planes(planes: list[bytes], n: int, dtype) -> np.ndarray:
    import zstandard

    press, out, kind = zstandard.ZstdDecompressor(), np.zeros(n, dtype), np.dtype(dtype).type
    for k, plane in enumerate(planes):
        bits = np.unpackbits(np.frombuffer(press.decompress(plane), np.uint8), count=n)
        out |= bits.astype(dtype) << kind(k)
    return out


class ShardWriter:
    """Writes one file; holds one block of ids, the document table and the index."""

    def __init__(self, sink):
        self.sink, self.at, self.rest, self.n_tokens = sink, 0, b"", 0
        self.blocks, self.ids, self.lengths = [], [], []

    def _write(self, values: np.ndarray) -> list:
        planes, start = to_planes(values), self.at
        for plane in planes:
            self.sink.write(plane)
            self.at += len(plane)
        return [start, len(values), [len(x) for x in planes]]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.n_tokens += len(ids) // 4
        self.rest += ids
        size = 4 * BLOCK
        if len(self.rest) >= size:
            whole = len(self.rest) // size * size
            for k in range(0, whole, size):
                self.blocks.append(self._write(np.frombuffer(self.rest, "<u4", BLOCK, k)))
            self.rest = self.rest[whole:]

    def close(self) -> None:
        if self.rest:
            self.blocks.append(self._write(np.frombuffer(self.rest, "<u4")))
        known = np.array([x is not None for x in self.ids], np.uint64)
        table = [np.array([x or 0 for x in self.ids], np.int64).view(np.uint64), known, np.array(self.lengths, np.uint64)]
        index = {"blocks": self.blocks, "documents": [self._write(x) for x in table]}
        tail = json.dumps(index).encode()
        self.sink.write(tail + len(tail).to_bytes(8, "little") + MARK)


class ShardReader:
    """Reads a file block by block."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MARK:
            raise ValueError("not a file of bit planes")
        length = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - length)
        self.index = json.loads(source.read(length))

    def _read(self, entry: list, dtype) -> np.ndarray:
        at, n, sizes = entry
        self.source.seek(at)
        return from_planes([self.source.read(x) for x in sizes], n, dtype)

    def block(self, k: int) -> np.ndarray:
        return self._read(self.index["blocks"][k], np.uint32)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in the file's order."""
        ids, known, lengths = (self._read(x, np.uint64) for x in self.index["documents"])
        rest, k = np.zeros(0, np.uint32), 0
        for doc_id, there, n in zip(ids.view(np.int64).tolist(), known.tolist(), lengths.tolist(), strict=True):
            got, have = [rest], len(rest)
            while have < n:
                got.append(self.block(k))
                have, k = have + len(got[-1]), k + 1
            rest = np.concatenate(got) if len(got) > 1 else rest
            yield (doc_id if there else None), rest[:n]
            rest = rest[n:]


def write_token_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
                      end_id: int = END_ID, by_word: bool = True) -> DataFrame:
    """Writes the documents' ids in ascending doc_id order and returns the manifest: shard, file, n_docs, n_tokens.

    The rows are range-partitioned by doc_id (null first; equal ids by text hash) and every task writes one file under a name of
    its own attempt. Only files that the manifest names count, and the manifest is written by Spark's committer, so tasks that fail, run twice or
    move to another executor do no harm. ``folder`` must be shared by all executors; the files are opened through Arrow's
    file systems. A null text is the end id alone.
    """
    path = path or default_path()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        context, writer = TaskContext.get(), None
        shard, end = context.partitionId(), np.asarray([end_id], "<u4").tobytes()
        for part in parts:
            for at in range(0, part.num_rows, 1000):
                some = part.slice(at, 1000)
                if writer is None:
                    store, top = FileSystem.from_uri(folder)
                    store.create_dir(f"{top}/files", recursive=True)
                    name = f"files/{shard:06d}-{context.taskAttemptId()}.planes"
                    sink = store.open_output_stream(f"{top}/{name}")
                    writer = ShardWriter(sink)
                for key, ids in zip(some.column(0).to_pylist(), encoder(path, by_word).encode(some.column(1).to_pylist()), strict=True):
                    writer.add(key, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [len(writer.ids)],
                                              "n_tokens": [writer.n_tokens]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids.

    The starts of the shards are running sums over the manifest, which has one small row per file.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("first"))
    tasks = max(1, manifest.count())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
        make = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        store, top = FileSystem.from_uri(folder)
        for part in parts:
            for file, start in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                with store.open_input_file(f"{top}/{file}") as source:
                    rows = []
                    for doc_id, ids in ShardReader(source).documents():
                        raw = ids.astype("<u4").tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(raw), raw)[: 4 + with_ids])
                        start += len(ids)
                        if len(rows) >= 1000:
                            yield make(rows)
                            rows = []
                    if rows:
                        yield make(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.repartition(tasks, "shard").mapInArrow(run, schema)


def round_trip(docs: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """Writes the files (to a new place in the shared folder if none is given) and reads them back.

    Rows that repeat a doc_id follow one another, ordered by a hash of the text. An empty table gives no file and no row. Other columns are ignored.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder, **settings)
    return read_token_files(docs.sparkSession, folder)
