"""Token ids in files of compressed bit or byte planes.

A shard file holds a range of documents in ascending id order. Its ids stand in
blocks of BLOCK; a block is transposed into planes (plane k has byte k, or bit
k, of every id) and each plane is compressed by zstandard for itself. At the end
of the file stand the chunk index (ids and plane lengths of every block, so any
block is found without reading others), the documents with their numbers of ids,
and the length of all that.

Each task writes under a name of its own attempt and renames the finished file;
only names that finished tasks return are read, so lost executors leave nothing
that counts. Files go to a folder that all executors share, through Arrow's file
systems (local, HDFS, S3, GCS by the folder's scheme).

Defined cases: a null text is the empty text and has the end id alone; rows of
one id stand in the order of their texts; null ids come first; an empty table
writes no file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailforge.llm.common import cut, parts_for
from trailforge.llm.tokens import encoder

MAGIC = b"TFPLANE1"
BLOCK = 1 << 16
#: Bytes of text whose ids go to a file, about, where the session's own number of partitions would make larger ones.
SHARD = 1 << 29


def to_planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """ids (uint32) as rows of planes, lowest first."""
    whole = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return np.packbits(np.unpackbits(whole, axis=1, bitorder="little").T, axis=1)
    return np.ascontiguousarray(whole.T)


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes])
        return np.ascontiguousarray(np.packbits(rows.T, axis=1, bitorder="little")).view("<u4").ravel()
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes]).T).view("<u4").ravel()


class Writer:
    """Writes ids and documents to an open binary file."""

    def __init__(self, file, bits: bool = False, block: int = BLOCK, level: int = 3):
        self.file, self.bits, self.block = file, bits, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.at = file.write(MAGIC) and len(MAGIC)
        self.index: list = []
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray):
        self.waiting.append(ids)
        self.n += len(ids)
        if self.n >= self.block:
            whole = np.concatenate(self.waiting)
            done = len(whole) - len(whole) % self.block
            for k in range(0, done, self.block):
                self._block(whole[k : k + self.block])
            self.waiting, self.n = [whole[done:]], len(whole) - done

    def _block(self, ids):
        packed = [self.press.compress(p.tobytes()) for p in to_planes(ids, self.bits)]
        self.index.append([len(ids), self.at, [len(p) for p in packed]])
        for p in packed:
            self.file.write(p)
            self.at += len(p)

    def close(self, documents: pa.Table):
        if self.n:
            self._block(np.concatenate(self.waiting))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, documents.schema) as out:
            out.write_table(documents)
        docs = self.press.compress(sink.getvalue().to_pybytes())
        head = self.press.compress(json.dumps({"bits": self.bits, "blocks": self.index}).encode())
        self.file.write(head + docs + struct.pack("<QQ", len(head), len(docs)) + MAGIC)


class Reader:
    """Reads a shard from an open random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        head, docs = struct.unpack("<QQ", file.read_at(16, size - 24))
        if file.read_at(8, size - 8) != MAGIC:
            raise ValueError("not a whole shard file")
        un = zstandard.ZstdDecompressor()
        top = json.loads(un.decompress(file.read_at(head, size - 24 - docs - head)))
        self.bits, self.blocks = top["bits"], top["blocks"]
        self.documents = pa.ipc.open_stream(un.decompress(file.read_at(docs, size - 24 - docs))).read_all()

    def block(self, k: int) -> np.ndarray:
        n, at, sizes = self.blocks[k]
        un, raw, out = zstandard.ZstdDecompressor(), self.file.read_at(sum(sizes), at), []
        for size in sizes:
            out.append(un.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(out, n, self.bits)

    def each(self):
        """The ids of one document after another."""
        k, have = 0, np.empty(0, np.uint32)
        for n in self.documents.column("n").to_numpy():
            some, short = [have], n - len(have)
            while short > 0:
                some.append(self.block(k))
                short -= len(some[-1])
                k += 1
            have = np.concatenate(some) if len(some) > 1 else have
            yield have[:n]
            have = have[n:]


def _store(folder: str):
    """A file system and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _writer(folder: str, path: str, end: int, bits: bool, kind: pa.DataType):
    def write(batches):
        task = TaskContext.get()
        store, place = _store(folder)
        name = f"part-{task.partitionId():06d}"
        draft = f"{place}/.{name}-{task.taskAttemptId()}"
        file, ids_of, sizes = None, [], []
        for batch in batches:
            if file is None and batch.num_rows:
                coder = encoder(path, True)
                file = store.open_output_stream(draft)
                out = Writer(file, bits)
            for i, ids in zip(batch.column(0).to_pylist(), coder.encode_all(t.as_py() for t in batch.column(1)) if batch.num_rows else ()):
                ids = np.append(ids, np.uint32(end))
                out.add(ids.astype(np.uint32))
                ids_of.append(i)
                sizes.append(len(ids))
        if file is not None:
            out.close(pa.table({"doc_id": pa.array(ids_of, kind), "n": pa.array(sizes, pa.int64())}))
            file.close()
            final = f"{name}-{task.taskAttemptId()}.planes"
            store.move(draft, f"{place}/{final}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "file": [final], "n_docs": pa.array([len(sizes)], pa.int64()), "n_ids": pa.array([sum(sizes)], pa.int64())})

    return write


def write_planes(docs: DataFrame, folder: str, path: str, end: int = 0, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write the ids of all documents in ascending id order; returns the manifest, a row a shard.

    The manifest has a row for each shuffle partition of the session or, beyond
    those, for each SHARD bytes of text.
    """
    kind = pa.from_numpy_dtype("int64") if docs.schema[id_col].dataType == T.LongType() else None
    if kind is None:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(docs.schema[id_col].dataType)
    store, place = _store(folder)
    store.create_dir(place)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange(parts_for(rows, "text", SHARD), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = cut(ranged.mapInArrow(_writer(folder, path, end, bits, kind), "part long, file string, n_docs long, n_ids long"))
    manifest, start = [], 0
    for row in shards.orderBy("part").collect():
        manifest.append(row.asDict() | {"start": start})
        start += row["n_ids"]
    with store.open_output_stream(f"{place}/manifest.json") as out:
        out.write(json.dumps({"block": BLOCK, "end": end, "shards": manifest}).encode())
    return manifest


def read_planes(spark, folder: str, manifest: list[dict], id_type: str = "long") -> DataFrame:
    """Per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""

    def read(batches):
        store, place = _store(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard = manifest[k]
                with store.open_input_file(f"{place}/{shard['file']}") as file:
                    whole = Reader(file)
                    sums = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for ids in whole.each()), np.int64, whole.documents.num_rows)
                    n = whole.documents.column("n").to_numpy()
                    out = pa.table({"doc_id": whole.documents.column("doc_id"), "start": shard["start"] + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": sums})
                    yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    n = len(manifest)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end: int = 0, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids to a new folder beside the session's checkpoints, and read them back."""
    spark = docs.sparkSession
    cut(spark.range(1))  # sets the checkpoint folder where the session has none
    folder = f"{spark.sparkContext.getCheckpointDir()}/planes-{uuid.uuid4().hex}"
    manifest = write_planes(docs, folder, path, end, bits, id_col, text_col)
    return read_planes(spark, folder, manifest, docs.schema[id_col].dataType.simpleString())
