"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, then two skippable frames, so any zstandard tool
can decompress it whole.  All numbers are little-endian.

* data frames: each holds ids of one document (unsigned 32-bit), at most FRAME_IDS of
  them; a longer document has several frames in a row.
* skippable frame 0x184D2A50, the directory: for each document doc_id (signed 64-bit,
  the least value for null), its first frame (unsigned 32-bit), its number of ids
  (unsigned 64-bit).
* skippable frame 0x184D2A5E, the seek table of the zstandard seekable format: for each
  data frame its compressed size, decompressed size and the low 32 bits of the XXH64 of
  its decompressed bytes; then the number of frames, a descriptor byte 0x80 and the
  magic number 0x8F92EAB1.

A reader takes the last 9 bytes, then the seek table, then the directory, and
decompresses the frames of the documents it wants only.

``write`` deals the documents to files by ranges of doc_id, as many files as the bytes of
text ask for; each file is renamed to a name of its attempt when it is complete, so a lost
executor leaves no half file, and a task that is run again no file that counts twice: the
manifest names those that do.

Null text counts as empty (just the end id).  Null doc_ids come first.  Rows that share a
doc_id, or have none, follow each other in the order of their texts' hashes, and may go on in
the next file, so that no file has to hold them all.  A very long text has many frames.  An
empty table gives no files.  Only doc_id and text are read; whatever other columns are named,
they don't matter.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, parts_for, read
from .tokens import Encoder, file_of, kept, load

FRAME_IDS = 1 << 18
#: Bytes of text that a file is meant to hold.
FILE_BYTES = 64 << 20
DIRECTORY, SEEK, MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_ID = -(1 << 63)
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])
PLACE = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("n_ids", "<u8")])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Writes to a binary stream; holds one frame and the tables."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.pack = stream, zstandard.ZstdCompressor(level=level, write_checksum=False)
        # plain numbers, not objects: three of 8 bytes a document and a frame
        self.frames, self.places = array("q"), array("q")
        self.n_ids = 0

    @property
    def n_docs(self) -> int:
        return len(self.places) // 3

    @property
    def n_frames(self) -> int:
        return len(self.frames) // 3

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.places.extend((NO_ID if doc_id is None else doc_id, self.n_frames, len(ids) // 4))
        self.n_ids += len(ids) // 4
        for at in range(0, len(ids), 4 * FRAME_IDS):
            plain = ids[at : at + 4 * FRAME_IDS]
            packed = self.pack.compress(plain)
            self.stream.write(packed)
            self.frames.extend((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    @staticmethod
    def _table(numbers: array, kind: np.dtype) -> bytes:
        rows = np.frombuffer(numbers, np.int64).reshape(-1, 3)
        out = np.zeros(len(rows), kind)
        for i, name in enumerate(kind.names):
            out[name] = rows[:, i]
        return out.tobytes()

    def close(self) -> None:
        places = self._table(self.places, PLACE)
        self.stream.write(struct.pack("<II", DIRECTORY, len(places)) + places)
        table = self._table(self.frames, ENTRY) + struct.pack("<IBI", self.n_frames, 0x80, MAGIC)
        self.stream.write(struct.pack("<II", SEEK, len(table)) + table)


class Reader:
    """Reads from a seekable binary stream; decompresses frames on demand only."""

    def __init__(self, stream):
        self.stream, self.unpack = stream, zstandard.ZstdDecompressor()
        end = stream.seek(0, 2)
        n, flag, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != MAGIC or flag != 0x80:
            raise ValueError("no seek table")
        size = n * ENTRY.itemsize + 9
        kind, said = struct.unpack("<II", self._at(end - size - 8, 8))
        if kind != SEEK or said != size:
            raise ValueError("broken seek table")
        self.frames = np.frombuffer(self._at(end - size, n * ENTRY.itemsize), ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        kind, said = struct.unpack("<II", self._at(int(self.at[-1]), 8))
        if kind != DIRECTORY:
            raise ValueError("no directory")
        self.places = np.frombuffer(self._at(int(self.at[-1]) + 8, said), PLACE)

    def _at(self, where: int, size: int) -> bytes:
        self.stream.seek(where)
        data = self.stream.read(size)
        if len(data) != size:
            raise ValueError("the file ends too early")
        return data

    def frame(self, k: int) -> bytes:
        e = self.frames[k]
        plain = self.unpack.decompress(self._at(int(self.at[k]), int(e["packed"])), max_output_size=int(e["plain"]))
        if len(plain) != e["plain"] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != e["sum"]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def document(self, i: int) -> tuple[int | None, bytes]:
        """doc_id and ids of the file's i-th document."""
        doc_id, first, n = (int(x) for x in self.places[i])
        parts = -(-n // FRAME_IDS)
        return (None if doc_id == NO_ID else doc_id), b"".join(self.frame(first + k) for k in range(parts))

    def find(self, doc_id: int) -> list[bytes]:
        a, b = np.searchsorted(self.places["doc_id"], doc_id, "left"), np.searchsorted(self.places["doc_id"], doc_id, "right")
        return [self.document(i)[1] for i in range(a, b)]


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 0, files: int | None = None) -> list[tuple[str, int, int]]:
    """Encodes and writes ``docs``.  (file, documents, ids) in ascending doc_id order; the
    list has one entry a file, ``files`` at most (default: by the bytes of text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path or file_of("byte_bpe_50k.json")))
    last = np.array([end], "<u4").tobytes()
    fs, base = filesystem(folder)
    fs.create_dir(base)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(folder)
        tmp = f"{base}/.{uuid.uuid4().hex}"
        writer = stream = None
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    if writer is None:
                        stream = where.open_output_stream(tmp)
                        writer, encoder = Writer(stream), kept(Encoder, shared.value)
                    for k, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1)), strict=True):
                        writer.add(k, ids + last)
            if writer is None:
                return
            writer.close()
            stream.close()
        except BaseException:
            if stream is not None:
                stream.close()
                where.delete_file(tmp)
            raise
        # a name of this attempt: one that is run again writes beside it, and the manifest says which counts
        name = f"ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.zst"
        where.move(tmp, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.n_docs]), pa.array([writer.n_ids])], names=["file", "n_docs", "n_ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    if files is None:
        files = parts_for(spark, rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, FILE_BYTES)
    # equal rows are told apart by the part they come from, so that a range can end among them;
    # whole texts are no range key, as the keys of a sample go to the driver
    order = ["id", F.xxhash64("text"), "part"]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    done = dealt.mapInArrow(work, "file string, n_docs long, n_ids long").collect()
    return [(r["file"], r["n_docs"], r["n_ids"]) for r in sorted(done, key=lambda r: r["file"])]


def read_files(spark: SparkSession, folder: str, manifest: list[tuple[str, int, int]], with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in manifest], dtype=np.int64)]).tolist()
    files = [(name, at) for (name, _, _), at in zip(manifest, starts, strict=False)]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_input_file(f"{base}/{name}") as f:
                    reader = Reader(f)
                    for first in range(0, len(reader.places), 500):
                        out: list[list] = [[] for _ in names]
                        for i in range(first, min(first + 500, len(reader.places))):
                            doc_id, ids = reader.document(i)
                            row = (doc_id, at, len(ids) // 4, zlib.crc32(ids), np.frombuffer(ids, "<i4"))
                            at += len(ids) // 4
                            for c, v in zip(out, row, strict=False):
                                c.append(v)
                        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    listed = spark.createDataFrame(files, "file string, at long")
    return listed.repartition(max(1, len(files)), "file").mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    manifest = write(read(spark, sf_dir, "documents"), folder)
    return read_files(spark, folder, manifest, with_ids=False)
