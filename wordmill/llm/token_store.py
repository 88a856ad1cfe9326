"""Token ids in files of independent zstandard frames with a trailing seek table.

A file: frames of whole documents' ids (little-endian unsigned 32-bit), one frame
with the directory (per document its id, whether the id is null, and its number
of ids), then a skippable frame in zstandard's public seekable layout: for every
frame its compressed and plain size and the low 32 bits of the plain data's
xxh64, the number of frames, a flag byte and a closing magic number. A reader
fetches the table and the directory, then only the frames that it needs.

Null texts are empty; every document ends with the end id, so none is without
ids. Rows with equal doc_id stay separate and lie next to each other, null ids
first, in no order of their texts. A very long text is one frame. Extra columns
are ignored. An empty table gives no file and no row.

The list of files has one row a file with the least and greatest doc_id in it, so
`fetch` opens only the files, and decompresses only the frames, that hold a wanted
document.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, new_path, ship

# Fixed values of the seekable layout.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 18  # a frame is closed once it holds so many bytes of ids
CHUNK = 128  # texts encoded at once in a worker
ROWS = 5000  # documents in a batch that a reader hands on
FILE_SCHEMA = "part int, path string, n_docs long, n_ids long, least long, greatest long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Corrupt(ValueError):
    """A frame's data doesn't match its checksum, or the layout is broken."""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Writer:
    """Writes one file; add documents in their order, then close."""

    def __init__(self, out, level: int = 1, frame_bytes: int = FRAME_BYTES):
        self.out, self.level, self.frame_bytes = out, level, frame_bytes
        self.table: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.n_ids = 0
        self.ids, self.counts, self.null = array("q"), array("Q"), bytearray()

    def _frame(self, data: bytes) -> None:
        done = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(data)
        self.out.write(done)
        self.table.append((len(done), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self._frame(self.ids.tobytes() + self.counts.tobytes() + bytes(self.null))
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        body = entries + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class Reader:
    """Reads one file (anything with seek, read and a known size)."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise Corrupt("no seek table")
        raw = self._at(size - 9 - 12 * n, 12 * n)
        self.table = np.frombuffer(raw, "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        raw = self.frame(n - 1)
        k = len(raw) // 17
        null = np.frombuffer(raw, np.uint8, k, 16 * k)
        self.null = null.astype(bool)
        self.numbers = np.frombuffer(raw, "<i8", k)
        self.counts = np.frombuffer(raw, "<u8", k, 8 * k).astype(np.int64)
        self.offsets = np.cumsum(self.counts) - self.counts
        self.frame_ends = np.cumsum(self.table[:-1, 1]) // 4

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        plain = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
            raise Corrupt(f"frame {k}")
        return plain

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """doc_id, offset in ids and ids of all documents, frame by frame."""
        doc = 0
        for k in range(len(self.table) - 1):
            plain, first = self.frame(k), int(self.offsets[doc])
            while doc < len(self.numbers) and self.offsets[doc] < self.frame_ends[k]:
                a = 4 * (int(self.offsets[doc]) - first)
                yield None if self.null[doc] else int(self.numbers[doc]), int(self.offsets[doc]), plain[a : a + 4 * int(self.counts[doc])]
                doc += 1

    def document(self, doc_id: int) -> list[bytes]:
        """Ids of the documents of that doc_id; only their frames are read."""
        return [x for _, x in self.wanted(np.array([doc_id], np.int64))]

    def wanted(self, doc_ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """doc_id and ids of those documents, in the file's order; only their frames
        are read, each once. Within a file the ids that aren't null ascend."""
        first = int(self.null.sum())
        own = self.numbers[first:]
        doc_ids = np.unique(doc_ids)
        low, high = np.searchsorted(own, doc_ids, "left"), np.searchsorted(own, doc_ids, "right")
        held, plain = -1, b""
        for doc in (first + k for a, b in zip(low.tolist(), high.tolist(), strict=True) for k in range(a, b)):
            k = int(np.searchsorted(self.frame_ends, self.offsets[doc], side="right"))
            if k != held:
                held, plain = k, self.frame(k)
            a = 4 * (int(self.offsets[doc]) - (int(self.frame_ends[k - 1]) if k else 0))
            yield int(self.numbers[doc]), plain[a : a + 4 * int(self.counts[doc])]


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode and write documents in ascending doc_id; one row per file
    (FILE_SCHEMA), files in order of part.

    Each attempt of a task writes a file of its own name and only the attempt
    that Spark accepts is listed, so lost executors and repeated tasks never
    damage a file that is read."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "token-store")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from wordmill.llm.bytepair import encoder

        own, end = encoder(tokenizer), struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        system, base = opened(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        out = writer = None
        for b in batches:
            for start in range(0, b.num_rows, CHUNK):
                piece = b.slice(start, CHUNK)
                if writer is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                    writer = Writer(out)
                for i, ids in zip(piece.column(0).to_pylist(), own.encode([t or "" for t in piece.column(1).to_pylist()]), strict=True):
                    writer.add(i, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            known = [i for i, m in zip(writer.ids, writer.null, strict=True) if not m] or [None]
            row = {"part": part, "path": f"{folder}/{name}", "n_docs": len(writer.ids), "n_ids": writer.n_ids, "least": known[0], "greatest": known[-1]}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_ids", "least", "greatest"))]))

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return Table(ranged.mapInArrow(run, FILE_SCHEMA), "token-files").df


def read(files: DataFrame) -> DataFrame:
    """Every document of the files, each file by one task: doc_id, start (ids of
    all documents before it), n_tokens, ids_crc32. Frames are checked."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, inner = opened(path)
                with system.open_input_file(inner) as source:
                    rows = ((i, start + at, len(ids) // 4, zlib.crc32(ids)) for i, at, ids in Reader(source, source.size()).documents())
                    while some := list(islice(rows, ROWS)):
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, files.count())).mapInArrow(run, DOC_SCHEMA)


def fetch(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of the documents of those
    doc_id. Files and wanted ids meet by the files' ranges; what is broadcast is one
    row a file. Each file that may hold wanted documents is opened by one task."""
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    near = ids.join(F.broadcast(files.select("path", "least", "greatest")), F.col("doc_id").between(F.col("least"), F.col("greatest")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        system, inner = opened(key[0].as_py())
        with system.open_input_file(inner) as source:
            found = list(Reader(source, source.size()).wanted(table.column("doc_id").to_numpy()))
        return pa.table({"doc_id": pa.array([i for i, _ in found], pa.int64()), "ids": pa.array([x for _, x in found], pa.binary())})

    return near.select("path", "doc_id").groupBy("path").applyInArrow(run, "doc_id long, ids binary")
