"""Token files: independent zstandard frames, a document index and a trailing seek table.

A file is a sequence of zstandard frames, each with ids of one document (a document longer than
``frame_ids`` has several), then a skippable frame with the document index, then the seek table of the
public zstandard seekable format: for each data frame its compressed size, its decompressed size and the
low 32 bits of the XXH64 of its content.  Any zstandard decoder reads the data; a reader of this module
fetches the tail, then decompresses only the frames of requested documents and checks each.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, staged, tasks_for
from .tokens import encoder

# Fixed values of the seekable format.
SEEK_MAGIC, SEEK_FOOTER, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_MAGIC = 0x184D2A50

MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long, first_id long, last_id long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class TokenWriter:
    """Writes documents, in order, to a stream."""

    def __init__(self, out: BinaryIO, dtype: str, frame_ids: int = 1 << 20, level: int = 3) -> None:
        self.out, self.dtype, self.frame_ids = out, np.dtype(dtype), frame_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.docs: list[tuple[int | None, int]] = []
        self.n_tokens = self.n_bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        step = self.frame_ids * self.dtype.itemsize
        cuts = range(0, max(len(ids), 1), step)
        for at in cuts:
            part = ids[at : at + step]
            data = self.zip.compress(part)
            self.out.write(data)
            self.n_bytes += len(data)
            self.frames.append(struct.pack("<III", len(data), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.docs.append((doc_id, len(cuts)))
        self.n_tokens += len(ids) // self.dtype.itemsize

    def close(self) -> None:
        ids = np.array([0 if d is None else d for d, _ in self.docs], "<i8").tobytes()
        nulls = np.array([d is None for d, _ in self.docs], "u1").tobytes()
        counts = np.array([n for _, n in self.docs], "<u4").tobytes()
        head = json.dumps({"dtype": self.dtype.str, "documents": len(self.docs)}).encode()
        index = zstandard.compress(struct.pack("<I", len(head)) + head + ids + nulls + counts)
        table = b"".join(self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_FOOTER)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.n_bytes += 16 + len(index) + len(table)


class TokenReader:
    """Reads single documents from a seekable file; raises ValueError on damage."""

    def __init__(self, file: BinaryIO, size: int) -> None:
        self.file = file
        if size < 17:
            raise ValueError("too short for a token file")
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER or flags != CHECKSUMS:
            raise ValueError("no seek table")
        start = size - 17 - 12 * n
        if start < 0 or struct.unpack("<II", self._at(start, 8)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("seek table damaged")
        self.table = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        end = int(self.offsets[-1])
        magic, length = struct.unpack("<II", self._at(end, 8))
        if magic != INDEX_MAGIC or end + 8 + length != start:
            raise ValueError("document index damaged")
        index = zstandard.decompress(self._at(end + 8, length))
        (h,) = struct.unpack_from("<I", index)
        head = json.loads(index[4 : 4 + h])
        m, at = head["documents"], 4 + h
        self.dtype = np.dtype(head["dtype"])
        self.ids = np.frombuffer(index, "<i8", m, at)
        self.nulls = np.frombuffer(index, "u1", m, at + 8 * m).astype(bool)
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(index, "<u4", m, at + 9 * m), dtype=np.int64)])
        self.unzip = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("file cut short")
        return data

    def __len__(self) -> int:
        return len(self.ids)

    def find(self, doc_id: int | None) -> list[int]:
        """Positions of the documents of an id."""
        return np.flatnonzero(self.nulls if doc_id is None else (self.ids == doc_id) & ~self.nulls).tolist()

    def read(self, i: int) -> np.ndarray:
        """Token ids of the i-th document; touches its frames only."""
        parts = []
        for f in range(int(self.first[i]), int(self.first[i + 1])):
            size, full, check = map(int, self.table[f])
            data = self.unzip.decompress(self._at(int(self.offsets[f]), size), max_output_size=max(full, 1))
            if len(data) != full or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {f} damaged")
            parts.append(data)
        return np.frombuffer(b"".join(parts), self.dtype)


def _filesystem(uri: str):
    """Any store that pyarrow knows: local, HDFS, object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = 1 << 26, partitions: int | None = None, file_docs: int = 1 << 17) -> DataFrame:
    """Writes ids of all texts, each document ended by ``end_id``, in ascending order of id (nulls first,
    ties by a hash of the text), and returns the manifest: one row per file.

    Ids are integers or null; null texts are empty; extra columns are not read.  Files have names of
    their own per attempt, and the manifest holds those of tasks that ended well, so retries and
    speculative copies are harmless.  Rows are dealt by range; each task streams its rows to files of
    about ``file_tokens`` ids and ``file_docs`` documents at most, which bounds what writers and readers hold.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions or tasks_for(docs), F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        part, attempt, seq, writer = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, None
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        store, base = _filesystem(path)
        done: list[tuple] = []

        def close() -> None:
            writer.close()
            out.close()
            known = [d for d, _ in writer.docs if d is not None]
            done.append((part, seq, name, len(writer.docs), writer.n_tokens, writer.n_bytes, min(known, default=None), max(known, default=None)))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.column(batch.column(1), end).to_pylist()):
                if writer is None:
                    name = f"{base}/tokens-{part:06d}-{seq:04d}-{attempt}.zst"
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                    writer = TokenWriter(out, enc.dtype.str)
                writer.add(doc_id, ids)
                if writer.n_tokens >= file_tokens or len(writer.docs) >= file_docs:
                    close()
                    writer, seq = None, seq + 1
        if writer is not None:
            close()
        enc.trim()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5))], names=[c.split(" ")[0] for c in MANIFEST.split(", ")])

    return staged(rows.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens and the
    crc32 of its ids as 32-bit integers.  Every frame is checked as it is read."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))  # a row per file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(path)
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(name) as f:
                    reader = TokenReader(f, f.size())
                    sizes, crcs = [], []
                    for i in range(len(reader)):
                        ids = reader.read(i)
                        sizes.append(len(ids))
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                starts = base + np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.int64)]) if sizes else []
                yield pa.RecordBatch.from_arrays([pa.array(reader.ids, mask=reader.nulls), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path", "base").repartition(n, "path").mapInArrow(read, DOCUMENTS)


def fetch_documents(manifest: DataFrame, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and tokens (array<int>) of the documents of the ids asked for; opens the files whose ids reach around one
    and decompresses the frames of these documents only.  Ids that no file holds give no row."""
    asked = sorted(set(doc_ids))
    near = F.exists(F.array(*map(F.lit, asked)), lambda i: i.between(F.col("first_id"), F.col("last_id"))) if asked else F.lit(False)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(path)
        for batch in batches:
            for name, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("path", "first_id", "last_id"))):
                with store.open_input_file(name) as f:
                    reader = TokenReader(f, f.size())
                    found = [(i, reader.read(k).astype(np.int32)) for i in asked if lo <= i <= hi for k in reader.find(i)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int32()))], names=["doc_id", "tokens"])

    return manifest.where(near).select("path", "first_id", "last_id").mapInArrow(read, "doc_id long, tokens array<int>")


def tokens_on_disk(spark: SparkSession, docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the token files of ``docs`` and reads them back."""
    path = path or new_path(spark, "tokens")
    return read_token_files(write_token_files(docs, path, **options), path)
