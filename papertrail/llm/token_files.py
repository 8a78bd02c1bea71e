"""Token ids of a corpus in binary files of fixed-width bit packing, in ascending order of doc_id.

File format (all numbers little-endian).  An id takes the fewest bits that hold every id of the vocabulary, lowest bit
first.  A file has, one after the other:

* blocks of ``BLOCK_IDS`` ids each (the last may be shorter), every block padded to whole 8 bytes;
* the offset of each block and of the end of the last (unsigned 64 bit);
* for each document its doc_id (signed 64 bit), whether the id is null (8 bit) and its first id in the file (unsigned
  64 bit), in columns; one more first id ends the last document;
* a tail of 40 bytes: magic, width, ids in a block, ids, documents (each 64 bit).

So the ids from any place on are read by one seek, and a block is unpacked by a few numpy operations.  The manifest, a
Parquet table beside the files, has for each file its path and the number of ids in all files before it.

Ranges of doc_id of about as many bytes are bounded by a sample of keys.  Every document's ids are packed where its text is
read and dealt by range, and each range is written as one file.  Rows of equal doc_id are ordered by a hash of their text (equal
rows in any order), and a range may end between them, so no doc_id gathers its rows in one task.  A file is written under a
name of its attempt and then renamed, so a repeated task replaces it whole.  The folder must be one that pyarrow's file systems reach (a shared mount, HDFS, S3, ...).

Contract: null and empty texts have the closing id alone; repeated rows are each written; null ids come first; other
columns are not read; an empty table gives no file and no row.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertrail.llm import _util as U
from papertrail.llm.word_encoder import encoder, forget, vocabulary_size
from papertrail.session import scratch_path

#: Ids in a block, bytes of packed ids that one file should hold, and bytes of packed ids handed on at once.
BLOCK_IDS = 1 << 16
FILE_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
#: Keys that the bounds are drawn from, for each file.
KEYS = 100

_MAGIC = b"IDPACK01"
_TAIL = struct.Struct("<8s4Q")


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as bits, ``width`` each, lowest bit first, in whole bytes."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int, first: int = 0) -> np.ndarray:
    """``n`` ids from place ``first`` on."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n, first * width // 8).astype(np.uint32)
    raw = np.frombuffer(data + bytes(8), np.uint8)
    bit = (np.arange(n, dtype=np.int64) + first) * width
    at = bit >> 3
    out = np.zeros(n, np.uint64)
    for k in range((width + 14) // 8):  # the bytes that an id may touch
        out |= raw[at + k].astype(np.uint64) << np.uint64(8 * k)
    return (out >> (bit & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


class Writer:
    """Writes one file, document after document; holds one block of ids and the index."""

    def __init__(self, sink, width: int, block: int = BLOCK_IDS):
        self.sink, self.width, self.block = sink, width, block
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.at = 0
        self.offsets, self.docs, self.nulls, self.firsts = [0], [], [], [0]

    def _blocks(self, least: int) -> None:
        ids = np.concatenate(self.held)
        cut = 0
        while len(ids) - cut >= least and cut < len(ids):
            data = pack(ids[cut:cut + self.block], self.width)
            data += bytes(-len(data) % 8)
            self.sink.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
            cut += self.block
        self.held = [ids[cut:]]
        self.n_held = len(self.held[0])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.firsts.append(self.n_ids)
        if self.n_held >= self.block:
            self._blocks(self.block)

    def close(self) -> int:
        """Writes what is left; the bytes of the file."""
        if self.n_held:
            self._blocks(1)
        parts = [np.array(self.offsets, "<u8"), np.array(self.docs, "<i8"), np.array(self.nulls, "u1"),
                 np.array(self.firsts, "<u8")]
        data = b"".join(p.tobytes() for p in parts)
        self.sink.write(data + _TAIL.pack(_MAGIC, self.width, self.block, self.n_ids, len(self.docs)))
        return self.at + len(data) + _TAIL.size


class Reader:
    """Reads a file by seeks; ``source``: a seekable file."""

    def __init__(self, source):
        source.seek(0, os.SEEK_END)
        size = source.tell()
        source.seek(size - _TAIL.size)
        magic, self.width, self.block, self.n_ids, self.n_docs = _TAIL.unpack(source.read(_TAIL.size))
        if magic != _MAGIC:
            raise ValueError("not a file of packed ids")
        self.source = source
        n = -(-self.n_ids // self.block) + 1
        length = 8 * n + 9 * self.n_docs + 8 * (self.n_docs + 1)
        source.seek(size - _TAIL.size - length)
        data = source.read(length)
        self.offsets = np.frombuffer(data, "<u8", n).astype(np.int64)
        at = 8 * n
        self.docs = np.frombuffer(data, "<i8", self.n_docs, at)
        self.nulls = np.frombuffer(data, "u1", self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.firsts = np.frombuffer(data, "<u8", self.n_docs + 1, at + 9 * self.n_docs).astype(np.int64)

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from place ``first`` of the file on; reads only the blocks that hold them."""
        if first < 0 or n < 0 or first + n > self.n_ids:
            raise IndexError(f"ids {first} to {first + n} of {self.n_ids}")
        if not n:
            return np.zeros(0, np.uint32)
        b, last = first // self.block, (first + n - 1) // self.block
        self.source.seek(int(self.offsets[b]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[b]))
        out = []
        for k in range(b, last + 1):
            lo, hi = max(first, k * self.block), min(first + n, (k + 1) * self.block)
            cut = data[self.offsets[k] - self.offsets[b]:self.offsets[k + 1] - self.offsets[b]]
            out.append(unpack(cut, self.width, hi - lo, lo - k * self.block))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.firsts[k]), int(self.firsts[k + 1] - self.firsts[k]))

    def sequential(self, ids: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(document, part of its ids): the whole file in order, about ``ids`` ids read at once; a document whose ids
        go on is given again."""
        step = max(1, ids // self.block) * self.block
        k = 0
        for lo in range(0, self.n_ids, step):
            part = self.ids(lo, min(step, self.n_ids - lo))
            while k < self.n_docs and self.firsts[k] < lo + len(part):
                yield k, part[max(0, self.firsts[k] - lo):self.firsts[k + 1] - lo]
                if self.firsts[k + 1] > lo + len(part):
                    break
                k += 1


def _uri(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, which is that of Spark's default file system if it names none."""
    if re.match(r"[a-z][a-z0-9+.-]*:", folder):
        return re.sub("^file:/+", "file:///", folder)
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return default.rstrip("/").replace("file:", "file://") + folder


def _bounds(keyed: DataFrame, files: int) -> list[tuple]:
    """Keys that part the corpus into ranges of about as many bytes, from a sample of a bounded number of keys."""
    n = keyed.count()
    share = min(1.0, KEYS * files / max(n, 1))
    got = keyed.select("doc_id", "tie", "row", F.octet_length("text").alias("bytes")).sample(share, seed=1).collect()
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["tie"], r["row"]), r["bytes"] + 1) for r in got)
    each, out, held = sum(x for _, x in got) / files, [], 0
    for key, size in got:
        if held >= each * (len(out) + 1):
            out.append(key)
        held += size
    return out


def write(df: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, block: int = BLOCK_IDS,
          file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and their manifest under ``folder`` and returns the manifest: file, path, n_docs, n_ids, n_bytes,
    first (the ids in all files before)."""
    spark = df.sparkSession
    folder = _uri(spark, folder)
    width = width_of(max(vocabulary_size(tokenizer_path), end_id + 1))
    keyed = U.texts(df, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("tie"),
                                                 F.monotonically_increasing_id().alias("row"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a text packs into fewer bytes than it has
    files = max(-(-total // file_bytes), U.parallelism(df))
    bounds = spark.sparkContext.broadcast(_bounds(keyed, files))  # a key for each file

    def packed(batches):
        enc = encoder(tokenizer_path)
        for b in batches:
            file, n, out, size = [], [], [], 0
            for k, (doc_id, text, tie, row) in enumerate(zip(*(b.column(c) for c in ("doc_id", "text", "tie", "row")))):
                ids = np.append(np.frombuffer(enc.ids(text.as_py()), "<u4"), np.uint32(end_id))
                key = (doc_id.is_valid, doc_id.as_py() or 0, tie.as_py(), row.as_py())
                file.append(bisect_right(bounds.value, key))
                n.append(len(ids))
                out.append(pack(ids, width))
                size += len(out[-1])
                if size >= BATCH_BYTES or k == b.num_rows - 1:
                    part = b.slice(k + 1 - len(n), len(n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file, pa.int32()), *(part.column(c) for c in ("doc_id", "tie", "row")),
                         pa.array(n, pa.int64()), pa.array(out, pa.binary())],
                        names=["file", "doc_id", "tie", "row", "n_tokens", "ids"])
                    file, n, out, size = [], [], [], 0

    order = [F.col("file"), F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    ordered = (keyed.mapInArrow(packed, "file int, doc_id long, tie long, row long, n_tokens long, ids binary")
               .repartition(int(files), "file").sortWithinPartitions(*order))

    def run(batches):
        forget()  # the words that this worker has encoded in earlier tasks
        store, base = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        sink = out = number = None

        def finished():
            size = out.close()
            sink.close()
            path = f"{base}/ids-{number:08d}.bin"
            store.move(f"{path}.{attempt}.tmp", path)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((number, pa.int32()), (path, pa.string()), (len(out.docs), pa.int64()),
                                               (out.n_ids, pa.int64()), (size, pa.int64()))],
                names=["file", "path", "n_docs", "n_ids", "n_bytes"])

        for b in batches:
            for file, doc_id, n, ids in zip(*(b.column(c) for c in ("file", "doc_id", "n_tokens", "ids"))):
                if file.as_py() != number:
                    if sink is not None:
                        yield finished()
                    number = file.as_py()
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(f"{base}/ids-{number:08d}.bin.{attempt}.tmp")
                    out = Writer(sink, width, block)
                out.add(doc_id.as_py(), unpack(ids.as_py(), width, n.as_py()))
        if sink is not None:
            yield finished()

    written = ordered.select("file", "doc_id", "n_tokens", "ids").mapInArrow(
        run, "file int, path string, n_docs long, n_ids long, n_bytes long")
    written.write.parquet(f"{folder}/files")
    files_table = spark.read.parquet(f"{folder}/files")  # a row for each file
    first = F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")
    files_table.withColumn("first", first).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def _per_file(spark: SparkSession, folder: str, rows, schema: str) -> DataFrame:
    """``rows(reader, first)`` gives record batches; the files are dealt to tasks."""
    U.share(spark)
    folder = _uri(spark, folder)

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist()):
                with store.open_input_file(path) as source:
                    yield from rows(Reader(source), first)

    files = manifest(spark, folder)
    return files.repartition(max(1, files.count())).select("path", "first").mapInArrow(run, schema)


def _ids_of(reader: Reader) -> pa.Array:
    return pa.array(reader.docs, mask=reader.nulls)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids: every document as read from the files."""
    def rows(reader, first):
        for k in range(reader.n_docs):
            yield pa.RecordBatch.from_arrays(
                [_ids_of(reader).slice(k, 1), pa.array([first + int(reader.firsts[k])], pa.int64()),
                 pa.array([reader.document(k).astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return _per_file(spark, folder, rows, "doc_id long, start long, ids array<int>")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: computed from the files, which are read in order."""
    def rows(reader, first):
        crc = np.zeros(reader.n_docs, np.int64)
        for k, ids in reader.sequential():
            crc[k] = zlib.crc32(ids.astype("<u4").tobytes(), int(crc[k]))
        yield pa.RecordBatch.from_arrays(
            [_ids_of(reader), pa.array(first + reader.firsts[:-1]), pa.array(np.diff(reader.firsts)), pa.array(crc)],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _per_file(spark, folder, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, **options) -> DataFrame:
    """Writes the files (to a new folder of the shared one unless ``folder`` is given) and reads them back."""
    U.share(df.sparkSession)
    folder = folder or scratch_path(df.sparkSession, "token-files")
    write(df, tokenizer_path, folder, end_id, **options)
    return checksums(df.sparkSession, folder)
