"""Corpora as chunks: blobs of rows in a bucketed table, which several passes read and join by chunk without moving text."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from papertrail.llm._util import sliced
from papertrail.session import scratch_path

#: Characters of text in a chunk.
CHUNK = 1 << 21


def packed(**arrays: np.ndarray) -> bytes:
    """One-dimensional arrays as one compressed blob."""
    head = json.dumps([[k, a.dtype.str, a.nbytes] for k, a in arrays.items()]).encode()
    raw = len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for name, kind, size in json.loads(raw[4:at]):
        out[name] = np.frombuffer(raw[at:at + size], kind)
        at += size
    return out


def rows(blob: bytes) -> pa.Table:
    """The rows of a chunk."""
    return pa.ipc.open_stream(pa.BufferReader(blob)).read_all()


def stored(table: pa.Table) -> bytes:
    """A table as the blob that :func:`rows` reads."""
    sink = io.BytesIO()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, table.schema, options=options) as w:
        w.write_table(table)
    return sink.getvalue()


def chunked(df: DataFrame, text_col: str, buckets: int, size_of: int = CHUNK,
            made: Callable[[pa.Table], list[bytes]] = lambda table: [stored(table)],
            columns: tuple[str, ...] = ("data",)) -> DataFrame:
    """chunk and ``columns``: the rows of ``df`` in blobs of about ``size_of`` characters, bucketed by chunk in the shared
    folder; ``made`` gives a chunk's blobs, its rows unless told otherwise."""
    spark = df.sparkSession
    text_at = df.columns.index(text_col)

    def run(batches):
        held, size = [], 0

        def blob():
            blobs = made(pa.Table.from_batches(held))
            name = np.array([xxhash.xxh64_intdigest(b"".join(blobs))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(name), *[pa.array([x], pa.binary()) for x in blobs]],
                                              names=["chunk", *columns])

        for b in batches:
            lengths = np.array([0 if t is None else len(t) for t in b.column(text_at).to_pylist()], np.int64)
            start = 0
            for i, x in enumerate(lengths.tolist()):
                size += x
                if size >= size_of:
                    held.append(b.slice(start, i + 1 - start))
                    yield blob()
                    held, size, start = [], 0, i + 1
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield blob()

    name = f"papertrail_chunks_{uuid.uuid4().hex[:12]}"
    chunks = df.mapInArrow(sliced(run), ", ".join(["chunk long", *[f"{c} binary" for c in columns]]))
    (chunks.write.format("parquet").option("compression", "none").option("path", scratch_path(spark, "chunks"))
     .bucketBy(buckets, "chunk").saveAsTable(name))
    return spark.table(name)


def by_bucket(batches, columns: list[str]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition sorted by bucket, bucket by bucket."""
    held: list[dict] = []
    for b in batches:
        for r in b.select(columns).to_pylist():
            if held and r["bucket"] != held[0]["bucket"]:
                yield held[0]["bucket"], held
                held = []
            held.append(r)
    if held:
        yield held[0]["bucket"], held
