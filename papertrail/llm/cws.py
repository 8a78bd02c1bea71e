"""Document fingerprints by consistent weighted sampling.

A document is its words (ASCII letters lower-cased, split at ASCII white space) weighted by their counts.  For each
of ``SAMPLES`` draws every word has gamma variates r, c and a uniform b of its own, made from its hash; a
word of weight S gives t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1), and the draw's sample is the pair
(word, t) of least a.  Two documents draw the same sample with a probability equal to their generalised
Jaccard similarity, so the share of equal samples estimates it.  A fingerprint holds 16 bits of each sample.

Contract of :func:`fingerprint_edits`: one row per input row; null texts count as empty; a text without words has
the fingerprint of zeros, like only to its own kind; the next document is the next row by doc_id (nulls last), rows of one
doc_id by a hash of their text; a single row is its own next; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm import _util as U
from papertrail.session import materialize

#: Samples of a fingerprint; characters read at once; words drawn and rows compared at once.
SAMPLES = 64
CHARS = 1 << 22
BLOCK = 512

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: 64 well spread bits from a counter."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _uniform(words: np.ndarray, which: int) -> np.ndarray:
    """Uniform numbers in (0, 1): a row for each word hash, a column for each sample."""
    at = (np.arange(SAMPLES, dtype=np.uint64) * np.uint64(5) + np.uint64(which + 1)) * _STEP
    return ((_mix(words[:, None] + at) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52


def draws(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each (word hash, count) and sample: the order of ln a in the high half, its sample in the low 16 bits."""
    out = np.empty((len(words), SAMPLES), np.uint64)
    for i in range(0, len(words), BLOCK):
        w, n = words[i:i + BLOCK], counts[i:i + BLOCK]
        r = -np.log(_uniform(w, 0) * _uniform(w, 1))
        c = -np.log(_uniform(w, 2) * _uniform(w, 3))
        b = _uniform(w, 4)
        t = np.floor(np.log(n)[:, None] / r + b)
        a = (np.log(c) - r * (t - b + 1)).astype(np.float32).view(np.uint32).astype(np.uint64)
        order = np.where(a >> np.uint64(31), a ^ np.uint64(0xFFFFFFFF), a | np.uint64(0x80000000))
        sample = _mix(w[:, None] + _mix(t.astype(np.int64).view(np.uint64) + np.uint64(77))) & np.uint64(0xFFFF)
        out[i:i + BLOCK] = (order << np.uint64(32)) | np.maximum(sample, np.uint64(1))
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of ``SAMPLES`` 16-bit samples for each text; zeros for a text without words."""
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    found = [t.encode().lower().split() for t in texts]
    number = {w: i for i, w in enumerate(set().union(*found))} if found else {}
    if not number:
        return out
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
    sizes = np.array([len(f) for f in found], np.int64)
    flat = np.fromiter((number[w] for f in found for w in f), np.int64, int(sizes.sum()))
    pairs, counts = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(number) + flat, return_counts=True)
    text, word = np.divmod(pairs, len(number))
    most = int(counts.max()) + 1
    kinds, kind = np.unique(word * most + counts, return_inverse=True)
    table = draws(hashes[kinds // most], kinds % most)
    rows, first = np.unique(text, return_index=True)
    ends = np.append(first[1:], len(text))
    i = 0
    while i < len(rows):  # about BLOCK words at once, or one longer text in blocks
        j = max(i + 1, int(np.searchsorted(ends, first[i] + BLOCK, "right")))
        if j == i + 1:
            least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
            for k in range(first[i], ends[i], BLOCK):
                least = np.minimum(least, table[kind[k:min(k + BLOCK, ends[i])]].min(axis=0))
            out[rows[i]] = (least & np.uint64(0xFFFF)).astype(np.uint16)
        else:
            got = np.minimum.reduceat(table[kind[first[i]:ends[j - 1]]], first[i:j] - first[i], axis=0)
            out[rows[i:j]] = (got & np.uint64(0xFFFF)).astype(np.uint16)
        i = j
    return out


def hexed(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint for every row of ``df``."""
    U.share(df.sparkSession)

    def run(batches):
        for b in batches:
            for part in _parts([(d, t) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in part], pa.int64()), pa.array(hexed(fingerprints([t for _, t in part])))],
                    names=["doc_id", "fingerprint"])

    return U.texts(df, id_col, text_col).mapInArrow(U.sliced(run), "doc_id long, fingerprint string")


def _parts(rows: list[tuple]):
    """Runs of rows whose texts (last item) have about CHARS characters."""
    start = size = 0
    for i, r in enumerate(rows):
        size += len(r[-1])
        if size >= CHARS or i == len(rows) - 1:
            yield rows[start:i + 1]
            start, size = i + 1, 0


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by the beginning of the next one."""
    h = len(text) // 2
    return text[:len(text) - h] + following[:h]


def _compare(rows: list[tuple[int | None, str]], following: list[str]) -> list[pa.Array]:
    """Result columns of rows (doc_id, text) that ``following`` follow; a chain of rows shares fingerprints."""
    texts = [t for _, t in rows]
    new = [edited(t, n) for t, n in zip(texts, following)]
    chain = texts[1:] == following[:-1]
    both = fingerprints(texts + (following[-1:] if chain else following) + new)
    own = both[:len(texts)]
    nxt = both[1:len(texts) + 1] if chain else both[len(texts):2 * len(texts)]
    cut = both[-len(texts):]
    return [pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), pa.array(hexed(own)),
            pa.array(hexed(cut)), pa.array((own == cut).mean(axis=1)), pa.array((own == nxt).mean(axis=1))]


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint, that of its edited text, and the likeness of its own to that and to the next row's.

    Rows are range-partitioned by doc_id, so a row's next is beside it but at the ends of a partition; each
    partition hands on its first and last row, which are matched by partition number."""
    spark = df.sparkSession
    U.share(spark)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = (U.texts(df, id_col, text_col).repartitionByRange(U.parallelism(df), *order)
              .sortWithinPartitions(*order))
    names = [f.split()[0] for f in _RESULT.split(", ")]

    def walk(batches):
        pid = TaskContext.get().partitionId()

        def edge(kind, doc, text):
            cols = {n: None for n in names} | {"doc_id": doc, "kind": kind, "pid": pid, "text": text}
            return pa.RecordBatch.from_pylist([cols], schema=schema)

        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in names[2:5]),
                            ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kind", pa.int32()),
                            ("pid", pa.int32()), ("text", pa.string())])
        held = None
        for b in batches:
            rows = list(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()))
            if held is None and rows:
                yield edge(1, *rows[0])
            for part in _parts(rows):
                part = part if held is None else [held, *part]
                held = part[-1]
                if len(part) > 1:
                    cols = _compare(part[:-1], [t for _, t in part[1:]])
                    n = len(part) - 1
                    yield pa.RecordBatch.from_arrays(
                        cols + [pa.array([0] * n, pa.int32()), pa.array([pid] * n, pa.int32()),
                                pa.nulls(n, pa.string())], schema=schema)
        if held is not None:
            yield edge(2, *held)

    walked = materialize(ranged.mapInArrow(U.sliced(walk), f"{_RESULT}, kind int, pid int, text string"), "fingerprints")
    first = walked.where("kind = 1").select("pid", F.col("text").alias("next_text"))
    pids = sorted(r["pid"] for r in first.select("pid").collect())  # one number a partition
    after = spark.createDataFrame(list(zip(pids, pids[1:] + pids[:1])), "at int, pid int")
    last = (walked.where("kind = 2").select(F.col("pid").alias("at"), "doc_id", "text")
            .join(after, "at").join(first, "pid").select("doc_id", "text", "next_text"))

    def ends(batches):
        for b in batches:
            rows = list(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()))
            if rows:
                yield pa.RecordBatch.from_arrays(_compare(rows, b.column("next_text").to_pylist()), names=names)

    return walked.where("kind = 0").select(*names).unionByName(last.mapInArrow(U.sliced(ends), _RESULT))
