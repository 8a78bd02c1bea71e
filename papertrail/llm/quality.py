"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network and a
temperature fitted on rows kept apart.

Words are the parts of every stretch of visible text: letters, digits, marks, plus one word for its shape and
one for a stretch that repeats its predecessor.  Each word has a sparse ternary index vector drawn from its hash; its word
vector adds up the index vectors around it in the sampled documents.  A document is the mean of its word vectors and
the largest and smallest means of its segments.

What is fitted sees a bounded sample: the ``SAMPLE`` labelled rows of least hash among those the caller allows.  Every
row of the input is scored over its whole text.

Contract: one row per input row; null and empty texts get the score of a document without words; repeated
rows are each scored alike; a null id stays null; other columns are not read.  A document with several labels
counts by the least one; rows without a label are not learnt from.  With no usable label every score is 0.5, with one
class of labels it is that class's smoothed share.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm import _util as U

#: Labelled rows learnt from at most, parts that count them, words hashed to buckets, vector length, +1/-1 entries,
#: words on either side that form a vector, and stretches in a segment.
SAMPLE = 6_000
SAMPLE_PARTS = 4
BUCKETS = 1 << 14
DIMS = 48
ENTRIES = 4
WINDOW = 2
SEGMENT = 48
HIDDEN = 24
EPOCHS = 400
PREDICT_FROM = 0.7
REMEMBERED = 200_000

_PART = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors of all buckets, drawn from a fixed seed."""
    rng = np.random.default_rng(20_011)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for k in range(ENTRIES):
        out[np.arange(BUCKETS), rng.integers(0, DIMS, BUCKETS)] += np.where(rng.random(BUCKETS) < 0.5, -1, 1)
    return out


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _shape(stretch: str, parts: list[str]) -> str:
    """Case, number of marks and length class of a stretch, as a word no text can hold."""
    case = "upper" if len(stretch) > 1 and stretch.isupper() else "lower" if stretch.islower() else \
        "title" if stretch[0].isupper() else "none"
    marks = 0 if stretch.isalnum() else sum(len(p) for p in parts if not p.isalnum())
    return f" shape {case} {min(marks, 3)} {min(len(stretch).bit_length(), 6)}"


REPEAT = " repeat"


class Reader:
    """Stretches of text as numbers; the buckets of each stretch's words are worked out once."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.buckets: list[list[int]] = []
        self.words: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        if word not in self.words:
            self.words[word] = _bucket(word)
        return self.words[word]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of all texts in a row, and how many each text has."""
        found = [t.encode().split() for t in texts]
        number = self.number
        for s in set().union(*found) - number.keys():
            t = s.decode()
            number[s] = len(self.buckets)
            parts = _PART.findall(t)
            self.buckets.append([*(self._bucket(x.lower()) for x in parts), self._bucket(_shape(t, parts))])
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((number[x] for f in found for x in f), np.int32, int(sizes.sum()))
        return flat, sizes


def slices(texts: list[str], most: int = 1 << 21):
    """Runs of texts of about ``most`` characters, or one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            yield texts[start:i + 1]
            start, size = i + 1, 0


def context_sums(texts: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the index vectors around the words of each bucket, and how often each was met."""
    sums, met = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, np.int64)
    order = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :ENTRIES]
    value = np.take_along_axis(index, order, axis=1)
    for part in slices(texts):
        reader = Reader()
        flat, sizes = reader.numbers(part)
        each = np.array([len(b) for b in reader.buckets], np.int64)
        first = np.cumsum(each) - each
        all_buckets = np.fromiter((x for b in reader.buckets for x in b), np.int64, int(each.sum()))
        n = each[flat]
        words = all_buckets[np.repeat(first[flat], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        doc = np.repeat(np.repeat(np.arange(len(part)), sizes), n)
        met += np.bincount(words, minlength=BUCKETS)
        for step in range(1, WINDOW + 1):
            same = doc[:-step] == doc[step:]
            a, b = words[:-step][same], words[step:][same]
            for x, y in ((a, b), (b, a)):
                for k in range(ENTRIES):
                    sums += np.bincount(x * DIMS + order[y, k], weights=value[y, k], minlength=BUCKETS * DIMS)
    return sums.reshape(BUCKETS, DIMS), met


def word_vectors(sums: np.ndarray, met: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Unit word vectors: own index vector and the contexts' direction without what all words share."""
    seen = met > 0
    context = np.zeros_like(sums)
    context[seen] = sums[seen] / np.sqrt(met[seen])[:, None]
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    context = np.divide(context, norm, out=context, where=norm > 0)
    if seen.any():
        context[seen] -= np.average(context[seen], axis=0, weights=met[seen])
    out = context + index / np.sqrt(ENTRIES)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


class Pooler:
    """Pooled vectors of texts; remembers the vector of each stretch."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.repeat = vectors[_bucket(REPEAT)]
        self._forget()

    def _forget(self) -> None:
        self.reader = Reader()
        self.table = np.zeros((0, DIMS), np.float32)

    def _fill(self) -> None:
        new = self.reader.buckets[len(self.table):]
        if new:
            n = np.array([len(b) for b in new], np.int64)
            rows = self.vectors[np.fromiter((x for b in new for x in b), np.int64, int(n.sum()))]
            self.table = np.concatenate([self.table, np.add.reduceat(rows, np.cumsum(n) - n) / n[:, None].astype(np.float32)])

    def _pool(self, texts: list[str]) -> np.ndarray:
        if len(self.reader.buckets) > REMEMBERED:
            self._forget()
        flat, sizes = self.reader.numbers(texts)
        self._fill()
        out = np.zeros((len(texts), 3 * DIMS + 1), np.float32)
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        sizes = sizes[some]
        begin = np.cumsum(sizes) - sizes
        again = np.zeros(len(flat), np.float32)
        again[1:] = flat[1:] == flat[:-1]
        again[begin] = 0
        of = -(-sizes // SEGMENT)  # segments of each text
        first = np.cumsum(of) - of
        starts = np.repeat(begin, of) + (np.arange(of.sum()) - np.repeat(first, of)) * SEGMENT
        ends = np.append(starts[1:], len(flat))
        sums = np.empty((len(starts), DIMS), np.float32)
        for i in range(0, len(starts), 4096):  # bounded, however long a text is
            a, b = starts[i], ends[min(i + 4096, len(starts)) - 1]
            sums[i:i + 4096] = np.add.reduceat(self.table[flat[a:b]], starts[i:i + 4096] - a, axis=0)
        sums += np.add.reduceat(again, starts)[:, None] * self.repeat
        means = sums / np.maximum(ends - starts, SEGMENT // 4)[:, None].astype(np.float32)
        out[some, :DIMS] = np.add.reduceat(sums, first, axis=0) / sizes[:, None]
        out[some, DIMS:2 * DIMS] = np.maximum.reduceat(means, first, axis=0)
        out[some, 2 * DIMS:3 * DIMS] = np.minimum.reduceat(means, first, axis=0)
        out[some, 3 * DIMS] = np.log1p(sizes)
        return out

    def pool(self, texts: list[str]) -> np.ndarray:
        """A row for each text."""
        return np.concatenate([np.zeros((0, 3 * DIMS + 1), np.float32), *map(self._pool, slices(texts))])


@dataclass
class Model:
    """Word vectors, scaling, both layers and the temperature."""
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum((pooled - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -60, 60)))


def fit(vectors: np.ndarray, pooled: np.ndarray, labels: np.ndarray, apart: np.ndarray) -> Model:
    """Train both layers by Adam on the rows not kept apart; fit the temperature on those kept apart."""
    f = pooled.shape[1] if pooled.size else 3 * DIMS + 1
    blank = Model(vectors, np.zeros(f), np.ones(f), np.zeros((f, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    if len(set(labels.tolist())) < 2:
        if len(labels):
            blank.b2 = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        return blank
    if len(set(labels[~apart].tolist())) < 2 or not apart.any():
        apart = np.zeros(len(labels), bool)
    x, y = pooled[~apart].astype(np.float64), labels[~apart].astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(7)
    p = [rng.normal(0, np.sqrt(2 / f), (f, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, EPOCHS + 1):
        pre = x @ p[0] + p[1]
        h = np.maximum(pre, 0)
        err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -60, 60))) - y) / len(y)
        back = np.outer(err, p[2]) * (pre > 0)
        grads = [x.T @ back + 1e-3 * p[0], back.sum(axis=0), h.T @ err + 1e-3 * p[2], np.array([err.sum()])]
        for a, g, mi, vi in zip(p, grads, m, v):
            mi += 0.1 * (g - mi)
            vi += 0.001 * (g * g - vi)
            a -= 0.01 * (mi / (1 - 0.9 ** t)) / (np.sqrt(vi / (1 - 0.999 ** t)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    held = apart if apart.any() else ~apart
    z, y = model.logits(pooled[held]), labels[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    loss = [np.logaddexp(0, np.where(y == 1, -z, z) / t).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, labels: DataFrame, allowed, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from the ``sample`` labelled rows of least hash for which the column expression ``allowed``
    (over ``doc_id``) holds."""
    spark = docs.sparkSession
    U.share(spark)
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).where(allowed)
              .groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    keys = {r["doc_id"]: r["label"] for r in chosen.collect()}  # at most ``sample`` pairs
    if not keys:
        index = index_vectors()
        return fit(word_vectors(np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS, np.int64), index),
                   np.zeros((0, 3 * DIMS + 1), np.float32), np.zeros(0, int), np.zeros(0, bool))
    wanted = spark.createDataFrame(list(keys.items()), "doc_id long, label int")
    rows = (U.texts(docs, id_col, text_col).join(F.broadcast(wanted), "doc_id")
            .select("doc_id", "label", "text").repartition(SAMPLE_PARTS, "doc_id"))

    def count(batches):
        index = index_vectors()
        sums, met = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS, np.int64)
        for b in batches:
            s, n = context_sums(b.column("text").to_pylist(), index)
            sums += s
            met += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([sums.astype(np.float32).tobytes()], pa.binary()), pa.array([met.tobytes()], pa.binary())],
            names=["sums", "met"])

    sums, met = np.zeros((BUCKETS, DIMS)), np.zeros(BUCKETS, np.int64)
    for r in rows.mapInArrow(U.sliced(count), "sums binary, met binary").toLocalIterator():  # SAMPLE_PARTS rows
        sums += np.frombuffer(r["sums"], np.float32).reshape(BUCKETS, DIMS)
        met += np.frombuffer(r["met"], np.int64)
    vectors = word_vectors(sums, met, index_vectors())
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches):
        pooler = Pooler(shared.value)
        for b in batches:
            pooled = [x.tobytes() for x in pooler.pool(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(pooled, pa.binary())],
                                             names=["doc_id", "label", "pooled"])

    got = rows.mapInArrow(U.sliced(pool), "doc_id long, label int, pooled binary").collect()
    got = sorted({(r["doc_id"], r["label"], bytes(r["pooled"])) for r in got})[:2 * sample]  # repeated rows once
    pooled = np.array([np.frombuffer(r[2], np.float32) for r in got], np.float32).reshape(len(got), -1)
    apart = np.array([zlib.crc32(f"apart {r[0]}".encode()) % 5 == 0 for r in got], bool)
    return fit(vectors, pooled, np.array([r[1] for r in got], int), apart)


#: The model that this worker scores with, and its pooler.
_POOLERS: list[tuple[Model, Pooler]] = []


def _pooler(model: Model) -> Pooler:
    """The pooler of this very model; the model is held, so no later one can take its identity."""
    if not _POOLERS or _POOLERS[0][0] is not model:
        _POOLERS[:] = [(model, Pooler(model.vectors))]
    return _POOLERS[0][1]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = PREDICT_FROM, keep: bool = False) -> DataFrame:
    """doc_id, score, predicted for every row of ``df``; with ``keep`` the rows of ``df`` predicted 1."""
    spark = df.sparkSession
    U.share(spark)
    shared = spark.sparkContext.broadcast(model)  # a few MB, fixed by BUCKETS and DIMS

    def of(texts: list[str]) -> np.ndarray:
        m = shared.value
        return m.scores(_pooler(m).pool(texts))

    if keep:
        at = df.columns.index(text_col)

        def kept(batches):
            for b in batches:
                if b.num_rows:
                    good = of([t or "" for t in b.column(at).to_pylist()]) >= threshold
                    yield b.filter(pa.array(good))
        return df.mapInArrow(U.sliced(kept), df.schema)

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = of(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"])

    return U.texts(df, id_col, text_col).mapInArrow(U.sliced(run), "doc_id long, score double, predicted int")
