"""N-gram language model in Elias-Fano tries, counted and queried in shards.

Words are told apart by 64-bit hashes (XXH64, seed 0).  A text is split once: a chunk of the corpus keeps the numbers of its
tokens in its own list of words.  Each chunk sends its words to the words' shards, which add up their counts in training rows and
give every word a number, small for frequent words.  Then it sends, for every order above one, its distinct n-grams as such
numbers, with their counts, to the shard of their context; the shard adds them up, builds a trie of its contexts
and their successors and answers every n-gram it was sent.  A trie level is two monotone sequences in Elias-Fano form (the
contexts' successors, each put above those of the contexts before it, and the pointers to where a context's begin),
with a byte for each successor's discounted log probability and one for each context's back-off weight.  Levels lie in a
memory-mapped file; a query finds its context, then the successor within that context's range.

Probability of a word w after a context h: a(h, w) + b(h) P(w | shorter context), a = max(c(hw) - D, 0) / c(h),
b = D * distinct successors / c(h), both as quantised; without a context (c + 1) / (N + V + 1), so an unknown word has
1 / (N + V + 1).  The first context of a document is a begin mark; its end is a token.

Contract of :func:`score`: one row per input row; null and empty texts are the end token alone; repeated rows count
each time; a null id never trains unless ``training`` says so; other columns are not read.  Without training rows N = 0 and
every probability is 1.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail.llm import _util as U
from papertrail.llm import chunks
from papertrail.session import materialize

#: Order of the model, discount, characters of text in a chunk.
ORDER = 3
DISCOUNT = 0.75
CHUNK = 1 << 23

#: Bytes of a quantised value: 0 is "not there", 1..255 are log10 from 0 down in these steps.
STEP_SUCCESSOR = 10 / 254
STEP_BACKOFF = 5 / 254

#: Number of the begin mark, hash of the end.
_BEGIN = 0
_END = np.uint64(0x27D4EB2F165667C5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def quantise(p: np.ndarray, step: float) -> np.ndarray:
    """Probabilities in (0, 1] as bytes 1..255; zero stays 0."""
    out = np.zeros(len(p), np.uint8)
    some = p > 0
    out[some] = 1 + np.minimum(254, np.rint(-np.log10(p[some]) / step)).astype(np.uint8)
    return out


def restored(q: np.ndarray, step: float) -> np.ndarray:
    return np.where(q > 0, 10.0 ** (-(q.astype(np.float64) - 1) * step), 0.0)


# ---------------------------------------------------------------- compact levels


class EliasFano:
    """A monotone sequence of integers: low bits packed, high bits in unary with a count every 512 bits.

    ``arrays`` are what it needs; they may lie in a memory-mapped file."""

    SPAN = 64  # bytes of high bits between two counts

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.bits, self.n = int(arrays["shape"][0]), int(arrays["shape"][1])

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) // 8 + 1) if n else 0, np.uint8)
        np.bitwise_or.at(high, at // 8, (1 << (at % 8)).astype(np.uint8))
        low = np.zeros(0, np.uint8)
        if bits and n:
            spread = (v[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
            low = np.packbits(spread.ravel(), bitorder="little")
        padded = np.append(high, np.zeros(-len(high) % EliasFano.SPAN, np.uint8))
        ones = np.cumsum(np.bitwise_count(padded).reshape(-1, EliasFano.SPAN).sum(axis=1, dtype=np.int64))
        return {"low": low, "high": high, "ones": np.append(0, ones), "shape": np.array([bits, n], np.int64)}

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop``; reads the part of the level that holds them."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        block = int(np.searchsorted(self.ones, start, "right")) - 1
        end = int(np.searchsorted(self.ones, stop, "left"))
        part = np.unpackbits(np.asarray(self.high[block * self.SPAN:end * self.SPAN]), bitorder="little")
        at = np.flatnonzero(part)[start - int(self.ones[block]):stop - int(self.ones[block])] + block * self.SPAN * 8
        out = (at - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            first = start * self.bits
            raw = np.unpackbits(np.asarray(self.low[first // 8:(stop * self.bits + 7) // 8]), bitorder="little")
            raw = raw[first % 8:first % 8 + (stop - start) * self.bits].reshape(-1, self.bits)
            low = np.zeros(stop - start, np.uint64)
            for k in range(self.bits):
                low |= raw[:, k].astype(np.uint64) << np.uint64(k)
            out |= low
        return out


class Level:
    """Contexts and their successors in a memory-mapped file."""

    BLOCK = 1 << 16  # contexts read at once

    def __init__(self, contexts: np.ndarray, first: np.ndarray, words: np.ndarray, successor: np.ndarray,
                 backoff: np.ndarray):
        """``contexts`` (sorted) and where the successors of each begin; successors (vocabulary ranks, sorted in each
        context) with the bytes of their probabilities, and a byte a context."""
        self.vocabulary = int(words.max()) + 1 if len(words) else 1
        of = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(np.append(first, len(words))))
        parts = {"successors": EliasFano.build(of * np.uint64(self.vocabulary) + words.astype(np.uint64)),
                 "pointers": EliasFano.build(np.append(first, len(words)).astype(np.uint64)),
                 "contexts": EliasFano.build(contexts)}
        plain = {"successor": successor, "backoff": backoff}
        self.file = tempfile.TemporaryFile()
        place: dict[tuple[str, str], tuple[int, np.dtype, int]] = {}
        for name, arrays in [*parts.items(), ("plain", plain)]:
            for k, a in arrays.items():
                self.file.write(b"\0" * (-self.file.tell() % 8))
                place[name, k] = (self.file.tell(), a.dtype, len(a))
                self.file.write(np.ascontiguousarray(a).tobytes())
        self.file.flush()

        def mapped(key):
            at, kind, n = place[key]
            return np.memmap(self.file, kind, "r", at, (n,)) if n else np.zeros(0, kind)

        self.successors, self.pointers, self.contexts = (
            EliasFano({k: mapped((name, k)) for k in parts[name]}) for name in ("successors", "pointers", "contexts"))
        self.successor, self.backoff = mapped(("plain", "successor")), mapped(("plain", "backoff"))

    def query(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of (successor, back-off) for pairs sorted by context; 0 where there is none."""
        a, b = np.zeros(len(contexts), np.uint8), np.zeros(len(contexts), np.uint8)
        done = 0
        for c in range(0, self.contexts.n, self.BLOCK):
            held = self.contexts.slice(c, min(c + self.BLOCK, self.contexts.n))
            stop = len(contexts) if c + self.BLOCK >= self.contexts.n else \
                int(np.searchsorted(contexts, held[-1], "right"))
            if stop <= done:
                continue
            q = slice(done, stop)
            at = np.minimum(np.searchsorted(held, contexts[q]), len(held) - 1)
            known = held[at] == contexts[q]
            b[q] = np.where(known, self.backoff[c:c + len(held)][at], 0)
            start = self.pointers.slice(c, c + len(held) + 1).astype(np.int64)
            values = self.successors.slice(int(start[0]), int(start[-1]))
            want = (at + c).astype(np.uint64) * np.uint64(self.vocabulary) + words[q].astype(np.uint64)
            pos = np.minimum(np.searchsorted(values, want), len(values) - 1)
            hit = known & (words[q] >= 0) & (values[pos] == want)  # successor within the context's range
            a[q] = np.where(hit, self.successor[int(start[0]):int(start[-1])][pos], 0)
            done = stop
        return a, b

    def close(self) -> None:
        self.file.close()


def build_level(contexts: np.ndarray, words: np.ndarray, counts: np.ndarray, discount: float) -> tuple[Level, np.ndarray]:
    """The level of distinct n-grams sorted by (context, word) with counts above zero; the vocabulary of ``words``."""
    vocabulary, rank = np.unique(words, return_inverse=True)
    new = np.ones(len(contexts), bool)
    new[1:] = contexts[1:] != contexts[:-1]
    first = np.flatnonzero(new)
    total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
    distinct = np.diff(np.append(first, len(contexts)))
    successor = (counts - discount) / np.repeat(total, distinct)
    return Level(contexts[first], first, rank, quantise(successor, STEP_SUCCESSOR),
                 quantise(discount * distinct / total, STEP_BACKOFF)), vocabulary


# ---------------------------------------------------------------- chunks


def _planes(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 as their lowest bytes, then their second ones and so on: small numbers compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def read_chunk(table: pa.Table) -> list[bytes]:
    """Rows (doc_id, train, number of tokens), words (hashes from the most frequent on, counts in training rows) and tokens
    (numbers of words, each row's end included) of a chunk."""
    number: dict[bytes, int] = {}
    each = []  # a text's words go as soon as they are numbered
    for t in table.column("text").to_pylist():
        found = t.encode().lower().split()
        each.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
    sizes = np.array([len(f) + 1 for f in each], np.int64)  # with the end
    token = np.full(int(sizes.sum()), len(number), np.int32)
    inside = np.ones(len(token), bool)
    inside[np.cumsum(sizes) - 1] = False
    token[inside] = np.concatenate([np.zeros(0, np.int32), *each])
    del each
    hashes = np.append(np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number)), _END)
    train = np.array(table.column("train").to_pylist(), bool)
    count = np.bincount(token, weights=np.repeat(train, sizes), minlength=len(hashes)).astype(np.int64)
    by = np.argsort(-np.bincount(token, minlength=len(hashes)), kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    rows = pa.table({"doc_id": table.column("doc_id"), "train": pa.array(train), "size": pa.array(sizes)})
    return [chunks.stored(rows), chunks.packed(word=hashes[by], count=_planes(count[by])),
            chunks.packed(token=_planes(place[token]))]


def _shard(name: np.ndarray, buckets: int) -> np.ndarray:
    return (((name >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _by_shard(shard: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings a shard's items together, and where each shard's begin."""
    small = shard.astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # sorted by radix
    return (np.argsort(small, kind="stable"),
            np.append(0, np.cumsum(np.bincount(shard, minlength=buckets))))


def _context_names(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit names of contexts, given by a column of word numbers a place."""
    name = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        name = _mix(name * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(len(columns) + 1))
    return name


class Grams:
    """A chunk's distinct n-grams by shard, context and word: a column of word numbers for each place of the contexts, the
    n-grams of each context, their last words, their counts in training rows; which one each token is (``of``)."""

    def __init__(self, columns, size, word, count, of, buckets):
        by, self.context_cut = _by_shard(_shard(_context_names(columns), buckets), buckets)
        first = np.cumsum(size) - size
        self.columns, self.size = [c[by] for c in columns], size[by]
        at = np.repeat(first[by] - (np.cumsum(self.size) - self.size), self.size) + np.arange(len(word))
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        self.word, self.count, self.of = word[at], count[at], place[of]
        self.cut = np.append(0, np.cumsum(self.size))[self.context_cut]

    def sent(self) -> list[tuple[int, bytes]]:
        """What each shard is sent; the contexts' first words lie in ascending order there."""
        out = []
        for i in np.flatnonzero(np.diff(self.cut)).tolist():
            c, g = slice(*self.context_cut[i:i + 2]), slice(*self.cut[i:i + 2])
            places = {f"place{k}": _planes(np.diff(x[c], prepend=0) if k == 0 else x[c]) for k, x in enumerate(self.columns)}
            out.append((i, chunks.packed(**places, size=_planes(self.size[c]), word=_planes(self.word[g]),
                                         count=_planes(self.count[g]))))
        return out

    @staticmethod
    def received(blob: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Columns and sizes of the contexts, words and counts of the n-grams."""
        got = {k: _numbers(v) for k, v in chunks.unpacked(blob).items()}
        columns = [got[f"place{k}"] for k in range(len(got) - 3)]
        columns[0] = np.cumsum(columns[0])
        return columns, got["size"].astype(np.int64), got["word"], got["count"].astype(np.int64)


class Chunk:
    """Rows of a chunk, counts of its words and its distinct n-grams of each order above one."""

    def __init__(self, rows: bytes, words: bytes, tokens: bytes, answers: list[bytes], order: int, buckets: int):
        """``answers`` of the shards of words, in the order of the shards."""
        table = chunks.rows(rows)
        self.doc = table.column("doc_id").combine_chunks()
        self.train, self.sizes = (np.asarray(table.column(c).to_pylist()) for c in ("train", "size"))
        by, _ = _by_shard(_shard(chunks.unpacked(words)["word"], buckets), buckets)
        got = [chunks.unpacked(a) for a in answers]
        number, count = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        number[by] = np.concatenate([_numbers(g["number"]) for g in got])
        count[by] = np.concatenate([_numbers(g["count"]) for g in got])
        rank = np.argsort(number, kind="stable")  # from here a word is its rank by number, so n-grams sort like numbers
        self.number, self.count = number[rank], count[rank]
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.of = place[_numbers(chunks.unpacked(tokens)["token"]).astype(np.int64)]
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.order, self.buckets = order, buckets

    def grams(self):
        """:class:`Grams` of each order from 2 on."""
        weight = np.repeat(self.train, self.sizes)
        words = len(self.number)
        columns, of = [self.number], self.of  # of the n-grams one shorter, sorted
        for _ in range(2, self.order + 1):
            context = np.empty(len(of), np.int64)  # the n-gram before, from 1; 0: begin marks alone
            context[1:] = of[:-1] + 1
            context[self.begin] = 0
            distinct, of = np.unique(context * words + self.of, return_inverse=True)
            before, word = np.divmod(distinct, words)
            first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
            held = before[first]
            places = [np.where(held > 0, c[held - 1], _BEGIN) for c in columns]
            size = np.diff(np.append(first, len(distinct)))
            count = np.bincount(of, weights=weight, minlength=len(distinct)).astype(np.int64)
            yield Grams(places, size, self.number[word], count, of, self.buckets)
            columns = [*(np.repeat(p, size) for p in places), self.number[word]]


def _packed_rows(bucket: int, rows: list[dict], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()),
         pa.array(blobs, pa.binary()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())],
        names=["chunk", "bucket", "answers", "tokens", "words"])


_ANSWERS = "chunk long, bucket long, answers binary, tokens long, words long"


def _word_answers(table: DataFrame, order: int, buckets: int, parts: int) -> DataFrame:
    """chunk, bucket, answers for every part of a chunk's words: their counts and numbers; and a row without chunk for each
    shard, with the training tokens and distinct words it holds."""

    def send(batches):
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("words").to_pylist()):
                got = chunks.unpacked(data)
                by, cut = _by_shard(_shard(got["word"], buckets), buckets)
                word, count = got["word"][by], _numbers(got["count"])[by]
                some = np.flatnonzero(np.diff(cut))
                blobs = [chunks.packed(word=word[cut[i]:cut[i + 1]], count=_planes(count[cut[i]:cut[i + 1]])) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some * order, pa.int64()), pa.array([chunk] * len(some), pa.int64()),
                     pa.array(blobs, pa.binary())], names=["bucket", "chunk", "grams"])

    def judge(batches):
        for bucket, rows in chunks.by_bucket(batches, ["bucket", "chunk", "grams"]):
            got = [chunks.unpacked(r["grams"]) for r in rows]
            names, of = np.unique(np.concatenate([g["word"] for g in got]), return_inverse=True)
            count = np.bincount(of, weights=np.concatenate([_numbers(g["count"]) for g in got])).astype(np.int64)
            number = np.empty(len(names), np.int64)
            number[np.argsort(-count, kind="stable")] = 1 + np.arange(len(names)) * buckets + bucket // order
            cuts = np.cumsum([len(g["word"]) for g in got])[:-1]
            yield _packed_rows(bucket, rows, [chunks.packed(count=_planes(x), number=_planes(y)) for x, y in
                                              zip(np.split(count[of], cuts), np.split(number[of], cuts))])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.array([bucket], pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([int(count.sum())], pa.int64()), pa.array([int((count > 0).sum())], pa.int64())],
                names=["chunk", "bucket", "answers", "tokens", "words"])

    sent = table.select("chunk", "words").mapInArrow(U.sliced(send, 1), "bucket long, chunk long, grams binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(U.sliced(judge, 1), _ANSWERS)


def _answers(table: DataFrame, order: int, discount: float, buckets: int, parts: int) -> DataFrame:
    """chunk, bucket, answers for every part of a chunk's n-grams of orders above one; ``table`` has the answers of the
    shards of words, too."""

    def send(batches):
        for b in batches:
            for r in b.to_pylist():
                c = Chunk(*_cells(r, order), order, buckets)
                for n, g in enumerate(c.grams(), 2):
                    some, blobs = zip(*g.sent())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(some) * order + n - 1, pa.int64()), pa.array([r["chunk"]] * len(some), pa.int64()),
                         pa.array(blobs, pa.binary())], names=["bucket", "chunk", "grams"])

    def successors(rows):
        names, words, counts, sizes = [], [], [], []
        for r in rows:
            columns, size, w, x = Grams.received(r["grams"])
            names.append(np.repeat(_context_names(columns), size))
            words.append(w)
            counts.append(x)
            sizes.append(size)
        cuts = np.cumsum([len(x) for x in counts])[:-1]
        context, word, count = np.concatenate(names), np.concatenate(words), np.concatenate(counts)
        del names, words, counts
        by = np.lexsort((word, context))
        c, w = context[by], word[by]
        del context, word
        new = np.ones(len(by), bool)
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(count[by], first)
        del count
        c, w = c[first], w[first]
        seen = total > 0
        a, b = np.zeros(len(c), np.uint8), np.zeros(len(c), np.uint8)
        if seen.any():
            level, vocabulary = build_level(c[seen], w[seen], total[seen], discount)
            rank = np.minimum(np.searchsorted(vocabulary, w), len(vocabulary) - 1)
            a, b = level.query(c, np.where(vocabulary[rank] == w, rank, -1))
            level.close()
        of = np.empty(len(by), np.int64)
        of[by] = np.cumsum(new) - 1
        return [chunks.packed(successor=x, backoff=y[np.cumsum(z) - z])  # a context has one back-off weight
                for x, y, z in zip(np.split(a[of], cuts), np.split(b[of], cuts), sizes)]

    def judge(batches):
        for bucket, rows in chunks.by_bucket(batches, ["bucket", "chunk", "grams"]):
            yield _packed_rows(bucket, rows, successors(rows))

    sent = table.mapInArrow(U.sliced(send, 1), "bucket long, chunk long, grams binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(U.sliced(judge, 1), _ANSWERS)


def _with_answers(table: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """The chunks with the list of their answers; the chunks are not moved."""
    back = (answers.where("chunk IS NOT NULL").repartition(parts, "chunk").groupBy("chunk")
            .agg(F.collect_list(F.struct("bucket", "answers")).alias("answers")))
    return table.hint("merge").join(back, "chunk")


def _cells(row: dict, order: int) -> tuple[bytes, bytes, bytes, list[bytes]]:
    """What :class:`Chunk` is made of."""
    got = {r["bucket"]: r["answers"] for r in row["answers"]}
    return row["rows"], row["words"], row["tokens"], [got[k] for k in sorted(got) if k % order == 0]


def score(df: DataFrame, training: Column, order: int = ORDER, discount: float = DISCOUNT, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row of ``df``; rows for which
    ``training`` (over doc_id) holds are learnt from."""
    spark = df.sparkSession
    U.share(spark)
    parts = U.parallelism(df)
    buckets = parts
    rows = U.texts(df, id_col, text_col).withColumn("train", F.coalesce(training, F.lit(False)))
    table = chunks.chunked(rows, "text", parts, CHUNK, read_chunk, ("rows", "words", "tokens"))
    words = materialize(_word_answers(table, order, buckets, parts), "answers")
    total = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()
    tokens, vocabulary = total["n"], total["v"]
    answers = words
    if order > 1:
        answers = words.unionByName(_answers(_with_answers(table, words, parts), order, discount, buckets, parts))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c = Chunk(*_cells(r, order), order, buckets)
                got = {x["bucket"]: x["answers"] for x in r["answers"]}
                p = ((c.count + 1) / (tokens + vocabulary + 1))[c.of]
                base = np.add.reduceat(np.log10(p), c.begin)
                known = np.add.reduceat((c.count > 0)[c.of].astype(np.int64), c.begin)
                for n, g in enumerate(c.grams(), 2):
                    blobs = [chunks.unpacked(got[k]) for k in sorted(x for x in got if x % order == n - 1)]
                    a = restored(np.concatenate([x["successor"] for x in blobs]), STEP_SUCCESSOR)
                    back_off = np.concatenate([x["backoff"] for x in blobs])
                    weight = np.repeat(np.where(back_off > 0, restored(back_off, STEP_BACKOFF), 1.0), g.size)
                    p = a[g.of] + weight[g.of] * p
                value = np.add.reduceat(np.log10(np.minimum(p, 1.0)), c.begin)
                yield pa.RecordBatch.from_arrays(
                    [c.doc, pa.array(c.train), pa.array(c.sizes), pa.array(known),
                     pa.array(np.full(len(c.sizes), tokens)), pa.array(base), pa.array(value)],
                    names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _with_answers(table, answers, parts).mapInArrow(
        U.sliced(run, 1), "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
