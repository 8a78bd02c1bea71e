"""Runs of repeated word groups, found by string synchronising sets.

A run is a stretch of words with smallest period q, at least ``max(min_words, 2 q)`` long, that neither neighbour
extends.  All documents of a batch are searched at once, as one array of word numbers that no match leaves:

* For each dyadic scale t, a hash of every block of t words picks positions: i is picked if the least hash among the
  blocks at i .. i + t stands at i or i + t.  Picking looks at the 2 t words from i only, so equal contexts are picked alike.
  Blocks inside highly periodic regions (period of up to t / 3) are left out of the choice, which keeps the set sparse.
* Two picked positions of a document with equal contexts of 2 t words and a distance of 3 t - 1 up to 6 t - 2 propose
  their distance as a period.  Such positions are more than t / 3 apart, so a position has a bounded number of partners.
* What is left out: period 1, found word by word before the first scale, and runs whose first period lies inside a highly
  periodic region.  Such a run lies where two regions with the same period and root meet; they are taken from the regions
  found before (small periods come first) and propose the distances that bring their roots in step.
* A proposal is extended to both sides by common extensions of prefix hashes.  Every run found is compared word by word
  in the end; should a hash have collided, the batch is searched anew with other bases.

Contract: null and empty texts have no words; repeated rows are each answered; a null id stays null; other columns are
not read; an empty table gives no rows.  A document is held whole by its task, other documents share the array.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papertrail.llm import _util as U

#: Words searched together, unless one document has more.
BATCH_WORDS = 1 << 17
MIN_WORDS = 12

_PRIMES = (2_147_483_647, 2_147_483_629)
_MAX = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Prefixes:
    """Hashes of all stretches of an array of word numbers, by two polynomials."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.n = len(words)
        self.powers, self.sums = [], []
        for p in _PRIMES:
            base = int(rng.integers(1 << 20, p - 1))
            power = np.ones(self.n + 1, np.int64)
            done = 1
            while done <= self.n:
                m = min(done, self.n + 1 - done)
                power[done:done + m] = power[:m] * pow(base, done, p) % p
                done += m
            terms = (words + 1) % p * power[:-1] % p
            # sums of 2^31 terms below 2^31 stay below 2^62
            self.sums.append(np.concatenate([np.zeros(1, np.int64), np.cumsum(terms) % p]))
            self.powers.append(power)
        self.wheel = np.full(self.n + 1, int(rng.integers(1 << 62)) | 1, np.uint64)
        self.wheel[0] = 1
        self.wheel = np.cumprod(self.wheel)
        mixed = words.astype(np.uint64) * _MIX
        mixed = (mixed ^ mixed >> np.uint64(32)) * self.wheel[:-1]
        self.rough = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        self.wheel = self.wheel[::-1].copy()

    def keys(self, n: int, length: int) -> np.ndarray:
        """A number for the ``length`` words at each of the first n places; equal words have equal numbers, others
        differ but for a few, which is enough to pick positions by."""
        return (self.rough[length:length + n] - self.rough[:n]) * self.wheel[:n]

    def blocks(self, at: np.ndarray, length: int) -> np.ndarray:
        """One number for each stretch of ``length`` words; equal stretches have equal numbers."""
        out = None
        for p, s, w in zip(_PRIMES, self.sums, self.powers):
            x = (s[at + length] - s[at]) % p * w[self.n - at] % p
            out = x if out is None else out << 31 | x
        return out.view(np.uint64)

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from a and those from b > a agree for ``length`` words."""
        out = None
        for p, s, w in zip(_PRIMES, self.sums, self.powers):
            x = (s[a + length] - s[a]) % p * w[b - a] % p == (s[b + length] - s[b]) % p
            out = x if out is None else out & x
        return out

    def right(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from a and b > a on, ``most`` at the most."""
        return self._longest(lambda k, n: self.same(a[k], b[k], n), most)

    def left(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree before a and b > a."""
        return self._longest(lambda k, n: self.same(a[k] - n, b[k] - n, n), most)

    @staticmethod
    def _longest(agree, most: np.ndarray) -> np.ndarray:
        """Doubling steps until one fails, then halving."""
        got = np.zeros(len(most), np.int64)
        todo = np.flatnonzero(most > 0)
        step, limit = 1, []
        while len(todo):
            n = np.minimum(got[todo] + step, most[todo])
            ok = agree(todo, n)
            got[todo[ok]] = n[ok]
            limit.append(todo[~ok])
            todo = todo[ok & (n < most[todo])]
            step *= 2
        for k in range(len(limit) - 1, -1, -1):  # failed at step 2^k: between got and got + 2^k - 1
            part = np.concatenate(limit[k:])
            limit[k:] = [part]
            half = (1 << k) >> 1
            if half and len(part):
                n = got[part] + half
                fits = n <= most[part]
                ok = fits.copy()
                ok[fits] = agree(part[fits], n[fits])
                got[part[ok]] = n[ok]
        return got


def _spans(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Marks the places first .. last - 1 of every pair."""
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, first, 1)
    np.add.at(edges, last, -1)
    return np.cumsum(edges[:-1]) > 0


def _inside(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ..."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), once for each stretch, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)][:len(runs)]]


def _of_period_one(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    last = np.ones(len(words), bool)  # the last word of each stretch of equal words
    last[:-1] = (words[1:] != words[:-1]) | (ends[1:] != ends[:-1])
    stop = np.flatnonzero(last) + 1
    start = np.r_[0, stop[:-1]]
    long = stop - start >= 2
    return np.stack([start[long], stop[long], np.ones(int(long.sum()), np.int64)], 1)


def synchronising_set(hashes: Prefixes, ends: np.ndarray, runs: np.ndarray, scale: int) -> np.ndarray:
    """Positions picked at a scale, among the words whose document's ends are given; ``runs``: all of smaller period."""
    n = len(ends)
    if n < 2 * scale:
        return np.zeros(0, np.int64)
    key = hashes.keys(n - scale + 1, scale)
    key = (key ^ key >> np.uint64(29)) * _MIX >> np.uint64(1)
    periodic = runs[(runs[:, 2] * 3 <= scale) & (runs[:, 1] - runs[:, 0] >= scale) & (runs[:, 0] + scale <= n)]
    if len(periodic):
        key[_spans(periodic[:, 0], np.minimum(periodic[:, 1] - scale + 1, len(key)), len(key))] = _MAX
    least, width = key, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])  # over scale + 1 blocks
    m = len(least)
    picked = (least != _MAX) & ((key[:m] == least) | (key[scale:scale + m] == least))
    picked &= np.arange(m) + 2 * scale <= ends[:m]
    return np.flatnonzero(picked)


def _proposals(hashes: Prefixes, ends: np.ndarray, at: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of picked positions of one document with equal contexts and a distance of this scale."""
    context = hashes.blocks(at, 2 * scale) + ends[at].astype(np.uint64) * _MIX
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    first, second = [], []
    k = np.arange(len(at) - 1)
    m = 1
    while len(k):
        k = k[k + m < len(at)]
        near = (context[k] == context[k + m]) & (at[k + m] - at[k] < 6 * scale - 1) & (ends[at[k]] == ends[at[k + m]])
        k = k[near]
        far = at[k + m] - at[k] >= max(2, 3 * scale - 1)
        first.append(at[k[far]])
        second.append(at[k[far] + m])
        m += 1
    return (np.concatenate(first), np.concatenate(second)) if first else (at[:0], at[:0])


def _extended(hashes: Prefixes, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The stretches with period b - a around the pairs, where they are two periods long."""
    order = np.lexsort((a, b - a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)  # of pairs in one stretch the first is extended
    k = np.flatnonzero((b[1:] - a[1:] == b[:-1] - a[:-1]) & (starts[a[1:]] == starts[a[:-1]]))
    fresh[k[hashes.same(a[k], b[k], a[k + 1] - a[k] + 1)] + 1] = False
    a, b = a[fresh], b[fresh]
    stop = b + hashes.right(a, b, ends[b] - b)
    start = a - hashes.left(a, b, a - starts[a])
    long = stop - start >= 2 * (b - a)
    return np.stack([start, stop, b - a], 1)[long]


def _meeting(words: np.ndarray, starts: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that bring two meeting regions of one period and root in step."""
    regions = runs[runs[:, 1] - runs[:, 0] >= 8 * runs[:, 2]]
    regions = regions[np.lexsort((regions[:, 0], regions[:, 2]))]
    first, second = [], []
    same = (regions[1:, 2] == regions[:-1, 2]) & (regions[1:, 0] <= regions[:-1, 1])
    for k in np.flatnonzero(same):
        (s1, e1, p), (s2, e2, _) = regions[k].tolist(), regions[k + 1].tolist()
        if starts[s1] != starts[s2]:
            continue
        root, once = words[s2:s2 + p], words[s1:s1 + 2 * p]
        shift = next((r for r in np.flatnonzero(once[:p] == root[0]).tolist() if (once[r:r + p] == root).all()), None)
        if shift is None:
            continue
        q = np.arange((s2 - s1 - shift) % p, min(e1 - s1, e2 - s2, (e2 - s1) // 2) + 1, p)
        q = q[q >= 8 * p]
        first.append(np.maximum(s1, s2 - q))
        second.append(np.maximum(s1, s2 - q) + q)
    if not first:
        return runs[:0, 0], runs[:0, 0]
    return np.concatenate(first), np.concatenate(second)


def _holds(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, runs: np.ndarray) -> bool:
    """Whether the runs hold word by word and neither neighbour extends them."""
    s, e, q = runs.T
    before = s > starts[s]
    after = e < ends[s]
    if (words[s[before] - 1] == words[s[before] - 1 + q[before]]).any():
        return False
    if (words[e[after]] == words[e[after] - q[after]]).any():
        return False
    size = e - s - q
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // (8 * BATCH_WORDS))) + 1
    for part in np.split(np.arange(len(runs)), cuts):
        at = _inside(s[part], size[part])
        if (words[at] != words[at + np.repeat(q[part], size[part])]).any():
            return False
    return True


def find(words: np.ndarray, lengths: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, end, period) of all runs, by places in ``words``: documents of ``lengths`` words, longest first."""
    words = words.astype(np.int64)
    stop = np.cumsum(lengths)
    ends = np.repeat(stop, lengths)
    starts = np.repeat(stop - lengths, lengths)
    for seed in itertools.count():
        hashes = Prefixes(words, seed)
        runs = _of_period_one(words, ends)
        scale = 1
        while True:
            docs = int(np.searchsorted(-lengths, -(6 * scale - 2), "right"))  # two of the shortest periods fit in
            n = int(stop[docs - 1]) if docs else 0
            if n < 6 * scale - 2:
                break
            at = synchronising_set(hashes, ends[:n], runs, scale)
            a, b = _proposals(hashes, ends, at, scale)
            if len(a):
                runs = _least_periods(np.concatenate([runs, _extended(hashes, starts, ends, a, b)]))
            scale *= 2
        a, b = _meeting(words, starts, runs)
        if len(a):
            runs = _least_periods(np.concatenate([runs, _extended(hashes, starts, ends, a, b)]))
        runs = runs[runs[:, 1] - runs[:, 0] >= min_words]
        if _holds(words, starts, ends, runs):
            return runs
    raise AssertionError("unreachable")


Edit = Callable[[int | None, list[bytes]], list[bytes]]


class Document:
    """Words of a text (as UTF-8) and its runs as (start, length, period), by start, then period."""

    __slots__ = ("doc_id", "words", "runs")

    def __init__(self, doc_id: int | None, words: list[bytes]):
        self.doc_id, self.words = doc_id, words
        self.runs: list[tuple[int, int, int]] = []

    def kept(self) -> list[bytes]:
        """The words without those that a run holds after its first period."""
        if not self.runs:
            return self.words
        s, n, q = np.array(self.runs, np.int64).T
        drop = _spans(s + q, s + n, len(self.words))
        return [w for w, x in zip(self.words, drop.tolist()) if not x]


def _search(docs: list[Document], min_words: int) -> None:
    """Fills in the runs of all documents."""
    long = sorted((d for d in docs if len(d.words) >= min_words), key=lambda d: -len(d.words))
    if not long:
        return
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    lengths = np.array([len(d.words) for d in long], np.int64)
    words = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(d.words for d in long)), np.int64,
                        int(lengths.sum()))
    runs = find(words, lengths, min_words)
    stop = np.cumsum(lengths)
    of = np.searchsorted(stop, runs[:, 0], "right")
    for k, (s, e, q) in zip(of.tolist(), runs[np.lexsort((runs[:, 2], runs[:, 0]))].tolist()):
        long[k].runs.append((s - int(stop[k] - lengths[k]), e - s, q))


def _documents(batches, edit: Edit | None, min_words: int):
    """Lists of searched documents, about BATCH_WORDS words each."""
    held: list[Document] = []
    size = 0
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            words = text.as_py().encode().split()  # bytes: white space is \x20 and \x09 to \x0D
            d = Document(doc_id, edit(doc_id, words) if edit else words)
            if held and size + len(d.words) > BATCH_WORDS:
                _search(held, min_words)
                yield held
                held, size = [], 0
            held.append(d)
            size += len(d.words)
    if held:
        _search(held, min_words)
        yield held


def _mapped(df: DataFrame, id_col: str, text_col: str, edit: Edit | None, min_words: int, rows, schema: str,
            kinds: list[pa.DataType]) -> DataFrame:
    U.share(df.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for docs in _documents(batches, edit, min_words):
            cols = list(zip(*(r for d in docs for r in rows(d)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return U.texts(df, id_col, text_col).mapInArrow(run, schema)


def runs(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
         edit: Edit | None = None) -> DataFrame:
    """doc_id, start, length, period: one row for each run; ``edit`` may change the words of a document before."""
    return _mapped(df, id_col, text_col, edit, min_words, lambda d: [(d.doc_id, *r) for r in d.runs],
                   "doc_id long, start long, length long, period long", [pa.int64()] * 4)


def collapse(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
             edit: Edit | None = None) -> DataFrame:
    """doc_id, text: the kept words of every text, joined by one space."""
    return _mapped(df, id_col, text_col, edit, min_words, lambda d: [(d.doc_id, b" ".join(d.kept()).decode())],
                   "doc_id long, text string", [pa.int64(), pa.string()])


def _digest(d: Document) -> list[tuple]:
    top = max(d.runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in d.runs)
    return [(d.doc_id, len(d.runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
             hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(d.kept())).hexdigest())]


def summary(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
            edit: Edit | None = None) -> DataFrame:
    """One row per document: n_runs, the longest run (ties: smallest start, then period) with its exponent in
    thousandths, digests of all runs and of the collapsed text."""
    return _mapped(df, id_col, text_col, edit, min_words, _digest,
                   "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                   "runs_sha256 string, collapsed_sha256 string", [pa.int64()] * 6 + [pa.string()] * 2)
