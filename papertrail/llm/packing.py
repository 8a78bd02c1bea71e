"""Best-fit packing of documents into sequences by bin completion branch-and-bound.

Every document is its ids and a closing id; one that is longer than a sequence is cut into whole sequences and a
rest.  The search for fillings sees only how many pieces there are of each length (at most ``capacity``
numbers, whatever the corpus), so it runs on the driver; pieces then find their place by their rank
among those of their length, which Spark counts in two levels, so no length gathers its pieces in one task.

Search: around the longest piece left, fillings are listed by least waste, undominated ones only (no piece left fits
in as well or could replace one or two smaller ones in it); each is taken as often as its lengths allow, then half as
often, down to once.  A branch ends when its waste exceeds what the incumbent's number of sequences allows; the first
incumbent is best-fit decreasing, and the one cut is the number of fillings looked at in all (``NODES``).

Contract: null and empty texts are one piece with the closing id alone; repeated rows are each packed; an empty table
gives no rows; a null id stays null; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertrail.llm import _util as U
from papertrail.llm.word_encoder import encoder
from papertrail.session import materialize

#: Fillings that the search may look at, over all its branches, before it keeps its incumbent; steps of the path that
#: hold their rows of reachable totals; and pieces of one length that one task ranks.
NODES = 4_000
HELD = 64
RANKED = 50_000


def cut_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""
    U.share(df.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer_path)
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = enc.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return U.texts(df, id_col, text_col).mapInArrow(
        U.sliced(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Filling:
    """Sequences of one make: ``times`` of them, each with the lengths ``parts`` (longest first)."""
    parts: tuple[int, ...]
    times: int


def _largest(counts: np.ndarray, up_to: int) -> int:
    """The longest length with pieces left that is at most ``up_to``; 0 if there is none."""
    at = np.flatnonzero(counts[1:up_to + 1]) if up_to > 0 else ()
    return int(at[-1]) + 1 if len(at) else 0


class Completions:
    """Undominated fillings of ``gap`` from the pieces left, listed one by one: least waste first, then longest first.

    Rows of reachable totals (bit sets, one for each length and all shorter ones) lead the listing, so no step of it
    ends without a filling.  They can be let go and are made again when the listing goes on."""

    def __init__(self, counts: np.ndarray, gap: int):
        at = np.flatnonzero(counts[:gap + 1])
        self.lengths = [int(x) for x in at if x > 0]
        self.left = {x: int(counts[x]) for x in self.lengths}
        self.gap = gap
        self.rows: list[int] | None = None

    def _row(self, i: int) -> int:
        """Totals that the lengths up to place ``i`` can make, as bits."""
        if self.rows is None:
            row, mask = 1, (1 << (self.gap + 1)) - 1
            self.rows = [row]
            for x in self.lengths:
                n, step = min(self.left[x], self.gap // x), 1
                while n:
                    step = min(step, n)
                    row |= (row << (x * step)) & mask
                    n -= step
                    step *= 2
                self.rows.append(row)
        return self.rows[i + 1]

    def listed(self, waste: int):
        """(waste, filling) of all fillings that waste up to ``waste``; the filling is None where it is dominated."""
        last = len(self.lengths) - 1
        for lost in range(min(waste, self.gap) + 1):
            if not self._row(last) >> (self.gap - lost) & 1:
                continue
            todo: list[tuple[int, int, tuple]] = [(last, self.gap - lost, ())]
            while todo:
                i, total, chosen = todo.pop()
                if not total:
                    yield lost, None if self._dominated(chosen, lost) else tuple(x for x, n in chosen for _ in range(n))
                    continue
                x, below = self.lengths[i], self._row(i - 1)
                for n in range(min(self.left[x], total // x) + 1):  # the most of the longest is taken up first
                    if below >> (total - n * x) & 1:
                        todo.append((i - 1, total - n * x, (*chosen, (x, n)) if n else chosen))

    def _dominated(self, chosen: tuple, lost: int) -> bool:
        """Whether a piece that is left fits in as well, or could stand for one or two of the shorter pieces."""
        used = dict(chosen)
        short = [0, *used]
        for k, x in enumerate(short):
            for y in short[k:]:
                if x and x == y and used[x] < 2:
                    continue
                least = x + y  # x = 0: y alone, or nothing
                for at in range(bisect_left(self.lengths, least + (not x)), len(self.lengths)):
                    z = self.lengths[at]
                    if z > least + lost:
                        break
                    if self.left[z] > used.get(z, 0):
                        return True
        return False


def _take(counts: np.ndarray, parts: tuple[int, ...], most: int | None = None) -> int:
    """How often the filling can be taken, up to ``most`` times; takes it."""
    kinds = {x: parts.count(x) for x in set(parts)}
    times = min(int(counts[x]) // n for x, n in kinds.items())
    times = times if most is None else min(times, most)
    for x, n in kinds.items():
        counts[x] -= n * times
    return times


def best_fit(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Best-fit decreasing, taken in bulk: the longest piece, then ever the longest that still fits."""
    counts = counts.copy()
    out = []
    while top := _largest(counts, capacity):
        used, parts, room = {top: 1}, [top], capacity - top
        x = _largest(counts, min(room, top))
        while x:
            if counts[x] > used.get(x, 0):
                parts.append(x)
                used[x] = used.get(x, 0) + 1
                room -= x
                x = _largest(counts, min(room, x))
            else:
                x = _largest(counts, min(room, x - 1))
        out.append(Filling(tuple(parts), _take(counts, tuple(parts))))
    return out


def plan(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[Filling]:
    """Fillings for all pieces in as few sequences as the search finds; ``counts[n]``: pieces of length n."""
    total = int((counts * np.arange(len(counts))).sum())
    least = -(-total // capacity)
    best = best_fit(counts, capacity)
    count = sum(f.times for f in best)
    left = nodes

    def branches(rest, waste, made):
        """(parts, times, waste of one) around the longest piece left; None for each dominated filling."""
        top = _largest(rest, capacity)
        for lost, f in made.listed((count - 1) * capacity - total - waste):
            if f is None:
                yield None
                continue
            parts = (top, *f)
            times = _take(rest.copy(), parts)
            while times:  # fewer as well, so that the longest piece can have several fillings
                yield parts, times, lost
                times //= 2

    def node(rest, chain, n, waste):
        top = _largest(rest, capacity)
        others = rest.copy()
        others[top] -= 1
        made = Completions(others, capacity - top)
        return rest, chain, n, waste, made, branches(rest, waste, made)

    #: path of (pieces left, fillings so far as a chain, sequences, waste so far, its completions, its branches to come)
    path = [node(counts, None, 0, 0)] if count > least else []
    while path and left > 0 and count > least:
        rest, chain, n, waste, _, to_come = path[-1]
        branch = next(to_come, False)
        if branch is False:
            path.pop()
            continue
        left -= 1
        if branch is None:
            continue
        parts, times, lost = branch
        if waste + lost * times > (count - 1) * capacity - total:  # waste of a solution with a sequence less
            continue
        after = rest.copy()
        _take(after, parts, times)
        chain, n = (Filling(parts, times), chain), n + times
        if after.any():
            path.append(node(after, chain, n, waste + lost * times))
            if len(path) > HELD:
                path[-HELD - 1][4].rows = None
            continue
        best, count = [], n
        while chain:
            best.append(chain[0])
            chain = chain[1]
        best.reverse()
    return best


def _places(made: list[Filling], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> for each filling that has it: first rank, first sequence, pieces a sequence, first offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for f in made:
        offset = 0
        for x in dict.fromkeys(f.parts):
            n = f.parts.count(x)
            out.setdefault(x, []).append((taken.get(x, 0), first, n, offset))
            taken[x] = taken.get(x, 0) + n * f.times
            offset += n * x
        first += f.times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in out.items()}


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    spark = df.sparkSession
    rows = materialize(cut_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    held = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for x, n in held.items():
        counts[x] = n
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity), capacity))  # bounded by capacity

    parts = max(1, -(-max(held.values(), default=1) // RANKED))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = (dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
              .select("length", "part", "before"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (dealt.withColumn("own", F.row_number().over(own).cast("long") - 1)
              .join(before, ["length", "part"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank")))

    def run(batches):
        where = places.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                ranks, firsts, n, offsets = where[int(x)]
                k = np.searchsorted(ranks, rank[at], "right") - 1
                slot = rank[at] - ranks[k]
                seq[at] = firsts[k] + slot // n[k]
                off[at] = offsets[k] + slot % n[k] * x
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(seq), pa.array(off)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(U.sliced(run), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                  "sequence_id long, offset long")
