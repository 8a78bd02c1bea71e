"""SimHash near-duplicates by vantage-point trees.

Two 64-bit fingerprints that differ in at most ``2 t + 1`` bits differ in at most t bits of one of their halves, so
links are searched in two vantage-point trees, one for each half, with radius t there.  A tree, grown over a sample,
splits fingerprints at a median Hamming distance from a vantage point; a fingerprint whose distance is so near the bound
that the triangle inequality lets a partner lie beyond it goes to both sides.  The leaves are Spark's shards; inside one
the same splitting goes on until blocks are small, and pairs of a block are compared exactly.  Each shard hands on a
spanning forest of its links, never its pairs; components come from alternating star contractions.

Contract of :func:`near_duplicates`: one row per input row; null and empty texts have fingerprint zero; equal
fingerprints are linked; component_id is the least non-null doc_id of the component; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm import _util as U
from papertrail.session import materialize

#: Words of a shingle, seed of its hash, most differing bits of a link.
SHINGLE = 3
SEED = 42
BITS = 3
#: Fingerprints a shard should hold, those one task compares at most, sample rows for each leaf of a tree, block size.
LEAF = 20_000
MOST = 100_000
PER_LEAF = 32
BLOCK = 256
#: Hashes unpacked at once.
HASHES = 1 << 17


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Bit-wise majority of the hashes of all word shingles; zero without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        begin = (end - size + 1)[:len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begin, end[shingle - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES):
        part = np.array(hashes[i:i + HASHES], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), text_hash for every row of ``df``."""
    U.share(df.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), b.column("text_hash")],
                                             names=["doc_id", "fp", "text_hash"])

    return (U.texts(df, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
            .mapInArrow(U.sliced(run), "doc_id long, fp long, text_hash long"))


def _distance(a: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ v)


def grow(sample: np.ndarray, leaves: int) -> list[tuple]:
    """A vantage-point tree over half-fingerprints as a list of nodes (point, bound, inner child, outer child); a child
    below zero is leaf -child - 1."""
    nodes: list = []
    made = 0
    rng = np.random.default_rng(1)

    def build(points: np.ndarray, want: int) -> int:
        nonlocal made
        if want > 1 and len(points) > 1:
            v = points[rng.integers(len(points))]
            d = _distance(points, v)
            bound = int(np.median(d))
            if bound == d.max():
                bound -= 1
            if bound >= 0:
                inner = points[d <= bound]
                at = len(nodes)
                nodes.append(None)
                part = max(1, min(want - 1, round(want * len(inner) / len(points))))
                nodes[at] = (v, bound, build(inner, part), build(points[d > bound], want - part))
                return at
        made += 1
        return -made

    root = build(sample, leaves)
    return nodes if root >= 0 else []


def route(tree: list[tuple], half: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every half; of two within ``radius`` on either side of a bound, the inner one goes to both."""
    rows, leaves = [], []
    todo = [(0 if tree else -1, np.arange(len(half)))]
    while todo:
        node, at = todo.pop()
        if node < 0:
            rows.append(at)
            leaves.append(np.full(len(at), -node - 1))
            continue
        v, bound, inner, outer = tree[node]
        d = _distance(half[at], v)
        todo.append((inner, at[d <= bound]))
        todo.append((outer, at[d > bound - radius]))  # beyond, or a partner may be beyond
    return np.concatenate(rows), np.concatenate(leaves)


class Forest:
    """Union-find over positions; the root is the least position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        for x, y in zip(a.tolist(), b.tolist()):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            while up[y] != y:
                up[y] = up[up[y]]
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        return up


def _block_links(fp: np.ndarray, at: np.ndarray, bits: int, forest: Forest) -> None:
    """Compare all pairs of a block, rows at a time; every row is joined to the first of its partners."""
    for i in range(0, len(at), BLOCK):
        rows = at[i:i + BLOCK]
        for j in range(i, len(at), 64 * BLOCK):
            cols = at[j:j + 64 * BLOCK]
            near = np.bitwise_count(fp[rows][:, None] ^ fp[cols][None, :]) <= bits
            a, b = np.nonzero(near)
            keep = rows[a] < cols[b]
            a, b = rows[a[keep]], cols[b[keep]]
            if len(a):
                forest.join(a, b)


def shard_links(fp: np.ndarray, bits: int) -> np.ndarray:
    """For sorted distinct fingerprints: the position of the least one each is linked to, over both halves' trees.

    Splitting goes on by distances in the half first, radius bits // 2, then by whole distances."""
    forest = Forest(len(fp))
    low = fp & np.uint64(0xFFFFFFFF)
    rng = np.random.default_rng(2)
    for half in (low, fp >> np.uint64(32)):
        todo = [(np.arange(len(fp)), False, 0)]
        while todo:
            at, whole, failed = todo.pop()
            if len(at) <= BLOCK or failed >= 3:
                if whole or len(at) <= BLOCK:
                    _block_links(fp, at, bits, forest)
                else:
                    todo.append((at, True, 0))
                continue
            space, radius = (fp, bits) if whole else (half, bits // 2)
            d = _distance(space[at], space[at[rng.integers(len(at))]])
            bound = int(np.median(d)) - (1 if int(np.median(d)) == d.max() else 0)
            inner, outer = at[d <= bound], at[d > bound - radius]
            if max(len(inner), len(outer)) > 0.95 * len(at):
                todo.append((at, whole, failed + 1))
            else:
                todo += [(inner, whole, 0), (outer, whole, 0)]
    return forest.roots()


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """src, dst (dst below src, both unsigned order as signed longs): spanning forests of the links between the distinct
    fingerprints in column ``fp``."""
    spark = fps.sparkSession
    n = fps.count()
    leaves = max(1, -(-n // LEAF))
    share = min(1.0, 4.0 * PER_LEAF * leaves / max(n, 1))
    sample = np.array([r["fp"] for r in fps.select("fp").where(
        F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        .orderBy(F.xxhash64("fp", F.lit(1))).limit(PER_LEAF * leaves).collect()], np.int64).view(np.uint64)
    mask = np.uint64(0xFFFFFFFF)
    trees = spark.sparkContext.broadcast([grow(sample & mask, leaves), grow(sample >> np.uint64(32), leaves)])

    def deal(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for side, half in enumerate((fp & mask, fp >> np.uint64(32))):
                rows, leaf = route(trees.value[side], half, bits // 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf.astype(np.int64) * 2 + side), pa.array(fp[rows].view(np.int64))], names=["leaf", "fp"])

    dealt = materialize(fps.select("fp").mapInArrow(deal, "leaf long, fp long"), "shards")
    # A leaf of too many is compared in pairs of parts.
    big = dealt.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / MOST).cast("int").alias("parts"))
    cut = (dealt.join(big, "leaf").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
           .select("leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(pdf["fp"].to_numpy().view(np.uint64))
        root = shard_links(fp, bits)
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"src": fp[own].view(np.int64), "dst": fp[root[own]].view(np.int64)})

    return cut.groupBy("leaf", "a", "b").applyInPandas(compare, "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the undirected edges (src, dst): alternating large and small stars, each round
    written to the shared folder, until no edge changes."""
    now = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"),
                                                       F.least("src", "dst").alias("dst")).distinct(), "edges")
    last = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")),
                                                           F.lit(0)).alias("h")).first()
        if (seen["n"], seen["h"]) == last:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        last = (seen["n"], seen["h"])
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min(F.least("src", "dst")).alias("m"))
        large = (both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
                 .where("src <> dst").distinct())
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src")
        now = materialize(
            small.select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
            .union(small.select("src", F.col("m").alias("dst"))).distinct(), "edges")


def _classes(df: DataFrame, bits: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_hash) of every row; (fp, root) of every distinct fingerprint."""
    rows = materialize(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(links(fps, bits))
    return rows, (fps.join(linked, fps["fp"] == linked["node"], "left")
                  .select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(df: DataFrame, bits: int = BITS, shingle: int = SHINGLE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``df``."""
    rows, classes = _classes(df, bits, shingle, id_col, text_col)
    of = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return (rows.join(classes.join(of, "root").select("fp", "component_id"), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(df: DataFrame, bits: int = BITS, shingle: int = SHINGLE, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``df`` of which no near-duplicate has a smaller doc_id: one row of each group, all columns kept."""
    rows, classes = _classes(df, bits, shingle, id_col, text_col)
    first = (rows.join(classes.select("fp", "root"), "fp").groupBy("root")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("m"))
             .select(F.col("m.doc_id").alias("_doc"), F.col("m.text_hash").alias("_hash")).distinct())
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
                      F.col(id_col).cast("long").alias("_doc"),
                      F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"))
    on = keyed["_doc"].eqNullSafe(first["_doc"]) & (keyed["_hash"] == first["_hash"])
    return keyed.join(first, on, "left_semi").dropDuplicates(["_doc", "_hash"]).select("row.*")
