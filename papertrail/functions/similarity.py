"""Jaro and Jaro-Winkler similarity as higher-order column expressions (SIM-01/02).

Rules kept from the reference: both strings empty -> 1.0; match window is
max(len)//2 - 1, so two equal one-character strings score 0; each character of
s1 takes the first unused equal character of s2 inside the window;
transpositions are halved with integer division; the Winkler prefix is NOT
capped at four characters (scores can exceed 1).  NULL input gives NULL.
Characters are UTF-16 units (names outside the BMP are not expected).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from papertrail import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _chars(s: Column) -> Column:
    return F.split(s, "")


def bind(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and hand it to ``fn`` as a lambda variable.

    Column trees are inlined wherever they are referenced, so a value used
    several times would otherwise be recomputed each time."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


def _jaro_state(s1: Column, s2: Column) -> Column:
    """Greedy matching of s1 against s2; returns the final accumulator."""
    n2 = F.length(s2)
    init = F.struct(_chars(s1).alias("c1"), _chars(s2).alias("c2"),
                    (F.floor(F.greatest(F.length(s1), n2) / 2).cast("int") - 1).alias("d"),
                    F.array_repeat(F.lit(False), n2).alias("used"),
                    F.array().cast("array<string>").alias("m1"))
    empty_int = F.array().cast("array<int>")

    def step(acc, i):
        lo = F.greatest(F.lit(0), i - acc["d"])
        hi = F.least(i + acc["d"], F.size(acc["c2"]) - 1)
        window = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(empty_int)
        first = F.try_element_at(
            F.filter(window, lambda j: (acc["c2"][j] == acc["c1"][i]) & ~acc["used"][j]), F.lit(1))

        def take(j):
            return F.when(j.isNull(), acc).otherwise(F.struct(
                acc["c1"].alias("c1"), acc["c2"].alias("c2"), acc["d"].alias("d"),
                F.transform(acc["used"], lambda u, k: u | (k == j)).alias("used"),
                F.concat(acc["m1"], F.array(acc["c1"][i])).alias("m1")))
        return bind(first, take)

    def finish(acc):
        m2 = F.filter(acc["c2"], lambda ch, k: acc["used"][k])
        m = F.size(acc["m1"])
        t = F.floor(F.size(F.filter(F.zip_with(acc["m1"], m2, lambda a, b: a != b),
                                    lambda x: x)) / 2)
        n1, n2_ = F.size(acc["c1"]), F.size(acc["c2"])
        return F.when(m == 0, F.lit(0.0)).otherwise((m / n1 + m / n2_ + (m - t) / m) / 3.0)

    return F.aggregate(F.sequence(F.lit(0), F.length(s1) - 1), init, step, finish)


def jaro(s1, s2) -> Column:
    s1, s2 = _c(s1), _c(s2)
    n1, n2 = F.length(s1), F.length(s2)
    return (F.when(s1.isNull() | s2.isNull(), F.lit(None).cast("double"))
            .when((n1 == 0) & (n2 == 0), F.lit(1.0))
            .when((n1 == 0) | (n2 == 0), F.lit(0.0))
            .otherwise(_jaro_state(s1, s2)))


def common_prefix(s1, s2) -> Column:
    s1, s2 = _c(s1), _c(s2)
    n = F.least(F.length(s1), F.length(s2))
    eq = F.zip_with(_chars(s1), _chars(s2), lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.when(n == 0, F.lit(0)).otherwise(bind(
        F.array_position(eq, False),
        lambda p: F.when(p == 0, n).otherwise(F.least(p - 1, n)))).cast("int")


def jaro_winkler(s1, s2, scaling: float = K.WINKLER_SCALE) -> Column:
    p = common_prefix(s1, s2)
    return bind(jaro(s1, s2), lambda j: j + p * F.lit(scaling) * (F.lit(1.0) - j))


def jaro_py(s1: str, s2: str) -> float:
    """Plain-Python statement of the same rule, used only by tests as brute force."""
    if not s1 and not s2:
        return 1.0
    d = max(len(s1), len(s2)) // 2 - 1
    used = [False] * len(s2)
    m1 = []
    for i, ch in enumerate(s1):
        for j in range(max(0, i - d), min(i + d + 1, len(s2))):
            if not used[j] and s2[j] == ch:
                used[j] = True
                m1.append(ch)
                break
    m = len(m1)
    if m == 0:
        return 0.0
    m2 = [ch for ch, u in zip(s2, used) if u]
    t = sum(a != b for a, b in zip(m1, m2)) // 2
    return (m / len(s1) + m / len(s2) + (m - t) / m) / 3


def jaro_winkler_py(s1: str, s2: str, scaling: float = K.WINKLER_SCALE) -> float:
    j = jaro_py(s1, s2)
    p = 0
    for a, b in zip(s1, s2):
        if a != b:
            break
        p += 1
    return j + p * scaling * (1 - j)


# --- Arrow-batched forms (the fast path for large pair tables) ------------------
# Higher-order lambdas run interpreted in the JVM; here the pairs of an Arrow batch
# are matched side by side, one position of the first strings at a time.  Both forms
# compute the same rule and are cross-checked by the tests.

#: Characters of the code matrix that is worked on at once.
SLICE_CHARS = 1 << 17


def _codes(strings: list[str], width: int) -> np.ndarray:
    """Code points, a row for each string, zeros behind its end."""
    return np.array(strings, dtype=f"U{max(1, width)}").view(np.uint32).reshape(len(strings), -1)


def _scored(a: list[str], b: list[str], n1: np.ndarray, n2: np.ndarray, scaling: float | None) -> np.ndarray:
    """Scores of pairs whose longer strings have one length, so that one window holds for all."""
    longest = int(max(n1.max(), n2.max()))
    c1, c2 = _codes(a, longest), _codes(b, longest)
    if max(c1.max(), c2.max()) < 256:
        c1, c2 = c1.astype(np.uint8), c2.astype(np.uint8)
    at, rows = np.arange(c1.shape[1]), np.arange(len(a))
    inside1, inside2 = at < n1[:, None], at < n2[:, None]
    free, matched = inside2.copy(), np.zeros(inside1.shape, bool)
    d = longest // 2 - 1
    for i in range(int(n1.max())):
        lo, hi = max(0, i - d), min(i + d + 1, longest)
        if lo < hi:
            hit = (c2[:, lo:hi] == c1[:, i:i + 1]) & free[:, lo:hi]
            first = hit.argmax(1)
            found = hit[rows, first] & inside1[:, i]
            matched[:, i] = found
            free[rows[found], lo + first[found]] = False
    used = inside2 & ~free
    m = matched.sum(1)
    row1, i1 = np.nonzero(matched)  # by row, then place: the k-th match of a row lies at one place in both lists
    row2, i2 = np.nonzero(used)
    t = np.bincount(row1, c1[row1, i1] != c2[row2, i2], len(a)).astype(np.int64) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        j = np.where(m == 0, 0.0, (m / n1 + m / n2 + (m - t) / m) / 3)
    j = np.where((n1 == 0) & (n2 == 0), 1.0, j)
    if scaling is None:
        return j
    same = np.zeros((len(a), c1.shape[1] + 1), bool)
    same[:, :-1] = (c1 == c2) & inside1 & inside2
    return j + same.argmin(1) * scaling * (1 - j)


def score_pairs(a, b, scaling: float | None = None) -> np.ndarray:
    """Jaro of the strings in ``a`` and ``b``, pair by pair, or Jaro-Winkler with a ``scaling``."""
    a, b = np.asarray(a, dtype=object), np.asarray(b, dtype=object)
    n1, n2 = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out, longest = np.zeros(len(a)), np.maximum(n1, n2)
    order = np.argsort(longest, kind="stable")
    for rows in np.split(order, np.nonzero(np.diff(longest[order]))[0] + 1) if len(a) else ():
        step = max(1, SLICE_CHARS // max(1, int(longest[rows[0]])))
        for k in range(0, len(rows), step):
            r = rows[k:k + step]
            out[r] = _scored(a[r].tolist(), b[r].tolist(), n1[r], n2[r], scaling)
    return out


def _objects(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def _score_arrow(s1, s2, scaling: float | None) -> Column:

    @F.arrow_udf("double")
    def _score(a: pa.Array, b: pa.Array) -> pa.Array:
        null = np.asarray(pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False), bool)
        out = np.zeros(len(a))
        out[~null] = score_pairs(_objects(a)[~null], _objects(b)[~null], scaling)
        return pa.array(out, pa.float64(), mask=null)
    return _score(_c(s1), _c(s2))


def jaro_arrow(s1, s2) -> Column:
    return _score_arrow(s1, s2, None)


def jaro_winkler_arrow(s1, s2, scaling: float = K.WINKLER_SCALE) -> Column:
    return _score_arrow(s1, s2, scaling)


def best_index_arrow(names, target, scaling: float = K.WINKLER_SCALE,
                     lower_names: bool = True) -> Column:
    """0-based index of the first name with the strictly highest JW score
    against ``target``; NULL for an empty or NULL list."""

    @F.arrow_udf("int")
    def _best(ns: pa.Array, ts: pa.Array) -> pa.Array:
        each, row = _objects(ns.flatten()), pc.list_parent_indices(ns).to_numpy()
        place = np.arange(len(row)) - np.searchsorted(row, row)  # rows ascend
        goal = _objects(ts)[row]
        held = np.fromiter((x is not None and t is not None for x, t in zip(each, goal)), bool, len(row))
        each, row, place, goal = each[held], row[held], place[held], goal[held]
        who = [x.lower() for x in each] if lower_names else each
        score = score_pairs(who, goal, scaling)
        best = np.lexsort((place, -score, row))  # by row, the best first, the first of equals
        found, first = np.unique(row[best], return_index=True)
        out, null = np.zeros(len(ns), np.int32), np.ones(len(ns), bool)
        out[found], null[found] = place[best[first]], False
        return pa.array(out, pa.int32(), mask=null)
    return _best(_c(names), _c(target))
