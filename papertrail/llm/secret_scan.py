"""Secret scan: fixed patterns, plus random strings told from identifiers by two character Markov models.

Both models are first-order chains over the characters of candidate runs.  The one of random strings is
counted on the labelled samples that the fixed patterns give (their spans, of ``assign`` the value), the one of
ordinary identifiers on all other text.  What a run leaves outside the fixed spans is a secret when its total
log-likelihood ratio reaches a threshold that grows with its length and is never below a least total.

Contract: one row per input row; null and empty texts have no spans; repeated rows are each scanned; a
null id stays null; other columns are not read.  With no labelled sample at all the random model is uniform.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm import _util as U

#: Patterns of the contract.  For ``access`` and ``hex`` the least length is part of the
#: pattern, which keeps the same matches (both take maximal runs).
PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII)),
    ("access", re.compile(r"AKIA[A-Z0-9]{16,}")),
    ("hex", re.compile(r"[0-9a-f]{24,}")),
]
ASSIGN_LEAST = 6
KINDS = ["assign", "access", "hex", "random"]

#: Runs that the models judge, the least length of a part judged, and its least log-likelihood ratio (nats): for each
#: character, and in total, which binds parts under 10 characters.
LEAST = 8
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
THRESHOLD = 1.2
TOTAL = 12.0
#: Weight of single-character frequencies in each row of a chain.
PRIOR = 8.0

#: Characters of the chains; class 0 is every other byte and the border of a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
_CLASS = np.zeros(256, np.int64)
_CLASS[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, STATES)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind as listed."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if kind != "assign" or len(m[2]) >= ASSIGN_LEAST:
                out.append((m.start(), k, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def labelled(text: str) -> list[str]:
    """Samples of secrets: the values of the fixed patterns, overlapping ones as one."""
    found = sorted(m.span(2) if kind == "assign" else m.span() for kind, pattern in PATTERNS
                   for m in pattern.finditer(text) if kind != "assign" or len(m[2]) >= ASSIGN_LEAST)
    out: list[list[int]] = []
    for a, b in found:
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [text[a:b] for a, b in out]


def pair_counts(data: bytes) -> np.ndarray:
    """Counts of neighbouring character classes, borders of runs included."""
    c = np.zeros(len(data) + 2, np.int64)
    c[1:-1] = _CLASS[np.frombuffer(data, np.uint8)]
    return np.bincount(c[:-1] * STATES + c[1:], minlength=STATES * STATES)


def log_ratio(pairs: dict[tuple[bool, int], int]) -> np.ndarray:
    """log P(next | previous) of the random model less that of the identifier model, from pair counts."""
    logs = []
    for secret in (True, False):
        n = np.zeros((STATES, STATES))
        for (label, pair), count in pairs.items():
            if label == secret:
                n[divmod(pair, STATES)] = max(count, 0)
        n = n[:, 1:]  # from the border too, never to it
        single = n.sum(axis=0) + 0.5
        mixed = n + PRIOR * single / single.sum()  # a rare predecessor falls back on single characters
        logs.append(np.log(mixed / mixed.sum(axis=1, keepdims=True)))
    out = np.zeros((STATES, STATES))
    out[:, 1:] = logs[0] - logs[1]
    return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The table of log ratios, from pair counts over all rows: at most 2 * STATES^2 rows reach the driver."""
    U.share(df.sparkSession)

    def count(batches):
        secret, all_ = np.zeros(STATES * STATES, np.int64), np.zeros(STATES * STATES, np.int64)
        for b in batches:
            rows = b.column("text").to_pylist()
            found = [x for t in rows for x in labelled(t)]
            secret += pair_counts("\n".join(found).encode())
            all_ += pair_counts("\n".join(rows).encode())
        for label, n in ((True, secret), (False, all_ - secret)):
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), label)), pa.array(at.astype(np.int32)), pa.array(n[at])],
                    names=["secret", "pair", "n"])

    rows = (U.texts(df, id_col, text_col).mapInArrow(U.sliced(count), "secret boolean, pair int, n long")
            .groupBy("secret", "pair").agg(F.sum("n").alias("n")).collect())
    return log_ratio({(r["secret"], r["pair"]): r["n"] for r in rows})


def _outside(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Parts of runs outside the spans ``base`` (by start), of at least ``LEAST`` characters."""
    out = []
    for m in RUN.finditer(text):
        at, b = m.span()
        for _, s, e in base:
            if s >= b:
                break
            if e > at:
                if s - at >= LEAST:
                    out.append((at, s))
                at = e
        if b - at >= LEAST:
            out.append((at, b))
    return out


def totals(parts: list[str], ratio: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each part in total."""
    c = _CLASS[np.frombuffer(("\n" + "\n".join(parts)).encode(), np.uint8)]
    size = np.array([len(p) + 1 for p in parts], np.int64)
    return np.add.reduceat(ratio[c[:-1], c[1:]], np.cumsum(size) - size)  # a step to a border counts 0


def find(text: str, ratio: np.ndarray, threshold: float = THRESHOLD, total: float = TOTAL) -> tuple[list[Span], list[Span]]:
    """(spans of the fixed patterns, all spans) of one text."""
    base = base_spans(text)
    parts = _outside(text, base)
    if not parts:
        return base, base
    least = np.maximum(total, threshold * np.array([b - a for a, b in parts]))
    hit = totals([text[a:b] for a, b in parts], ratio) >= least
    more = [("random", *parts[i]) for i in np.flatnonzero(hit)]
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]))) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame, ratio: np.ndarray | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for every row of ``df``."""
    U.share(df.sparkSession)
    ratio = train(df, id_col, text_col) if ratio is None else ratio

    def run(batches):
        for b in batches:
            found = [find(t, ratio, threshold) for t in b.column("text").to_pylist()]
            n = [pa.array([sum(s[0] == k for s in every) for _, every in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *n,
                 pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([joined(every) for _, every in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return U.texts(df, id_col, text_col).mapInArrow(
        U.sliced(run), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def blank(text: str, spans: list[Span], mark: str) -> str:
    """The text with each stretch of touching or overlapping spans replaced by ``mark``."""
    out, at = [], 0
    stretch: list[list[int]] = []
    for _, a, b in spans:
        if stretch and a <= stretch[-1][1]:
            stretch[-1][1] = max(stretch[-1][1], b)
        else:
            stretch.append([a, b])
    for a, b in stretch:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, ratio: np.ndarray | None = None, threshold: float = THRESHOLD, mark: str = "<secret>",
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the secrets in its text column replaced by ``mark``; other columns and null texts stay."""
    U.share(df.sparkSession)
    ratio = train(df, id_col, text_col) if ratio is None else ratio
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            rows = b.column(at).to_pylist()
            new = [t if t is None else blank(t, find(t, ratio, threshold)[1], mark) for t in rows]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return df.mapInArrow(U.sliced(run), df.schema)
