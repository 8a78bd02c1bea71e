"""Token counts by batch encoding; only lengths leave the Python workers.

Contract of :func:`token_counts`: one row per input row; null and empty texts have zero tokens; repeated rows
are each counted; a null id stays null; other columns of the input are not read.  Special strings inside
a text are one token each, as the library's default has it.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame

from papertrail.llm import _util as U

#: Bytes of text handed to the library at once, and distinct pieces that a worker remembers.
BATCH_BYTES = 1 << 18
REMEMBERED = 400_000
#: Longer pieces are counted each time instead of being remembered.
LONG_PIECE = 256


class LengthCounter:
    """Counts tokens of texts from the lengths of their pieces; equal pieces are encoded once."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.batch_bytes = batch_bytes
        self.known: dict[str, int] = {"": 0}

    def _encode(self, batch: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def _learn(self, wanted: set[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        batch: list[str] = []
        size = 0
        for p in wanted:
            batch.append(p)
            size += len(p)
            if size >= self.batch_bytes:
                out.update(zip(batch, self._encode(batch)))
                batch, size = [], 0
        out.update(zip(batch, self._encode(batch)))
        return out

    def lengths(self, texts: list[str]) -> list[int]:
        cut = [U.pieces(t) for t in texts]
        wanted = set().union(*cut) - self.known.keys() if cut else set()
        if len(self.known) + len(wanted) > REMEMBERED:
            self.known = {"": 0}
            wanted = set().union(*cut) - {""}
        new = self._learn(wanted)
        self.known.update(new)
        out = [sum(map(self.known.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > LONG_PIECE:
                del self.known[p]
        return out


_COUNTERS: dict[tuple[str, int], LengthCounter] = {}


def _counter(path: str, batch_bytes: int) -> LengthCounter:
    """One counter per worker process and vocabulary."""
    key = (path, batch_bytes)
    if key not in _COUNTERS:
        _COUNTERS[key] = LengthCounter(path, batch_bytes)
    return _COUNTERS[key]


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of ``df``."""
    U.share(df.sparkSession)

    def run(batches):
        counter = _counter(tokenizer_path, batch_bytes)
        for b in batches:
            rows = b.column("text").to_pylist()
            n = []
            start = size = 0
            for i, t in enumerate(rows):  # slices of about as many bytes each
                size += len(t)
                if size >= 4 * batch_bytes or i == len(rows) - 1:
                    n += counter.lengths(rows[start:i + 1])
                    start, size = i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in rows], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return U.texts(df, id_col, text_col).mapInArrow(
        U.sliced(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
