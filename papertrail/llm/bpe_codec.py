"""Byte-level BPE encoding and decoding with DuckDB recursive queries per partition.

Distinct words (matches of the split pattern) of a batch become rows (word, position, token) in an
in-memory DuckDB.  A recursive query joins neighbouring tokens with the merge table and contracts the
leftmost pair of least rank of each word until none is left; an ordered aggregation gives the ids, another one
over the vocabulary the bytes.  Texts are put together from their words.

Contract of :func:`bpe_round_trip`: one row per input row; null and empty texts give no ids and the hash
of nothing; repeated rows are each encoded; a null id stays null; other columns are not read.

A long word is cut into spans that the query encodes like words of their own; then neighbours are joined, two by two, until
one is left.  Ids in a row are the encoding of their bytes exactly if each two neighbours are that of theirs (the first merge
across a boundary would happen in the pair alone as well), so a seam is settled by encoding the few tokens around it
again until the pairs at both ends of these hold.  The work grows with the word's length.  Only a seam that does not settle
within 2^23 bytes would be an error (rank and two positions share one integer).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papertrail.llm import _util as U

#: Token rows that a query may make and bytes of long words per query; pieces and words that a worker remembers
#: in each of two generations.
QUERY_ROWS = 1 << 22
QUERY_BYTES = 1 << 21
REMEMBERED = 600_000
REMEMBERED_WORDS = 700_000
#: Characters of text whose words are asked together; pieces and words longer than this are not remembered.
GROUP_CHARS = 1 << 23
LONG_PIECE = 256
#: Bytes of a word from which a query holds its present tokens only, not those of every step; bytes of a word that is cut
#: into spans, of a span, tokens on each side of a seam that are encoded again, and pairs of tokens remembered.
LONG_WORD = 1024
CUT_WORD = 512
SPAN = 64
SEAM = 4
REMEMBERED_PAIRS = 1 << 20

#: Every step makes the tokens of all unfinished words anew; ``b`` is the next merge of the word (merged id, its
#: position, that of the token it takes in), null when none is left.
ENCODE_SQL = """
WITH RECURSIVE neighbours AS (
  SELECT w, pos, id, lead(id) OVER n AS next_id, lead(pos) OVER n AS next_pos
  FROM first_tokens WINDOW n AS (PARTITION BY w ORDER BY pos)),
first_best AS (
  SELECT p.w, min((m.merged::BIGINT << 46) + (p.pos::BIGINT << 23) + p.next_pos) AS b
  FROM neighbours p JOIN merges m ON p.id = m.l AND p.next_id = m.r GROUP BY p.w),
tok(w, pos, id, b) AS (
  SELECT w, pos, id, b FROM first_tokens LEFT JOIN first_best USING (w)
  UNION ALL
  (WITH kept AS (
     SELECT w, pos, CASE WHEN pos = (b >> 23) & 8388607 THEN (b >> 46)::INT ELSE id END AS id
     FROM tok WHERE b IS NOT NULL AND pos <> b & 8388607),
   pairs AS MATERIALIZED (
     SELECT w, pos, id, lead(id) OVER n AS next_id, lead(pos) OVER n AS next_pos
     FROM kept WINDOW n AS (PARTITION BY w ORDER BY pos)),
   best AS (
     SELECT p.w, min((m.merged::BIGINT << 46) + (p.pos::BIGINT << 23) + p.next_pos) AS b
     FROM pairs p JOIN merges m ON p.id = m.l AND p.next_id = m.r GROUP BY p.w)
   SELECT w, pos, id, best.b FROM pairs LEFT JOIN best USING (w)))
SELECT w, list(id ORDER BY pos) AS ids FROM tok WHERE b IS NULL GROUP BY w ORDER BY w
"""

#: The same for long words: a step only changes the two rows that it contracts.
ENCODE_LONG_SQL = """
WITH RECURSIVE tok(w, pos, id) USING KEY (w, pos) AS (
  SELECT w, pos, id FROM first_tokens
  UNION
  (WITH active AS (SELECT DISTINCT w FROM tok),
   pairs AS (
     SELECT r.w, r.pos, r.id,
            lead(r.id) OVER (PARTITION BY r.w ORDER BY r.pos) AS next_id,
            lead(r.pos) OVER (PARTITION BY r.w ORDER BY r.pos) AS next_pos
     FROM recurring.tok r SEMI JOIN active USING (w) WHERE r.id >= 0),
   best AS (
     SELECT p.w, min((m.merged::BIGINT << 46) + (p.pos::BIGINT << 23) + p.next_pos) AS b
     FROM pairs p JOIN merges m ON p.id = m.l AND p.next_id = m.r GROUP BY p.w)
   SELECT w, ((b >> 23) & 8388607)::INT, (b >> 46)::INT FROM best
   UNION ALL
   SELECT w, (b & 8388607)::INT, -1 FROM best))
SELECT w, list(id ORDER BY pos) AS ids FROM tok WHERE id >= 0 GROUP BY w ORDER BY w
"""

DECODE_SQL = """
SELECT t.w, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM ids t JOIN vocab v ON t.id = v.id GROUP BY t.w ORDER BY t.w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def last_pair(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[int]:
    """The tokens that merges of ranks below ``rank`` leave of ``token``: the pair that forms it.

    When a merge of that rank is the least of a word, all smaller ones in its span have been made, and none
    crosses the span's ends, so the span holds this pair; other splits of the token are never met."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
        if best >= rank:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[x] for x in parts]


class Memory:
    """ids and decoded bytes of strings; what was not met since the last ``most`` strings is forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of ``wanted`` that are not remembered; the others are in ``known`` from now on."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        absent = wanted - self.known.keys()
        back = absent & self.older.keys()
        self.known.update(zip(back, map(self.older.__getitem__, back)))
        return list(absent - back)

    def forget_long(self, asked: list[str]) -> None:
        for x in asked:
            if len(x) > LONG_PIECE:
                del self.known[x]


def joined(parts) -> tuple[bytes, bytes]:
    """ids and decoded bytes of successive parts."""
    ids, decoded = tuple(zip(*parts)) or ((), ())
    return b"".join(ids), b"".join(decoded)


class Codec:
    """Encodes and decodes words in DuckDB; remembers pieces (see ``_util.pieces``) of texts."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex
        self.pattern = regex.compile(pattern)
        self.ranks = read_ranks(path)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        made = [(*parts, r) for t, r in self.ranks.items() if len(parts := last_pair(t, r, self.ranks)) == 2]
        left, right, merged = zip(*made) if made else ((), (), ())
        self._table("merges", l=left, r=right, merged=merged)
        vocab = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()),
                          "hex": [t.hex() for t in self.ranks]})
        self.con.register("v", vocab)
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM v")
        self.con.unregister("v")
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces, self.known_words = Memory(REMEMBERED), Memory(REMEMBERED_WORDS)

    def _table(self, name: str, **cols) -> None:
        data = pa.table({k: pa.array(v, pa.int32()) for k, v in cols.items()})
        self.con.register("given", data)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _encode(self, words: list[bytes], sql: str, known: bool) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, and where each word's begin and end; with ``known``, a word in the vocabulary is one token."""
        if any(len(x) >= 1 << 23 for x in words):
            raise ValueError("2^23 bytes or more to encode at once")
        whole = np.array([self.ranks.get(x, -1) if known else -1 for x in words], np.int32)
        size = np.where(whole >= 0, 1, [len(x) for x in words])
        start = np.cumsum(size) - size
        tokens = self.first[np.frombuffer(b"".join([x[:1] if r >= 0 else x for x, r in zip(words, whole)]), np.uint8)]
        tokens[start[whole >= 0]] = whole[whole >= 0]
        self._table("first_tokens", w=np.repeat(np.arange(len(words)), size),
                    pos=np.arange(len(tokens)) - np.repeat(start, size), id=tokens)
        out = self.con.sql(sql).to_arrow_table().column("ids").combine_chunks()
        ends = out.offsets.to_numpy()
        return out.values.to_numpy()[ends[0]:ends[-1]], ends - ends[0]

    def _decode(self, flat: np.ndarray, ends: np.ndarray) -> list[tuple[bytes, bytes]]:
        """ids (little-endian 32-bit integers) and decoded bytes of each word."""
        n = np.diff(ends)
        self._table("ids", w=np.repeat(np.arange(len(n)), n),
                    pos=np.arange(len(flat)) - np.repeat(ends[:-1], n), id=flat)
        hexed = self.con.sql(DECODE_SQL).to_arrow_table().column("hex").to_pylist()
        raw, at = flat.astype("<u4").tobytes(), (4 * ends).tolist()
        return [(raw[i:j], bytes.fromhex(h)) for i, j, h in zip(at, at[1:], hexed)]

    def _batches(self, words: list[bytes]):
        """(words, query) of bounded size: of short words, then of long ones."""
        short = [x for x in words if len(x) <= LONG_WORD]
        long = [x for x in words if len(x) > LONG_WORD]
        for some, sql, most, weight in ((short, ENCODE_SQL, QUERY_ROWS, lambda n: n * (n + 1) // 2),
                                        (long, ENCODE_LONG_SQL, QUERY_BYTES, lambda n: n)):
            batch: list[bytes] = []
            size = 0
            for i, x in enumerate(some):
                batch.append(x)
                size += weight(len(x))
                if size >= most or i == len(some) - 1:
                    yield batch, sql
                    batch, size = [], 0

    def _merged(self, strings: set[bytes]) -> dict[bytes, list[int]]:
        """string -> ids that merging alone gives."""
        out: dict[bytes, list[int]] = {}
        for batch, sql in self._batches(list(strings)):
            flat, ends = self._encode(batch, sql, known=False)
            out.update((x, flat[i:j].tolist()) for x, i, j in zip(batch, ends, ends[1:]))
        return out

    def _hold(self, pairs: set[tuple[int, int]]) -> None:
        """Find out which pairs of tokens are the encoding of their bytes."""
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs = {}
        new = [p for p in pairs if p not in self.pairs]
        text = {p: self.bytes_of[p[0]] + self.bytes_of[p[1]] for p in new}
        ids = self._merged(set(text.values()))
        self.pairs.update((p, ids[t] == list(p)) for p, t in text.items())

    def _joined(self, seams: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The encodings of the bytes of left and right ids together, each of them an encoding."""
        out: list[list[int] | None] = [None] * len(seams)
        self._hold({(a[-1], b[0]) for a, b in seams})
        todo = []
        for i, (a, b) in enumerate(seams):
            if self.pairs[a[-1], b[0]]:
                out[i] = a + b
            else:
                todo.append(i)
        wide = SEAM
        while todo:
            near = {i: (seams[i][0][-wide:], seams[i][1][:wide]) for i in todo}
            text = {i: b"".join(map(self.bytes_of.__getitem__, a + b)) for i, (a, b) in near.items()}
            ids = self._merged(set(text.values()))
            ends = {}
            for i in todo:
                (a, b), mid = seams[i], ids[text[i]]
                left, right = a[:max(len(a) - wide, 0)], b[wide:]
                ends[i] = left, mid, right, {(x[-1], y[0]) for x, y in ((left, mid), (mid, right)) if x and y}
            self._hold(set().union(*(e[3] for e in ends.values())))
            left_over = []
            for i, (left, mid, right, pairs) in ends.items():
                if all(self.pairs[p] for p in pairs):
                    out[i] = left + mid + right
                else:
                    left_over.append(i)
            todo, wide = left_over, 2 * wide
        return out

    def _cut(self, word: bytes) -> list[int]:
        """ids of a long word from those of its spans."""
        if word in self.ranks:
            return [self.ranks[word]]
        spans = [word[i:i + SPAN] for i in range(0, len(word), SPAN)]
        ids = self._merged(set(spans))
        have = [ids[x] for x in spans]
        while len(have) > 1:
            odd = [have.pop()] if len(have) % 2 else []
            have = self._joined(list(zip(have[::2], have[1::2]))) + odd
        return have[0]

    def words(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """word -> (ids as little-endian 32-bit integers, decoded bytes)."""
        out: dict[bytes, tuple[bytes, bytes]] = {}
        for batch, sql in self._batches([x for x in words if len(x) <= CUT_WORD]):
            out.update(zip(batch, self._decode(*self._encode(batch, sql, known=True))))
        for x in words:
            if len(x) > CUT_WORD:
                ids = np.array(self._cut(x), np.int32)
                out[x] = self._decode(ids, np.array([0, len(ids)]))[0]
        return out

    def _ask(self, words: set[str]) -> list[str]:
        """Make the words known, asking for those that are not; the words asked for."""
        new = self.known_words.missing(words)
        coded = [x.encode() for x in new]
        self.known_words.known.update(zip(new, map(self.words(coded).__getitem__, coded)))
        return new

    def round_trip(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """ids and decoded bytes of each text."""
        cut = [U.pieces(t) for t in texts]
        new = self.pieces.missing(set().union(*cut))
        split = [self.pattern.findall(p) for p in new]
        asked = self._ask(set().union(*split))
        word, piece = self.known_words.known.__getitem__, self.pieces.known.__getitem__
        self.pieces.known.update(zip(new, [word(ws[0]) if len(ws) == 1 else joined(map(word, ws)) for ws in split]))
        out = [joined(map(piece, ps)) for ps in cut]
        self.pieces.forget_long(new)
        self.known_words.forget_long(asked)
        return out


def grouped(batches, most: int = GROUP_CHARS):
    """(ids column, texts) of successive batches together, of about ``most`` characters: a query has a fixed cost."""
    ids, texts, size = [], [], 0
    for b in batches:
        rows = b.column("text").to_pylist()
        ids.append(b.column("doc_id"))
        texts += rows
        size += sum(map(len, rows))
        if size >= most:
            yield pa.concat_arrays(ids), texts
            ids, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(ids), texts


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) for every row of ``df``."""
    U.share(df.sparkSession)

    def run(batches):
        c = codec(ranks_path, pattern)
        for doc, texts in grouped(batches):
            got = c.round_trip(texts)
            ids = [np.frombuffer(i, "<u4").astype(np.int32) for i, _ in got]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [doc, pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *ids])),
                 pa.array([d for _, d in got], pa.binary())], names=["doc_id", "ids", "decoded"])

    return U.texts(df, id_col, text_col).mapInArrow(U.sliced(run), "doc_id long, ids array<int>, decoded binary")


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of what :func:`bpe_encode` gives."""
    U.share(df.sparkSession)

    def run(batches):
        c = codec(ranks_path, pattern)
        for doc, texts in grouped(batches):
            got = c.round_trip(texts)
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                 pa.array([hashlib.sha256(i).hexdigest() for i, _ in got]),
                 pa.array([hashlib.sha256(d).hexdigest() for _, d in got])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return U.texts(df, id_col, text_col).mapInArrow(
        U.sliced(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
