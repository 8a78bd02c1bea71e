"""Faults of conversations and their cheapest repair.

Rows are dealt by ranges of (conv_id, turn, role, text), so a large conversation lies over several tasks.  A conversation
that lies inside one task and has at most ``BLOCK`` rows is answered there.  The others (the first and last of a task, and
large ones) go on as blocks of rows, which later steps handle each by itself:

1. the first row of every distinct (role, text) of such a conversation is found by a minimum per key, so repeated lines
   are told apart without bringing them together;
2. every block gives its counts and the distances through it, from each state of the grammar to each (``lattice``);
3. per conversation these small matrices, one for each block, are chained backwards to the prices at the blocks' ends;
4. every block traces its least audit from each state, given the prices at its end;
5. per conversation the blocks' audits are chained forwards, then every block repairs its own rows.

Only the last two digests, which the query asks for, read a conversation's blocks one after the other (streamed, a block
in memory at a time); :func:`repaired` returns the rows themselves.

Contract: a null role or text counts as one space, a null turn stays null and comes first, a null conv_id is a conversation
of its own; rows of one turn are ordered by role, the first 64 characters of the text and a hash of it; equal rows are
each a row (and duplicates); conversations without rows have zeros; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm import _util as U
from papertrail.llm import lattice as L
from papertrail.session import materialize

#: Rows, and characters of text, of a block.
BLOCK = 480
BLOCK_CHARS = 1 << 20

_SPACE = " \t\n\x0b\f\r"
_LEGAL = {"su", "ua", "au"}
_LETTER = {"s": "s", "u": "u", "a": "a"}


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: the contract's damage by a checksum of ``conv_id:turn``.  A dropped row stays
    as one that is not present, so that its conversation is answered."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    kind = F.col("kind")
    return (df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"),
                      (F.crc32(key) % 20).alias("kind"))
            .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"), (kind != 0).alias("present"),
                    F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


def present(df: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that :func:`audit` and :func:`repaired` read."""
    space = F.lit(" ")
    return df.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                     F.coalesce("text", space).alias("text"), F.lit(True).alias("present"))


def _sorted(df: DataFrame) -> DataFrame:
    """Rows in order over ranges, with ``mark``: b blank, t truncated, o neither."""
    left = F.rtrim(F.col("text"), F.lit(_SPACE))
    mark = F.when(left == "", "b").when(F.right(left, F.lit(1)).isin(".", "!", "?"), "o").otherwise("t")
    # equal rows are interchangeable, so a range may end between them
    rows = df.withColumns({"mark": mark, "head": F.substring("text", 1, 64), "hash": F.xxhash64("text"),
                           "row": F.monotonically_increasing_id() % 4096})
    order = [F.col("conv_id").asc_nulls_first(), F.col("present").asc(), F.col("turn").asc_nulls_first(), F.col("role"),
             F.col("head"), F.col("hash")]
    return (rows.repartitionByRange(U.parallelism(df), *order, F.col("row")).sortWithinPartitions(*order)
            .select("conv_id", "present", "turn", "role", "text", "mark"))


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("mark", pa.string())])
_RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2


def _letters(rows: list[dict], again: list[bool]) -> tuple[str, int, int, int]:
    """The rows' letters for the lattice, and how many are blank, duplicate and truncated."""
    out, counts = [], {"b": 0, "d": 0, "t": 0, "o": 0}
    for r, seen in zip(rows, again):
        fault = "b" if r["mark"] == "b" else "d" if seen else r["mark"]
        counts[fault] += 1
        letter = _LETTER.get(r["role"][:1], "x")
        out.append("-" if fault in "bd" else letter.upper() if fault == "t" else letter)
    return "".join(out), counts["b"], counts["d"], counts["t"]


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))


def _edited(rows: list[dict], audit: str, state: int) -> Iterator[tuple[str, str, str, int | None]]:
    """(edit, role, text, turn) of the repaired rows, and of the deleted ones as (D, role, text, turn)."""
    at = 0
    for edit in audit:
        if edit == "I":
            state = L.NEXT[state]
            yield edit, L.ROLES[state], "", None
            continue
        if at == len(rows):
            continue
        r = rows[at]
        at += 1
        role = r["role"]
        if edit == "R":
            state = L.NEXT[state]
            role = L.ROLES[state]
        elif edit == "K":
            state = {"s": L.SYSTEM, "u": L.USER, "a": L.ASSISTANT}[role[0]]
        yield edit, role, r["text"], r["turn"]


def _lines(rows: list[dict], audit: str, state: int) -> list[str]:
    return [f"{role}:{text}" for edit, role, text, _ in _edited(rows, audit, state) if edit != "D"]


def _turns(rows: list[dict]) -> list[int]:
    return [r["turn"] for r in rows if r["turn"] is not None]


def _whole(conv_id, rows: list[dict]) -> tuple:
    """The answer for a conversation that is all here."""
    seen: set = set()
    again = []
    for r in rows:
        key = (r["role"], r["text"])
        again.append(key in seen)
        seen.add(key)
    letters, blank, duplicate, truncated = _letters(rows, again)
    cost, audit = L.repair(letters)
    turns = _turns(rows)
    gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(_lines(rows, audit, L.NOTHING)).encode()).hexdigest()
    return conv_id, gaps, blank, duplicate, truncated, _illegal([r["role"][:1] for r in rows]), cost, audit, digest


def _split(df: DataFrame, most: int, keep: bool = False) -> DataFrame:
    """Finished answers (``keep``: with their rows), and blocks (``task``, ``block``, ``rows``) of up to ``most`` rows of
    conversations that may go on elsewhere; written."""
    U.share(df.sparkSession)

    def run(batches):
        task = TaskContext.get().partitionId()
        held: list[dict] = []
        conv, size, block, first, begun = None, 0, 0, True, False
        out: list[tuple] = []

        def flush():
            nonlocal held, size, block
            out.append((conv, task, block, held, *(None,) * 8))
            held, size, block = [], 0, block + 1

        def end(last: bool):
            nonlocal block, held, size
            if first or last or block:
                flush()
            else:
                answer = _whole(conv, held)
                out.append((conv, None, None, held if keep else None, *answer[1:]))
            held, size, block = [], 0, 0

        def batch():
            cols = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.list_(_ROW), *_KINDS[1:]])],
                names=["conv_id", "task", "block", "rows", *(x.split()[0] for x in _RESULT.split(", ")[1:])])

        for b in batches:
            for r in b.to_pylist():
                if begun and r["conv_id"] != conv:
                    end(False)
                    first = False
                begun, conv = True, r["conv_id"]
                if r["present"]:
                    if len(held) >= most or size >= BLOCK_CHARS:
                        flush()
                    held.append(r)
                    size += len(r["text"])
            if out:
                yield batch()
                out.clear()
        if begun:
            end(True)
            yield batch()

    schema = (f"conv_id long, task int, block int, rows array<struct<turn:long,role:string,text:string,mark:string>>, "
              f"{_RESULT.partition(', ')[2]}")
    return materialize(_sorted(df).mapInArrow(run, schema), "conversation-blocks")


def _by_conversation(batches) -> Iterator[tuple[bool, dict]]:
    """Rows, with whether the row is the first of its conversation."""
    conv, begun = None, False
    for b in batches:
        for r in b.to_pylist():
            yield not begun or r["conv_id"] != conv, r
            conv, begun = r["conv_id"], True


def _ordered(df: DataFrame, forward: bool) -> DataFrame:
    """Blocks of a conversation one after the other in one task; a block is a small row here."""
    at = [F.col(c).asc() if forward else F.col(c).desc() for c in ("task", "block")]
    return df.repartition(U.parallelism(df), "conv_id").sortWithinPartitions("conv_id", *at)


def _table(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), kinds)],
                                      names=names)


_PRICES = pa.list_(pa.float64())


def _traced(blocks: DataFrame) -> DataFrame:
    """conv_id, task, block, state, audit and the counts of every block, ``state`` being where its audit starts."""
    lines = blocks.select("conv_id", "task", "block", F.posexplode("rows").alias("at", "row"))
    place = F.struct("task", "block", "at")
    firsts = (lines.groupBy("conv_id", "row.role", F.sha2(F.col("row.text"), 256).alias("digest"))
              .agg(F.min(place).alias("p")))
    firsts = (firsts.groupBy("conv_id", "p.task", "p.block").agg(F.collect_list("p.at").alias("new"))
              .select(F.col("conv_id").alias("c"), F.col("task").alias("t"), F.col("block").alias("b"), "new"))
    marked = (blocks.select("conv_id", "task", "block",
                            F.transform("rows", lambda r: F.struct(r["turn"], F.substring(r["role"], 1, 1), r["mark"]))
                            .cast("array<struct<turn:long,role:string,mark:string>>").alias("rows"))
              .join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("t"))
                    & (F.col("block") == F.col("b")), "left").drop("c", "t", "b"))

    measured_as = ("conv_id long, task int, block int, letters string, blank long, duplicate long, truncated long, "
                   "illegal long, head string, tail string, n int, low long, high long, turns long, through array<double>")
    measured_kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(),
                      pa.int32(), *[pa.int64()] * 3, _PRICES]

    def measure(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                rows, new = r["rows"], set(r["new"] or ())
                letters, *counts = _letters(rows, [k not in new for k in range(len(rows))])
                initials = [x["role"] for x in rows]
                turns = _turns(rows)
                out.append((r["conv_id"], r["task"], r["block"], letters, *counts, _illegal(initials),
                            *((initials[0], initials[-1]) if rows else ("", "")), len(rows),
                            min(turns, default=None), max(turns, default=None), len(set(turns)),
                            [x for row in L.transfer(letters) for x in row]))
            yield _table(out, measured_as, measured_kinds)

    measured = materialize(marked.mapInArrow(measure, measured_as), "conversation-distances")

    priced_as = measured_as.replace("through array<double>", "after array<double>")

    def price(batches):
        after: tuple = ()
        out = []
        for new, r in _by_conversation(batches):
            if new:
                after = L.settle("$", L.ACCEPTED)[1]
            through = r.pop("through")
            out.append((*r.values(), list(after)))
            after = tuple(min(through[4 * s + e] + after[e] for e in range(4)) for s in range(4))
            if len(out) >= 1024:
                yield _table(out, priced_as, measured_kinds)
                out = []
        yield _table(out, priced_as, measured_kinds)

    priced = _ordered(measured, False).mapInArrow(price, priced_as)
    audits_as = measured_as.replace("through array<double>", "ends array<int>, audits array<string>, cost double")
    audit_kinds = [*measured_kinds[:-1], pa.list_(pa.int32()), pa.list_(pa.string()), pa.float64()]

    def audits(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                windows, start = L.settle(r["letters"], tuple(r.pop("after")))
                traced = [L.trace(windows, s) if start[s] < L.inf else ("", 0) for s in range(4)]
                out.append((*r.values(), [t[1] for t in traced], [t[0] for t in traced], start[L.NOTHING]))
            yield _table(out, audits_as, audit_kinds)

    variants = materialize(priced.mapInArrow(audits, audits_as), "conversation-audits")
    chained_as = ("conv_id long, task int, block int, state int, audit string, last boolean, blank long, duplicate long, "
                  "truncated long, illegal long, n int, low long, high long, turns long, cost long")
    chained_kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), *[pa.int64()] * 4,
                     pa.int32(), *[pa.int64()] * 4]

    def chain(batches):
        out: list[list] = []
        state, cost, latest, before = L.NOTHING, 0, None, None

        def close():
            audit, _ = L.trace(L.settle("$", L.ACCEPTED)[0], state)
            out[-1][4] += audit
            out[-1][5] = True

        for new, r in _by_conversation(batches):
            if new:
                if out:
                    close()
                state, cost, latest, before = L.NOTHING, int(r["cost"]), None, None
            if len(out) >= 1024:  # the last of a conversation is among what is kept back
                yield _table(out[:-1], chained_as, chained_kinds)
                out = out[-1:]
            turns, illegal = r["turns"], r["illegal"]
            if r["n"]:
                if before is not None and before + r["head"] not in _LEGAL:
                    illegal += 1
                before = r["tail"]
            if latest is not None and r["low"] == latest:
                turns -= 1
            latest = r["high"] if r["high"] is not None else latest
            out.append([r["conv_id"], r["task"], r["block"], state, r["audits"][state], False, r["blank"], r["duplicate"],
                        r["truncated"], illegal, r["n"], r["low"], r["high"], turns, cost])
            cost = 0  # counted once, at the first block
            state = r["ends"][state]
        if out:
            close()
        yield _table(out, chained_as, chained_kinds)

    return materialize(_ordered(variants, True).mapInArrow(chain, chained_as), "conversation-edits")


def _pieces(blocks: DataFrame, traced: DataFrame) -> DataFrame:
    """Blocks with their audits."""
    t = traced.select(F.col("conv_id").alias("c"), F.col("task").alias("t"), F.col("block").alias("b"), "state", "audit")
    return (blocks.select("conv_id", "task", "block", "rows")
            .join(t, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("t"))
                  & (F.col("block") == F.col("b"))).drop("c", "t", "b"))


def audit(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conversation: its faults, the cost and edits of its cheapest repair and a digest of the result."""
    done = _split(df, block)
    blocks = done.where("task is not null")
    traced = _traced(blocks)
    piece_as = "conv_id long, task int, block int, audit string, text string"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def piece(batches):
        for b in batches:
            yield _table([(r["conv_id"], r["task"], r["block"], r["audit"], "".join(
                f"{x}\n" for x in _lines(r["rows"], r["audit"], r["state"]))) for r in b.to_pylist()], piece_as, kinds)

    digest_as = "c long, audit string, sha string"

    def digest(batches):
        audits: list[str] = []
        sha, tail, conv, begun = hashlib.sha256(), "", None, False
        kinds = [pa.int64(), pa.string(), pa.string()]
        for new, r in _by_conversation(batches):
            if new and begun:
                yield _table([(conv, "".join(audits), sha.hexdigest())], digest_as, kinds)
            if new:
                audits, sha, tail = [], hashlib.sha256(), ""
            conv, begun = r["conv_id"], True
            audits.append(r["audit"])
            if r["text"]:
                sha.update((tail + r["text"][:-1]).encode())
                tail = "\n"
        if begun:
            yield _table([(conv, "".join(audits), sha.hexdigest())], digest_as, kinds)

    texts = _ordered(_pieces(blocks, traced).mapInArrow(piece, piece_as), True).mapInArrow(digest, digest_as)
    counts = traced.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"))
    names = [x.split()[0] for x in _RESULT.split(", ")]
    chained = (counts.join(texts, F.col("conv_id").eqNullSafe(F.col("c")))
               .withColumn("repaired_sha256", F.col("sha")).select(*names))
    return done.where("task is null").select(*names).unionByName(chained)


def repaired(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, task, block, place, edit, role, text, turn: the rows of the repaired conversations and the deleted ones
    (edit D), in order of (task, block, place) within a conversation; inserted rows (I) have no turn."""
    done = _split(df, block, keep=True)
    blocks = done.where("task is not null")
    whole = done.where("task is null").select("conv_id", F.lit(0).alias("task"), F.lit(0).alias("block"), "rows",
                                              F.lit(L.NOTHING).alias("state"), "audit")
    schema = "conv_id long, task int, block int, place int, edit string, role string, text string, turn long"
    kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.string()] * 3, pa.int64()]

    def run(batches):
        for b in batches:
            yield _table([(r["conv_id"], r["task"], r["block"], k, *row) for r in b.to_pylist()
                          for k, row in enumerate(_edited(r["rows"], r["audit"], r["state"]))], schema, kinds)

    return whole.unionByName(_pieces(blocks, _traced(blocks))).mapInArrow(run, schema)
