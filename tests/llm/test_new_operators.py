"""Conversation repair, token files and periodic runs against a brute force, on rows with nulls, empty and long texts,
ties, repeats and clashing extra columns; the registered queries run over the smallest driver tables."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash

from papertrail.llm import conversations, lattice, periodic_runs, queries, token_files, word_encoder
from tests.conftest import SF

SEEN = re.compile(r"[^\x20\x09-\x0D]")
INITIAL = re.compile(r"[^\x20\x09-\x0D]+")


# --- conversations ---------------------------------------------------------------------------------------------

def least_repair(letters):
    """(cost, audit) by plain dynamic programming over the least (cost, audit) of every node, from the end."""
    follow = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = None
    for i in range(len(letters), -1, -1):
        here = {s: (0, "") if i == len(letters) and s in (0, 3) else (10**9, "~") for s in range(4)}
        if i < len(letters):
            y = letters[i]
            for s in range(4):
                options = [(best[s][0] + 3, "D" + best[s][1])]
                if y != "-":
                    if (s, y.lower()) in kept:
                        to = best[kept[s, y.lower()]]
                        options.append((to[0] + y.isupper(), "K" + to[1]))
                    to = best[follow[s]]
                    options.append((to[0] + 2 + y.isupper(), "R" + to[1]))
                here[s] = min([here[s], *options])
        for _ in range(3):
            for s in range(4):
                here[s] = min(here[s], (here[follow[s]][0] + 2, "I" + here[follow[s]][1]))
        best = here
    return best[0]


def plain_audit(rows):
    """The contract's columns of one conversation's (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, letters, counts = set(), "", collections.Counter()
    for _, role, text in rows:
        visible = SEEN.findall(text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else \
            "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        y = role[:1] if role[:1] in set("sua") else "x"
        letters += "-" if fault in ("blank", "duplicate") else y.upper() if fault else y
    cost, audit = least_repair(letters)
    out, state, at = [], 0, 0
    names = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    for e in audit:
        if e == "I":
            out.append(names[state] + ":")
        elif e in "KR":
            role = names[state] if e == "R" else rows[at][1]
            out.append(f"{role}:{rows[at][2]}")
        if e != "D":
            state = {"s": 1, "u": 2, "a": 3}[out[-1][0]]
        at += e != "I"
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in {"su", "ua", "au"} for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"],
            counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        kept = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_auction_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(1500):
        kind = rng.choice(["suaxSUAX-", "uuaa-", "ua", "xsUA-"])
        letters = "".join(rng.choice(kind) for _ in range(rng.randint(0, 70) if rng.random() < .2 else rng.randint(0, 9)))
        assert lattice.repair(letters) == least_repair(letters)


def _conversations(rng, n):
    texts = ["Fine.", "Fine.", "Why?", "no end", "", " \t", None, "Yes!\x0b", "x.\x1c", "é.", "a. b", "1", "2.", "3.", "4."]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 8)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]),
                         rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ubiquitous"]),
                         rng.choice(texts)))
    for turn in range(700):  # a large one, and one line that fills it
        rows.append((10**6, turn // 2, ["user", "assistant"][turn % 2] if rng.random() < .9 else "system",
                     f"line {turn}." if rng.random() < .7 else "same line"))
    rows += [(10**6 + 1, 5, "user", "again.")] * 60 + [(10**6 + 2, None, "user", "t.")] * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [3, conversations.BLOCK])
def test_conversations_against_plain_repair(spark, block):
    rows = _conversations(random.Random(block), 120)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, mark string, task int")
    want = {c: plain_audit(x) for c, x in plain_damage(rows).items()}
    frame = conversations.audit(conversations.damaged(df), block=block)
    assert frame.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                             "repaired_sha256"]
    got = {r.conv_id: tuple(r)[1:] for r in frame.collect()}
    assert got == want


def test_repaired_rows(spark):
    rows = [(c, t, r, x) for c, t, r, x in _conversations(random.Random(1), 20)]
    df = conversations.present(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    lines = collections.defaultdict(list)
    for r in conversations.repaired(df, block=5).orderBy("conv_id", "task", "block", "place").collect():
        assert (r.turn is None) >= (r.edit == "I")
        if r.edit != "D":
            lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in conversations.audit(df).collect():
        assert hashlib.sha256("\n".join(lines[r.conv_id]).encode()).hexdigest() == r.repaired_sha256
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.audit(conversations.damaged(empty)).count() == 0


def test_conversation_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, SF).collect()}
    assert got == {c: plain_audit(x) for c, x in plain_damage(rows).items()}


# --- token files -----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("width", [1, 3, 7, 8, 9, 13, 16, 17, 24, 25, 31, 32])
def test_packing_of_bits(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        data = token_files.pack(ids, width)
        assert len(data) == -(-n * width // 8)
        assert (token_files.unpack(data, width, n) == ids).all()
        if n > 7:
            assert (token_files.unpack(data, width, n - 7, 5) == ids[5:n - 2]).all()
            assert int.from_bytes(data, "little") >> 3 * width & (1 << width) - 1 == ids[3]


def test_file_of_blocks_and_random_access():
    rng = np.random.default_rng(1)
    docs = [(i if i % 5 else None, rng.integers(0, 1 << 17, n, dtype=np.uint32)) for i, n in
            enumerate([1, 0, 3, 500, 1, 64, 63, 65, 1000, 1])]
    sink = io.BytesIO()
    w = token_files.Writer(sink, 17, block=64)
    for d, ids in docs:
        w.add(d, ids)
    assert w.close() == len(sink.getvalue())
    r = token_files.Reader(sink)
    whole = np.concatenate([ids for _, ids in docs])
    assert r.n_ids == len(whole) and len(r.offsets) == -(-len(whole) // 64) + 1
    for k, (d, ids) in enumerate(docs):
        assert (r.document(k) == ids).all() and (None if r.nulls[k] else r.docs[k]) == d
    for first, n in [(0, len(whole)), (63, 2), (64, 64), (1000, 1), (len(whole), 0)]:
        assert (r.ids(first, n) == whole[first:first + n]).all()
    with pytest.raises(IndexError):
        r.ids(len(whole), 1)
    parts = collections.defaultdict(list)
    for k, ids in r.sequential(128):
        parts[k].append(ids)
    assert all((np.concatenate(parts[k]) == ids).all() for k, (_, ids) in enumerate(docs) if len(ids))


WORDS = ["", None, " ", "one two", "Don't I'LL 'S ..'re x''t", "naïve Ünïcode ß é 漢字 İ ΣΑΣ ﬁ x² １ á", "a\x1cb\x85c d",
         "<|endoftext|> a<|startoftext|>b <|start <| |>", "word " * 3000, "z" * 5000, "a.b,c!d 1,234.5 \x7f ÷×", "É" * 300]


def _ids(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [2, 100_000])
def test_word_encoder_equals_library(remembered):
    e = word_encoder.WordEncoder(P.path("word_bpe_49k.json"), remembered)
    assert e.model is not None
    signs = [chr(c) + x for c in range(33, 0x180) for x in ("", "a", "́", ".", "'s", "À")]
    for text in [*WORDS, *WORDS, " ".join(signs)]:
        assert np.frombuffer(e.ids(text or ""), "<u4").tolist() == _ids(text)


def _plain_files(rows):
    """doc_id, start, n_tokens, crc in ascending order."""
    def tie(text):
        return int(np.array([xxhash.xxh64_intdigest((text or "").encode(), 42)], np.uint64).view(np.int64)[0])

    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]))):
        ids = np.array([*_ids(t), 1], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, tmp_path):
    rows = [(i * 10 if i % 4 else None, t) for i, t in enumerate(WORDS)] + [(20, "same id")] * 30 + [(10, "x"), (-5, "y")]
    schema = "doc_id long, text string, ids string, row long, crc int"
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], schema).repartition(3)
    path = P.path("word_bpe_49k.json")
    got = token_files.round_trip(df, path, folder=str(tmp_path / "out"), block=64)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want = _plain_files(rows)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    files = token_files.manifest(spark, f"file://{tmp_path}/out")
    assert files.count() > 1 and not list((tmp_path / "out").glob("*.tmp"))
    texts = {(d, tuple([*_ids(t), 1])) for d, t in rows}
    assert {(r.doc_id, tuple(r.ids)) for r in token_files.documents(spark, f"file://{tmp_path}/out").collect()} == texts
    assert token_files.round_trip(spark.createDataFrame([], schema), path).count() == 0


def test_token_files_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_token_files"](spark, SF).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == _plain_files(rows)


# --- periodic runs ---------------------------------------------------------------------------------------------

def plain_runs(w, least):
    """Maximal stretches for every distance, the smallest for each stretch."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 2 * q and j > i:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= least)


def _strings(rng):
    fib, thue = [0], [0, 1]
    while len(thue) < 300:
        fib, thue = thue, thue + fib
    yield thue
    yield [bin(i).count("1") % 2 for i in range(300)]
    yield [0] * 200
    for _ in range(150):
        n = rng.randint(1, 120)
        yield [rng.randint(0, rng.choice([1, 3])) for _ in range(n)]
        x = [rng.randint(0, 2) for _ in range(rng.randint(1, 20))]
        w = (x * 10)[:n]
        w[rng.randrange(len(w))] = 5
        yield w
        p = rng.randint(2, 4)  # two regions of one root that meet out of step
        x = [rng.randint(0, 2) for _ in range(p)] * 60
        w = x[rng.randint(0, p - 1):][:rng.randint(9 * p, 40 * p)] + x[rng.randint(0, p - 1):][:rng.randint(9 * p, 40 * p)]
        yield w + [9] * rng.randint(0, 2) + w if rng.random() < .5 else w


@pytest.mark.parametrize("least", [2, 12])
def test_runs_against_all_distances(least):
    docs = sorted(_strings(random.Random(least)), key=len, reverse=True)
    for lo in range(0, len(docs), 7):
        part = docs[lo:lo + 7]
        found = periodic_runs.find(np.array([x for w in part for x in w]), np.array([len(w) for w in part]), least)
        want, off = [], 0
        for w in part:
            want += [(s + off, s + off + n, q) for s, n, q in plain_runs(w, least)]
            off += len(w)
        assert sorted(map(tuple, found.tolist())) == sorted(want)


def _plain_summary(doc_id, text, edit):
    words = [w.encode() for w in INITIAL.findall(text or "")]
    words = edit(doc_id, words) if edit else words
    found = plain_runs(words, 12)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_run_summaries(spark):
    rng = random.Random(9)
    texts = [None, "", " \n ", "a " * 11, "a " * 12, "a b c " * 4, "x\x1cy " * 13, "é è " * 20 + "tail"]
    texts += [rng.choice(["  ", " ", "\t"]).join(rng.choice("ab") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 2
    schema = "doc_id long, text string, start int, period string"
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], schema).repartition(2)
    for edit in (None, queries.planted_period):
        got = collections.Counter(map(tuple, periodic_runs.summary(df, edit=edit).collect()))
        assert got == collections.Counter(_plain_summary(*r, edit) for r in rows)
    runs = collections.Counter(map(tuple, periodic_runs.runs(df).collect()))
    assert runs == collections.Counter((d, *r) for d, t in rows
                                       for r in plain_runs(INITIAL.findall(t or ""), 12))
    assert {r.text for r in periodic_runs.collapse(df).where("doc_id = 5").collect()} == {"a b c"}
    assert periodic_runs.summary(spark.createDataFrame([], schema)).count() == 0


def test_planted_periods():
    words = [str(i) for i in range(97)]
    for d in range(300):
        h = zlib.crc32(str(d).encode())
        g, out = h // 10, list(words)
        if h % 10 == 0:
            a, p = g % 97, 1 + (97 - g % 97) // (3 + g % 8)
            out = [words[i] if i < a else words[a + (i - a) % p] for i in range(97)]
        assert queries.planted_period(d, words) == out


def test_run_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
            if len((r.text or "").split()) < 600]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == 200
    for d, t in rows:
        assert got[d] == _plain_summary(d, t, queries.planted_period)


def test_a_worker_scores_with_the_model_it_is_given(spark):
    import dataclasses

    from pyspark.sql import functions as F

    from papertrail.llm import quality
    docs = spark.createDataFrame([(i, ("good clear words " if i % 2 else "bad junk noise ") * 5) for i in range(80)],
                                 "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    for k in range(6):  # each turned model would answer like the one before if a stale pooler or model were kept
        turned = dataclasses.replace(model, w2=model.w2 * (-1) ** k, b2=model.b2 * (-1) ** k,
                                     vectors=model.vectors.copy())
        scores = {r.doc_id: r.score for r in quality.score(docs, turned).collect()}
        assert (scores[1] > scores[0]) == (k % 2 == 0)
        del turned


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_conversation_repair", "op12_token_files",
                                                                "op13_periodic_runs"}))
def test_registered_query_runs(spark, name):
    """The registered functions of the earlier operators: a row for each document, or at least one."""
    got = queries.QUERIES[name](spark, SF)
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    if name == "op9_bm25_topk":
        assert got.count() > 0
        return
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert set(ids) == docs and (name == "op8_packing" or len(ids) == len(docs))


def test_pipeline_runs_to_its_packed_pieces(spark):
    """run() over the smallest tables: pieces lie gapless in their sequences, and only kept documents have any."""
    import corpus_pipeline
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= docs
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
