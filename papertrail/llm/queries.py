"""Registered queries of this package: the operators over the driver's tables with production parameters."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import functions as F

from papertrail.llm import (bm25, bpe_codec, conversations, cws, ngram_lm, packing, periodic_runs, quality, secret_scan,
                            simhash, suffix_dedup, token_counts, token_files)
from papertrail.sources.driver import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op2_ngram_lm(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = ngram_lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


@register
def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


@register
def op5_bpe_codec(spark, sf_dir):
    return bpe_codec.bpe_round_trip(table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register
def op6_fingerprints(spark, sf_dir):
    return cws.fingerprint_edits(table(spark, sf_dir, "documents"))


@register
def op7_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@register
def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register
def op9_bm25_topk(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return bm25.search(documents, documents.where(F.col("doc_id") % 100 == 0))


def fold():
    """crc32 of the id as text, mod 4."""
    return F.crc32(F.col("doc_id").cast("string")) % 4


def quality_model(spark, sf_dir):
    """The classifier, from labelled rows outside the held-out fold."""
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold() != 2)


@register
def op10_quality(spark, sf_dir):
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@register
def op11_conversation_repair(spark, sf_dir):
    return conversations.audit(conversations.damaged(table(spark, sf_dir, "conversations")))


@register
def op12_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def planted_period(doc_id, words):
    """The contract's edit: documents whose checksum ends in 0 repeat a period from a place on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@register
def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.summary(table(spark, sf_dir, "documents"), edit=planted_period)
