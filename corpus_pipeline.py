"""Corpus pipeline: reject, deduplicate, strip, redact, pack.  Each stage takes the rows its predecessor kept.

Every stage but the last returns the columns of ``documents`` (n_chars follows the text it hands on); the last
returns the packed pieces.  Rows whose text is null count as empty texts."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from papertrail.llm import packing, quality, queries, secret_scan, simhash, suffix_dedup
from papertrail.session import ensure_checkpoint_dir
from papertrail.sources.driver import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df):
    """The columns of ``documents``, with n_chars as the text has it now."""
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality_stage(spark, docs, sf_dir):
    """Rows that the classifier predicts to be of quality; it learns from ``labels`` and their documents."""
    model = queries.quality_model(spark, sf_dir)
    return quality.score(docs.select(*COLUMNS), model, keep=True)


def simhash_stage(spark, docs, sf_dir):
    """One row of each group of near-duplicates, that of the smallest doc_id."""
    return simhash.keep_one(docs.select(*COLUMNS), bits=simhash.BITS, shingle=simhash.SHINGLE)


def suffix_stage(spark, docs, sf_dir):
    """Texts without the bytes that strings of an earlier document cover; no row goes."""
    return _documents(suffix_dedup.strip(docs.select(*COLUMNS)))


def secret_stage(spark, docs, sf_dir):
    """Secrets replaced by a mark; no row goes."""
    return _documents(secret_scan.redact(docs.select(*COLUMNS)))


def packing_stage(spark, docs, sf_dir):
    """The pieces of all documents with their sequences and places."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("simhash near-dedup", simhash_stage),
          ("suffix-array dedup", suffix_stage), ("secret scans", secret_stage), ("packing", packing_stage)]

#: Models, bit distances and vocabularies are not expressible in SQL.  The tests run the stages one by one and check
#: columns, ids and that no access key is left; they do not call run() and have no brute force for the whole.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/papertrail/pipeline-{uuid.uuid4().hex[:12]}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs
