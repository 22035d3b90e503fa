"""Corpus pipeline: from documents to packed training sequences.

    run(spark, sf_dir)

Each stage takes (spark, docs, sf_dir) and gives the rows it keeps, with the columns of
documents (the last one: pieces of sequences). ``run`` writes each stage's rows as
Parquet in the shared folder and reads them again as the next stage's docs, so a
lost executor never leads back beyond one stage. Nulls, empty texts, repeated rows and empty
tables pass through every stage as its operator defines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from plumbline.llm import ngram_join, packing, secret_scans, suffixes, toxicity
from plumbline.session import shared_dir

TOXIC_FROM = 0.5
SHINGLE_WORDS, LEAST_SIMILARITY = 5, 80
REPEAT_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC_FROM by the model that the labels of ``sf_dir`` train."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    rows = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    return toxicity.toxicity(rows, labels, ["_row"]).filter(F.col("score") < TOXIC_FROM).select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group that links by word shingles."""
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, LEAST_SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without byte strings that repeat; characters that a cut leaves broken go as well."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    kept = suffixes.remove_repeats(docs, REPEAT_BYTES, carry=rest)
    fields = {c: F.col(f"_carry.`{c}`") for c in rest}
    return _with_text(docs, kept, fields, F.when(F.col("was_null"), F.lit(None)).otherwise(F.col("kept_text")))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark."""
    scanned = secret_scans.scan(docs.select("text", F.struct("*").alias("_row")), ["_row"])
    return _with_text(docs, scanned, {c: F.col(f"_row.`{c}`") for c in docs.columns}, F.col("redacted"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    ranks, full = (public_tokenizers.path(name) for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    return packing.pack(docs, ranks, public_tokenizers.PATTERN, 50256, full)


def _with_text(docs: DataFrame, rows: DataFrame, fields: dict, text) -> DataFrame:
    """The columns of ``docs`` with a new text, and n_chars counted anew where there is such a column."""
    rows = rows.withColumn("_new", text)
    new = {"text": F.col("_new"), "n_chars": F.char_length("_new").cast("long")}
    return rows.select(*[new.get(c, fields.get(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("secret_scans", hide_secrets),
    ("packing", pack_sequences),
]

#: Models and suffix arrays are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
