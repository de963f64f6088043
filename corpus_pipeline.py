"""From raw documents to token ids: language ID, exact and near deduplication, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of ``documents``.  ``run`` writes each stage's result to the shared folder and reads it again.

Defined results: those of the operators, see their modules.  Nulls in any column, repeated rows, empty texts and further
columns pass through each stage as described there; documents without a letter have no language and go first; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from quire.llm.common import materialise, read

#: Share of the deduplicated tokens that the mixture takes, each document once.
MIX_PERCENT, MIX_EPOCHS = 80, 1


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep(docs, language_id.train(docs))


def drop_exact_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, percent=MIX_PERCENT, max_epochs=MIX_EPOCHS)


def encode_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (four bytes a token), n_tokens, ids_sha256, decoded_sha256."""
    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.tokenizer_path(), decoded="decoded")
    n = F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return rows.select("doc_id", "lang", "source", "ids", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: No SQL expresses the language model, the MinHash groups or the encoding: tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
