"""A stored full-text index: postings with positions, written once and read by term.

Ranking by it is ranking by :func:`quire.operators.search.bm25`, phrases included, but a query reads only the postings of its
own terms: folders of the terms' buckets, and within them the row groups whose range holds a term.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.search import parse_query, ranked
from quire.sources.readers import exists
from quire.sources.scratch import path_of

#: Folders that terms are dealt to, and pieces of a folder, so that a frequent term is not one task's work.
BUCKETS, PIECES = 32, 4


def bucket_of(term: Column) -> Column:
    return (F.crc32(term) % BUCKETS).cast("int")


def postings(docs: DataFrame, id: str, text: str) -> DataFrame:
    """bucket, piece, term, id, len, positions (from 0): one shuffle, by bucket and piece, which the grouping uses again."""
    tokens = docs.select(id, tx.tokens(F.coalesce(F.col(text), F.lit(""))).alias("__t")).select(id, F.size("__t").alias("len"), F.posexplode("__t").alias("pos", "term"))
    dealt = tokens.withColumns({"bucket": bucket_of(F.col("term")), "piece": F.pmod(F.xxhash64(id), F.lit(PIECES)).cast("int")}).repartition("bucket", "piece")
    return dealt.groupBy("bucket", "piece", "term", id, "len").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def build(docs: DataFrame, id: str, text: str, path: str) -> None:
    """Writes an index at ``path``, which appears there whole or not at all."""
    spark, new = docs.sparkSession, f"{path}-new"
    postings(docs, id, text).drop("piece").sortWithinPartitions("bucket", "term", id).write.mode("overwrite").partitionBy("bucket").parquet(f"{new}/postings")
    totals = docs.agg(F.count("*").alias("__N"), F.avg(F.size(tx.tokens(F.coalesce(F.col(text), F.lit(""))))).alias("__avg"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{new}/totals")
    source, system = path_of(spark, new)
    target, _ = path_of(spark, path)
    # Whoever comes second finds the index there, and leaves it.
    if exists(spark, path) or not system.rename(source, target):
        system.delete(source, True)


def search(spark: SparkSession, path: str, id: str, query: str, k: int | None = 10, any_if_none: bool = True, id_type: str = "long") -> DataFrame:
    """id, score (smaller is better) and matched, as :func:`quire.operators.search.bm25` has them."""
    phrases = parse_query(query)
    terms = sorted({word for phrase in phrases for word in phrase})
    index = spark.read.schema(f"term string, {id} {id_type}, len int, positions array<int>, bucket int").parquet(f"{path}/postings")
    own = index.where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % BUCKETS for w in terms})) & F.col("term").isin(terms))
    # A row a document: the positions of each of the query's terms, null where it does not have it.
    at = [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"__p{i}") for i, w in enumerate(terms)]
    found = own.groupBy(id).agg(F.max("len").alias("__len"), *at)

    def count(phrase: list[str]) -> Column:
        first, *rest = [F.col(f"__p{terms.index(w)}") for w in phrase]
        if not rest:
            return F.coalesce(F.size(first), F.lit(0))
        starts = F.filter(first, lambda p: F.forall(F.array(*(F.array_contains(r, p + n) for n, r in enumerate(rest, 1))), lambda ok: ok))
        together = first.isNotNull()
        for r in rest:
            together = together & r.isNotNull()
        return F.when(together, F.size(starts)).otherwise(0)

    counted = found.select(id, "__len", *(count(p).alias(f"__f{i}") for i, p in enumerate(phrases)))
    totals = spark.read.schema("__N long, __avg double").parquet(f"{path}/totals")
    return ranked(counted, totals, len(phrases), id, k, any_if_none)
