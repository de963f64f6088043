"""Quotations and the documents that hold them, as joins on runs of words that lose no pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx

#: Words of the runs that parts of quotations are looked for by, the longest that fits a part.
RUNS = (8, 4, 2, 1)
#: Characters by which a part without a whole word is looked for.
LETTERS = 4


def _words(text: Column) -> Column:
    return F.filter(F.split(tx.squash(text), " "), lambda w: w != "")


def _run_hashes(words: Column, size: int) -> Column:
    """A hash for each run of so many words; each word is hashed once."""
    last = F.size(words) - size + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))


def grams(rows: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """id, gram: each run of so many words once."""
    # Arrays of one bind the words to a name, so that texts are folded once.
    hashed = F.transform(F.array(_words(F.col(text))), lambda w: F.transform(w, lambda x: F.xxhash64(x)))
    runs = F.transform(hashed, lambda w: F.array_distinct(_run_hashes(w, size)))
    return rows.select(id, F.explode(F.get(runs, 0)).alias("gram"))


def _parts(quotes: DataFrame, id: str, text: str) -> DataFrame:
    """id, __of, __part, __key: what a document must have to hold a third of a quotation (a short one's whole).

    A third begins and ends anywhere in a word, so only the words between its first and its last space are whole; the longest
    run of them, or else the third's first letters, is its key.
    """
    q = quotes.select(id, tx.squash(F.col(text)).alias("__text")).where(F.length("__text") >= 8)
    third = F.floor(F.length("__text") / 3).cast("int")
    pieces = F.when(third >= 4, F.array(*(F.substring(F.col("__text"), third * i + 1, third) for i in range(3)))).otherwise(F.array("__text"))
    rows = q.select(id, F.size(pieces).alias("of"), F.posexplode(pieces).alias("part", "piece"))
    inner = F.split(F.regexp_extract("piece", r"^[^ ]* (.*) [^ ]*$", 1), " ")
    rows = rows.withColumn("words", F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.xxhash64(w)))
    key = F.lit(None).cast("struct<run:int,hash:bigint>")
    for run in reversed(RUNS):
        key = F.when(F.size("words") >= run, F.struct(F.lit(run).alias("run"), F.xxhash64(F.slice("words", 1, run)).alias("hash"))).otherwise(key)
    # The first letters of a third may be blanks between words, as those of the document are.
    letters = F.struct(F.lit(0).alias("run"), F.xxhash64(F.substring("piece", 1, LETTERS)).alias("hash"))
    return rows.select(id, F.col("of").alias("__of"), F.col("part").alias("__part"), F.coalesce(key, letters).alias("__key"))


def _keys(docs: DataFrame, id: str, text: str, runs: list[int]) -> DataFrame:
    """id, __key: every key of the given lengths that a document has."""
    folded = tx.squash(F.col(text))

    def letters(s: Column) -> Column:
        last = F.length(s) - LETTERS + 1
        return F.transform(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.substring(s, i, F.lit(LETTERS))))

    def of(s: Column, words: Column, run: int) -> Column:
        own = F.get(F.transform(words, lambda w: _run_hashes(w, run)), 0) if run else letters(s)
        return F.transform(F.array_distinct(own), lambda x: F.struct(F.lit(run).alias("run"), x.alias("hash")))

    def every(s: Column) -> Column:
        words = F.array(F.transform(F.filter(F.split(s, " "), lambda w: w != ""), lambda w: F.xxhash64(w)))
        return F.concat(*(of(s, words, run) for run in runs))

    return docs.select(id, F.explode(F.get(F.transform(F.array(folded), every), 0)).alias("__key"))


def grounded_in(quotes: DataFrame, quote_id: str, quote: str, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """quote id, doc id of each quotation that a document holds whole or in two of its thirds, by
    :func:`quire.operators.validate.grounded`; ids are unique.

    A pair that holds has the keys of two thirds in common (of a short quotation the one of the whole), so none is lost.
    """
    from quire.operators.validate import grounded

    parts = _parts(quotes, quote_id, quote)
    runs = sorted(r.run for r in parts.select("__key.run").distinct().collect())  # five lengths at most
    if not runs:
        return quotes.select(quote_id).join(docs.select(doc_id)).where(F.lit(False))
    keys = _keys(docs, doc_id, text, runs)
    common = parts.join(keys, "__key").groupBy(quote_id, doc_id).agg(F.countDistinct("__part").alias("__n"), F.max("__of").alias("__of"))
    pairs = common.where(F.col("__n") >= F.least("__of", F.lit(2))).select(F.col(quote_id).alias("__q"), F.col(doc_id).alias("__d"))
    rows = pairs.join(quotes.select(quote_id, F.col(quote).alias("__quote")), F.col("__q") == F.col(quote_id)).join(docs.select(doc_id, F.col(text).alias("__body")), F.col("__d") == F.col(doc_id))
    return rows.where(grounded(F.col("__quote"), F.col("__body"))).select(quote_id, doc_id)
