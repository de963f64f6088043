"""Retrieval: full-text and vector ranking, fusion, collapse of copies, keyword in context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx

K1, B = 1.2, 0.75
#: What an inverse document frequency that would not be positive counts as.
LEAST_IDF = 1e-6

# Words that a query leaves out.
STOP_WORDS = {"de", "da", "do", "das", "dos", "a", "o", "as", "os", "e", "em", "no", "na", "nos", "nas", "um", "uma", "por", "para", "com", "sem", "que", "se", "ao", "à", "às", "aos", "ou", "sobre", "qual", "quais", "foi", "ser", "há", "ha"}


def fold(text: str) -> str:
    return text.translate(str.maketrans(tx.FOLD_FROM, tx.FOLD_TO)).lower()


def parse_query(query: str) -> list[list[str]]:
    """The phrases of a query, each the list of its tokens: quoted ones first, then the words between them.

    The query is cut at quotation marks, so every second piece is quoted; a mark that no other one closes quotes nothing.
    Words are cut at white space; one whose letters are a stop word or fewer than two is left out, and a word with inner signs,
    such as a number with dots, is a phrase of its parts.
    """
    pieces = query.split('"')
    if len(pieces) % 2 == 0:
        pieces[-2:] = [" ".join(pieces[-2:])]
    quoted, loose = pieces[1::2], " ".join(pieces[::2]).split()
    kept = []
    for word in loose:
        bare = "".join(c for c in word if c.isalnum())
        if len(bare) >= 2 and bare.lower() not in STOP_WORDS:
            kept.append(word)
    phrases = [re.findall(r"[^\W_]+", fold(x)) for x in quoted + kept]
    return [p for p in phrases if p]


def token_string(tokens: Column) -> Column:
    """The tokens with a space of its own on either side of each, so that counting strings counts tokens."""
    return F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))


def phrase_count(tokens: Column, joined: Column, phrase: list[str]) -> Column:
    """How often the tokens hold the phrase; ``joined`` is their :func:`token_string`.

    Only a phrase that can overlap itself needs a look at every place.
    """
    if not any(phrase[:n] == phrase[-n:] for n in range(1, len(phrase))):
        wanted = " " + "  ".join(phrase) + " "
        found = F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(wanted), F.lit("")))
        return F.coalesce((found / len(wanted.encode())).cast("int"), F.lit(0))
    last = F.size(tokens) - len(phrase) + 1
    wanted = F.array(*map(F.lit, phrase))
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.slice(tokens, i, F.lit(len(phrase))) == wanted))


def bm25(docs: DataFrame, id: str, text: str, query: str, k: int | None = 10, any_if_none: bool = True) -> DataFrame:
    """id, score (smaller is better) and matched for the documents that hold all phrases, or any if none holds all.

    Two scans and no shuffle of documents: only the phrases' counts leave a task, and the collection's figures are one row.
    """
    phrases = parse_query(query)
    if not phrases:
        return docs.select(id, F.lit(0.0).alias("score"), F.lit(0).alias("matched")).where(F.lit(False))
    # An array of one binds the tokens to a name: filters on the counts stay above it and never tokenize a text again.
    tokens = F.array(tx.tokens(F.coalesce(F.col(text), F.lit(""))))
    both = F.transform(tokens, lambda t: F.named_struct(F.lit("t"), t, F.lit("s"), token_string(t)))
    counts = lambda x: [c for i, p in enumerate(phrases) for c in (F.lit(f"__f{i}"), phrase_count(x["t"], x["s"], p))]
    bound = F.transform(both, lambda x: F.named_struct(F.lit("__len"), F.size(x["t"]), *counts(x)))
    counted = docs.select(id, F.explode_outer(bound).alias("__x")).select(id, "__x.*")
    totals = counted.agg(F.count("*").alias("__N"), F.avg("__len").alias("__avg"))
    return ranked(counted, totals, len(phrases), id, k, any_if_none)


def ranked(counted: DataFrame, totals: DataFrame, phrases: int, id: str, k: int | None, any_if_none: bool) -> DataFrame:
    """Scores of documents whose phrases are counted (__len, __f0 ..); ``totals`` has one row, __N and __avg.

    Documents without any of the phrases may be left out of ``counted``.
    """
    if not phrases:
        return counted.select(id, F.lit(0.0).alias("score"), F.lit(0).alias("matched")).where(F.lit(False))
    fs = [F.col(f"__f{i}") for i in range(phrases)]
    every = F.least(*fs, fs[0]) > 0
    own = counted.agg(F.count_if(every).alias("__all"), *(F.count_if(f > 0).alias(f"__n{i}") for i, f in enumerate(fs)))
    # Both are tables of one row.
    rows = counted.where(F.greatest(*fs, fs[0]) > 0).join(F.broadcast(own)).join(F.broadcast(totals))
    score = F.lit(0.0)
    for i, f in enumerate(fs):
        n = F.col(f"__n{i}")
        idf = F.ln((F.col("__N") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
        score = score - idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    matched = sum((f > 0).cast("int") for f in fs)
    keep = every | ((F.col("__all") == 0) & F.lit(any_if_none))
    out = rows.where(keep).select(id, score.alias("score"), matched.alias("matched"))
    return out.orderBy("score", id).limit(k) if k else out


def postings(docs: DataFrame, id: str, text: str) -> DataFrame:
    """term, id, tf, len: the inverted index without positions; :mod:`quire.operators.fulltext` stores one with them."""
    t = docs.select(id, tx.tokens(F.col(text)).alias("__t")).select(id, F.size("__t").alias("len"), F.explode("__t").alias("term"))
    return t.groupBy("term", id, "len").agg(F.count("*").alias("tf")).select("term", id, "tf", "len")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in double; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def nearest(vectors: DataFrame, query: DataFrame, id: str, vector: str, k: int | None = 10, where: Column | None = None, digits: int = 5) -> DataFrame:
    """id, score of the nearest vectors, exact, filtered before ranking; ``query`` has one row, column q."""
    rows = vectors if where is None else vectors.where(where)
    out = rows.join(F.broadcast(query.limit(1))).select(id, F.round(cosine(F.col(vector), F.col("q")), digits).alias("score")).where("score IS NOT NULL")
    return out.orderBy(F.desc("score"), id).limit(k) if k else out


def presence_cosine(text_hits: DataFrame, vector_hits: DataFrame, key: str) -> DataFrame:
    """1 for a full-text hit plus the cosine of a vector hit: not a rank fusion, whatever it may be called elsewhere."""
    from quire.operators.relational import merge_candidates

    merged = merge_candidates(text_hits.select(key, F.col("score").alias("score_text")), vector_hits.select(key, F.col("score").alias("score_vector")), key, ("fts", "vector"))
    fused = F.when(F.col("score_text").isNotNull(), 1.0).otherwise(0.0) + F.coalesce("score_vector", F.lit(0.0))
    return merged.withColumn("fused", fused)


def reciprocal_ranks(text_hits: DataFrame, vector_hits: DataFrame, key: str, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over both rankings."""
    from quire.operators.relational import merge_candidates

    rank = lambda df, order, name: df.select(key, F.row_number().over(Window.orderBy(order, key)).alias(name))  # noqa: E731  candidates are a top-k
    merged = merge_candidates(rank(text_hits, F.asc("score"), "rank_text"), rank(vector_hits, F.desc("score"), "rank_vector"), key, ("fts", "vector"))
    share = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return merged.withColumn("fused", share("rank_text") + share("rank_vector"))


def collapse_copies(rows: DataFrame, text: str, id: str, order: list[Column | str], shown: int = 3) -> DataFrame:
    """One row for each duplicate key: the first in ``order``, with the number of copies and the first few others.

    Texts without letters have no key and stay alone.  The others are capped by rank before they are gathered; ids are unique.
    """
    key = F.when(F.col("dup_key") == "", F.concat(F.lit("\0"), F.col(id).cast("string"))).otherwise(F.col("dup_key"))
    keyed = rows.withColumn("dup_key", tx.duplicate_key(F.col(text))).withColumn("__k", key)
    # Ranks, counts and the shown others need no texts; only rows that stay are read with theirs.
    rank = F.row_number().over(Window.partitionBy("__k").orderBy(*order))
    narrow = keyed.select("__k", F.col(id).alias("__id"), rank.alias("__n"))
    shown_ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("__n").between(2, shown + 1), F.struct("__n", F.col("__id").cast("string").alias("i"))))), lambda x: x["i"])
    groups = narrow.groupBy("__k").agg(F.min_by("__id", "__n").alias("__first"), F.count("*").alias("copies"), F.array_join(shown_ids, ",").alias("also_in"))
    kept = groups.select("__first", "copies", "also_in")
    return rows.withColumn("dup_key", tx.duplicate_key(F.col(text))).join(kept, F.col(id) == F.col("__first")).drop("__first")


def hits(docs: DataFrame, id: str, text: str, query: str) -> DataFrame:
    """id, n (from 1), start (from 1): non-overlapping hits of a literal, marks and case ignored, positions in the original."""
    wanted = fold(query)
    folded = docs.select(id, tx.fold_same_length(F.col(text)).alias("__f")).where(F.contains("__f", F.lit(wanted)))
    gaps = folded.select(id, F.posexplode(F.transform(F.split("__f", f"\\Q{wanted}\\E", -1), lambda p: F.length(p))).alias("__n", "__gap"))
    w = Window.partitionBy(id).orderBy("__n")
    last = F.max("__n").over(Window.partitionBy(id))
    start = F.sum("__gap").over(w) + F.col("__n") * len(wanted) + 1
    return gaps.select(id, (F.col("__n") + 1).alias("n"), start.cast("int").alias("start"), (F.col("__n") < last).alias("__hit")).where("__hit").drop("__hit")


def kwic(docs: DataFrame, id: str, source: str, text: str, query: str, each: int, context: int) -> DataFrame:
    """Hits with their snippets, at most ``each`` for a source, in the order of document and place.

    Texts leave the scan only for hits that are kept.
    """
    from quire.operators.relational import at_most

    found = hits(docs, id, text, query).join(docs.select(F.col(id).alias("__id"), source), F.col(id) == F.col("__id")).drop("__id")
    kept = at_most(found, [source], [id, "start"], each)
    rows = kept.join(docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")), F.col(id) == F.col("__id"))
    return rows.select(id, source, "rank", "start", tx.snippet(F.col("__text"), F.col("start"), len(query), context).alias("snippet"))


def tiered(rows: DataFrame, name: str, body: str, query: str, id: str, k: int | None = 10) -> DataFrame:
    """Exact name first, then the query in the name, then in the body; within a tier by name and id.

    ``k`` is for a top few, as each task sets aside room for twice as many rows; None returns all, sorted by ranges.
    """
    q = fold(query)
    n, b = tx.fold_same_length(F.col(name)), tx.fold_same_length(F.col(body))
    tier = F.when(n == q, 1).when(F.contains(n, F.lit(q)), 2).when(F.contains(b, F.lit(q)), 3)
    out = rows.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", name, id)
    return out if k is None else out.limit(k)


def reference(id: Column, volume: Column, page: Column, kind: Column, date: Column, part: Column | None = None) -> Column:
    """What a draft cites: ``[ID .. | volume p. n | kind | date]``."""
    block = F.when(part > 0, F.concat(F.lit(" block "), part.cast("string"))).otherwise("") if part is not None else F.lit("")
    return F.concat(F.lit("[ID "), F.coalesce(id.cast("string"), F.lit("-")), F.lit(" | "), F.coalesce(volume, F.lit("")), F.lit(" p. "), F.coalesce(page.cast("string"), F.lit("-")), block, F.lit(" | "), F.coalesce(kind, F.lit("-")), F.lit(" | "), F.coalesce(date.cast("string"), F.lit("undated")), F.lit("]"))
