"""Search, ranking, copies, keyword in context, vectors."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import fulltext, quotes
from quire.operators import relational as rel
from quire.operators import search as s
from quire.plans.registry import Tables, query, spread
from quire.sources.readers import exists
from quire.sources.scratch import path_of, shared_dir

TEXT = tx.FOLD_SQL.format("text")
TOKENS = f"regexp_extract_all({TEXT}, '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(words: list[str], k: int) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(words))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(words)))
    every = " AND ".join(f"f{i} > 0" for i in range(len(words)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(words)))
    idf = [f"CASE WHEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) ELSE {s.LEAST_IDF} END" for i in range(len(words))]
    score = " + ".join(f"{idf[i]} * (f{i} * {s.K1 + 1}) / (f{i} + {s.K1} * ({1 - s.B} + {s.B} * dl / avgdl))" for i in range(len(words)))
    matched = " + ".join(f"(f{i} > 0)::INTEGER" for i in range(len(words)))
    return f"""
WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
f AS (SELECT doc_id, len(t) AS dl, {tf} FROM t),
g AS (SELECT count(*) AS N, avg(dl) AS avgdl, count(*) FILTER ({every}) AS n_all, {n} FROM f),
r AS (SELECT doc_id, -({score}) AS score, {matched} AS matched FROM f, g WHERE ({every}) OR (n_all = 0 AND ({some})))
SELECT doc_id, round(score, 6) AS score, matched::INTEGER AS matched FROM r ORDER BY r.score, doc_id LIMIT {k}"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", F.round("score", 6).alias("score"), "matched")


@query(_bm25_sql(["thing", "hand", "est"], 10))
def bm25_scan(t: Tables) -> DataFrame:
    """R2 O1: full-text ranking of the documents that hold all words, by reading all texts."""
    return _rounded(s.bm25(spread(t.documents), "doc_id", "text", "thing hand est", 10))


@query(_bm25_sql(["thing", "qqzznone"], 10))
def bm25_and_or_fallback(t: Tables) -> DataFrame:
    """no document holds all words, so any will do."""
    return _rounded(s.bm25(spread(t.documents), "doc_id", "text", "thing qqzznone", 10))


PHRASE = ["the", "and"]
_PAIRS = f"len(list_filter(range(1, len(t)), lambda i: t[i] = '{PHRASE[0]}' AND t[i + 1] = '{PHRASE[1]}'))"


def _index(t: Tables) -> str:
    """The stored index of the documents: built when first asked for, and kept as long as the table stays as it is and the
    driver runs."""
    table, system = path_of(t.spark, f"{t.folder}/documents.parquet")
    state = f"{t.folder} {system.getContentSummary(table).getLength()} {system.getFileStatus(table).getModificationTime()}"
    path = f"{shared_dir(t.spark)}/quire/fulltext-{hashlib.sha1(state.encode()).hexdigest()[:16]}"
    if not exists(t.spark, f"{path}/totals/_SUCCESS"):
        fulltext.build(spread(t.documents.select("doc_id", "text")), "doc_id", "text", path)
        stored, _ = path_of(t.spark, path)
        system.deleteOnExit(stored)
    return path


@query(_bm25_sql(["thing", "hand", "est"], 10))
def bm25_topk(t: Tables) -> DataFrame:
    """The same ranking from a stored index: only the postings of the query's terms are read."""
    return _rounded(fulltext.search(t.spark, _index(t), "doc_id", "thing hand est", 10))


@query(_bm25_sql(["thing"], 10).replace("len(list_filter(t, lambda x: x = 'thing')) AS f0", f"{_PAIRS} AS f0, len(list_filter(t, lambda x: x = '{PHRASE[0]}')) AS unused"))
def bm25_phrase(t: Tables) -> DataFrame:
    """A quoted phrase, from the positions that the index stores."""
    return _rounded(fulltext.search(t.spark, _index(t), "doc_id", f'"{PHRASE[0]} {PHRASE[1]}"', 10))


@query(f"""
WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM t GROUP BY term""")
def term_index(t: Tables) -> DataFrame:
    """The inverted index, summed by term."""
    return s.postings(t.documents, "doc_id", "text").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").cast("long").alias("occurrences"))


@query(f"""
WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM t GROUP BY term""")
def fulltext_index(t: Tables) -> DataFrame:
    """The stored index, built if it is not there, summed by term."""
    stored = t.spark.read.parquet(f"{_index(t)}/postings")
    return stored.groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("occurrences"))


KWIC, CONTEXT, EACH = "pation", 60, 3


@query(f"""
WITH f AS (SELECT doc_id, source, text, {TEXT} AS f FROM documents WHERE contains({TEXT}, '{KWIC}')),
p AS (SELECT doc_id, source, text, unnest(string_split(f, '{KWIC}')) AS piece, generate_subscripts(string_split(f, '{KWIC}'), 1) AS n FROM f),
h AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n) + (n - 1) * {len(KWIC)} + 1 AS start, max(n) OVER (PARTITION BY doc_id) AS last FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, start) AS rank FROM h WHERE n < last)
SELECT doc_id, source, rank::INTEGER AS rank, start::INTEGER AS start, trim(regexp_replace(
  substr(text, greatest(start - {CONTEXT // 2}, 1)::BIGINT, (least(start + {len(KWIC)} + {CONTEXT // 2}, length(text) + 1) - greatest(start - {CONTEXT // 2}, 1))::BIGINT), '\\s+', ' ', 'g')) AS snippet
FROM r WHERE rank <= {EACH}""")
def kwic_hits(t: Tables) -> DataFrame:
    """Hits with their surroundings, a few for each source."""
    return s.kwic(t.documents, "doc_id", "source", "text", KWIC, EACH, CONTEXT)


@query(f"SELECT source, count(*) AS documents, sum((length({TEXT}) - length(replace({TEXT}, '{KWIC}', ''))) // {len(KWIC)})::BIGINT AS hits FROM documents WHERE contains({TEXT}, '{KWIC}') GROUP BY source")
def kwic_titles_only(t: Tables) -> DataFrame:
    """Which sources hold a phrase, and how often."""
    hits = s.hits(t.documents, "doc_id", "text", KWIC).groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = t.documents.select(F.col("doc_id").alias("d"), "source")
    return hits.join(docs, F.col("doc_id") == F.col("d")).groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("hits"))


COSINE = "round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5)"


def _query_vector(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))


@query(f"SELECT v.vec_id, {COSINE} AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(t: Tables) -> DataFrame:
    """Exact nearest vectors."""
    return s.nearest(t.embeddings, _query_vector(t), "vec_id", "embedding", 10)


@query(f"SELECT v.vec_id, {COSINE} AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk_prefilter(t: Tables) -> DataFrame:
    """O2: filtered before ranking."""
    return s.nearest(t.embeddings, _query_vector(t), "vec_id", "embedding", 10, F.col("label") == 3)


def _candidates(t: Tables) -> tuple[DataFrame, DataFrame]:
    text = fulltext.search(t.spark, _index(t), "doc_id", "thing hand est", 20)
    return text, s.nearest(t.embeddings, _query_vector(t), "vec_id", "embedding", 20).withColumnRenamed("vec_id", "doc_id")


_HYBRID = f"""
WITH a AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS ra FROM ({_bm25_sql(["thing", "hand", "est"], 20).replace("round(score, 6) AS score", "r.score AS score")})),
b AS (SELECT vec_id AS doc_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rb FROM (SELECT v.vec_id, {COSINE} AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20)),
m AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'fts' WHEN a.doc_id IS NULL THEN 'vector' ELSE 'fts+vector' END AS via, a.score AS sa, b.score AS sb, ra, rb FROM a FULL JOIN b ON a.doc_id = b.doc_id)
"""


@query(_HYBRID + "SELECT doc_id, via, round((sa IS NOT NULL)::INTEGER + coalesce(sb, 0), 5) AS fused FROM m")
def hybrid_fusion_presence_cosine(t: Tables) -> DataFrame:
    """Both candidate sets merged, one for a full-text hit plus the cosine."""
    return s.presence_cosine(*_candidates(t), "doc_id").select("doc_id", "via", F.round("fused", 5).alias("fused"))


@query(_HYBRID + "SELECT doc_id, via, round(coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0), 6) AS fused FROM m")
def hybrid_rrf(t: Tables) -> DataFrame:
    """Reciprocal rank fusion proper."""
    return s.reciprocal_ranks(*_candidates(t), "doc_id").select("doc_id", "via", F.round("fused", 6).alias("fused"))


DUP_KEY = f"substr(regexp_replace({TEXT}, '[^\\p{{L}}\\p{{N}}]', '', 'g'), 1, 200)"


@query(f"""
WITH k AS (SELECT doc_id, {DUP_KEY} AS k FROM documents),
r AS (SELECT *, CASE WHEN k = '' THEN 'id' || doc_id ELSE 'k' || k END AS g FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) AS n FROM r)
SELECT min(doc_id) AS doc_id, count(*) AS copies, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (n BETWEEN 2 AND 4), '') AS also_in FROM n GROUP BY g""")
def near_dup_collapse(t: Tables) -> DataFrame:
    """One row for texts that open alike, with where else they occur."""
    return s.collapse_copies(spread(t.documents.select("doc_id", "text")), "text", "doc_id", ["doc_id"]).select("doc_id", "copies", "also_in")


@query("""
SELECT left(sha256(text), 16) AS hash, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_hash_groups(t: Tables) -> DataFrame:
    """Texts that occur more than once."""
    hashed = t.documents.select("doc_id", "source", tx.content_hash(F.col("text")).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""
WITH r AS (SELECT p_partkey, p_name, CASE WHEN p_name = 'red ring' THEN 'exact' WHEN contains(p_name, 'ring') THEN 'in name' WHEN p_type = 'PROMO' THEN 'in body' END AS how FROM part WHERE p_size <= 12)
SELECT p_partkey, p_name, how FROM r WHERE how IS NOT NULL""")
def tiered_lookup(t: Tables) -> DataFrame:
    """Exact names first, then names that hold the query, then bodies that do."""
    rows = t.part.where("p_size <= 12").select("p_partkey", F.when(F.col("p_name") == "red ring", "Ring").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_type") == "PROMO", "a RING set").otherwise("none").alias("body"), "p_name")
    found = s.tiered(rows, "name", "body", "ring", "p_partkey", None)
    return found.select("p_partkey", "p_name", F.when(F.col("tier") == 1, "exact").when(F.col("tier") == 2, "in name").otherwise("in body").alias("how"))


@query("""
WITH r AS (SELECT p_partkey, p_name, CASE WHEN p_name = 'red ring' THEN 1 WHEN contains(p_name, 'ring') THEN 2 ELSE 3 END AS tier FROM part WHERE p_size = 7 AND (contains(p_name, 'ring') OR p_type = 'PROMO'))
SELECT p_partkey, tier FROM r ORDER BY tier, CASE WHEN p_name = 'red ring' THEN 'Ring' ELSE p_name END, p_partkey LIMIT 12""")
def tiered_top(t: Tables) -> DataFrame:
    """The first dozen over all tiers."""
    rows = t.part.where("p_size = 7").select("p_partkey", F.when(F.col("p_name") == "red ring", "Ring").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_type") == "PROMO", "a RING set").otherwise("none").alias("body"))
    return s.tiered(rows, "name", "body", "ring", "p_partkey", 12).select("p_partkey", "tier")


@query("""
WITH c AS (SELECT *, greatest(score, 0) AS s FROM (SELECT v.vec_id, """ + COSINE + """ AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q))
SELECT CASE WHEN score >= 0.3 THEN 'near' WHEN score >= 0 THEN 'some' ELSE 'away' END AS band, count(*) AS n FROM c GROUP BY 1""")
def cosine_bands(t: Tables) -> DataFrame:
    """How the whole table lies around one vector."""
    scored = s.nearest(t.embeddings, _query_vector(t), "vec_id", "embedding", None)
    return scored.groupBy(F.when(F.col("score") >= 0.3, "near").when(F.col("score") >= 0, "some").otherwise("away").alias("band")).agg(F.count("*").alias("n"))


@query(f"""
WITH q AS (SELECT conv_id, turn, regexp_extract_all({TEXT}, '[\\p{{L}}\\p{{N}}]+') AS t, role FROM conversations),
a AS (SELECT conv_id, turn, role, list_distinct(list_filter(t, lambda x: length(x) >= 4 AND x <> 'that' AND x <> 'with')) AS k FROM q),
p AS (SELECT *, lead(k) OVER w AS nk, lead(role) OVER w AS nr FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, len(k)::INTEGER AS wanted, len(list_intersect(k, nk))::INTEGER AS given, round(CASE WHEN len(k) > 0 THEN len(list_intersect(k, nk)) / len(k) END, 6) AS coverage
FROM p WHERE role = 'user' AND nr = 'assistant'""")
def keyword_coverage(t: Tables) -> DataFrame:
    """How much of a question's vocabulary its answer takes up."""
    from pyspark.sql import Window

    from quire.operators.validate import coverage, keywords

    rows = t.conversations.withColumn("k", keywords(F.col("text"), ["that", "with"]))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumns({"nk": F.lead("k").over(w), "nr": F.lead("role").over(w)}).where("role = 'user' AND nr = 'assistant'")
    return rows.select("conv_id", "turn", F.size("k").alias("wanted"), F.size(F.array_intersect("k", "nk")).alias("given"), F.round(coverage(F.col("k"), F.col("nk")), 6).alias("coverage"))


GRAM = 8


_SQUASH = f"trim(regexp_replace({TEXT}, '[^a-z0-9]+', ' ', 'g'))"
_GRAMS_SQL = f"SELECT DISTINCT {{id}}, array_to_string(w[i:i + {GRAM - 1}], ' ') AS gram FROM (SELECT {{id}}, w, unnest(range(1, len(w) - {GRAM - 2})) AS i FROM (SELECT {{id}}, list_filter(string_split({_SQUASH}, ' '), lambda x: x <> '') AS w FROM {{table}}))"


@query(f"""
WITH b AS ({_GRAMS_SQL.format(id="item_id", table="benchmark")}), d AS ({_GRAMS_SQL.format(id="doc_id", table="documents")}),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
SELECT b.item_id, d.doc_id, count(*) AS shared, round(count(*) / any_value(n.n), 6) AS share FROM b JOIN d ON b.gram = d.gram JOIN n ON n.item_id = b.item_id GROUP BY 1, 2""")
def contamination_ngrams(t: Tables) -> DataFrame:
    """F25 as a semi-join: which documents share runs of words with which benchmark items, and how much of them."""
    b, d = quotes.grams(t.benchmark, "item_id", "text", GRAM), quotes.grams(spread(t.documents), "doc_id", "text", GRAM)
    n = b.groupBy(F.col("item_id").alias("i")).agg(F.count("*").alias("n"))
    shared = b.join(d, "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    return shared.join(n, F.col("item_id") == F.col("i")).select("item_id", "doc_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("share"))


@query(f"""
WITH b AS (SELECT item_id, {_SQUASH} AS q, length({_SQUASH}) // 3 AS n FROM benchmark), d AS (SELECT doc_id, {_SQUASH} AS s FROM documents)
SELECT item_id, doc_id FROM b JOIN d ON length(q) >= 8 AND (contains(s, q) OR (n >= 4 AND contains(s, substr(q, 1, n))::INTEGER + contains(s, substr(q, n + 1, n))::INTEGER + contains(s, substr(q, 2 * n + 1, n))::INTEGER >= 2))""")
def quote_grounding(t: Tables) -> DataFrame:
    """benchmark items that a document holds whole or in two of three thirds."""
    return quotes.grounded_in(t.benchmark, "item_id", "text", spread(t.documents), "doc_id", "text")


@query()
def fuzzy_cascade(t: Tables) -> DataFrame:
    """Names resolved exactly, by the only prefix, or by the only alike name."""
    from quire.operators.segment import resolve_ids

    known = t.part.select(F.col("p_name").alias("entry")).distinct()
    spoilt = F.when(F.col("p_size") < 15, F.col("p_name")).when(F.col("p_size") < 30, F.expr("substring(p_name, 1, length(p_name) - 1)")).otherwise(F.concat(F.expr("substring(p_name, 1, 3)"), F.lit("x"), F.expr("substring(p_name, 4)")))
    return resolve_ids(t.part.select(spoilt.alias("id")), known, "id", "entry")


@query("""
WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT source, doc_id, n_chars, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def longest_per_source(t: Tables) -> DataFrame:
    """The three longest of each source."""
    return rel.at_most(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 3)
