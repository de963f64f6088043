"""Segmentation, conversion, lint, privacy and incremental work over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import ledger, privacy, relational, segment, validate
from quire.plans.registry import Tables, query

TEXT = tx.FOLD_SQL.format("text")


_STEP = """lambda acc, x: CASE WHEN length(acc.now) + length(x.now) + 2 > 1000 AND acc.now <> ''
    THEN {'done': list_append(acc.done, trim(acc.now)), 'now': right(acc.now, 100) || chr(10) || x.now}
    ELSE {'done': acc.done, 'now': CASE WHEN acc.now = '' THEN x.now ELSE acc.now || chr(10) || x.now END} END"""


@query(f"""
WITH p AS (SELECT doc_id, source, text, list_reduce(list_transform(string_split(text, chr(10)), lambda p: {{'done': []::VARCHAR[], 'now': p}}), {_STEP}, {{'done': []::VARCHAR[], 'now': ''}}) AS f FROM documents),
c AS (SELECT doc_id, source, CASE WHEN length(text) <= 1000 THEN [text] WHEN trim(f.now) <> '' THEN list_append(f.done, trim(f.now)) ELSE f.done END AS chunks FROM p),
r AS (SELECT doc_id, source, unnest(range(len(chunks)))::INTEGER AS part, unnest(chunks) AS chunk FROM c)
SELECT doc_id, part, length(chunk)::INTEGER AS chars, left(sha256(chunk), 16) AS hash, source || '|' || doc_id || '|v1|1|' || part || '|' || left(sha256(chunk), 16) AS chunk_id FROM r WHERE length(chunk) >= 1""")
def chunk_paragraphs(t: Tables) -> DataFrame:
    """Documents packed into blocks of whole lines, with an overlap."""
    rows = segment.chunks(t.documents, F.col("source"), F.col("doc_id"), F.lit("v1"), F.lit(1), "text", most=1000, overlap=100, separator="\\n", glue="\n")
    return rows.select("doc_id", "part", "chars", "hash", "chunk_id")


@query("""
WITH s AS (SELECT *, sum((role = 'user' OR rn = 1)::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS act FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations))
SELECT conv_id, act::BIGINT AS act, count(*) AS turns, min(turn) AS first_turn, sum(length(text))::BIGINT AS chars, sha256(string_agg(text, chr(10) ORDER BY turn)) AS hash FROM s GROUP BY 1, 2""")
def segment_pages_into_acts(t: Tables) -> DataFrame:
    """Consecutive turns grouped at boundaries, with a hash of what they say."""
    rows = relational.segments(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user", "act")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("conv_id", "act").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("chars"), F.sha2(text, 256).alias("hash"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
f AS (SELECT *, (length(trim(line)) BETWEEN 4 AND 80 AND len(regexp_extract_all(trim(line), '\\p{L}')) >= 4
  AND len(regexp_extract_all(trim(line), '\\p{Lu}')) * 5 >= len(regexp_extract_all(trim(line), '\\p{L}')) * 4)::INTEGER AS title FROM l),
s AS (SELECT *, sum(title) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM f)
SELECT doc_id, section::BIGINT AS section, max(CASE WHEN title = 1 THEN trim(line) END) AS title, sum(CASE WHEN title = 0 THEN length(regexp_replace(line, '\\s', '', 'g')) ELSE 0 END)::BIGINT AS body_chars FROM s GROUP BY 1, 2""")
def sections_by_title(t: Tables) -> DataFrame:
    """Documents split at lines in capitals."""
    letters = F.length(F.regexp_replace("body", r"\s", ""))
    return segment.sections(t.documents, "doc_id", "text").select("doc_id", "section", "title", letters.cast("long").alias("body_chars"))


STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({STRIPPED}) AS chars, sha256({STRIPPED}) AS hash FROM pages")
def html_to_text(t: Tables) -> DataFrame:
    """Pages without scripts, comments and tags."""
    text = tx.strip_tags(F.col("html"))
    return t.pages.select("page_id", F.length(text).cast("long").alias("chars"), F.sha2(text, 256).alias("hash"))


@query()
def html_to_markdown(t: Tables) -> DataFrame:
    """Pages with headings, lists and tables kept, by a parser; and whether letters were lost on the way."""
    from quire.operators.convert import html_to_markdown as convert

    rows = t.pages.select("page_id", tx.strip_tags(F.col("html")).alias("plain"), convert(F.col("html")).alias("md"))
    return rows.select("page_id", F.length("md").alias("chars"), validate.loss(tx.decode_entities(F.col("plain")), F.col("md")).alias("ruler"))


_ARTICLE = "regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
_BODY = "regexp_replace(" + _ARTICLE + ", '<[^>]*>', ' ', 'g')"
_ALNUM = "length(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


@query(f"""
SELECT page_id, {_ALNUM.format(STRIPPED)} AS source_alnum, {_ALNUM.format(_BODY)} AS out_alnum,
  CASE WHEN {_ALNUM.format(STRIPPED)} = 0 THEN 'unmeasured' WHEN {_ALNUM.format(_BODY)} < 0.98 * {_ALNUM.format(STRIPPED)} OR {_ALNUM.format(STRIPPED)} - {_ALNUM.format(_BODY)} > 200 THEN 'loss' ELSE 'intact' END AS status FROM pages""")
def loss_ruler(t: Tables) -> DataFrame:
    """What the main article keeps of a page's letters and digits."""
    source = tx.strip_tags(F.col("html"))
    out = F.regexp_replace(F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1), "<[^>]*>", " ")
    return t.pages.select("page_id", tx.alnum_count(source).cast("long").alias("source_alnum"), tx.alnum_count(out).cast("long").alias("out_alnum"), validate.loss(source, out).alias("status"))


@query("""
SELECT e AS entity, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '&(?:[a-z]+|#\\d+);')) AS e FROM pages) GROUP BY 1""")
def control_and_entity_census(t: Tables) -> DataFrame:
    """Entities by kind."""
    rows = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(validate.ENTITY), F.lit(0))).alias("entity"))
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


_U = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z]+://', '')"
_U = f"regexp_replace({_U}, '^(?:www|m|amp)\\.', '')"
_U = f"regexp_replace({_U}, '([?&]){tx.TRACKING}=[^&]*', '\\1', 'g')"
_U = f"regexp_replace(regexp_replace({_U}, '([?&])&+', '\\1', 'g'), '[?&]+$', '')"
_U = f"regexp_replace(lower(regexp_replace({_U}, '([^/])/+$', '\\1')), '([a-z])-\\d{{1,2}}$', '\\1')"


@query(f"SELECT {_U} AS key, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def url_identity(t: Tables) -> DataFrame:
    """addresses of one item under one key."""
    return t.pages.groupBy(tx.url_identity(F.col("url")).alias("key")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


_TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"


@query(f"""
WITH p AS (SELECT page_id, {_U} AS key, {_TITLE} AS title, contains(url, 'blog.') AS held FROM pages)
SELECT page_id FROM p WHERE NOT held AND key NOT IN (SELECT key FROM p WHERE held) AND title NOT IN (SELECT title FROM p WHERE held AND title IS NOT NULL)""")
def anti_join_new_items(t: Tables) -> DataFrame:
    """Pages that agree with no page already held, neither in address nor in title."""
    rows = t.pages.select("page_id", tx.url_identity(F.col("url")).alias("key"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.contains("url", F.lit("blog.")).alias("held"))
    return relational.not_known(rows.where("NOT held"), rows.where("held"), ["key", "title"]).select("page_id")


@query("""
WITH n AS (SELECT doc_id, sha256(text) AS v FROM documents WHERE source <> 'src3'),
b AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || '.' ELSE text END) AS v FROM documents WHERE source <> 'src7')
SELECT coalesce(n.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'obsolete' WHEN n.v = b.v THEN 'reused' ELSE 'changed' END AS status
FROM n FULL JOIN b ON n.doc_id = b.doc_id""")
def index_resume_diff(t: Tables) -> DataFrame:
    """What an index has to add, drop, replace and may keep, between two states of a collection."""
    docs = t.documents
    now = docs.where("source <> 'src3'").select("doc_id", F.sha2("text", 256).alias("v"))
    before = docs.where("source <> 'src7'").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("v"))
    return relational.difference(now, before, "doc_id", "v")


_HEAD = f"left(trim(regexp_replace({TEXT}, '[^a-z0-9]+', ' ', 'g')), 40)"


@query(f"""
WITH h AS (SELECT lang, sum(c) AS same_head FROM (SELECT lang, {_HEAD} AS h, count(*) AS c FROM documents GROUP BY 1, 2 HAVING count(*) > 1) WHERE h <> '' GROUP BY lang)
SELECT d.lang, count(*) AS n_rows, count(doc_id) - count(DISTINCT doc_id) AS repeated, greatest(max(doc_id) - count(DISTINCT doc_id) FILTER (doc_id >= 1), 0)::BIGINT AS gaps,
  count(*) FILTER (length(trim(text)) < 200) AS short, count(*) FILTER (regexp_matches(text, '\\x{{FFFD}}')) AS mojibake, count(*) FILTER (regexp_matches(text, '&(?:[a-z]+|#\\d+);')) AS entities,
  count(*) FILTER (text IS NULL) AS missing_text, coalesce(any_value(h.same_head), 0)::BIGINT AS same_head
FROM documents d LEFT JOIN h ON h.lang = d.lang GROUP BY d.lang""")
def dataset_lint(t: Tables) -> DataFrame:
    """Signs of a damaged dataset, by language."""
    return validate.lint(t.documents, "lang", "doc_id", "text", 200)


@query("""
SELECT 'label without document' AS finding, doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'document without label', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_labels(t: Tables) -> DataFrame:
    """Orphans on either side."""
    docs, labels = t.documents.select("doc_id"), t.labels.select("doc_id")
    side = lambda a, b, what: a.join(b.distinct(), "doc_id", "left_anti").select(F.lit(what).alias("finding"), "doc_id")
    return side(labels, docs, "label without document").unionByName(side(docs, labels, "document without label"))


@query("""
WITH m AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM (SELECT l_orderkey, unnest(range(1, top + 1)) AS l_linenumber FROM m) e
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = e.l_orderkey AND l.l_linenumber = e.l_linenumber)""")
def line_number_gaps(t: Tables) -> DataFrame:
    """Line numbers that an order skips."""
    return relational.gaps(t.lineitem, "l_linenumber", ["l_orderkey"])


_KINDS = ["EMAIL", "IP", "PHONE"]
_IDENTIFIERS = " UNION ALL ".join(f"SELECT doc_id, source, '{k}' AS kind, unnest(regexp_extract_all(text, '{privacy.IDENTIFIERS[k]}')) AS value, generate_subscripts(regexp_extract_all(text, '{privacy.IDENTIFIERS[k]}'), 1) - 1 AS pos FROM documents" for k in _KINDS)


@query(f"SELECT kind, count(*) AS n, count(DISTINCT value) AS distinct_values, count(DISTINCT doc_id) AS documents FROM ({_IDENTIFIERS}) GROUP BY kind")
def identifier_census(t: Tables) -> DataFrame:
    """V5: identifiers of three kinds, each looked for on its own; :func:`identifier_census_all` has all kinds."""
    values = privacy.identifier_values(t.documents, "doc_id", "text", _KINDS)
    return values.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"), F.countDistinct("doc_id").alias("documents"))


@query(f"""
WITH v AS ({_IDENTIFIERS}), f AS (SELECT source, kind, value, min((doc_id, pos)) AS f FROM v GROUP BY ALL)
SELECT source, kind, value, kind || '_' || row_number() OVER (PARTITION BY source, kind ORDER BY f, value) AS token FROM f""")
def pseudonymize_stable(t: Tables) -> DataFrame:
    """Tokens of three kinds; :func:`pseudonymize_stable_all` has all kinds, as the round trip uses them."""
    values = privacy.identifier_values(t.documents, "doc_id", "text", _KINDS).join(t.documents.select(F.col("doc_id").alias("d"), "source"), F.col("doc_id") == F.col("d"))
    return privacy.assign_tokens(values, ["source"], ["doc_id", "pos"])


def _identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, source, pos, kind, value: all kinds, in their order of precedence and outside shielded numbers."""
    return docs.select("doc_id", "source", F.posexplode(privacy.identifiers(F.col("text"))).alias("pos", "x")).select("doc_id", "source", "pos", "x.*")


@query()
def identifier_census_all(t: Tables) -> DataFrame:
    """V5: identifiers by kind, over all kinds."""
    return _identifiers(t.documents).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"), F.countDistinct("doc_id").alias("documents"))


@query()
def pseudonymize_stable_all(t: Tables) -> DataFrame:
    """Tokens of all kinds, numbered by first occurrence within a source."""
    return privacy.assign_tokens(_identifiers(t.documents), ["source"], ["doc_id", "pos"])


@query()
def pseudonymize_roundtrip(t: Tables) -> DataFrame:
    """V5 V6: texts rewritten with tokens and turned back."""
    docs = t.documents.select("doc_id", "source", "text")
    tokens = privacy.assign_tokens(_identifiers(docs), ["source"], ["doc_id", "pos"])
    hidden = privacy.pseudonymize(docs, tokens, ["source"], "doc_id", "text")
    back = privacy.restore(hidden, tokens, ["source"], "doc_id", "text").select(F.col("doc_id").alias("b"), F.col("text").alias("restored"))
    rows = docs.join(hidden.select(F.col("doc_id").alias("h"), F.col("text").alias("hidden")), F.col("doc_id") == F.col("h")).join(back, F.col("doc_id") == F.col("b"))
    return rows.select("doc_id", (F.col("hidden") != F.col("text")).alias("changed"), (F.col("restored") == F.col("text")).alias("restored"))


RULES = [("marked", "[#*%&$]{3}"), ("shouted", "[A-Z]{4,}!!"), ("secret", "(?i)(password|token|api_key) ?="), ("contact", "[A-Za-z0-9._+-]+@[a-z0-9-]+\\.[a-z]+"), ("licensed", "(?i)licen[sc]e")]


@query("SELECT kind, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in RULES) + " ELSE 'prose' END AS kind FROM documents) GROUP BY kind")
def classify_first_rule(t: Tables) -> DataFrame:
    """The first rule that a document matches."""
    return t.documents.groupBy(segment.classify(F.col("text"), RULES, "prose").alias("kind")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""
SELECT lang, count(*) AS n, count(*) FILTER (length(text) < 100) AS short, count(*) FILTER (contains(text, '@')) AS with_at, count(*) FILTER (contains(text, '!!')) AS shouted,
  count(*) FILTER (n_chars <> length(text)) AS miscounted FROM documents GROUP BY lang""")
def multi_flag_counts(t: Tables) -> DataFrame:
    """A3: several flags counted in one pass."""
    text = F.col("text")
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.length(text) < 100).alias("short"), F.count_if(F.contains(text, F.lit("@"))).alias("with_at"), F.count_if(F.contains(text, F.lit("!!"))).alias("shouted"), F.count_if(F.col("n_chars") != F.length(text)).alias("miscounted"))


@query("""
SELECT source, count(*) AS n, count(severity) AS alerts, count(*) FILTER (severity = 'high') AS high, CASE WHEN count(*) FILTER (severity = 'high') > 0 THEN 'REJECTED' WHEN count(severity) > 0 THEN 'ALERT' ELSE 'APPROVED' END AS status
FROM (SELECT d.source, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'low' END AS severity FROM documents d JOIN labels l ON l.doc_id = d.doc_id) GROUP BY source""")
def gate_status(t: Tables) -> DataFrame:
    """Whether a source passes."""
    severity = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "low")
    return validate.gate(t.documents.select("doc_id", "source").join(t.labels, "doc_id").withColumn("severity", severity), ["source"], "severity")


@query("""
SELECT source, min(doc_id) AS first_doc, max(doc_id) AS last_doc, arg_min(doc_id, (-n_chars, doc_id)) AS longest_doc FROM documents GROUP BY source""")
def first_last_longest_wins(t: Tables) -> DataFrame:
    """The three ways to choose one row a key, without a window."""
    return t.documents.groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("longest_doc"))


@query("""
SELECT route, band, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM (SELECT CASE WHEN length(text) // 3 <= 2000 THEN 'local' ELSE 'remote' END AS route,
  (length(text) // 3 > 500)::INTEGER + (length(text) // 3 > 2000)::INTEGER + (length(text) // 3 > 8000)::INTEGER AS band, length(text) // 3 AS tokens FROM documents) GROUP BY 1, 2""")
def token_routing(t: Tables) -> DataFrame:
    """Work by size."""
    text = F.col("text")
    return t.documents.groupBy(ledger.route(text, 2000).alias("route"), ledger.bands(text, [500, 2000, 8000]).alias("band")).agg(F.count("*").alias("n"), F.sum(tx.token_estimate(text)).alias("tokens"))


@query("SELECT source, median(n_chars) AS median, round(quantile_cont(n_chars, 0.9), 3) AS p90, max(n_chars) AS longest FROM documents GROUP BY source")
def size_percentiles(t: Tables) -> DataFrame:
    """Median, ninetieth percentile and largest."""
    return t.documents.groupBy("source").agg(F.percentile("n_chars", 0.5).alias("median"), F.round(F.percentile("n_chars", 0.9), 3).alias("p90"), F.max("n_chars").alias("longest"))


@query("""
WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://([^?#]*).*$', '\\1'), '/') AS parts FROM pages)
SELECT array_to_string(parts[1:i], '/') AS folder, count(*) AS n FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p) GROUP BY 1""")
def subtree_counts(t: Tables) -> DataFrame:
    """Pages at and below each folder of their addresses."""
    return relational.subtree_counts(t.pages.select(F.regexp_replace("url", "^[a-z]+://([^?#]*).*$", "$1").alias("path")), "path")


@query("""
SELECT conv_id, role, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / any_value(total), 6) AS share, min(turn) AS first_turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations) GROUP BY 1, 2""")
def speech_shares(t: Tables) -> DataFrame:
    """How much each speaker says, and when first."""
    said = t.conversations.groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("chars"), F.min("turn").alias("first_turn"))
    total = said.groupBy(F.col("conv_id").alias("c")).agg(F.sum("chars").alias("total"))
    return said.join(total, F.col("conv_id") == F.col("c")).select("conv_id", "role", "chars", F.round(F.col("chars") / F.col("total"), 6).alias("share"), "first_turn")


@query("""
WITH u AS (SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, a.turn, u.turn AS marker_position, u.chars::INTEGER AS chars FROM a ASOF LEFT JOIN u ON a.conv_id = u.conv_id AND a.turn >= u.turn""")
def kwic_asof_heading(t: Tables) -> DataFrame:
    """The question before each answer."""
    turns = t.conversations
    marks = turns.where("role = 'user'").select("conv_id", "turn", F.length("text").alias("chars"))
    return relational.asof_backward(turns.where("role = 'assistant'").select("conv_id", "turn"), marks, ["conv_id"], "turn", ["chars"])


@query("SELECT DISTINCT user_id FROM events")
def seen_key_stream(t: Tables) -> DataFrame:
    """T4: each key once, by a stream that runs until its source is empty."""
    from quire.plans.streams import run_seen_keys

    return run_seen_keys(t.spark, t.folder)


@query("SELECT page_id, url FROM pages")
def incremental_file_sweep(t: Tables) -> DataFrame:
    """A folder swept twice gives each row once."""
    from quire.plans.streams import run_sweep

    return run_sweep(t.spark, t.folder)
