"""Filters, look-ups, ledgers, orders, sets, page measures and rules of dates over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.dates import age_at
from quire.operators import calendar as cal
from quire.operators import convert, extract, ledger, lookup, models, relational, validate
from quire.plans.registry import Tables, query
from quire.sources import readers, sinks
from quire.streaming import incremental

# Filters and look-ups -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type IN ('ECONOMY', 'PROMO') AND p_retailprice >= 900")
def filters_given(t: Tables) -> DataFrame:
    """Equality, lists and ranges; a filter that is not given is none."""
    return lookup.where_given(t.part, p_size=(10, 20), p_type=["ECONOMY", "PROMO"], p_retailprice=(900.0, None), p_brand=None, p_name=None).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size <= 17 AND p_size + p_partkey % 9 >= 17")
def editions_held(t: Tables) -> DataFrame:
    """The ranges that hold a number."""
    ranges = t.part.select("p_partkey", F.col("p_size").alias("first"), (F.col("p_size") + F.col("p_partkey") % 9).alias("last"))
    return lookup.holds(ranges, "first", "last", 17).select("p_partkey")


@query("SELECT p_partkey AS id, contains(p_name, 'red') AS folded, contains(p_name, 'red') AS lower, false AS unmarked FROM part")
def names_containing(t: Tables) -> DataFrame:
    """Marks and case ignored, or case alone."""
    name = F.concat(F.lit("AÇÃO "), F.upper("p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), (lookup.contains_folded(name, "acao") & lookup.contains_folded(name, "Réd")).alias("folded"), (lookup.contains_lower(name, "ação") & lookup.contains_lower(name, "red")).alias("lower"), lookup.contains_lower(name, "acao").alias("unmarked"))


@query("SELECT p_partkey AS id, ['in force', 'cancelled', 'pending', NULL, 'cancelled'][p_partkey % 5 + 1] AS status, CASE p_partkey % 3 WHEN 0 THEN 'court' WHEN 1 THEN 'law' END AS family FROM part")
def statuses_and_families(t: Tables) -> DataFrame:
    """Statuses in words, and the family that a file's name tells."""
    words = F.element_at(F.array(*map(F.lit, ["Vigente", "CANCELADA (2021)", "suspensa", "?", "Revogada"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ["Inf0800_STJ.md", "codigo_penal.txt", "notas.md"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), lookup.in_force(words).alias("status"), lookup.family(name, {"court": ["stj", "stf"], "law": ["codigo", "lei"]}).alias("family"))


_ARTICLES = "SELECT p_partkey, p_size || CASE WHEN p_partkey % 4 = 0 THEN '-A' ELSE '' END AS article, p_name FROM part"


@query(f"""
WITH a AS ({_ARTICLES}), f AS (SELECT 'key' AS asked, *, row_number() OVER (ORDER BY p_name) AS rank FROM a WHERE article = '7-A'
UNION ALL SELECT 'text', *, row_number() OVER (ORDER BY regexp_extract(article, '^[0-9]+')::INTEGER, regexp_extract(article, '[A-Z]*$'), article, p_name) FROM a WHERE contains(p_name, 'widget'))
SELECT asked, article, p_name FROM f WHERE rank <= 20""")
def articles_looked_up(t: Tables) -> DataFrame:
    """A query that looks like an article's number is one, any other is looked for in the text; natural order."""
    article = F.concat(F.lit("Art. "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 4 == 0, "-a").otherwise("º"))
    rows = t.part.select("p_partkey", article.alias("label"), tx.article_key(article).alias("article"), "p_name")
    asked = lambda q, name: lookup.look_up(rows, "article", "p_name", q, 20).select(F.lit(name).alias("asked"), "article", "p_name")
    return asked("art. 7-A", "key").unionByName(asked("Widget", "text"))


@query("""
WITH b AS (SELECT DISTINCT p_size, p_type FROM part WHERE p_size = 7), h AS (SELECT bool_or(p_type = 'ECONOMY') AS has, min(p_type) FILTER (p_type <> 'ECONOMY') AS other FROM b)
SELECT '7' AS wanted, has AS found, CASE WHEN NOT has THEN other END AS hint FROM h""")
def articles_in_blocks(t: Tables) -> DataFrame:
    """P10: an article of the permanent text, or a hint at the other block that has it."""
    rows = t.part.select(F.col("p_type").alias("block"), F.col("p_size").cast("string").alias("article"))
    return lookup.look_up_block(rows, "block", "article", "ECONOMY", "7").select("wanted", F.col("found").isNotNull().alias("found"), "hint")


@query("""
WITH n AS (SELECT p_partkey, p_name, p_name = 'red ring' AS exact, contains(p_name, 'red ring') AS part FROM part)
SELECT p_partkey, p_name FROM n WHERE CASE WHEN (SELECT bool_or(exact) FROM n) THEN exact ELSE part END""")
def names_exact_else_partial(t: Tables) -> DataFrame:
    """Rows of exactly that name if there are any, else those that hold it."""
    return lookup.exact_else_partial(t.part, "p_name", "Red Ring").select("p_partkey", "p_name")


@query("""
WITH a AS (SELECT o_orderkey AS act, o_custkey % 50 AS id, (o_orderkey % 40) * 10 AS a, (o_orderkey % 40) * 10 + 9 AS b FROM orders WHERE o_orderkey < 400),
c AS (SELECT p_partkey AS cite, p_partkey % 60 AS id, p_size * 7 AS page FROM part WHERE p_partkey < 300)
SELECT cite, arg_min(act, (NOT coalesce(page BETWEEN a AND b, false), act)) AS act FROM c LEFT JOIN a ON a.id = c.id GROUP BY cite""")
def acts_of_citations(t: Tables) -> DataFrame:
    """The act that holds the page, else the first with the id; an id that none carries stays without (none is alike)."""
    act = t.orders.where("o_orderkey < 400").select(F.col("o_orderkey").alias("act"), F.format_string("%08d", F.col("o_custkey") % 50 * 1111111).alias("id"), F.array().cast("array<string>").alias("variants"), (F.col("o_orderkey") % 40 * 10).alias("pag_ini"), (F.col("o_orderkey") % 40 * 10 + 9).alias("pag_fim"))
    cite = t.part.where("p_partkey < 300").select(F.col("p_partkey").alias("__cite"), F.format_string("%08d", F.col("p_partkey") % 60 * 1111111).alias("cid"), (F.col("p_size") * 7).alias("page"))
    return validate.resolve_id(cite, act, "cid", "page", 0.99).select(F.col("__cite").alias("cite"), "act")


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2') AND NOT regexp_matches(source, '[37]$')")
def sources_left_out(t: Tables) -> DataFrame:
    """Sources left out by list and by pattern."""
    known = t.spark.createDataFrame([("src1",), ("src2",)], "source string")
    return relational.not_known(t.documents, known, ["source"]).where(~F.col("source").rlike("[37]$")).select("doc_id")


# Files, stages, queues ------------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey AS name FROM orders o WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate)""")
def files_to_do(t: Tables) -> DataFrame:
    """Inputs without temporary names and without an output as new as they are."""
    name = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".tmp"))).when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("~$"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    done = t.lineitem.select(F.col("l_orderkey").cast("string").alias("name"), F.col("l_shipdate").alias("modified"))
    return readers.triage(t.orders.select(name.alias("name"), F.col("o_orderdate").alias("modified")), done).select(F.col("name").cast("long").alias("name"))


@query("""
WITH i AS (SELECT o_custkey, max(o_orderdate) AS i FROM orders GROUP BY 1), o AS (SELECT o_custkey, max(l_shipdate) AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 GROUP BY 1)
SELECT i.o_custkey AS stage FROM i LEFT JOIN o ON i.o_custkey = o.o_custkey WHERE o IS NULL OR i > o""")
def stages_to_run(t: Tables) -> DataFrame:
    """Stages whose input is newer than their output, or that have none."""
    newest = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("i"))
    made = t.lineitem.where("l_linenumber = 1").join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c").agg(F.max("l_shipdate").alias("o"))
    return incremental.stale(newest.join(made, F.col("o_custkey") == F.col("c"), "left"), "i", "o").select(F.col("o_custkey").alias("stage"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'x1' WHEN 'click' THEN 'x2' END AS extractor FROM events WHERE event_type = 'error' OR (event_type = 'click' AND contains(props, '7'))")
def extraction_tasks(t: Tables) -> DataFrame:
    """Acts with each extractor of their kind whose pattern occurs in them."""
    extractors = t.spark.createDataFrame([("x1", ["error"], None), ("x2", ["click", "none"], "7"), ("x3", ["absent"], None)], "extractor string, kinds array<string>, pattern string")
    return ledger.tasks(t.events, extractors, "event_type", "props").select("event_id", "extractor")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def queue_uncached(t: Tables) -> DataFrame:
    """Work that no cache holds yet."""
    return ledger.uncached(t.orders.select("o_orderkey"), t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT event_id, floor(epoch(ts))::BIGINT % 240 > 120 AS edited FROM events")
def edited_files(t: Tables) -> DataFrame:
    """Files changed more than two minutes after they were written."""
    stamped = F.lit("2024-01-01 00:00:00").cast("timestamp")
    seconds = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))) % 240
    return t.events.select("event_id", lookup.edited_since(stamped, stamped + F.make_dt_interval(secs=seconds)).alias("edited"))


@query("SELECT event_type, count(*) AS n, CASE WHEN bool_or(value > 499) THEN 'error' WHEN bool_or(value > 400) THEN 'pending' ELSE 'ok' END AS status FROM events GROUP BY 1")
def batch_statuses(t: Tables) -> DataFrame:
    """The worst outcome of each batch."""
    return lookup.status_order(t.events.withColumn("s", F.when(F.col("value") > 499, "error").when(F.col("value") > 400, "pending").otherwise("ok")), ["event_type"], "s")


# Aggregates -----------------------------------------------------------------------------------------------------------------


@query("""
SELECT lang, count(*) AS n, sum(n_chars)::DOUBLE AS chars, 'detail' AS level FROM documents GROUP BY lang
UNION ALL SELECT NULL, count(*), coalesce(sum(n_chars), 0)::DOUBLE, 'total' FROM documents""")
def totals_by_language(t: Tables) -> DataFrame:
    """Counts and sums by language, and the grand totals beside them."""
    return ledger.totals(t.documents, ["lang"], {"chars": F.col("n_chars").cast("double")})


@query("SELECT doc_id, 2 AS headers, 3 AS clean, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 0 END AS dirty, CASE WHEN doc_id % 2 = 0 THEN 'no' ELSE 'yes' END AS ordinals_ok, (n_chars + 44 + CASE WHEN doc_id % 2 = 0 THEN 16 ELSE 0 END) / 2.0 < 800 AS thin FROM documents WHERE n_chars = length(text) AND NOT regexp_matches(text, '(?i)hc [0-9]|[0-9][ºo?]')")
def volumes_measured(t: Tables) -> DataFrame:
    """A volume's distinct headers, clean and corrupt ordinals, and whether it is thin."""
    docs = t.documents.where((F.col("n_chars") == F.length("text")) & ~F.col("text").rlike("(?i)hc [0-9]|[0-9][ºo?]"))
    text = F.concat(F.lit("HC 1\nhc  1\nHC 2\nart 1º, 2º, 3º   "), F.rpad(F.lit(""), 11, "-"), F.when(F.col("doc_id") % 2 == 0, " 1? 2? 3? 4? ...").otherwise(""), F.col("text"))
    rows = ledger.measure_volumes(docs.withColumn("text", text), "doc_id", "text", F.lit(2), r"(?i)hc\s+[0-9]", "[0-9]º", r"[0-9]\?")
    return rows.select("doc_id", "headers", "clean", "dirty", "ordinals_ok", "thin")


@query("SELECT length(text) // 300 AS band, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1")
def token_histogram(t: Tables) -> DataFrame:
    """Documents by hundreds of estimated tokens, and each band's share."""
    bands = t.documents.groupBy(F.floor(tx.token_estimate(F.col("text")) / 100).alias("band")).agg(F.count("*").alias("n"))
    total = bands.agg(F.sum("n").alias("total"))
    return bands.join(F.broadcast(total)).select("band", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT o_custkey, count(DISTINCT o_orderdate) AS dates, count(DISTINCT o_orderdate) > 1 AS warn FROM orders GROUP BY 1")
def date_warnings(t: Tables) -> DataFrame:
    """Groups with more than one date."""
    return t.orders.groupBy("o_custkey").agg(F.countDistinct("o_orderdate").alias("dates")).withColumn("warn", F.col("dates") > 1)


@query("SELECT event_type, count(*) AS quotes, count(*) FILTER (value >= 100) AS located FROM events GROUP BY 1")
def quotes_tallied(t: Tables) -> DataFrame:
    """How many of the quotations that a model put into records their source holds."""
    text = F.concat(F.lit("O acusado foi visto no local dos fatos "), F.col("event_id").cast("string"))
    said = F.when(F.col("value") >= 100, F.lit("acusado foi visto no local")).otherwise(F.lit("jamais se ouviu falar disso ali"))
    acts = t.events.select("event_type", text.alias("source"), F.concat(F.lit('{"quotes": ["'), said, F.lit('"')).alias("answer"))
    # The model's answer is cut off, and repaired before it is read.
    read = models.extract(acts, "answer", lambda prompt: prompt, "quotes array<string>")
    return ledger.grounding_tally(read.select("event_type", "record.quotes", "source"), ["event_type"], "quotes", "source")


# Orders and sets ------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def first_three(t: Tables) -> DataFrame:
    """The first three of each source."""
    return relational.at_most(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate"), ["c_custkey"], ["o_orderdate", "o_orderkey"], 3).select("c_custkey", "o_orderkey", "rank")


@query("""
WITH d AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM d WHERE n = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def top_after_dedup(t: Tables) -> DataFrame:
    """The best over all, after one row a key."""
    return relational.first_wins(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("""
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS n, p_name FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY coalesce(n, 9999), p_partkey) AS place, row_number() OVER (ORDER BY n DESC NULLS LAST, p_partkey) AS newest, row_number() OVER (ORDER BY length(p_name) DESC, p_name, p_partkey) AS longest FROM r WHERE p_partkey < 500""")
def orders_with_gaps(t: Tables) -> DataFrame:
    """Rows without a number come last, newest first, longest key first; every order is total."""
    rows = t.part.where("p_partkey < 500").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("n"), "p_name")
    place = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("long")  # noqa: E731  500 rows
    return rows.select("p_partkey", place(F.coalesce("n", F.lit(9999)), "p_partkey").alias("place"), place(F.desc_nulls_last("n"), "p_partkey").alias("newest"), place(F.desc(F.length("p_name")), "p_name", "p_partkey").alias("longest"))


@query("""
WITH a AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS have, list_distinct(list(o_orderpriority)) AS p FROM orders GROUP BY 1)
SELECT o_custkey, list_sort(list_filter(['F', 'O', 'P'], lambda x: NOT list_contains(have, x))) AS missing, list_has_all(have, ['F', 'O']) AS complete, len(p)::INTEGER AS kinds FROM a""")
def sets_compared(t: Tables) -> DataFrame:
    """What is missing, whether all that is required is there, distinct values."""
    own = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("have"), F.collect_set("o_orderpriority").alias("p"))
    wanted = F.array(*map(F.lit, "FOP"))
    return own.select("o_custkey", F.array_sort(F.array_except(wanted, F.col("have"))).alias("missing"), (F.size(F.array_except(F.array(F.lit("F"), F.lit("O")), F.col("have"))) == 0).alias("complete"), F.size("p").alias("kinds"))


@query("""
SELECT o_custkey, o_orderdate, left(o_orderpriority, 3) AS label, min(o_orderkey) AS first_order FROM orders GROUP BY ALL""")
def union_first_by_key(t: Tables) -> DataFrame:
    """A union with one row for each date and beginning of the label, the first."""
    rows = t.orders.select("o_custkey", "o_orderdate", F.left("o_orderpriority", F.lit(3)).alias("label"), "o_orderkey")
    both = rows.where("o_orderkey % 2 = 0").unionByName(rows.where("o_orderkey % 2 = 1")).unionByName(rows.where("o_orderkey % 10 = 0"))
    return relational.first_wins(both, ["o_custkey", "o_orderdate", "label"], ["o_orderkey"]).withColumnRenamed("o_orderkey", "first_order")


# Pages and figures ----------------------------------------------------------------------------------------------------------


@query("""
WITH i AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_partkey % 5 AS hash FROM lineitem), p AS (SELECT doc, count(DISTINCT page) AS n FROM i GROUP BY 1)
SELECT i.doc, hash, count(DISTINCT page) AS on_pages FROM i JOIN p ON p.doc = i.doc GROUP BY i.doc, hash, n HAVING count(DISTINCT page) >= least(3, greatest(2, n // 2))""")
def figures_recurring(t: Tables) -> DataFrame:
    """Figures that recur on so many pages that they are furniture."""
    images = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 5).alias("hash"))
    return convert.furniture(images, "doc", "page", "hash", images.groupBy("doc").agg(F.countDistinct("page").alias("n_pages")))


@query("SELECT l_orderkey AS doc, min(l_linenumber) AS page, md5((l_partkey % 5)::VARCHAR) AS md5 FROM lineitem GROUP BY l_orderkey, l_partkey % 5")
def images_extracted(t: Tables) -> DataFrame:
    """C14: one image for each content in a document, the first."""
    images = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 5).cast("string").alias("content"))
    return convert.first_images(images, "doc", "content", ["page"]).select("doc", "page", "md5")


@query("SELECT l_orderkey AS doc, round(least(sum(l_quantity) / 100, 1), 6) AS image_cover FROM lineitem GROUP BY 1")
def image_cover(t: Tables) -> DataFrame:
    """How much of a page images cover, one at most."""
    images = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").alias("area"), F.lit(100.0).alias("page_area"))
    return convert.image_cover(images, ["doc"], "area", "page_area").select("doc", F.round("image_cover", 6).alias("image_cover"))


@query("SELECT l_orderkey AS doc, CASE WHEN bool_or(l_quantity > 48) THEN 'scan' WHEN bool_or(l_tax > 0.07) THEN 'case' WHEN bool_or(l_returnflag = 'R') THEN 'book' ELSE 'generic' END AS profile FROM lineitem GROUP BY 1")
def profiles_detected(t: Tables) -> DataFrame:
    """The first rule that some sampled page fulfils."""
    rules = [("scan", F.col("l_quantity") > 48), ("case", F.col("l_tax") > 0.07), ("book", F.col("l_returnflag") == "R")]
    return convert.detect_profile(t.lineitem.withColumnRenamed("l_orderkey", "doc"), ["doc"], rules)


@query("""
WITH h AS (SELECT l_linenumber AS page, (l_partkey % 256)::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER o AS w0, sum(n * bin) OVER o AS s0, sum(n) OVER a AS w, sum(n * bin) OVER a AS s FROM h WINDOW o AS (PARTITION BY page ORDER BY bin), a AS (PARTITION BY page)),
v AS (SELECT page, bin, coalesce(w0::DOUBLE * (w - w0) * pow(s0::DOUBLE / w0 - (s - s0)::DOUBLE / nullif(w - w0, 0), 2), 0) AS v FROM w)
SELECT page, arg_min(bin, (-v, bin)) AS threshold FROM v GROUP BY page""")
def otsu_thresholds(t: Tables) -> DataFrame:
    """C11: the grey level that parts a page's histogram best."""
    histogram = t.lineitem.groupBy(F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 256).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return convert.otsu(histogram, ["page"])


@query("""
WITH RECURSIVE p AS (SELECT l_orderkey AS doc, l_quantity AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n FROM lineitem),
b AS (SELECT doc, n, size, 1 AS bin, size AS held FROM p WHERE n = 1
UNION ALL SELECT p.doc, p.n, p.size, b.bin + (b.held + p.size > 58.2)::INTEGER, CASE WHEN b.held + p.size > 58.2 THEN p.size ELSE b.held + p.size END FROM b JOIN p ON p.doc = b.doc AND p.n = b.n + 1)
SELECT doc, n, bin FROM b""")
def parts_packed(t: Tables) -> DataFrame:
    """Parts packed greedily, in order, into bins of 97 % of a capacity."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    parts = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.row_number().over(order).cast("long").alias("n"), F.col("l_quantity").alias("size"))
    return convert.bins(parts, ["doc"], "n", "size", 60.0).select("doc", "n", "bin")


@query("""
SELECT c_custkey AS id, unnest([1, 2, 3, 4, 5, 6]) AS n, unnest(['CPF', 'CNPJ', 'EMAIL', 'POSTCODE', 'PHONE', NULL]) AS kind FROM customer""")
def tokens_classified(t: Tables) -> DataFrame:
    """Kinds of identifier of recognised tokens, a digit more or less allowed; a phone of two tokens."""
    tokens = F.array(*map(F.lit, ["123.456.789-0", "12.345.678/0001-95", "a.b@c.org", "78000-000", "(65)", "3333-1234x"]))
    five = F.element_at(tokens, 5)
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.posexplode(F.transform(tokens, lambda x: F.when(x == "3333-1234x", F.lit("99999-1234y")).when(x == five, F.lit("3333-1234")).otherwise(x))).alias("p", "token"))
    return convert.token_kinds(rows.withColumn("n", F.col("p") + 1), ["id"], "n", "token").select("id", "n", "kind")


@query("SELECT p_partkey AS id, 2 AS n FROM part WHERE p_name = 'red ring'")
def phrases_in_tokens(t: Tables) -> DataFrame:
    """Where a phrase begins among recognised tokens, marks and case ignored."""
    words = F.split(F.concat(F.lit("x "), F.initcap("p_name"), F.lit(", y")), " ")
    rows = t.part.select(F.col("p_partkey").alias("id"), F.posexplode(words).alias("p", "token")).withColumn("n", F.col("p") + 1)
    return convert.phrase_matches(rows, ["id"], "n", "token", ["réd", "ring"])


# Dates ----------------------------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, (datediff('year', o_orderdate, DATE '2024-06-15') - CASE WHEN (month(o_orderdate), day(o_orderdate)) > (6, 15) THEN 1 ELSE 0 END)::INTEGER AS age,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderdate <= DATE '1996-01-01' THEN 'timely' ELSE 'late' END AS filed FROM orders""")
def ages_and_timeliness(t: Tables) -> DataFrame:
    """Whole years at a day, and whether something was filed in time."""
    day = F.col("o_orderdate").cast("date")
    due = F.when(F.col("o_orderkey") % 4 != 0, F.lit("1996-01-01").cast("date"))
    return t.orders.select("o_orderkey", age_at(day, F.lit("2024-06-15").cast("date")).alias("age"), extract.timely(day, due).alias("filed"))


@query("""
SELECT DATE '2024-03-01' + i::INTEGER AS day, CASE i WHEN 5 THEN 'state day' WHEN 12 THEN 'town day' END AS name FROM (VALUES (5), (12)) v(i)""")
def holidays_of_a_district(t: Tables) -> DataFrame:
    """D3: local holidays of general scopes and of one's own district, not those of others."""
    local = t.spark.sql("SELECT date_add(DATE'2024-03-01', i) AS day, scope, name FROM VALUES (5, 'estadual', 'state day'), (12, ' Cuiaba ', 'town day'), (13, 'outra', 'elsewhere') AS v(i, scope, name)")
    return cal.holidays(t.spark, 2024, 2024, local, "Cuiabá", ("estadual",)).where("day BETWEEN DATE'2024-03-01' AND DATE'2024-03-27'")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND event_id % 3 > 0")
def milestones_of_acts(t: Tables) -> DataFrame:
    """Acts that interrupt and have a date."""
    acts = t.events.select("event_id", F.when(F.col("event_type") == "error", "SENTENCA").otherwise("JUNTADA").alias("kind"), F.when(F.col("event_id") % 3 > 0, F.col("ts").cast("date")).alias("date"))
    return cal.milestones_of(acts, "kind", "date").select("event_id")


# Reports --------------------------------------------------------------------------------------------------------------------


@query("""
SELECT 0 AS n, '| r_regionkey | r_name |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey) + 1, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region""")
def report_table(t: Tables) -> DataFrame:
    """K8: a table to be read by people."""
    return sinks.markdown_table(t.region, ["r_regionkey", "r_name"], ["r_regionkey"]).withColumn("n", F.col("n").cast("long"))


@query("SELECT 'SPEAKER audio 1 ' || turn || '.500 2.250 <NA> <NA> ' || role || ' <NA> <NA>' AS value FROM conversations")
def speaker_files(t: Tables) -> DataFrame:
    """K7: turns in the format of speaker diarization files."""
    return sinks.speaker_lines(t.conversations.select((F.col("turn") + 0.5).alias("start"), (F.col("turn") + 2.75).alias("end"), "role"), "audio", "start", "end", "role")


@query("""
WITH v AS (SELECT DISTINCT o_custkey % 7 AS scope, o_orderpriority AS kind, o_clerk AS value FROM (SELECT *, o_custkey % 11 AS o_clerk FROM orders))
SELECT scope, kind, count(*) AS tokens, min(value) AS least FROM v GROUP BY ALL""")
def token_map_summary(t: Tables) -> DataFrame:
    """V7: how many tokens of each kind a map holds."""
    from quire.operators.privacy import assign_tokens

    values = t.orders.select((F.col("o_custkey") % 7).alias("scope"), F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 11).alias("value"), F.col("o_orderkey").alias("pos"))
    return assign_tokens(values, ["scope"], ["pos"]).groupBy("scope", "kind").agg(F.count("*").alias("tokens"), F.min("value").alias("least"))
