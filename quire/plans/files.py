"""Round trips through files: what sinks write, sources read, and the SQL asks of the tables themselves."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import models, pdf
from quire.plans.registry import Tables, query
from quire.sources import readers, sinks
from quire.sources.scratch import lock, new_path, unlock, write_text
from quire.streaming import incremental

_CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal FROM customer"


@query(_CUSTOMERS)
def json_lines_round_trip(t: Tables) -> DataFrame:
    """A log of JSON lines that is appended to; a line that does not parse is left out."""
    path, rows = new_path(t.spark, "log"), t.customer.select("c_custkey", "c_name", "c_acctbal")
    sinks.json_lines(rows.where("c_custkey % 2 = 0"), path)
    sinks.json_lines(rows.where("c_custkey % 2 = 1"), path, "append")
    t.spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    return readers.json_lines(t.spark, path, "c_custkey long, c_name string, c_acctbal double")


@query(_CUSTOMERS)
def tsv_round_trip(t: Tables) -> DataFrame:
    """A tab-separated index of fixed columns; a file that is not there has no rows."""
    path, schema = new_path(t.spark, "index"), "c_custkey long, c_name string, c_acctbal double"
    sinks.tsv(t.customer, path, ["c_custkey", "c_name", "c_acctbal"], ["c_custkey"])
    return readers.tsv(t.spark, path, schema).unionByName(readers.tsv(t.spark, path + "-none", schema))


@query("SELECT c_custkey, c_name, true AS marked, false AS empty_written FROM customer")
def csv_with_mark_round_trip(t: Tables) -> DataFrame:
    """K5: CSV for spreadsheets, with a byte-order mark; an empty table writes nothing."""
    path = new_path(t.spark, "sheet")
    marked = sinks.csv_with_mark(t.customer.select("c_custkey", "c_name"), path)
    empty = sinks.csv_with_mark(t.customer.limit(0), path + "-empty")
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    heads = int(files.agg(F.bool_and(F.hex(F.substring("content", 1, 3)) == "EFBBBF")).first()[0])
    rows = t.spark.read.csv(path, header=True, schema="c_custkey long, c_name string")
    return rows.select("c_custkey", "c_name", F.lit(marked and heads == 1).alias("marked"), F.lit(empty).alias("empty_written"))


@query("SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'v2 ' || s_name ELSE s_name END AS body FROM supplier")
def json_datasets_last_wins(t: Tables) -> DataFrame:
    """Several JSON files, lists at the root or below it, keyed by the first field there is; the last file wins."""
    path = new_path(t.spark, "datasets")
    record = lambda key, body: F.to_json(F.collect_list(F.struct(F.col("s_suppkey").alias(key), body.alias("texto"))))
    first = t.supplier.agg(record("numero", F.col("s_name")).alias("value"))
    second = t.supplier.where("s_suppkey % 3 = 0").agg(F.concat(F.lit('{"versao": 2, "itens": '), record("id", F.concat(F.lit("v2 "), F.col("s_name"))), F.lit("}")).alias("value"))
    first.coalesce(1).write.text(path + "/a")
    second.coalesce(1).write.text(path + "/b")
    return readers.keyed_last_wins(t.spark, [path + "/a/*.txt", path + "/b/*.txt"], ["numero", "id"], ["texto"])


@query("SELECT n_nationkey::VARCHAR AS id FROM nation WHERE n_nationkey % 3 > 0")
def cases_registered(t: Tables) -> DataFrame:
    """Registered cases, active unless they say otherwise."""
    path = new_path(t.spark, "cases")
    active = F.when(F.col("n_nationkey") % 3 == 0, False).when(F.col("n_nationkey") % 3 == 1, True)
    t.nation.agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("id"), active.alias("ativo")))).alias("value")).coalesce(1).write.text(path)
    return readers.cases(t.spark, path + "/*.txt").select("id")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, NULL::VARCHAR AS region, 'corpo de ' || n_name AS body FROM nation")
def notes_round_trip(t: Tables) -> DataFrame:
    """A Markdown file for each document, its front matter read back, absent values as null."""
    path = new_path(t.spark, "vault")
    text = F.concat(sinks.front_matter({"id": F.col("n_nationkey"), "name": F.col("n_name"), "region": F.lit(None).cast("string")}), F.lit("\ncorpo de "), F.col("n_name"))
    sinks.markdown_files(t.nation, path, "n_nationkey", text)
    meta = F.col("meta")
    return readers.notes(t.spark, path).select(meta["id"].alias("id"), meta["name"].alias("name"), meta["region"].alias("region"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("body"))


@query("SELECT count(*) AS files, true AS found, true AS missing FROM nation")
def files_collected(t: Tables) -> DataFrame:
    """Files of a tree, each once; the first folder of several that exists."""
    path = new_path(t.spark, "tree")
    sinks.markdown_files(t.nation, path, "n_nationkey", F.col("n_name"))
    found = readers.first_existing(t.spark, [path + "-none", path]) == path
    missing = readers.first_existing(t.spark, [path + "-none"]) is None
    return readers.binary_files(t.spark, path, "*.txt").agg(F.count("*").alias("files")).withColumns({"found": F.lit(found), "missing": F.lit(missing)})


@query("SELECT p_partkey::VARCHAR AS id FROM part WHERE p_partkey % 4 > 0")
def id_lists(t: Tables) -> DataFrame:
    """Ids of a list with remarks and empty lines."""
    path = new_path(t.spark, "ids")
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("# "), F.col("p_name"))).otherwise(F.concat(F.lit("  "), F.col("p_partkey").cast("string"), F.lit(" # "), F.col("p_name")))
    t.part.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    return readers.id_list(t.spark, path)


@query("SELECT 'http://x.org/vol_' || (p_partkey + 1) || CASE WHEN p_partkey % 2 = 0 THEN '_' || p_size ELSE '' END || '.pdf' AS url, (p_partkey + 1)::INTEGER AS volume, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS part FROM part")
def volume_addresses(t: Tables) -> DataFrame:
    """Static lists of addresses, with volume and part."""
    path = new_path(t.spark, "urls")
    url = F.concat(F.lit("http://x.org/vol_"), (F.col("p_partkey") + 1).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise(""), F.lit(".pdf"))
    t.part.select(F.explode(F.array(url, F.lit("a remark"))).alias("value")).write.text(path)
    return readers.volume_urls(t.spark, path)


@query("""
SELECT r_name || ' & co' AS term, 'note on ' || r_name AS note, 'TE' AS kind, n_name AS target FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || ' & co', 'note on ' || r_name, 'USE', 'x < y' FROM region""")
def thesaurus_terms(t: Tables) -> DataFrame:
    """Relations of terms in XML with invalid signs and bare ampersands; a term that was crawled twice counts once."""
    below = t.nation.groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.concat(F.lit("<TE>"), F.col("n_name"), F.lit("</TE>"))), "").alias("te"))
    rows = t.region.join(below, F.col("r_regionkey") == F.col("n_regionkey"))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="x"?><t><termo id="1"><nome>'), F.col("r_name"), F.lit(" & co</nome><NE>note\x01 on "), F.col("r_name"), F.lit("</NE><USE>x &lt; y</USE>"), F.col("te"), F.lit("</termo></t>"))
    landed = rows.select(F.explode(F.array(xml, xml)).alias("xml"))
    found = readers.thesaurus(landed, "xml")
    from quire.operators.relational import first_wins

    return first_wins(found, ["term", "kind", "target"], ["note"])


_LINK = """(?is)<a\\b[^>]*\\bhref=["'']([^"''#]+)["''][^>]*>(.*?)</a>"""


@query(f"""
WITH l AS (SELECT unnest(regexp_extract_all(html, '{_LINK}', 1)) AS u, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS t FROM pages)
SELECT DISTINCT CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'http://base.org/' || regexp_replace(u, '^/', '') END AS url FROM l WHERE trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) <> ''""")
def listing_links(t: Tables) -> DataFrame:
    """The links of landed listing pages, each once."""
    return readers.listing(t.pages, "html", "http://base.org").select("url")


@query("SELECT (s_suppkey // 7 + 1)::INTEGER AS page, s_suppkey, s_name FROM supplier UNION ALL SELECT NULL, -1, 'status' FROM region WHERE r_regionkey = 0")
def paged_listings(t: Tables) -> DataFrame:
    """Pages of a listing as partitions of a batch source; a page that is not there has no rows."""
    import json
    from itertools import groupby

    path = new_path(t.spark, "listing")
    # A listing as a crawler lands it: a few small files.
    rows = [(r.s_suppkey // 7 + 1, {"id": r.s_suppkey, "nome": r.s_name}) for r in t.supplier.orderBy("s_suppkey").select("s_suppkey", "s_name").collect()]
    for page, own in groupby(rows, lambda r: r[0]):
        write_text(t.spark, f"{path}/page-{page}.json", json.dumps([record for _, record in own]))
    t.spark.dataSource.register(readers.PagedListing)
    last = rows[-1][0] if rows else 1
    read = t.spark.read.format("paged_listing").options(path=path.removeprefix("file://"), pages=str(last + 2), per_partition="5").load()
    found = read.select("page", F.from_json("record", "id long, nome string").alias("r")).select("page", F.col("r.id").alias("s_suppkey"), F.col("r.nome").alias("s_name"))
    return found.unionByName(t.spark.createDataFrame([(None, -1, "status")], found.schema))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN upper(p_name) ELSE p_name END AS p_name, p_size % 3 AS collection FROM part")
def collections_replaced(t: Tables) -> DataFrame:
    """A collection written anew replaces itself and leaves the others; writing twice changes nothing."""
    path, rows = new_path(t.spark, "collections"), t.part.select("p_partkey", "p_name", (F.col("p_size") % 3).alias("collection"))
    sinks.by_collection(rows, path)
    for _ in range(2):
        sinks.by_collection(rows.where("collection = 1").withColumn("p_name", F.upper("p_name")), path)
    return t.spark.read.parquet(path).select("p_partkey", "p_name", "collection")


# Incremental work -----------------------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || '.' ELSE text END) AS version FROM documents WHERE source <> 'src7'), b AS (SELECT doc_id, sha256(text) AS version FROM documents WHERE source <> 'src3')
SELECT b.doc_id, b.version, CASE WHEN a.version = b.version THEN 0 ELSE 1 END AS generation FROM b LEFT JOIN a ON a.doc_id = b.doc_id""")
def index_resumed(t: Tables) -> DataFrame:
    """An index brought up to date: known versions stay where they are, changed and new rows come, obsolete ones go."""
    index, docs = new_path(t.spark, "resumed"), t.documents
    then = docs.where("source <> 'src7'").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("version"))
    now = docs.where("source <> 'src3'").select("doc_id", F.sha2("text", 256).alias("version"))
    incremental.resync(t.spark, index, then, "doc_id", "version", 0)
    for _ in range(2):  # an attempt that is made again leaves the same index
        incremental.resync(t.spark, index, now, "doc_id", "version", 1)
    return incremental.current(t.spark, index, "doc_id").select("doc_id", "version", "generation")


@query("SELECT DISTINCT user_id FROM events")
def seen_keys_for_ever(t: Tables) -> DataFrame:
    """Each key once over several batches and two runs of a stream, whatever the time between them."""
    source, out, state = (new_path(t.spark, name) for name in ("arrivals", "unseen", "unseen-state"))
    t.events.select("user_id", "event_id").repartition(4, "event_id").write.parquet(source)
    stream = lambda: t.spark.readStream.schema("user_id long, event_id long").option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        incremental.unseen_stream(stream(), out, state, "user_id", ["event_id"]).awaitTermination()
    return incremental.current(t.spark, out, "user_id").select("user_id")


# PDF, models, deliveries ----------------------------------------------------------------------------------------------------


def _pdf(pages: list[str], deflate: bool) -> bytes:
    """A small PDF with a page for each text, its lines moved down one by one."""
    import zlib

    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))), len(pages)), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    for i, text in enumerate(pages):
        show = b" ".join(b"(%s) Tj 0 -14 Td" % re.sub(rb"([()\\\\])", rb"\\\1", line.encode("cp1252")) for line in text.split("\n") if line)
        content = b"BT /F1 12 Tf 72 720 Td " + show + b" ET"
        packed = zlib.compress(content) if deflate else content
        bodies[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        bodies[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n" % (len(packed), b" /Filter /FlateDecode" if deflate else b"") + packed + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in bodies.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


@query("""
SELECT p_partkey AS id, unnest(CASE WHEN p_partkey % 10 = 9 THEN [NULL] ELSE [1, 2, 3] END) AS page, unnest(CASE WHEN p_partkey % 10 = 9 THEN [NULL] ELSE ['Página (1) é ' || p_name || chr(10) || p_brand, '', 'fim ' || p_size] END) AS text,
  unnest(CASE WHEN p_partkey % 10 = 9 THEN [NULL] ELSE [false, true, false] END) AS empty, p_partkey % 10 = 9 AS failed FROM part""")
def pdf_pages(t: Tables) -> DataFrame:
    """The text layer of PDF files, empty pages told apart, a file that is none as a row with its error."""
    @F.pandas_udf("binary")
    def made(id: pd.Series, name: pd.Series, brand: pd.Series, size: pd.Series) -> pd.Series:
        rows = zip(id, name, brand, size)
        return pd.Series([b"none" if i % 10 == 9 else _pdf([f"Página (1) é {n}\n{b}", "", f"fim {z}"], i % 2 == 0) for i, n, b, z in rows])

    files = t.part.select(F.col("p_partkey").alias("id"), made("p_partkey", "p_name", "p_brand", "p_size").alias("content"))
    return pdf.pages(files, "id", "content").select("id", "page", "text", "empty", F.col("error").isNotNull().alias("failed"))


def _cheap(prompt: str) -> str:
    if "7" in prompt:
        raise ValueError("too hard")
    return prompt.upper()


@query("""
WITH c AS (SELECT p_partkey AS id, p_name || ' ' || p_size AS q, CASE WHEN contains(p_size::VARCHAR, '7') THEN 'dear' ELSE 'cheap' END AS tier FROM part)
SELECT id, tier, CASE WHEN tier = 'cheap' THEN upper(q) ELSE q END AS answer, CASE WHEN tier = 'dear' THEN ['cheap: too hard'] ELSE [] END AS errors,
  round((length(q) // 3) * CASE WHEN tier = 'cheap' THEN 1000 + 2000 ELSE 30000 + 60000 END / 1e6, 4) AS cost FROM c""")
def models_in_tiers(t: Tables) -> DataFrame:
    """The first model that answers, what failed before it, and what it cost."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("q"))
    tiers = [("cheap", _cheap, 1000.0, 2000.0), ("dear", str, 30000.0, 60000.0)]
    return models.call_tiered(rows, "q", tiers).select("id", "tier", "answer", "errors", "cost")


@query("SELECT n_nationkey AS id, 2 AS rows_logged FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n_nationkey, 1 FROM nation WHERE n_nationkey % 5 > 0")
def deliveries_resumed(t: Tables) -> DataFrame:
    """Each row sent once over two attempts; the first of them fails for some, and only these are sent again."""
    log, rows = new_path(t.spark, "deliveries"), t.nation.select(F.col("n_nationkey").cast("long").alias("id"), "n_name")

    def fails(record: dict) -> None:
        if record["id"] % 5 == 0:
            raise OSError("not now")

    sinks.deliver(rows, "id", fails, log)
    done = sinks.deliver(rows, "id", lambda record: None, log)
    return done.groupBy("id").agg(F.count("*").cast("int").alias("rows_logged"))


@query("SELECT p_partkey AS id, '[\"' || p_name || '\", ' || p_size || ']' AS registry, NULL::VARCHAR AS computed FROM part")
def registries_read(t: Tables) -> DataFrame:
    """A literal that a module's source assigns, read without running it; what would have to be computed is not read."""
    source = F.concat(F.lit("import os\nREGISTRY = ['"), F.col("p_name"), F.lit("', "), F.col("p_size").cast("string"), F.lit("]\nOTHER: list = os.listdir('.')\n"))
    return t.part.select(F.col("p_partkey").alias("id"), readers.registry_literal(source, "REGISTRY").alias("registry"), readers.registry_literal(source, "OTHER").alias("computed"))


@query("SELECT r_regionkey, r_name, 'ok, error' AS outcomes, true AS first, false AS second, true AS released FROM region")
def mirrors_and_locks(t: Tables) -> DataFrame:
    """Rows mirrored to several targets, a broken one reported; a lock that only one holds."""
    target, held = new_path(t.spark, "mirror"), new_path(t.spark, "lock")
    done = sinks.mirror(t.region, [target, "nosuchscheme://x/y"])
    outcomes = ", ".join(x.split(":")[0] for x in done.values())
    first, second = lock(t.spark, held, "a", 600), lock(t.spark, held, "b", 600)
    released = not unlock(t.spark, held, "b") and unlock(t.spark, held, "a")
    return t.spark.read.parquet(target).withColumns({"outcomes": F.lit(outcomes), "first": F.lit(first), "second": F.lit(second), "released": F.lit(released)}).select("r_regionkey", "r_name", "outcomes", "first", "second", "released")


@query("SELECT '<tr><td>' || r_regionkey || '</td><td>' || r_name || ' &amp; &lt;co></td></tr>' AS value FROM region")
def catalogue_pages(t: Tables) -> DataFrame:
    """A catalogue page with a row for each entry and its own search."""
    page = sinks.html_catalogue(t.region.select("r_regionkey", F.concat("r_name", F.lit(" & <co>")).alias("name")), ["r_regionkey", "name"], "Regions")
    return page.where("value LIKE '<tr>%'")
