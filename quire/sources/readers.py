"""Sources: files of all kinds as DataFrames, and a batch source for paged listings.

Network access stays outside: pages that a crawler has landed are read as text and parsed here.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.functions import text as tx
from quire.operators.convert import decode


def file_name(path: Column | str = "path") -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def binary_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content; one row for paths that differ in case only."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).withColumn("__key", F.lower("path")).dropDuplicates(["__key"]).drop("__key")


def triage(inputs: DataFrame, outputs: DataFrame, name: str = "name", skip: tuple[str, ...] = (".tmp", ".crdownload", ".part")) -> DataFrame:
    """Inputs that have work to do: no temporary name, and no output as new as they are.  Both have ``name`` and modified."""
    wanted = inputs.where(~F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in skip) + ")$") & ~F.startswith(name, F.lit("~$")))
    done = outputs.select(F.col(name).alias("__name"), F.col("modified").alias("__done"))
    return wanted.join(done, (F.col(name) == F.col("__name")) & (F.col("__done") >= F.col("modified")), "left_anti")


def text_corpus(spark: SparkSession, path: str, family: list[tuple[str, str]] | None = None) -> DataFrame:
    """path, name, text and family of whole text files; bytes are decoded by what they are, not by what they claim."""
    from quire.operators.segment import classify

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select("path", file_name().alias("name"), decode(F.col("content")).alias("text"))
    return rows.withColumn("family", classify(F.col("name"), family or []))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """path, name, meta (front matter), body of Markdown notes."""
    rows = text_corpus(spark, path)
    return rows.select("path", "name", tx.front_matter(F.col("text")).alias("meta"), tx.body_after_front_matter(F.col("text")).alias("body"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A tab-separated index with header and stated schema; no file, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines log; a line that does not parse is left out."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])).option("columnNameOfCorruptRecord", "__bad").json(path)
    return rows.where("__bad IS NULL").drop("__bad")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """path, record (VARIANT): a list at the root, or the first list of objects among the root's values."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.try_parse_json(decode(F.col("content"))).alias("v"))
    root = F.try_variant_get("v", "$", "array<variant>")
    members = F.map_values(F.try_variant_get("v", "$", "map<string,variant>"))
    lists = F.filter(F.transform(members, lambda m: F.try_variant_get(m, "$", "array<variant>")), lambda a: a.isNotNull() & (F.size(a) > 0))
    objects = F.filter(lists, lambda a: F.try_variant_get(F.get(a, 0), "$", "map<string,variant>").isNotNull())
    return raw.select("path", F.explode(F.coalesce(root, F.get(objects, 0))).alias("record"))


def field(record: str, names: list[str], kind: str = "string") -> Column:
    """The first of several fields that a record has."""
    return F.coalesce(*(F.try_variant_get(record, f"$.{n}", kind) for n in names))


def keyed_last_wins(spark: SparkSession, paths: list[str], key: list[str], body: list[str]) -> DataFrame:
    """key, body over several JSON files; of one key the record of the last file in order."""
    rows = json_records(spark, paths[0])
    for p in paths[1:]:
        rows = rows.unionByName(json_records(spark, p))
    rows = rows.select("path", field("record", key).alias("key"), field("record", body).alias("body")).where("key IS NOT NULL")
    return rows.groupBy("key").agg(F.max_by("body", "path").alias("body"))


def cases(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Registered cases: active unless they say otherwise, optionally only some."""
    rows = json_records(spark, path).select(field("record", ["id", "cnj"]).alias("id"), F.coalesce(F.try_variant_get("record", "$.ativo", "boolean"), F.lit(True)).alias("active"), "record")
    rows = rows.where("active")
    return rows.where(F.col("id").isin(ids)) if ids else rows


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id of each line that is neither empty nor a remark."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("id")).where("id <> ''")


def volume_urls(spark: SparkSession, path: str) -> DataFrame:
    """url, volume, part of static lists of addresses."""
    n = lambda p: F.regexp_extract("value", p, 1).try_cast("int")
    return spark.read.text(path).where("value LIKE 'http%'").select(F.trim("value").alias("url"), n(r"(\d+)(?:_\d+)?\.\w+$").alias("volume"), n(r"\d_(\d+)\.\w+$").alias("part"))


_TERM = "struct<term:string,note:string,relations:array<struct<kind:string,target:string>>>"


def thesaurus(landed: DataFrame, xml: str) -> DataFrame:
    """term, note, kind, target: the relations of terms in landed XML, whose invalid signs and bare ampersands are mended."""
    clean = F.regexp_replace(tx.without_controls(F.regexp_replace(F.col(xml), r"^\s*<\?xml[^>]*\?>", "")), r"&(?!(?:#\d+|#x[0-9A-Fa-f]+|\w+);)", "&amp;")
    items = F.regexp_extract_all(clean, F.lit(r"(?s)<termo\b[^>]*>(.*?)</termo>"), F.lit(1))
    rows = landed.select(F.explode(items).alias("t"))
    one = lambda tag: F.trim(tx.decode_entities(F.regexp_extract("t", f"(?s)<{tag}>(.*?)</{tag}>", 1)))
    kinds = ["USE", "UP", "TG", "TE", "TR", "CATEGORIA"]
    relations = F.concat(*(F.transform(F.regexp_extract_all("t", F.lit(f"(?s)<{k}>(.*?)</{k}>"), F.lit(1)), _relation(k)) for k in kinds))
    return rows.select(one("nome").alias("term"), one("NE").alias("note"), F.explode_outer(relations).alias("r")).select("term", "note", "r.*")


def _relation(kind: str):
    return lambda x: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("target"), F.trim(tx.decode_entities(x)))


def listing(landed: DataFrame, html: str, base: str) -> DataFrame:
    """url, title of the links in landed listing pages, each once."""
    zipped = F.arrays_zip(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref=[\"']([^\"'#]+)[\"'][^>]*>.*?</a>"), F.lit(1)).alias("u"), F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref=[\"'][^\"'#]+[\"'][^>]*>(.*?)</a>"), F.lit(1)).alias("t"))
    rows = landed.select(F.explode(zipped).alias("x")).select(F.col("x.u").alias("href"), tx.strip_tags(F.col("x.t")).alias("title"))
    url = F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("href", "^/", "")))
    return rows.select(url.alias("url"), "title").where("title <> ''").dropDuplicates(["url"])


class _Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class PagedListing(DataSource):
    """Batch source ``paged_listing``: pages of JSON records below a folder that executors share, one partition a run of pages.

    Options: ``path`` with page-1.json, page-2.json .., ``pages``, ``per_partition``.  An adapter for a live listing overrides
    ``fetch``; pages that are not there end nothing and give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pages, self.step = options["path"], int(options["pages"]), int(options.get("per_partition", 10))

    def partitions(self) -> list[InputPartition]:
        return [_Pages(a, min(a + self.step - 1, self.pages)) for a in range(1, self.pages + 1, self.step)]

    def fetch(self, page: int) -> list:
        name = os.path.join(self.path, f"page-{page}.json")
        if not os.path.exists(name):
            return []
        with open(name, encoding="utf-8") as f:
            return json.load(f)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in range(partition.value[0], partition.value[1] + 1):
            for record in self.fetch(page):
                yield page, json.dumps(record, ensure_ascii=False)


class HttpListing(PagedListing):
    """Batch source ``http_listing``: the same over HTTP, one partition a run of pages.

    Options: ``url`` with ``{page}`` in it, ``pages``, ``per_partition``, ``field`` (where the records are, if not at the root),
    ``tries``, ``wait`` (seconds before the second try; each next one waits twice as long), ``timeout``, ``headers`` (JSON).
    A page that is not there (404, 410) has no rows; one that cannot be had after all tries fails the task, which Spark runs anew.
    """

    @classmethod
    def name(cls) -> str:
        return "http_listing"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _HttpReader(self.options)


class _HttpReader(_PagedReader):
    def __init__(self, options: dict):
        super().__init__({"path": "", **options})
        self.url, self.field, self.headers = options["url"], options.get("field"), json.loads(options.get("headers", "{}"))
        self.tries, self.wait, self.timeout = int(options.get("tries", 4)), float(options.get("wait", 1)), float(options.get("timeout", 30))

    def fetch(self, page: int) -> list:
        import time
        import urllib.error
        import urllib.request

        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url.format(page=page), headers=self.headers), timeout=self.timeout) as answer:
                    records = json.load(answer)
                return records[self.field] if self.field else records
            except urllib.error.HTTPError as e:
                if e.code in (404, 410):
                    return []
                if attempt + 1 == self.tries or (e.code < 500 and e.code != 429):
                    raise
            except (urllib.error.URLError, TimeoutError):
                if attempt + 1 == self.tries:
                    raise
            time.sleep(self.wait * 2**attempt)
        return []


@F.pandas_udf(T.StringType())
def _literal(source: pd.Series, name: pd.Series) -> pd.Series:
    import ast

    def one(text: str | None, wanted: str) -> str | None:
        try:
            tree = ast.parse(text or "")
        except SyntaxError:
            return None
        for node in tree.body:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
            if any(isinstance(t, ast.Name) and t.id == wanted for t in targets):
                try:
                    return json.dumps(ast.literal_eval(node.value), ensure_ascii=False)
                except (ValueError, TypeError):
                    return None
        return None

    return pd.Series([one(s, n) for s, n in zip(source, name)], dtype=object)


def registry_literal(source: Column, name: str) -> Column:
    """The value that a module's source assigns to a name, as JSON; the source is read, never run.  Anything else is null."""
    return _literal(source, F.lit(name))
