import math
import os
import subprocess
import sys
import textwrap

import duckdb
import pytest

from quire.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert columns == sorted(duck.sql(catalogue.oracle_sql()[name]).columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    got = df.select(*columns).collect()
    assert sorted(tuple(map(cell, r)) for r in got) == sorted(tuple(map(cell, r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_others_run(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_chunks_reassemble(spark, sf_dir):
    from pyspark.sql import functions as F

    from quire.operators import segment

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = docs.select("doc_id", F.posexplode(segment.pack(F.col("text"), 1000, 0, "\\n", "\n")).alias("part", "chunk"))
    whole = plain.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "chunk"))), lambda x: F.trim(x["chunk"])), "\n").alias("again"))
    rows = docs.join(whole, "doc_id").select(F.regexp_replace("text", r"\s", "") == F.regexp_replace("again", r"\s", "")).collect()
    assert rows and all(r[0] for r in rows)


def test_census_and_tokens_of_all_kinds(spark, sf_dir, duck):
    """Brute force: documents one by one, each kind in turn at each place, shields first."""
    import re
    from collections import defaultdict

    from quire.operators import privacy

    patterns = [(None, re.compile(p)) for p in privacy.SHIELDED] + [(k, re.compile(p)) for k, p in privacy.PATTERNS.items()]
    values, seen, tokens = defaultdict(list), defaultdict(list), {}
    for doc, source, text in duck.sql("SELECT doc_id, source, text FROM documents ORDER BY doc_id").fetchall():
        at = 0
        while at < len(text):
            kind, m = next(((k, m) for k, p in patterns if (m := p.match(text, at))), (None, None))
            if kind:
                values[kind].append((m[0], doc))
                if (source, kind, m[0]) not in tokens:
                    seen[source, kind].append(m[0])
                    tokens[source, kind, m[0]] = f"{kind}_{len(seen[source, kind])}"
            at = m.end() if m else at + 1
    census = {(k, len(v), len({x for x, _ in v}), len({d for _, d in v})) for k, v in values.items()}
    assert {"SERIAL", "EMAIL", "IP", "PHONE"} <= set(values)
    assert {(r.kind, r.n, r.distinct_values, r.documents) for r in catalogue.queries()["identifier_census_all"](spark, sf_dir).collect()} == census
    assert {(r.source, r.kind, r.value): r.token for r in catalogue.queries()["pseudonymize_stable_all"](spark, sf_dir).collect()} == tokens


def test_html_to_markdown_reports_planted_losses(spark, tmp_path):
    """The parser keeps nothing of a template, whose letters count as the page's: 2 % of them, or 200, may be lost."""
    from pyspark.sql import functions as F

    from quire.functions import text as tx
    from quire.operators.convert import html_to_markdown

    page = lambda kept, lost: f"<html><body><p>{'a' * kept}</p><template>{'b' * lost}</template></body></html>"
    pages = [(i, page(k, n)) for i, (k, n) in enumerate([(20_000, 0), (20_000, 150), (18_100, 1_900), (1_000, 15), (1_000, 30), (100_000, 201), (100_000, 200)])]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    count = lambda s: sum(c.isalnum() for c in s or "")
    read = spark.read.parquet(f"{tmp_path}/pages.parquet").select("page_id", tx.decode_entities(tx.strip_tags(F.col("html"))).alias("a"), html_to_markdown(F.col("html")).alias("b")).collect()
    want = {r.page_id: "loss" if count(r.b) < 0.98 * count(r.a) or count(r.a) - count(r.b) > 200 else "intact" for r in read}
    got = {r.page_id: r.ruler for r in catalogue.queries()["html_to_markdown"](spark, str(tmp_path)).collect()}
    assert got == want == {0: "intact", 1: "intact", 2: "loss", 3: "intact", 4: "loss", 5: "loss", 6: "intact"}


def test_roundtrip_restores(spark, sf_dir):
    rows = catalogue.queries()["pseudonymize_roundtrip"](spark, sf_dir).collect()
    assert all(r.restored for r in rows) and any(r.changed for r in rows)


def test_ranking_ignores_partitions(spark, sf_dir):
    from quire.operators import search

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = search.bm25(docs.coalesce(1), "doc_id", "text", "thing hand").collect()
    many = search.bm25(docs.repartition(13), "doc_id", "text", "thing hand").collect()
    assert [(r.doc_id, round(r.score, 9)) for r in one] == [(r.doc_id, round(r.score, 9)) for r in many]


def test_stored_index_ranks_alike(spark, sf_dir, tmp_path):
    """Words, phrases (one that overlaps itself too), the fall-back, and words that no document holds; null texts count."""
    from quire.operators import fulltext, search

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "the the the and the"), (10**6 + 2, "")], "doc_id long, text string"))
    path = f"{tmp_path}/index"
    fulltext.build(docs, "doc_id", "text", path)
    fulltext.build(docs.limit(1), "doc_id", "text", path)  # an index that is there stays
    for q in ("thing", "thing hand est", '"the and"', '"the the" and', "thing qqzznone", "qqzznone", "de"):
        one = search.bm25(docs, "doc_id", "text", q, 8).collect()
        two = fulltext.search(spark, path, "doc_id", q, 8).collect()
        assert [(r.doc_id, round(r.score, 9), r.matched) for r in two] == [(r.doc_id, round(r.score, 9), r.matched) for r in one], q
    read = spark.read.parquet(f"{path}/postings")
    assert len(read.inputFiles()) > 20 and len(read.where("bucket = 3").inputFiles()) <= len(read.inputFiles())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_works_without_the_training_data_subpackage():
    code = """
        import sys

        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name.startswith("quire.llm") or name == "corpus_pipeline":
                    raise ModuleNotFoundError(name)

        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert "bm25_topk" in e.queries() and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
        assert set(e.oracle_sql()) <= set(e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=ROOT)
