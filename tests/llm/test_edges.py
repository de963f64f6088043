"""Every operator and stage on a table of nulls, repeats and clashing column names, and on an empty one."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quire.llm import bpe, exact_dedup, language_id, license_scan, mixing, near_dedup, pii, secrets

CLASHES = ["norm", "row", "hits", "keys", "sig", "id", "ids", "base", "added", "h1", "kept", "evidence", "host", "declared", "language", "budget", "__n", "n_shingles", "component_id", "start", "body", "mentions"]


def table(spark):
    rows = [
        (1, "The same text of seven words here", "en", "src1", 5), (1, "The same text of seven words here", "en", "src1", 5), (2, "The  same text\nof seven words here", None, None, None),
        (None, None, None, None, None), (None, "another text that nobody else has got", "en", None, 1), (3, "", "fr", "src2", 0), (4, "x" * 60_000, "en", "src1", 60_000), (5, " ", "", "", 1), (6, None, "de", "src3", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


OPERATORS = {
    "exact": exact_dedup.assign, "near": near_dedup.assign, "pii": lambda d: pii.digests(pii.find(d)), "secrets": lambda d: secrets.digests(secrets.find(d)), "license": license_scan.find,
    "bpe": lambda d: bpe.digests(d, bpe.tokenizer_path()),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(spark, name):
    df = table(spark)
    got = OPERATORS[name](df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in df.collect())
    assert OPERATORS[name](df.limit(0)).count() == 0


STAGES = [s for s in cp.STAGES if s[0] != "bpe"]


@pytest.mark.parametrize("name,stage", STAGES, ids=[s[0] for s in STAGES])
def test_stages_keep_the_columns(spark, sf_dir, name, stage):
    df = table(spark)
    got = stage(spark, df, sf_dir)
    assert got.columns == df.columns
    rows = got.collect()
    assert all(r.norm == "clash norm" and r.budget == "clash budget" for r in rows)
    assert {r.doc_id for r in rows} <= {1, 2, 3, 4, 5, 6, None}
    assert stage(spark, df.limit(0), sf_dir).count() == 0


def test_what_each_stage_decides(spark, sf_dir):
    df = table(spark)
    ids = lambda d: sorted(str(r.doc_id) for r in d.collect())
    assert ids(cp.identify_language(spark, df, sf_dir)) == ["1", "1", "2", "4", "None"]
    assert ids(cp.drop_exact_copies(spark, df, sf_dir)) == ["1", "3", "4", "5", "None"]
    assert ids(cp.drop_near_copies(spark, df, sf_dir)) == ["1", "1", "3", "4", "5", "6", "None", "None"]
    assert language_id.train(df).languages == ["en"]
    last = cp.encode_tokens(spark, df, sf_dir).collect()
    assert len(last) == 9 and sum(r.n_tokens == 0 for r in last) == 4


def test_mixing_takes_nulls(spark):
    rows = mixing.mix(table(spark), percent=100).collect()
    assert len(rows) >= 5
