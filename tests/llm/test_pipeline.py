import hashlib
import re

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as cp
from quire.llm import bpe, mixing
from tests.llm import test_mixing, test_near_dedup


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_stage_same_as_brute_force(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(-5, "123 456 !", "en", "src1", 9), (-6, None, "fr", None, None), (None, "the and that with of this are", "en", "src2", 3)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("rejected", docs.doc_id * 2)
    first = cp.identify_language(spark, docs, sf_dir)
    assert first.columns == docs.columns
    assert rows_of(first) == [r for r in rows_of(docs) if r[0] not in (-5, -6)]

    second = cp.drop_exact_copies(spark, first, sf_dir)
    assert second.columns == docs.columns
    lead = {}
    for r in sorted(first.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        lead.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text), tuple(r))
    assert rows_of(second) == sorted(lead.values(), key=str)

    third = cp.drop_near_copies(spark, second, sf_dir)
    component, _ = test_near_dedup.brute([(r.doc_id, r.text) for r in second.collect() if r.doc_id is not None])
    assert rows_of(third) == [r for r in rows_of(second) if r[0] is None or component[r[0]] == r[0]]

    fourth = cp.mix_sources(spark, third, sf_dir)
    monkeypatch.setattr(test_mixing, "WEIGHTS", mixing.WEIGHTS)
    want = test_mixing.brute([(r.doc_id, r.text, r.lang, r.source, 0) for r in third.collect()], cp.MIX_PERCENT, cp.MIX_EPOCHS)
    taken = {i for i, _ in want}
    assert rows_of(fourth) == [r for r in rows_of(third) if r[0] in taken]
    assert 0 < len(taken) < third.count()

    library = Tokenizer.from_file(bpe.tokenizer_path())
    texts = {r.doc_id: r.text for r in fourth.collect()}
    last = cp.encode_tokens(spark, fourth, sf_dir).collect()
    assert len(last) == len(texts)
    for r in last:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_and_empty(spark, sf_dir, tmp_path):
    assert cp.run(spark, sf_dir).count() > 50
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is cp.run
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
