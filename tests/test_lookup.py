import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators import extract, lookup, models


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_optional_filters_and_lookups(spark):
    law = spark.createDataFrame([("121", "Matar alguém", "perm"), ("121-A", "Outro", "perm"), ("2", "Ação penal", "perm"), ("5", "temp", "adct"), ("10", "ação", "perm")], "art string, t string, block string")
    assert rows(lookup.where_given(law, art=["2", "5"], block="perm", t=None), "art") == [("2",)]
    assert rows(lookup.where_given(spark.range(9), id=(3, 5)), "id") == [(3,), (4,), (5,)] and lookup.where_given(spark.range(9), id=(None, 2)).count() == 3
    assert [r.art for r in lookup.look_up(law, "art", "t", "art. 121-a").collect()] == ["121-A"]
    assert [r.art for r in lookup.look_up(law, "art", "t", "acao").collect()] == ["2", "10"]
    assert [r.art for r in lookup.look_up(law, "art", "t", "acao", 1).collect()] == ["2"]
    hit = lookup.look_up_block(law, "block", "art", "perm", "5").first()
    assert hit.found is None and hit.hint == "adct"
    assert lookup.look_up_block(law, "block", "art", "adct", "5").first().found.t == "temp"
    assert rows(lookup.exact_else_partial(law, "t", "AÇÃO"), "art") == [("10",)] and rows(lookup.exact_else_partial(law, "t", "aca"), "art") == [("10",), ("2",)]
    assert rows(lookup.holds(spark.createDataFrame([(1, 5), (6, 9)], "a int, b int"), "a", "b", 6), "a") == [(6,)]
    r = spark.range(1).select(lookup.in_force(F.lit("Cancelada")).alias("a"), lookup.in_force(F.lit("Vigente")).alias("b"), lookup.in_force(F.lit("?")).alias("c"), lookup.family(F.lit("informativo_12"), {"bulletin": ["informativo"], "x": ["y"]}).alias("d"), lookup.contains_lower(F.lit("AÇÃO"), "acao").alias("e"), lookup.contains_folded(F.lit("AÇÃO"), "acao").alias("f")).first()
    assert tuple(r) == ("cancelled", "in force", None, "bulletin", False, True)


def test_pages_profiles_and_status(spark):
    pages = spark.range(1, 1001).select(F.col("id").alias("p"), lookup.volume_of(F.col("id")).alias("v"))
    assert rows(lookup.page_slice(pages, "p", "v", 249, 4), "p", "v") == [(249, 1), (250, 1), (251, 2), (252, 2)]
    assert lookup.with_overrides({"a": 1, "b": 2}, a=None, b=3) == {"a": 1, "b": 3}
    with pytest.raises(KeyError):
        lookup.with_overrides({"a": 1}, z=2)
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, t + dt.timedelta(seconds=119)), (t, t + dt.timedelta(seconds=121)), (None, t)], "s timestamp, m timestamp")
    assert [r.e for r in df.select(lookup.edited_since(F.col("s"), F.col("m")).alias("e")).collect()] == [False, True, True]
    done = spark.createDataFrame([("f", "ok"), ("f", "pending"), ("g", "ok")], "k string, s string")
    assert rows(lookup.status_order(done, ["k"], "s"), "k", "status") == [("f", "pending"), ("g", "ok")]


def test_extraction(spark):
    text = "SÚMULA 1 O texto da primeira. Referência: lei\nSÚMULA 2 (CANCELADA) curto\nSÚMULA 1 menor"
    got = extract.numbered_blocks(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", r"SÚMULA (\d+)", ["Referência:"])
    assert rows(got, "number", "body", "cancelled") == [(1, "O texto da primeira.", False), (2, "(CANCELADA) curto", True)]
    c = extract.decompose_citation(F.lit("AgRg no REsp 1.234.567-SP, Rel. Min. Fulano de Tal, julgado em 1/2/2020. Precedentes citados: HC 99.999-RJ"))
    r = spark.range(1).select(*(v.alias(k) for k, v in c.items())).first()
    assert tuple(r) == ("AgRg no REsp", "1234567", "SP", "Fulano de Tal", dt.date(2020, 2, 1))
    none = spark.range(1).select(*(v.alias(k) for k, v in extract.decompose_citation(F.lit("Precedentes citados: HC 99.999-RJ")).items())).first()
    assert none.number is None
    r = spark.range(1).select(
        extract.maximum_penalty(F.lit("Pena - reclusão, de seis a vinte anos.\n§ 1º detenção, de um a dois meses")).alias("a"), extract.maximum_penalty(F.lit("detenção, de 3 (três) meses a 1 (um) ano")).alias("b"), extract.maximum_penalty(F.lit("sem pena")).alias("c"),
        extract.law_of(F.lit("Lei nº 11.343/06")).alias("d"), extract.law_of(F.lit("Código de Processo Penal")).alias("e"), extract.law_of(F.lit("Lei X")).alias("f"), extract.end_of_last(F.lit("1 a\n2 b\nbody"), r"\d \w\n").alias("g"), extract.byline(F.lit('<a rel="author">Redação</a><a rel="author">Ana  Lima</a>'), ["redacao"]).alias("h"),
        extract.record_sheet(F.lit("Tipo de documento: Petição Inicial\nDescrição do documento: Denúncia\nData da assinatura: 05/06/2023"), {"peticao": "PETICAO", "peticao inicial": "INICIAL"}).alias("i"), extract.record_sheet(F.lit("nada"), {}).alias("j"), extract.timely(F.lit("2024-01-02").cast("date"), F.lit("2024-01-01").cast("date")).alias("k"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (240, 12, None, "lei11343", "cpp", None, 9, "Ana Lima")
    assert r.i.kind == "INICIAL" and r.i.document == "Denúncia" and r.i.date == dt.date(2023, 6, 5) and r.j is None and r.k == "late"
    acts = spark.createDataFrame([(1, "x " * 100 + "Recebo a denúncia oferecida. " + "y " * 100 + "Transitou em julgado."), (2, "não recebida a denúncia")], "seq int, t string")
    assert rows(extract.text_milestones(acts, ["seq"], "t"), "seq", "kind") == [(1, "complaint_received"), (1, "final")]


def test_model_places(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, None)], "id int, t string")
    assert rows(models.embed(df, "t", lambda ts: [[float(len(t)), 1.0] for t in ts], 2), "id", "vector", "error") == [(1, [2.0, 1.0], None), (2, [1.0, 1.0], None), (3, [0.0, 1.0], None)]
    assert all(r.vector is None and "shape" in r.error for r in models.embed(df, "t", lambda ts: [[1.0]] * len(ts), 2).collect())
    assert [r.id for r in models.rerank(df, "q", "t", "id", lambda pairs: [float(len(t)) for _, t in pairs], k=2).collect()] == [1, 2]
    out = models.extract(df, "t", lambda t: '{"quotes": ["' + t, "quotes array<string>").collect()
    assert {r.id: r.record and r.record.quotes for r in out} == {1: ["aa"], 2: ["b"], 3: None}
