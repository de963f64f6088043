import datetime as dt

from pyspark.sql import functions as F

from quire.operators import calendar as cal
from quire.operators import citations, extract, ledger, privacy, relational, search, segment, spans, validate

D = dt.date


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_asof_edges(spark):
    marks = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 5, "c")], "k int, p int, v string")
    hits = spark.createDataFrame([(1, 0), (1, 1), (1, 5), (1, 9), (2, 3)], "k int, p int")
    assert rows(relational.asof_backward(hits, marks, ["k"], "p", ["v"], 3), "k", "p", "v") == [(1, 0, None), (1, 1, "a"), (1, 5, "c"), (1, 9, None), (2, 3, None)]
    assert rows(relational.asof_backward(hits, marks, ["k"], "p", ["v"], same_position=False), "k", "p", "v") == [(1, 0, None), (1, 1, None), (1, 5, "a"), (1, 9, "c"), (2, 3, None)]
    assert rows(relational.asof_forward(hits, marks, ["k"], "p", ["v"]), "k", "p", "v") == [(1, 0, "a"), (1, 1, "a"), (1, 5, "b"), (1, 9, None), (2, 3, None)]


def test_overlap_prefers_the_earliest_of_equals(spark):
    turns = spark.createDataFrame([("f", 0, 10, "A"), ("f", 10, 20, "B"), ("f", 30, 31, "C")], "f string, s int, e int, who string")
    lines = spark.createDataFrame([("f", 1, 5, 15), ("f", 2, 12, 19), ("f", 3, 21, 25), ("g", 4, 0, 1)], "f string, n int, from int, to int")
    got = relational.best_overlap(lines, turns, ["f"], ["f", "n"], ("from", "to"), ("s", "e"), "who", 7)
    assert rows(got, "n", "best_label", "best_overlap") == [(1, "A", 5), (2, "B", 7), (3, None, None), (4, None, None)]
    assert len(rows(relational.interval_join(lines, turns, ["f"], ("from", "to"), ("s", "e"), 3), "n", "who", "overlap")) == 3
    near = relational.nearest_label(lines.withColumnRenamed("from", "p"), turns, ["f"], "p", ("s", "e"), "who")
    assert rows(near.where("n = 3"), "nearest_label") == [("B",)]


def test_joins_plan_no_nested_loop(spark):
    a = spark.range(100).selectExpr("id % 3 AS k", "id AS s", "id + 5 AS e")
    plan = relational.interval_join(a.withColumnsRenamed({"s": "s1", "e": "e1"}), a, ["k"], ("s1", "e1"), ("s", "e"), 8)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sequences(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "k int, n int, v string")
    assert rows(relational.islands(df, ["k"], ["n"], "v"), "n", "island") == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]
    assert rows(relational.segments(df, ["k"], ["n"], F.col("v").isNull()), "n", "segment") == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)]
    starts = spark.createDataFrame([(1, 1), (1, 1), (1, 4)], "k int, s int")
    assert rows(relational.next_start(starts, ["k"], "s", F.lit(9)), "s", "until") == [(1, 4), (1, 4), (4, 9)]
    tie = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (1, None, 0)], "k int, v string, n int")
    assert rows(relational.mode_first_seen(tie, ["k"], "v", "n"), "v", "n") == [("b", 2)]
    assert rows(relational.gaps(spark.createDataFrame([(1, 1), (1, 4), (2, 1)], "k int, n int"), "n", ["k"]), "k", "n") == [(1, 2), (1, 3)]


def test_differences(spark):
    new = spark.createDataFrame([(1, "u1", "t1"), (2, "u2", "t9"), (3, "u3", None)], "id int, url string, title string")
    known = spark.createDataFrame([("u1", "x"), ("zz", "t9"), (None, None)], "url string, title string")
    assert rows(relational.not_known(new, known, ["url", "title"]), "id") == [(3,)]
    now, then = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"), spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, v string")
    assert rows(relational.difference(now, then, "k", "v"), "k", "status") == [(1, "new"), (2, "reused"), (3, "changed"), (4, "obsolete")]
    merged = relational.merge_candidates(now, then.withColumnRenamed("v", "w"), "k", ("a", "b"))
    assert rows(merged, "k", "via") == [(1, "a"), (2, "a+b"), (3, "a+b"), (4, "b")]
    special = spark.createDataFrame([("x", 1)], "t string, days int")
    default = spark.createDataFrame([("x", 5), ("x", 6), ("y", 7)], "t string, days int")
    assert rows(relational.override(spark.createDataFrame([("x",), ("y",)], "t string"), special, default, "t"), "t", "days") == [("x", 1), ("y", 7)]


def test_paths_and_graphs(spark):
    refs = spark.createDataFrame([("a/b/c",), ("a/x",), ("q",)], "ref string")
    known = spark.createDataFrame([("a",), ("a/b",)], "path string")
    assert rows(relational.longest_existing_prefix(refs, known, "ref", "path"), "ref", "resolved") == [("a/b/c", "a/b"), ("a/x", "a"), ("q", None)]
    edges = spark.createDataFrame([("x", "y", "refutes"), ("y", "x", "refutes"), ("x", "z", "cites")], "s string, d string, k string")
    assert rows(relational.contradictions(edges, "s", "d", "k"), "s", "d", "k") == [("x", "y", "refutes")]
    assert rows(relational.reachable(edges, spark.createDataFrame([("y",)], "node string"), "s", "d", 2), "node", "hops") == [("x", 1), ("y", 0), ("z", 2)]


def test_search_edges(spark):
    assert search.parse_query('a "habeas corpus" de 1.234-5 ção') == [["habeas", "corpus"], ["1", "234", "5"], ["cao"]]
    docs = spark.createDataFrame([(1, "habeas corpus habeas"), (2, "corpus habeas"), (3, None)], "id int, text string")
    assert [r.id for r in search.bm25(docs, "id", "text", '"habeas corpus"').collect()] == [1]
    assert search.bm25(docs, "id", "text", "de a").count() == 0
    assert rows(search.hits(spark.createDataFrame([(1, "aaaa AÁ b"), (2, "none")], "id int, t string"), "id", "t", "aa"), "n", "start") == [(1, 1), (2, 3), (3, 6)]
    v = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 0.0], "x"), (3, [-1.0, 0.0], "y")], "id int, v array<double>, t string")
    q = spark.createDataFrame([([2.0, 0.0],)], "q array<double>")
    assert rows(search.nearest(v, q, "id", "v"), "id", "score") == [(1, 1.0), (3, -1.0)]
    assert rows(search.nearest(v, q, "id", "v", where=F.col("t") == "y"), "id") == [(3,)]
    r = spark.range(1).select(search.reference(F.lit(7), F.lit("v1"), F.lit(3), F.lit("X"), F.lit(None).cast("date")).alias("r")).first()
    assert r.r == "[ID 7 | v1 p. 3 | X | undated]"


def test_calendar_edges(spark):
    local = spark.createDataFrame([(D(2024, 7, 26), "state", "state day"), (D(2024, 7, 25), "São Town", "town day"), (D(2024, 7, 24), "Other", "other day")], "day date, scope string, name string")
    named = cal.holidays(spark, 2024, 2025, local, "sao town", ("state",))
    got = {r.day: r.name for r in named.collect()}
    assert got[D(2024, 7, 26)] == "state day" and D(2024, 7, 24) not in got and got[D(2024, 3, 29)] == "good friday" and got[D(2024, 2, 14)] == "ash wednesday"
    c = cal.calendar(spark, 2024, 2025)
    asks = spark.createDataFrame([(1, D(2024, 3, 27), 5), (2, D(2024, 12, 20), 10), (3, D(2024, 5, 3), 0), (4, None, 5), (5, D(2024, 5, 3), 1)], "id int, n date, d int")
    assert rows(cal.deadline(asks, c, "n", "d"), "id", "starts", "due", "moved") == [
        (1, D(2024, 3, 28), D(2024, 4, 1), False), (2, D(2024, 12, 23), D(2025, 1, 2), True), (3, D(2024, 5, 6), None, None), (4, None, None, None), (5, D(2024, 5, 6), D(2024, 5, 6), False),
    ]
    recess = cal.calendar(spark, 2024, 2025, recess=True)
    assert rows(cal.deadline(asks.where("id = 2"), recess, "n", "d"), "starts") == [(D(2025, 1, 21),)]
    due = [r.due for r in cal.deadline(asks.where("d > 0 AND n IS NOT NULL"), c, "n", "d").collect()]
    business = {r.day for r in c.where("reason IS NULL").collect()}
    assert set(due) <= business
    cover = spark.range(1).select(cal.procedure_of(F.lit("x procedimento sumaríssimo")).alias("a"), cal.procedure_of(F.lit("PROCEDIMENTO SUMÁRIO y")).alias("b"), cal.procedure_of(F.lit("z")).alias("c")).first()
    assert tuple(cover) == ("jecrim", "sumario", "ordinario")


def test_limitation(spark):
    cases = spark.createDataFrame([(145, None), (144, None), (97, None), (49, None), (25, None), (24, None), (12, None), (11, D(2010, 5, 5)), (11, D(2010, 5, 6)), (11, None)], "p int, f date")
    got = [r.m for r in cases.select(cal.limitation_months(F.col("p"), F.col("f")).alias("m")).collect()]
    assert got == [240, 192, 192, 144, 96, 48, 48, 24, 36, 36]
    marks = spark.createDataFrame([(1, D(2020, 1, 31), 1), (1, D(2020, 2, 29), 1), (1, D(2020, 4, 1), 1)], "k int, d date, m int")
    out = cal.limitation_intervals(marks, ["k"], "d", "m", D(2020, 5, 1))
    assert rows(out, "d", "barred_on", "barred", "ongoing") == [(D(2020, 1, 31), D(2020, 2, 29), False, False), (D(2020, 2, 29), D(2020, 3, 29), True, False), (D(2020, 4, 1), D(2020, 5, 1), False, True)]
    h = spark.range(1).select(cal.halved(F.lit(48), F.lit("2000-01-01").cast("date"), F.lit("2020-06-01").cast("date"), F.lit(None).cast("date")).alias("a"), cal.halved(F.lit(48), F.lit("1950-01-01").cast("date"), F.lit("2020-06-01").cast("date"), F.lit("2020-12-31").cast("date")).alias("b")).first()
    assert tuple(h) == (24, 48)


VOLUME = """intro
## [p. 1]
CAPA
## [p. 2]
text one
Num. 1234567 - Pág. 1
Assinado eletronicamente por: ANA - 02/03/2024 10:00:00
Número do documento: 99
## [p. 3] `OCR`
text two
Num. 1234568 - Pág. 2
Assinado eletronicamente por: ANA - 02/03/2024 10:00:00
## [p. 4]
loose page
Número do documento: 99
## [p. 5]
other
Num. 1234569 - Pág. 1
Assinado eletronicamente por: BIA - 31/02/2024 11:00:00
"""


def test_acts_from_pages(spark):
    vol = spark.createDataFrame([("v1", VOLUME), ("v2", "a\n" + "-" * 45 + "\n \n" + "-" * 45 + "\nb")], "volume string, text string")
    pages = segment.paginate(vol, "volume", "text")
    assert rows(pages.where("volume = 'v2'"), "page") == [(1,), (3,)]
    stamped = segment.fill_stamps(segment.read_stamps(pages.where("volume = 'v1'")), ["page"])
    got = {r.page: r for r in stamped.collect()}
    assert got[4].stamp == "1234567" and got[4].inherited and got[3].ocr and got[2].signer == "ANA" and got[1].stamp is None
    grouped = segment.group_acts(stamped, ["page"], ["volume"])
    # Page 3 reads an alike id under the same signature and is not page 1: one act; page 5 is page 1 of its document.
    assert rows(grouped, "page", "act") == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 3)]
    acts = {r.act: r for r in segment.assemble_acts(grouped, "volume", []).collect()}
    assert acts[2].id == "1234567" and acts[2].variants == ["1234568"] and acts[2].date == D(2024, 3, 2) and "id read in variants" in acts[2].warnings
    assert acts[3].date is None and "unreadable date" in acts[3].warnings and "Num." not in acts[2].text and acts[1].id is None


def test_cover_index_and_resolution(spark):
    text = "12345 [ 01/02/2024 10:30 | Denúncia MPE Petição Inicial\n678 x\n11111 02/02/2024 11:00 Certidão\n\n22222 03/02/2024 12:00 algo Termo de Audiência"
    out = segment.cover_index(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", ["Petição", "Petição Inicial", "Certidão", "Termo", "Termo de Audiência"])
    got = {r.entry: r for r in out.collect()}
    assert got["12345678"].kind == "Petição Inicial" and got["12345678"].document == "Denúncia MPE" and not got["12345678"].partial
    assert got["11111"].partial and got["22222"].kind == "Termo de Audiência"
    known = spark.createDataFrame([("1234567",), ("7654321",), ("555",)], "entry string")
    wanted = spark.createDataFrame([("1234567",), ("7654",), ("1234568",), ("999",)], "id string")
    assert rows(segment.resolve_ids(wanted, known, "id", "entry"), "id", "entry", "how") == [("1234567", "1234567", "exact"), ("1234568", "1234567", "fuzzy"), ("7654", "7654321", "prefix")]


def test_packing_sections_articles(spark):
    r = spark.range(1).select(segment.pack(F.lit("aaa\n\nbbb\n\nccc"), 8, 2).alias("p"), segment.pack(F.lit("short"), 8, 2).alias("q"), segment.requests(F.lit("a) um pedido\nb) outro")).alias("r"), segment.requests(F.lit("Primeiro pedido longo. Segundo pedido longo.")).alias("s")).first()
    assert r.p == ["aaa\n\nbbb", "bb\n\nccc"] and r.q == ["short"] and r.r == ["a) um pedido", "b) outro"] and len(r.s) == 2
    law = "Art. 1º O primeiro.\nmais texto\nArt. 2, cabeçalho corrido\nArt. 2º - O segundo.\nArt. 1º Nova redação mais longa do primeiro."
    df = spark.createDataFrame([(1, law)], "id int, t string")
    assert rows(segment.article_blocks(df, "id", "t"), "article", "wordings") == [("1", 2), ("2", 1)]
    assert dict(rows(segment.article_blocks(df, "id", "t", "longest"), "article", "body"))["2"].startswith("O segundo")
    doc = spark.createDataFrame([(1, "x\nDOS FATOS\nalgo\nDOS PEDIDOS\na) pedir tutela")], "id int, t string")
    assert rows(segment.sections(doc, "id", "t"), "section", "title", "body") == [(0, None, "x"), (1, "DOS FATOS", "algo"), (2, "DOS PEDIDOS", "a) pedir tutela")]
    out = segment.outline(spark.createDataFrame([(1, "Tema um ... 12\n\tSub\n34\nFim")], "id int, t string"), "id", "t")
    assert rows(out, "title", "page", "level") == [("Fim", None, 0), ("Sub", 34, 1), ("Tema um", 12, 0)]


def test_spans_and_citations(spark):
    text = "Ver Súmula Vinculante 11 e Súmula 7/STJ; art. 33 da Lei 11.343/06 e HC 123.456. [ID 1234567 | v1 p. 3] fls. 10-12, ID 7654321"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, t string")
    got = citations.find(df, "id", "t", matches=True).collect()
    kinds = {(r.kind, r.number) for r in got}
    assert ("BINDING", "11") in kinds and ("PRECIS", "7") in kinds and ("ARTICLE", "33") in kinds and ("PRECEDENT", "123.456") in kinds and ("ACT_ID", "7654321") in kinds and ("ANCHOR", "1234567") in kinds
    assert ("PRECIS", "11") not in kinds and ("ACT_ID", "1234567") not in kinds and ("ACT_PAGE", "3") not in kinds and ("ACT_PAGE", "10") in kinds
    assert all(text[r.start - 1 : r.end - 1] == r.match for r in got)
    inner = spans.spans(df, "id", F.col("t"), {"x": "[0-9]+"})
    assert [text[r.start - 1 : r.end - 1] for r in inner.orderBy("n").collect()][:2] == ["11", "7"]


def test_forms_of_citation(spark):
    cases = [
        ("STF, Súmula 279", [("PRECIS", "279", None, None), ("PRECIS", "279", "STF", None)]), ("súmula n.º 7 do STJ", [("PRECIS", "7", "STJ", None)]), ("SV nº 24", [("BINDING", "24", None, None)]),
        ("Tema de Repercussão Geral n. 1.234/STF", [("TOPIC", "1.234", "STF", None)]), ("art. 5º, § 2º, da Constituição Federal", [("ARTICLE", "5", "Constituicao Federal", None)]),
        ("artigo 157, parágrafo único, inciso II, do Código Penal", [("ARTICLE", "157", "Codigo Penal", None)]), ("arts. 33-A da Lei nº 11.343/2006", [("ARTICLE", "33-A", "Lei nº 11.343/2006", None)]),
        ("CPP, art. 312", [("ARTICLE", "312", None, None), ("ARTICLE", "312", "CPP", None)]), ("AgInt no AREsp 1.234.567/SP", [("PRECEDENT", "1.234.567", "AgInt no AREsp", "SP")]), ("EREsp nº 123456", [("PRECEDENT", "123456", "EREsp", None)]),
        ("RvCr 5.555 e Inq. 4781", [("PRECEDENT", "4781", "Inq", None), ("PRECEDENT", "5.555", "RvCr", None)]), ("hc 123.456 de volta re 1234", [("PRECEDENT", "1234", "re", None), ("PRECEDENT", "123.456", "hc", None)]), ("Informativo nº 800/STJ", [("BULLETIN", "800", "STJ", None)]),
        ("págs. 3, fls. 10-12", [("ACT_PAGE", "10", None, "12")]), ("[ID - | v2 p. 9 | x]", [("ANCHOR", "-", "v2", "9")]), ("Súmula 11 Vinculante; chart. 5; 12 HC", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    got = {}
    for r in citations.find(df, "id", "t").collect():
        got.setdefault(r.id, []).append((r.kind, r.number, r.scope, r.part))
    key = lambda xs: sorted(xs, key=str)
    for i, (t, want) in enumerate(cases):
        assert key(got.get(i, [])) == key(want), t


def test_citations_in_collections(spark):
    docs = spark.createDataFrame([(f"d{i}", f"julgado no HC n. {'123.456' if i % 2 else '123456'} e no REsp 99.{i}00") for i in range(6)] + [("e", "Tema 1.046 do STF; HC 1123456"), ("n", None)], "doc string, body string")
    cited = spark.createDataFrame([(1, "PRECEDENT", "123.456", "AgRg no HC", "NOT_FOUND"), (2, "TOPIC", "1046", None, "NO_SOURCE"), (3, "PRECEDENT", "777.777", "HC", "NOT_FOUND"), (4, "PRECIS", "7", "STJ", "CANCELLED")], "n int, kind string, number string, scope string, status string")
    hits = citations.in_collections(cited, docs, "doc", "body")
    assert rows(hits, "key", "doc", "rank") == [("PRECEDENT hc 123456", "d0", 1), ("PRECEDENT hc 123456", "d1", 2), ("PRECEDENT hc 123456", "d2", 3), ("TOPIC  1046", "e", 1)]
    assert rows(citations.located(cited, hits, "doc"), "n", "status") == [(1, "OK"), (2, "OK"), (3, "NOT_FOUND"), (4, "CANCELLED")]


def test_margins_and_penalties(spark):
    lines = ["corpo do texto", "xx Assinado eletronicamente por: FULANO - 01/02/2024 10:00:00", "https://pje.tj.jus.br/x?y=1", "Número do documento: 24010112345678", " Num. 123456 - Pág. 3 ", "Documento assinado digitalmente conforme MP", "Código de validação: ABC.123", "o Num. 123456 - Pág. 3 foi citado"]
    df = spark.createDataFrame([("\n".join(lines),)], "t string").select(segment.without_margins(F.col("t")).alias("t"))
    assert df.first().t == lines[0] + "\n" + lines[-1]
    cases = {"Matar alguém:\nPena - reclusão, de seis a vinte anos.": 240, "Pena – detenção, de um mês a um ano, e multa.": 12, "reclusão, de 4 (quatro) a 10 (dez) anos, e multa": 120, "detenção de 15 dias": None, "reclusão, de 2 (dois) meses a 8 meses": 8, "Art. 1\n§ 1º reclusão, de um a dois anos": None, "reclusão de dois a doze anos": 144, "detenção, de três meses a três anos, ou multa, se o fato": 36}
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", extract.maximum_penalty(F.col("t")).alias("m"))
    assert [m for _, m in rows(got, "i", "m")] == list(cases.values())


def test_penalties_read_the_words_once(spark):
    """Values that are named often, and inside lambdas, are evaluated once a row, not once a use."""
    cases = {"Pena - reclusão, de dois a doze anos.\nParágrafo único. detenção, de um a dois meses": 144, "detenção, de 3 (três) meses a 12 (doze) meses": 12, "reclusão, de um ano": None, "reclusão, de 99999999999 a trinta anos": None, "": None, "\n\n": None, "detenção": None, "reclusão, de um ano a xyz anos": None}
    got = spark.createDataFrame([*enumerate(cases), (99, None)], "i int, t string").select("i", extract.maximum_penalty(F.col("t")).alias("m"))
    assert [m for _, m in rows(got, "i", "m")] == [*cases.values(), None]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_citations_of_numbers_of_any_length(spark):
    cases = [
        ("o Tema 100000 do STF.", ("TOPIC", "100000", "STF")), ("Tema 1.234.567/STJ", ("TOPIC", "1.234.567", "STJ")), ("Tema 12345678", ("TOPIC", "12345678", None)),
        ("HC 12345678/SP", ("PRECEDENT", "12345678", "HC")), ("REsp 12.345.678", ("PRECEDENT", "12.345.678", "REsp")),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert rows(citations.find(df, "i", "t"), "i", "kind", "number", "scope") == [(i, *want) for i, (_, want) in enumerate(cases)]


def test_tiers_without_a_limit(spark):
    """All rows of all tiers, in order, and no room set aside in a task for a largest number of them."""
    names = ["Ring", "ring x", "a ring", "none", "RING", "other"]
    df = spark.createDataFrame([(i, names[i % 6], "a RING set" if i % 12 == 5 else "") for i in range(60)], "i int, n string, b string").repartition(5)
    tier = lambda i: 1 if names[i % 6].lower() == "ring" else 2 if i % 6 in (1, 2) else 3
    want = sorted((tier(i), names[i % 6], i) for i in range(60) if i % 6 != 3 and (i % 6 != 5 or i % 12 == 5))
    got = search.tiered(df, "n", "b", "ring", "i", None)
    assert [(r.tier, r.n, r.i) for r in got.collect()] == want
    assert [(r.tier, r.n, r.i) for r in search.tiered(df, "n", "b", "ring", "i", 7).collect()] == want[:7]
    assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_whole_look_up_has_no_limit(spark, sf_dir):
    from quire.plans import catalogue

    assert "Limit" not in catalogue.queries()["tiered_lookup"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_verification_has_more_than_two_outcomes(spark):
    cited = spark.createDataFrame([(1, "PRECIS", "7", "STJ", None), (2, "PRECIS", "7", None, None), (3, "PRECIS", "99", "STJ", None), (4, "PRECIS", "8", "STF", None), (5, "TOPIC", "1", "STF", None), (6, "PRECIS", "9", "STJ", "texto que nada tem a ver com a fonte citada"), (7, "PRECIS", "9", "STJ", "a fonte diz exatamente isto")], "n int, kind string, number string, scope string, quote string")
    sources = spark.createDataFrame([("PRECIS", "7", "stj", "a", False), ("PRECIS", "7", "stf", "b", False), ("PRECIS", "8", "stf", "c", True), ("PRECIS", "9", "stj", "a fonte diz exatamente isto aqui", False)], "kind string, key string, scope string, body string, cancelled boolean")
    assert rows(validate.verify(cited, sources, "quote"), "n", "status") == [(1, "OK"), (2, "AMBIGUOUS"), (3, "NOT_FOUND"), (4, "CANCELLED"), (5, "NO_SOURCE"), (6, "DIVERGES"), (7, "OK")]
    acts = spark.createDataFrame([(1, "1234567", ["7777777"], 1, 9), (2, "7777777", [], 10, 12)], "act int, id string, variants array<string>, pag_ini int, pag_fim int")
    asks = spark.createDataFrame([(1, "7777777", 5), (2, "7777777", 99), (3, "7777778", 11), (4, "000", 1)], "__cite int, cid string, pg int")
    assert rows(validate.resolve_id(asks, acts, "cid", "pg", 0.8), "__cite", "act") == [(1, 1), (2, 2), (3, 2), (4, None)]


def test_grounding_loss_gate(spark):
    source = "O réu foi visto às dez horas na praça central da cidade"
    q = lambda s: validate.grounded(F.lit(s), F.lit(source))
    r = spark.range(1).select(q("visto as DEZ horas").alias("a"), q("foi visto às dez horas xx praça central da cidade").alias("b"), q("nada disso aconteceu jamais ali").alias("c"), q("réu").alias("d"), validate.loss(F.lit("abc"), F.lit("ab")).alias("e"), validate.loss(F.lit(""), F.lit("")).alias("f"), validate.loss(F.lit("abc"), F.lit("a b c")).alias("g"), validate.cleaned(F.lit(" - ")).alias("h")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (True, True, False, None, "loss", "unmeasured", "intact", None)
    found = spark.createDataFrame([(1, None), (1, "high"), (2, "low"), (3, None)], "k int, s string")
    assert rows(validate.gate(found, ["k"], "s"), "k", "status") == [(1, "REJECTED"), (2, "ALERT"), (3, "APPROVED")]
    assert rows(found.groupBy("k").agg(validate.worst(F.coalesce("s", F.lit("ok")), ["high", "low", "ok"]).alias("w")), "k", "w") == [(1, "high"), (2, "low"), (3, "ok")]
    marked = validate.annotate(spark.createDataFrame([(1, "abcdef"), (2, "x")], "id int, t string"), spark.createDataFrame([(1, 3, "[A]"), (1, 7, "[B]")], "id int, end int, mark string"), "id", "t")
    assert rows(marked, "id", "t") == [(1, "ab [A]cdef [B]"), (2, "x")]
    quote = spark.range(1).select(validate.adjacent_quote(F.lit('Art. 5 diz "uma citação bastante longa aqui" fim'), F.lit(1), F.lit(7)).alias("q")).first()
    assert quote.q == "uma citação bastante longa aqui"


def test_lint_and_drafts(spark):
    df = spark.createDataFrame([("d", 1, "texto completo aqui"), ("d", 1, "texto completo aqui"), ("d", 4, "curto"), ("d", 5, "com &amp; entidade e mais"), ("e", None, None)], "d string, n int, t string")
    got = {r.d: r for r in validate.lint(df, "d", "n", "t", 10).collect()}
    assert (got["d"].repeated, got["d"].gaps, got["d"].short, got["d"].entities, got["d"].same_head) == (1, 2, 1, 1, 2) and got["e"].missing_text == 1
    secs = segment.sections(spark.createDataFrame([(1, "DOS FATOS\nhouve dano ambiental grave\nDOS PEDIDOS\na) reparação do dano ambiental\nb) aposentadoria especial rural"), (2, "sem nada")], "id int, t string"), "id", "t")
    assert rows(validate.draft_alerts(secs, "id"), "id", "rule") == [(1, "request without ground"), (2, "no facts"), (2, "no requests")]


def test_privacy(spark):
    cover = "ANA MARIA DA SILVA (RÉ)\nMINISTÉRIO PÚBLICO (AUTOR)\nJOSÉ (VÍTIMA)\n"
    df = spark.createDataFrame([(1, cover)], "id int, t string")
    assert rows(privacy.cover_parties(df, "id", "t"), "name", "role") == [("ANA MARIA DA SILVA", "RÉ")]
    witness = "x\nROL DE TESTEMUNHAS:\nJOÃO DE SOUZA, brasileiro\ncontinua aqui\ne aqui\nMARIA LIMA COSTA, casada\num\ndois\ntres\nPEDRO ALVES NETO\n"
    assert rows(privacy.witnesses(spark.createDataFrame([(1, witness)], "id int, t string"), "id", "t"), "name") == [("JOÃO DE SOUZA",), ("MARIA LIMA COSTA",)]
    assert ("ANA MARIA DA SILVA", 1) in rows(privacy.suggestions(df, "t"), "name", "n")
    docs = spark.createDataFrame([(1, "c", "a@b.co e 111.222.333-44; processo 1234567-89.2020.8.10.0001"), (2, "c", "de novo a@b.co e z@y.co"), (3, "d", "a@b.co"), (4, "c", None)], "id int, c string, t string")
    found = docs.select("id", "c", F.posexplode(privacy.identifiers(F.col("t"))).alias("pos", "x")).select("id", "c", "pos", "x.*")
    tokens = privacy.assign_tokens(found, ["c"], ["id", "pos"])
    assert rows(tokens, "c", "value", "token") == [("c", "111.222.333-44", "CPF_1"), ("c", "a@b.co", "EMAIL_1"), ("c", "z@y.co", "EMAIL_2"), ("d", "a@b.co", "EMAIL_1")]
    hidden = privacy.pseudonymize(docs, tokens, ["c"], "id", "t")
    assert dict(rows(hidden, "id", "t"))[1] == "EMAIL_1 e CPF_1; processo 1234567-89.2020.8.10.0001"
    assert rows(privacy.restore(hidden, tokens, ["c"], "id", "t"), "id", "t") == rows(docs, "id", "t")
    more = privacy.extend_tokens(tokens, spark.createDataFrame([("c", "EMAIL", "n@n.co", 9, 0), ("c", "EMAIL", "a@b.co", 9, 1)], "c string, kind string, value string, id int, pos int"), ["c"], ["id", "pos"])
    assert ("c", "n@n.co", "EMAIL_3") in rows(more, "c", "value", "token") and more.count() == 5
    named = spark.range(1).select(privacy.replace_names(F.lit("Élio  Dias da Cruz e da cruz; DIAS DA CRUZ"), [("ELIO DIAS DA CRUZ", "PESSOA_1")]).alias("t")).first()
    assert named.t == "PESSOA_1 e PESSOA_1; DIAS PESSOA_1"


#: Each form that tools/anonimizar.py hides, its kind, and the text around it.
FORMS = [
    ("CPF", "123.456.789-01"), ("CPF", "12345678901"), ("CPF", "123456789-01"), ("CPF", "123.456.78901"),
    ("CNPJ", "12.345.678/0001-95"), ("CNPJ", "12345678000195"), ("CNPJ", "12345678/0001-95"),
    ("EMAIL", "joão.silva+x@mail.example.br"), ("TEL", "(65) 3333-1234"), ("TEL", "65 3333-1234"), ("TEL", "(65) 9 9333-1234"), ("TEL", "(65)99333-1234"), ("TEL", "3333 1234"), ("TEL", "93333-1234"),
    ("PLATE", "ABC-1234"), ("PLATE", "ABC1D23"), ("SERIAL", "123456789012345"), ("POSTCODE", "78000-123"), ("PHONE", "+55 65 3333-1234"),
]
RG_FORMS = [("RG ", "12.345.678-9"), ("RG ", "1234567"), ("rg ", "1.234.567-X"), ("RG ", "12345"), ("RG: ", "1234567890"), ("RG nº ", "12345"), ("RG nº: ", "1234567890"), ("RG n° ", "1234567890")]


def test_each_form_of_the_reference_is_hidden(spark):
    texts = [(k, v, f"veja {v}, sim") for k, v in FORMS] + [("RG", v, f"com {lead}{v}, sim") for lead, v in RG_FORMS]
    texts += [("RG", "12.345.678-9", "RG nº 12.345.678-9, sim"), ("TEL", "3333-1234", "FONE3333-1234, sim"), ("SERIAL", "123456789012345", "IMEI123456789012345, sim")]
    docs = spark.createDataFrame([(i, "c", t) for i, (_, _, t) in enumerate(texts)], "id int, c string, t string")
    found = docs.select("id", "c", F.posexplode(privacy.identifiers(F.col("t"))).alias("pos", "x")).select("id", "c", "pos", "x.*")
    tokens = privacy.assign_tokens(found, ["c"], ["id", "pos"])
    hidden = privacy.pseudonymize(docs, tokens, ["c"], "id", "t")
    out = dict(rows(hidden, "id", "t"))
    assert [(k, v) for i, (k, v, _) in enumerate(texts) if v in out[i] or f"{k}_" not in out[i] or any(c.isdigit() for c in out[i].replace(out[i][out[i].index(f"{k}_") :].split(",")[0], ""))] == []
    assert rows(privacy.restore(hidden, tokens, ["c"], "id", "t"), "id", "t") == rows(docs, "id", "t")
    kept = "processo 1234567-89.2020.8.10.0001, Num. 12345678901, 123456789012345678901"
    assert privacy.find_identifiers(kept) == []


def test_ledger(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", None), ("b", 2.0)], "m string, c double")
    assert rows(ledger.totals(df, ["m"], {"cost": F.col("c")}), "m", "n", "cost", "level") == [("a", 2, 1.5, "detail"), ("b", 1, 2.0, "detail"), (None, 3, 3.5, "total")]
    acts = spark.createDataFrame([(1, "A", "tem laudo"), (2, "B", "x"), (3, "A", "y")], "seq int, kind string, t string")
    ex = spark.createDataFrame([("e1", ["A", "B"], None), ("e2", ["A"], "laudo")], "extractor string, kinds array<string>, pattern string")
    work = ledger.tasks(acts, ex, "kind", "t")
    assert rows(work, "seq", "extractor") == [(1, "e1"), (1, "e2"), (2, "e1"), (3, "e1")]
    assert rows(ledger.uncached(work, spark.createDataFrame([("e1", 1)], "extractor string, seq int"), ["extractor", "seq"]), "seq", "extractor") == [(1, "e2"), (2, "e1"), (3, "e1")]
    tally = ledger.grounding_tally(spark.createDataFrame([(1, ["a fonte diz", "nunca foi dito isso"], "aqui a fonte diz algo")], "k int, q array<string>, s string"), ["k"], "q", "s")
    assert rows(tally, "quotes", "located") == [(2, 1)]
    vol = ledger.measure_volumes(spark.createDataFrame([(1, "HC 1 x HC 1 RE 2 1º 2º 3o"), (2, "none")], "id int, t string"), "id", "t", F.lit(1), r"(?:HC|RE)\s+\d+", r"\dº", r"\do")
    assert rows(vol, "id", "headers", "ordinals_ok", "thin") == [(1, 2, "no", True), (2, 0, "none", True)]
    price = spark.range(1).select(ledger.cost(F.lit(1_000_000), F.lit(500_000), 3.0, 15.0).alias("c"), ledger.route(F.lit("x" * 100), 10).alias("r")).first()
    assert tuple(price) == (10.5, "remote")


def test_alike_ids_same_as_all_pairs(spark):
    """Ids misread anywhere, of different lengths, and with repeated characters: no alike pair is missed."""
    import difflib
    import random

    rng = random.Random(6)
    base = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(3, 16))) for _ in range(120)] + ["1111111111", "1212121212", "11", "1", "12"]
    def misread(x):
        x = list(x)
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(2)] = rng.choice(["", "7", "55"])
        return "".join(x)
    asked = sorted({misread(x) for x in base + base if x} - {""})
    known = sorted(set(base))
    got = {(r.id, r.entry) for r in segment._pairs_alike(spark.createDataFrame([(x,) for x in asked], "id string"), spark.createDataFrame([(x,) for x in known], "entry string"), "id", "entry", 0.85).collect()}
    alike = {(a, k) for a in asked for k in known if a != k and difflib.SequenceMatcher(None, a, k).ratio() >= 0.85}
    assert len(alike) > 50 and alike <= got and len(got) < 0.5 * len(asked) * len(known)
    want = {}
    for a in asked:
        starts = [k for k in known if k.startswith(a) or a.startswith(k)]
        near = [k for k in known if (a, k) in alike]
        if a in known:
            want[a] = (a, "exact")
        elif len(starts) == 1:
            want[a] = (starts[0], "prefix")
        elif len(near) == 1:
            want[a] = (near[0], "fuzzy")
    out = segment.resolve_ids(spark.createDataFrame([(x,) for x in asked], "id string"), spark.createDataFrame([(x,) for x in known], "entry string"), "id", "entry")
    assert {r.id: (r.entry, r.how) for r in out.collect()} == want and len({h for _, h in want.values()}) == 3
    read = spark.createDataFrame([("x1", ["zz", "555"]), ("555", ["777"])], "id string, other array<string>")
    assert rows(segment.resolve_ids(read, spark.createDataFrame([("555",), ("777",)], "entry string"), "id", "entry", variants="other"), "id", "entry", "how") == [("555", "555", "exact"), ("x1", "555", "variant")]


def test_quotes_same_as_all_pairs(spark):
    """Short and long quotations, whole, with one third altered, and cut inside words."""
    import random

    from quire.operators import quotes

    rng = random.Random(2)
    words = ["lei", "a", "de", "processo", "réu", "prova", "testemunha", "e", "foi", "acórdão", "no", "x"]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(60)] + ["", None]
    asked = []
    for d in docs[:50]:
        at, n = rng.randrange(max(1, len(d) - 10)), rng.choice([8, 9, 11, 13, 20, 40, 90])
        q = d[at : at + n]
        if rng.random() < 0.5:
            third = len(q) // 3
            i = rng.randrange(3)
            q = q[: third * i] + "zz " * (third // 3) + q[third * (i + 1) :]
        asked.append(q)
    asked += ["curto", "lei de a", None, "xxxxxxxxxxxxxxxx"]
    a, b = spark.createDataFrame(list(enumerate(asked)), "q int, quote string"), spark.createDataFrame(list(enumerate(docs)), "d int, body string")
    want = a.join(b).where(validate.grounded(F.col("quote"), F.col("body"))).select("q", "d")
    got = quotes.grounded_in(a, "q", "quote", b, "d", "body")
    assert rows(got, "q", "d") == rows(want, "q", "d") and got.count() > 40
