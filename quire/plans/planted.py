"""Texts planted from the tables' columns: operators read out of them what the SQL knows from the columns, without any text.

So the SQL shares neither patterns nor constants with the operators that it checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import citations, convert, extract, lookup, privacy, relational, search, segment, validate
from quire.plans.registry import Tables, query


def cat(*parts: Column | str | int) -> Column:
    """Columns by name in ``{}``, everything else as it stands, as one text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def col(name: str) -> Column:
    return F.col(name)


def planted(rows: DataFrame, id: str, *parts: Column | str) -> DataFrame:
    return rows.select(F.col(id).alias("id"), cat(*parts).alias("text"))


# Citations ------------------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey AS id, unnest(['BINDING', 'PRECIS', 'TOPIC', 'ARTICLE', 'PRECEDENT', 'BULLETIN', 'ANCHOR', 'ACT_PAGE', 'ACT_ID', 'PRECIS', 'PRECIS']) AS kind,
  unnest([p_size::VARCHAR, (p_partkey % 600 + 1)::VARCHAR, (p_partkey + 1)::VARCHAR, p_size::VARCHAR || '-A', (1000000 + p_partkey)::VARCHAR, p_size::VARCHAR, (3000000 + p_partkey)::VARCHAR, '7', (2000000 + p_partkey)::VARCHAR, p_size::VARCHAR, p_size::VARCHAR]) AS number,
  unnest([NULL, 'STJ', 'STF', 'CPP', 'AgRg no HC', 'STJ', 'v1', NULL, NULL, NULL, 'STF']) AS scope,
  unnest([NULL, NULL, NULL, NULL, 'SP', NULL, p_size::VARCHAR, '9', NULL, NULL, NULL]) AS part
FROM part""")
def citations_found(t: Tables) -> DataFrame:
    """Eleven forms of citation in one text, each with its number, court, law, class or page."""
    text = planted(
        t.part, "p_partkey", "Ver Súmula Vinculante nº ", col("p_size"), ", a Súmula ", col("p_partkey") % 600 + 1, "/STJ e o Tema ", col("p_partkey") + 1, " do STF. Art. ", col("p_size"), "-A, § 2º, do CPP; AgRg no HC ",
        col("p_partkey") + 1000000, "/SP; Inf. ", col("p_size"), " STJ; [ID ", col("p_partkey") + 3000000, " | v1 p. ", col("p_size"), " | x] e fls. 7-9, ID ", col("p_partkey") + 2000000, "; STF, Súmula ", col("p_size"), ".",
    )
    return citations.find(text, "id", "text").select("id", "kind", "number", "scope", "part")


@query("""
WITH c AS (SELECT p_partkey AS id, p_size AS n, CASE p_partkey % 3 WHEN 0 THEN 'stj' WHEN 1 THEN 'stf' END AS court, p_partkey % 7 = 0 AS topic FROM part),
h AS (SELECT *, (n % 2 = 0 AND coalesce(court, 'stj') = 'stj')::INTEGER + (n % 3 = 0 AND coalesce(court, 'stf') = 'stf')::INTEGER AS hits FROM c)
SELECT id, CASE WHEN topic THEN 'NO_SOURCE' WHEN hits = 0 THEN 'NOT_FOUND' WHEN hits = 2 THEN 'AMBIGUOUS' WHEN n % 10 = 0 THEN 'CANCELLED' ELSE 'OK' END AS status FROM h""")
def citations_verified(t: Tables) -> DataFrame:
    """Every outcome of a citation's verification."""
    court = F.when(col("p_partkey") % 3 == 0, "STJ").when(col("p_partkey") % 3 == 1, "STF")
    cited = t.part.select(F.col("p_partkey").alias("id"), F.when(col("p_partkey") % 7 == 0, "TOPIC").otherwise("PRECIS").alias("kind"), col("p_size").cast("string").alias("number"), court.alias("scope"))
    numbers = t.spark.range(1, 60).select(F.col("id").cast("int").alias("n"))
    source = lambda every, court: numbers.where(F.col("n") % every == 0).select(F.lit("PRECIS").alias("kind"), F.col("n").cast("string").alias("key"), F.lit(court).alias("scope"), cat("enunciado ", col("n")).alias("body"), (F.col("n") % 10 == 0).alias("cancelled"))
    return validate.verify(cited, source(2, "stj").unionByName(source(3, "stf"))).select("id", "status")


@query("""
WITH h AS (SELECT p_partkey, o_orderkey AS doc, row_number() OVER (PARTITION BY p_partkey ORDER BY o_orderkey) AS rank FROM part JOIN orders ON o_custkey = p_partkey WHERE p_partkey % 5 = 0)
SELECT 'PRECEDENT hc ' || (1000000 + p_partkey) AS key, doc, rank::INTEGER AS rank FROM h WHERE rank <= 3""")
def citations_in_collections(t: Tables) -> DataFrame:
    """Cited precedents looked up in a collection, numbers with and without dots alike, three hits a key."""
    cited = t.part.where("p_partkey % 5 = 0").select(F.lit("PRECEDENT").alias("kind"), (col("p_partkey") + 1000000).cast("string").alias("number"), F.lit("AgRg no HC").alias("scope"))
    dotted = F.translate(F.format_number(col("o_custkey") + 1000000, 0), ",", ".")
    docs = t.orders.select(F.col("o_orderkey").alias("doc"), cat("Na linha do HC n. ", F.when(col("o_orderkey") % 2 == 0, dotted).otherwise((col("o_custkey") + 1000000).cast("string")), ", julgado; e do REsp 77.", col("o_orderkey") % 900 + 100).alias("body"))
    return citations.in_collections(cited, docs, "doc", "body")


@query("SELECT p_partkey AS id, p_name || ' [A] ' || p_brand || ' [B]' || ' fim' AS text FROM part")
def draft_annotated(t: Tables) -> DataFrame:
    """Marks put behind spans from the back, so that earlier positions stay valid."""
    texts = t.part.select(F.col("p_partkey").alias("id"), cat(col("p_name"), " ", col("p_brand"), " fim").alias("text"))
    first = F.length("p_name") + 1
    marks = t.part.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.struct(first.alias("end"), F.lit("[A]").alias("mark")), F.struct((first + 1 + F.length("p_brand")).alias("end"), F.lit("[B]").alias("mark")))).alias("m")).select("id", "m.*")
    return validate.annotate(texts, marks, "id", "text")


_QUOTE = "trecho literal de bom tamanho sobre "


@query(f"SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '{_QUOTE}' || p_name WHEN 1 THEN '{_QUOTE}' || p_brand END AS quote FROM part")
def adjacent_quotes(t: Tables) -> DataFrame:
    """the quotation that follows a citation soon, or ends just before it; not one that is short or far away."""
    case = col("p_partkey") % 4
    far = F.rpad(F.lit(" longe"), 200, "x")
    head = F.when(case == 1, cat("Diz ", "“", _QUOTE, col("p_brand"), "”", " o ")).otherwise(F.lit("Ver o "))
    tail = F.when(case == 0, cat(" dispõe: ", '"', _QUOTE, col("p_name"), '"', " fim")).when(case == 2, F.lit(' diz "curto" só')).otherwise(cat(far, '"', _QUOTE, col("p_name"), '"'))
    rows = t.part.select(F.col("p_partkey").alias("id"), head.alias("head"), F.concat(head, F.lit("art. 5"), tail).alias("text"))
    start = F.length("head") + 1
    return rows.select("id", validate.adjacent_quote(F.col("text"), start, start + 6).alias("quote"))


@query("SELECT p_partkey AS id, 'AREsp' AS cls, (1000000 + p_partkey)::VARCHAR AS number, 'MG' AS state, p_name AS rapporteur, DATE '2020-01-01' + p_size AS decided FROM part")
def citation_lines(t: Tables) -> DataFrame:
    """Class, number, state, rapporteur and date of the citation that closes a paragraph."""
    date = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), col("p_size")), "dd/MM/yyyy")
    number = F.translate(F.format_number(col("p_partkey") + 1000000, 0), ",", ".")
    line = cat("AREsp ", number, "-MG, Rel. Min. ", col("p_name"), ", julgado em ", date, ". Precedentes citados: HC 99.999-RJ, Rel. Min. Outro, 1/1/2001.")
    return t.part.select(F.col("p_partkey").alias("id"), *(c.alias(k) for k, c in extract.decompose_citation(line).items()))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN (p_size + 1) * 12 WHEN 1 THEN 96 WHEN 2 THEN p_size + 1 END::INTEGER AS months,
  CASE p_partkey % 3 WHEN 0 THEN 'lei11343' WHEN 1 THEN 'cpp' END AS law FROM part""")
def penalties_and_laws(t: Tables) -> DataFrame:
    """The upper end of a penalty in an article's head, and the data set of a law as it is cited."""
    case = col("p_partkey") % 4
    text = F.when(case == 0, cat("Pena - reclusão, de ", col("p_size"), " a ", col("p_size") + 1, " anos, e multa.\n§ 1º detenção, de um a dois meses")).when(case == 1, F.lit("detenção, de três meses a oito anos"))
    text = text.when(case == 2, cat("Detenção, de 1 (um) mês a ", col("p_size") + 1, " meses")).otherwise(F.lit("Sem pena.\n§ 1º reclusão, de um a dois anos"))
    law = F.element_at(F.array(F.lit("Lei nº 11.343/2006"), F.lit("Código de Processo Penal"), F.lit("Regimento")), (col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), extract.maximum_penalty(text).alias("months"), extract.law_of(law).alias("law"))


# Pages, acts, blocks --------------------------------------------------------------------------------------------------------


@query("""
SELECT c_custkey AS id, unnest([1, 2, 3]) AS page, unnest([100000 + c_custkey, 100000 + c_custkey, NULL])::VARCHAR AS stamp, unnest([false, true, false]) AS inherited,
  unnest([c_name, NULL, NULL]) AS signer, unnest([1, NULL, NULL])::INTEGER AS page_in_doc FROM customer""")
def stamps_read(t: Tables) -> DataFrame:
    """Pages cut at their marks, the last stamp on a page, and stamps handed on by document number."""
    text = planted(
        t.customer, "c_custkey", "## [p. 1]\ncorpo Num. 999999 - Pág. 9 citado\nAssinado eletronicamente por: ", col("c_name"), " - 01/02/2024 10:11:12\nNúmero do documento: ", col("c_custkey") + 2024000000,
        "\nNum. ", col("c_custkey") + 100000, " - Pág. 1\n## [p. 2]\nsem carimbo\nNúmero do documento: ", col("c_custkey") + 2024000000, "\n## [p. 3]\nfim",
    )
    pages = segment.fill_stamps(segment.read_stamps(segment.paginate(text, "id", "text")), ["id", "page"])
    return pages.select("id", "page", "stamp", "inherited", "signer", "page_in_doc")


@query("SELECT c_custkey AS id, unnest([1, 3]) AS page, unnest([trim(c_name), trim(c_mktsegment)]) AS text FROM customer")
def pages_at_dashes(t: Tables) -> DataFrame:
    """Pages cut at rows of dashes where there are no marks; blank pages go but count."""
    dashes = "\n" + "-" * 44 + "\n"
    text = planted(t.customer, "c_custkey", col("c_name"), dashes, "  \n ", dashes, col("c_mktsegment"))
    return segment.paginate(text, "id", "text").select("id", "page", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN lpad((c_custkey % 90000 + 10000)::VARCHAR, 5, '0') ELSE (c_custkey % 90000 + 10000)::VARCHAR || lpad((c_custkey % 1000)::VARCHAR, 3, '0') END AS entry,
  c_custkey % 3 = 0 AS partial, DATE '2024-02-01' + (c_custkey % 28)::INTEGER AS date, '10:30' AS time, CASE WHEN c_custkey % 2 = 0 THEN 'Denúncia do MPE' ELSE 'Certidão' END AS document,
  CASE WHEN c_custkey % 2 = 0 THEN 'Petição Inicial' ELSE 'Certidão' END AS kind FROM customer""")
def cover_entries(t: Tables) -> DataFrame:
    """Entries of a cover's table, whose ids go on in the next line."""
    date = F.date_format(F.date_add(F.lit("2024-02-01").cast("date"), (col("c_custkey") % 28).cast("int")), "dd/MM/yyyy")
    what = F.when(col("c_custkey") % 2 == 0, "| Denúncia do MPE | Petição Inicial").otherwise("Certidão")
    rest = F.when(col("c_custkey") % 3 == 0, "\n\n\n\n777 longe").otherwise(cat("\n", F.lpad((col("c_custkey") % 1000).cast("string"), 3, "0"), " resto"))
    text = planted(t.customer, "c_custkey", "Id. Data Documento Tipo\n", col("c_custkey") % 90000 + 10000, " [ ", date, " 10:30 ", what, rest)
    return segment.cover_index(text, "id", "text", ["Petição", "Petição Inicial", "Certidão"])


@query("""
SELECT p_partkey AS id, unnest(['1', '2-A', '3']) AS article, unnest([0, 1, 2]) AS n, unnest(['O ' || p_name || '.' || chr(10) || 'Art. 3, cabeçalho corrido', 'A ' || p_brand || '.', 'Fim.']) AS body, unnest([2, 1, 1])::BIGINT AS wordings FROM part""")
def article_blocks_first(t: Tables) -> DataFrame:
    """Blocks of articles; running headers are none; of several wordings the first."""
    text = planted(t.part, "p_partkey", "LEI\nArt. 1º O ", col("p_name"), ".\nArt. 3, cabeçalho corrido\nArt. 2-A - A ", col("p_brand"), ".\nArt. 3. Fim.\nArt. 1º Outra redação de ", col("p_type"), " e muito mais longa.")
    return segment.article_blocks(text, "id", "text").select("id", "article", "n", "body", "wordings")


@query("SELECT p_partkey AS id, unnest(['1', '2']) AS article, unnest(['Longa redação de ' || p_type || '.', 'B.']) AS body FROM part")
def article_blocks_longest(t: Tables) -> DataFrame:
    """Of several blocks of one article the longest."""
    text = planted(t.part, "p_partkey", "Art. 1º A.\nArt. 2º B.\nArt. 1º Longa redação de ", col("p_type"), ".")
    return segment.article_blocks(text, "id", "text", "longest").select("id", "article", "body")


@query("SELECT p_partkey AS id, unnest([1, 2]) AS number, unnest(['O texto de ' || p_name || '.', '(CANCELADA) ' || p_brand]) AS body, unnest([false, true]) AS cancelled FROM part")
def precis_blocks(t: Tables) -> DataFrame:
    """Numbered blocks, cut at the first label; the longest of one number; whether cancelled."""
    text = planted(t.part, "p_partkey", "SÚMULA 1 O texto de ", col("p_name"), ". Referência: lei\nSÚMULA 2 (CANCELADA) ", col("p_brand"), "\nSÚMULA 1 O\n")
    return extract.numbered_blocks(text, "id", "text", r"SÚMULA (\d+)", ["Referência:", "Precedentes:"])


@query("SELECT p_partkey AS id, unnest([p_name, p_type, 'Sem']) AS title, unnest([p_size, p_size + 1, NULL])::INTEGER AS page, unnest([0, 1, 0]) AS level FROM part")
def outlines(t: Tables) -> DataFrame:
    """Titles with their page at the end of the line or alone on the next one; tabs are depth."""
    text = planted(t.part, "p_partkey", col("p_name"), " ..... ", col("p_size"), "\n\t", col("p_type"), "\n", col("p_size") + 1, "\n\nSem")
    return segment.outline(text, "id", "text").select("id", "title", "page", "level")


@query("""
SELECT p_partkey AS id, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['a) ' || p_name || ';', '2. ' || p_brand] ELSE ['Requer ' || p_name || ' no feito.', 'Pede ainda ' || p_type || ' e mais.'] END) AS item FROM part""")
def requests_listed(t: Tables) -> DataFrame:
    """Enumerated requests; the sentences of a section that enumerates nothing."""
    body = F.when(col("p_partkey") % 2 == 0, cat("Ante o exposto:\na) ", col("p_name"), ";\n  2. ", col("p_brand"), "\nfim")).otherwise(cat("Requer ", col("p_name"), " no feito. Pede ainda ", col("p_type"), " e mais."))
    return t.part.select(F.col("p_partkey").alias("id"), F.explode(segment.requests(body)).alias("item"))


@query("SELECT p_partkey + 1 AS page, ((p_partkey // 250) + 1)::INTEGER AS volume FROM part WHERE p_partkey + 1 BETWEEN 120 AND 180")
def page_slices(t: Tables) -> DataFrame:
    """Consecutive pages across volumes of 250."""
    pages = t.part.select((col("p_partkey") + 1).alias("page")).withColumn("volume", lookup.volume_of(F.col("page")))
    return lookup.page_slice(pages, "page", "volume", 120, 61)


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'INICIAL' ELSE 'PETICAO' END AS kind, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS document,
  CASE WHEN p_partkey % 5 > 0 THEN DATE '2023-03-01' + p_size END AS date, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS value FROM part""")
def record_sheets(t: Tables) -> DataFrame:
    """The sheet that an export puts before a document, its kind by the longest beginning; a value after its label."""
    date = F.date_format(F.date_add(F.lit("2023-03-01").cast("date"), col("p_size")), "dd/MM/yyyy")
    kind = F.when(col("p_partkey") % 2 == 0, "Petição Inicial (ação penal)").otherwise("Petição diversa")
    sheet = cat("Tipo de documento: ", kind, "\nDescrição do documento: ", col("p_name"), "\nData da assinatura: ", date, "\nNome\n\n ", col("p_name"), "\n")
    rows = t.part.select("p_partkey", F.when(col("p_partkey") % 5 > 0, sheet).otherwise("sem folha").alias("text"))
    read = extract.record_sheet(F.col("text"), {"peticao": "PETICAO", "peticao inicial": "INICIAL"})
    return rows.select(F.col("p_partkey").alias("id"), read["kind"].alias("kind"), read["document"].alias("document"), read["date"].alias("date"), tx.value_after(F.col("text"), "Nome").alias("value"))


@query("SELECT p_partkey AS id, 3 + p_partkey % 4 AS line, length(p_name) + length(p_type) + 7 AS body_from FROM part")
def positions_in_text(t: Tables) -> DataFrame:
    """The line that a position lies in, and where the body begins after an index."""
    before = F.repeat(F.lit("linha\n"), (col("p_partkey") % 4 + 2).cast("int"))
    index = cat("1 ", col("p_name"), "\n2 ", col("p_type"), "\ncorpo do texto")
    line = tx.line_number(F.concat(before, F.col("p_name")), F.length(before) + 1)
    return t.part.select(F.col("p_partkey").alias("id"), line.cast("long").alias("line"), extract.end_of_last(index, r"[0-9] [A-Za-z ]+\n").cast("long").alias("body_from"))


# People ---------------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, 'FULANO DE TAL ' || c_mktsegment AS name, 'RÉU' AS role FROM customer")
def parties_on_covers(t: Tables) -> DataFrame:
    """V1: names with roles on a cover; institutions are no parties."""
    text = planted(t.customer, "c_custkey", "PODER\nFULANO DE TAL ", col("c_mktsegment"), " (RÉU)\nMINISTÉRIO PÚBLICO DO ESTADO (AUTOR)\nSÓ (RÉU)\n")
    return privacy.cover_parties(text, "id", "text").select("id", "name", "role")


@query("SELECT c_custkey AS id, unnest(['MARIA ' || c_mktsegment, 'JOSE DA SILVA']) AS name FROM customer")
def witnesses_listed(t: Tables) -> DataFrame:
    """Names below the heading of a list, over two lines without one at most, up to the line that ends it."""
    text = planted(t.customer, "c_custkey", "texto ANA FORA DAQUI\nROL DE TESTEMUNHAS:\n", "MARIA ", col("c_mktsegment"), ", rua um\ncasa\nfundos\nJOSE DA SILVA\nDENUNCIADO:\nPEDRO DE FORA\n")
    return privacy.witnesses(text, "id", "text").select("id", "name")


@query("SELECT 'BELTRANO DE ' || c_mktsegment AS name, 2 * count(*) AS n FROM customer GROUP BY 1")
def name_suggestions(t: Tables) -> DataFrame:
    """V3: names in capitals and how often they occur."""
    text = planted(t.customer, "c_custkey", "viu BELTRANO DE ", col("c_mktsegment"), " na rua; BELTRANO DE ", col("c_mktsegment"), " negou; SÓ um")
    return privacy.suggestions(text, "text")


# Search ---------------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, unnest([[p_size::VARCHAR, '343'], ['processo', 'penal']]) AS phrase FROM part WHERE p_partkey < 50")
def query_phrases(t: Tables) -> DataFrame:
    """A query's phrases: numbers with dots are one, stop words go, quoted words stay together."""
    rows = [(r.p_partkey, p) for r in t.part.where("p_partkey < 50").select("p_partkey", "p_size").collect() for p in search.parse_query(f'a lei {r.p_size}.343 do "processo  penal"')[::-1] if p != ["lei"]]
    return t.spark.createDataFrame(rows, "id long, phrase array<string>")


@query("""
SELECT p_partkey AS id, '[ID ' || (p_partkey + 100000) || ' | v' || p_size || ' p. ' || (p_size + 1) || CASE WHEN p_partkey % 2 = 1 THEN ' block 1' ELSE '' END || ' | ' || p_type || ' | ' || CASE WHEN p_partkey % 3 = 0 THEN 'undated' ELSE '2024-01-02' END || ']' AS reference,
  'HC' || (p_partkey + 1000000) AS process FROM part""")
def references_rendered(t: Tables) -> DataFrame:
    """What a draft cites, and the key of a process."""
    date = F.when(col("p_partkey") % 3 != 0, F.lit("2024-01-02").cast("date"))
    shown = search.reference(col("p_partkey") + 100000, cat("v", col("p_size")), col("p_size") + 1, col("p_type"), date, (col("p_partkey") % 2).cast("int"))
    number = F.translate(F.format_number(col("p_partkey") + 1000000, 0), ",", ".")
    return t.part.select(F.col("p_partkey").alias("id"), shown.alias("reference"), tx.process_key(F.lit("hc"), number).alias("process"))


@query("SELECT p_partkey AS id, 'p' || p_size AS resolved FROM part")
def prefixes_resolved(t: Tables) -> DataFrame:
    """The longest prefix of a reference that exists."""
    refs = t.part.select(F.col("p_partkey").alias("id"), cat("p", col("p_size"), "/x/", col("p_partkey")).alias("ref"))
    known = t.part.select(cat("p", col("p_size")).alias("path")).distinct()
    return relational.longest_existing_prefix(refs, known, "ref", "path").select("id", "resolved")


@query("""
SELECT p_partkey AS id, 'hidden ' || p_name AS body FROM part WHERE p_partkey % 2 = 0""")
def spans_outside_spans(t: Tables) -> DataFrame:
    """A span that begins within another one is dropped."""
    from quire.operators.spans import outside, spans

    text = planted(t.part, "p_partkey", F.when(col("p_partkey") % 2 == 0, "").otherwise("["), "hidden ", col("p_name"), F.when(col("p_partkey") % 2 == 0, "").otherwise("]"))
    found = spans(text, "id", F.col("text"), {"in": "hidden [a-z ]+", "out": r"\[[^\]]*\]"})
    return outside(found.where("kind = 'in'"), found.where("kind = 'out'"), "id").select("id", F.col("match").alias("body"))


# Conversion -----------------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'unread' WHEN 2 THEN 'empty' ELSE 'stamp only' END AS status FROM part""")
def page_states(t: Tables) -> DataFrame:
    """Pages read, covered by an image, empty, or with a stamp alone."""
    case = col("p_partkey") % 4
    stamp = "Num. 123456 - Pág. 3"
    text = F.when(case == 0, cat(col("p_name"), " ", F.rpad(F.lit(""), 80, "texto "), "\n", stamp)).when(case == 2, F.lit(" x ")).otherwise(cat("  a \n", stamp, "\n"))
    rows = t.part.select(F.col("p_partkey").alias("id"), text.alias("text"), F.when(case == 1, 0.9).otherwise(0.1).alias("cover"))
    useful = tx.useful_text(F.col("text"), [r"\s*Num\. \d+ - P"])
    return rows.select("id", convert.page_status(F.col("text"), useful, F.col("cover")).alias("status"))


@query("SELECT p_partkey AS id, p_name || chr(10) || p_brand AS plain, 3 AS controls, true AS odd, 'José ' || p_name AS composed FROM part")
def controls_removed(t: Tables) -> DataFrame:
    """Control characters counted and taken out, marks composed, NUL gone."""
    text = cat("\x01", col("p_name"), "\x07\n", col("p_brand"), "\x7f")
    marked = cat("Jose\u0301\x00 ", col("p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), tx.without_controls(text).alias("plain"), tx.control_count(text).cast("int").alias("controls"), tx.has_control(text).alias("odd"), tx.compose(marked).alias("composed"))


@query("SELECT p_partkey AS id, 'Um texto de ' || p_name || ' que continua aqui.' || chr(10) || '- ' || p_brand || chr(10) || '' || chr(10) || 'Outra composição.' AS text FROM part")
def lines_unfolded(t: Tables) -> DataFrame:
    """Lines that were only wrapped are joined, also across a hyphen; items and paragraphs stay."""
    text = cat("Um texto de ", col("p_name"), "\nque continua aqui.\n- ", col("p_brand"), "\n\nOutra compo-\nsição.")
    return t.part.select(F.col("p_partkey").alias("id"), convert.unfold(text).alias("text"))


@query("SELECT p_partkey AS id, 'Olá ' || p_name || chr(10) || 'é – ' || p_brand || ' fim' AS text FROM part")
def rtf_read(t: Tables) -> DataFrame:
    """The text of RTF files: bytes of the code page, unicode with its fallback, silent groups, binary runs."""
    rtf = cat("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}{\\*\\generator x;}Ol\\'e1 ", col("p_name"), "\\par \\u233? ", "\\endash  ", F.replace(col("p_brand"), F.lit("\\"), F.lit("")), "\\bin3 abc fim}")
    return t.part.select(F.col("p_partkey").alias("id"), F.regexp_replace(F.trim(convert.rtf_to_text(F.encode(rtf, "UTF-8"))), "[ ]+", " ").alias("text"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE regexp_full_match(text, '[\\x{0}-\\x{7F}\\x{A0}-\\x{FF}]*')")
def bytes_decoded(t: Tables) -> DataFrame:
    """Texts decoded by what their bytes are: one of two in UTF-8, the others in Latin letters of a byte each."""
    rows = t.documents.where(F.col("text").rlike(r"\A[\x00-\x7F\xA0-\xFF]*\z"))
    data = F.when(col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return rows.select("doc_id", F.sha2(convert.decode(data), 256).alias("hash"))


@query("""
SELECT p_partkey AS id, 2 AS accents_old, 1 AS accents_new, 0 AS damage_old, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS damage_new FROM part""")
def conversions_compared(t: Tables) -> DataFrame:
    """Letters with marks and signs of damage, before and after."""
    old, new = cat("ação ", col("p_name")), cat("acão ", col("p_name"), F.when(col("p_partkey") % 2 == 0, " \ufffd").otherwise(""))
    return t.part.select(F.col("p_partkey").alias("id"), *(c.cast("int").alias(k) for k, c in validate.regression(old, new).items()))


@query("SELECT p_partkey AS id, [p_name || ' com um parágrafo de bom tamanho'] AS paragraphs FROM part")
def paragraphs_kept(t: Tables) -> DataFrame:
    """Paragraphs of more than thirty characters, without their tags."""
    html = cat("<b>", col("p_name"), "</b> com um parágrafo de bom tamanho")
    return t.part.select(F.col("p_partkey").alias("id"), tx.paragraphs(cat("<p>curto</p><P class='x'>", html, "</P>")).alias("paragraphs"))


@query("""
SELECT p_partkey AS id, list_concat(list_concat(CASE WHEN p_size >= 2 THEN [1, 2] ELSE [1] END, CASE WHEN p_size >= 7 THEN [7] ELSE []::INTEGER[] END), CASE WHEN p_size >= 4 THEN range(4, p_size + 1)::INTEGER[] ELSE []::INTEGER[] END) AS pages,
  p_size::BIGINT * 1048576 AS bytes, CASE WHEN p_size >= 2 THEN printf('%.1f KB', p_size * 512 / 1024.0) ELSE printf('%d B', p_size * 512) END AS shown FROM part""")
def ranges_and_sizes(t: Tables) -> DataFrame:
    """Page ranges with open ends, sizes read and written."""
    pages = tx.page_ranges(F.lit("-2, 7,4-"), col("p_size"))
    return t.part.select(F.col("p_partkey").alias("id"), pages.alias("pages"), tx.parse_size(cat(col("p_size"), " mb")).alias("bytes"), tx.format_size(col("p_size") * 512).alias("shown"))


# Small functions ------------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey AS id, 'acao-' || replace(p_name, ' ', '-') || '-' || p_size AS slug, DATE '2024-03-01' + p_size AS named, DATE '2023-03-01' + p_size AS br, NULL::DATE AS impossible,
  lpad((p_partkey // 3600)::VARCHAR, 2, '0') || ':' || lpad((p_partkey // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((p_partkey % 60)::VARCHAR, 2, '0') AS cut,
  p_size * 12 + 6 AS months, (1000000 + p_partkey)::VARCHAR AS process FROM part""")
def values_read(t: Tables) -> DataFrame:
    """Slugs, dates in words and figures, clock times, spans of time, process numbers."""
    names = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
    day, other = F.date_add(F.lit("2024-03-01").cast("date"), col("p_size")), F.date_add(F.lit("2023-03-01").cast("date"), col("p_size"))
    words = cat(F.dayofmonth(day), " de ", F.element_at(F.array(*map(F.lit, names)), F.month(day)), " de ", F.year(day))
    return t.part.select(
        F.col("p_partkey").alias("id"), tx.slug(cat("Ação: ", col("p_name"), " (", col("p_size"), ")!")).alias("slug"), tx.named_date(words).alias("named"), tx.br_date(F.date_format(other, "d/M/yyyy")).alias("br"),
        tx.br_date(F.lit("31/02/2024")).alias("impossible"), tx.hms(col("p_partkey") + 0.7, False).alias("cut"), tx.months_of(cat(col("p_size"), " anos e 6 meses")).cast("int").alias("months"),
        tx.process_number(cat("autos 12, nº ", col("p_partkey") + 1000000, " de 3")).alias("process"),
    )


@query("""
SELECT p_partkey AS id, 'Primeira ' || p_name || ' linha' AS hook, ['https://x.org/' || p_size || '/a', './b/' || p_name[1:3]] AS refs, [p_name, p_type] AS links, p_name || ', ' || p_brand || ' (+2)' AS sample,
  MAP {'A': p_name, 'B': p_brand} AS speakers, p_name AS author FROM part""")
def marks_read(t: Tables) -> DataFrame:
    """The hook line, references, links, speakers, the author, a list cut short."""
    note = cat("# Título\n\n---\n- **Primeira** ", col("p_name"), " `linha`\nmais")
    prose = cat("ver https://x.org/", col("p_size"), "/a, e ./b/", F.substring("p_name", 1, 3), ".")
    html = cat('<a rel="author">Redação</a><span class="post-author x">', col("p_name"), "</span>")
    return t.part.select(
        F.col("p_partkey").alias("id"), tx.first_useful_line(note).alias("hook"), tx.references(prose).alias("refs"), tx.wikilinks(cat("[[", col("p_name"), "|x]] e [[", col("p_type"), "]]")).alias("links"),
        tx.sample_list(F.array("p_name", "p_brand", F.lit("c"), F.lit("d")), 2).alias("sample"), F.str_to_map(cat("A=", col("p_name"), ",B=", col("p_brand")), F.lit(","), F.lit("=")).alias("speakers"), extract.byline(html, ["redacao"]).alias("author"),
    )


@query("""
SELECT p_partkey AS id, 'acao ' || p_name AS same_length, 'acao ' || p_name AS squashed, 'acao ' || p_name || ' o' AS ascii, 'ACAO ' || upper(p_name) AS upper, 'Acao ' || p_name AS unmarked FROM part""")
def five_normalizers(t: Tables) -> DataFrame:
    """the normalizers, each for its own use."""
    text = cat("Ação ", col("p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), tx.fold_same_length(text).alias("same_length"), tx.squash(cat(" ", text, " --")).alias("squashed"), tx.fold_ascii(cat(text, " º")).alias("ascii"), tx.fold_upper(text).alias("upper"), tx.strip_marks(text).alias("unmarked"))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '{"a": [1, ' || p_size || ']}' WHEN 1 THEN '{"a": "' || p_name || '"}' END AS repaired,
  round(length(p_name) / (length(p_name) + 4), 6) AS share FROM part""")
def repairs_and_blocks(t: Tables) -> DataFrame:
    """JSON that was cut off, and the longest common block as a share of a quotation."""
    from quire.functions.similarity import longest_block_share, repair_json

    cut = F.when(col("p_partkey") % 3 == 0, cat('x {"a": [1, ', col("p_size"))).when(col("p_partkey") % 3 == 1, cat('{"a": "', col("p_name"))).otherwise(F.lit("none"))
    share = longest_block_share(cat(col("p_name"), "@@@@"), cat("### ", col("p_name"), " ###"))
    return t.part.select(F.col("p_partkey").alias("id"), repair_json(cut).alias("repaired"), F.round(share, 6).alias("share"))


@query("""
SELECT p_partkey AS id, unnest(CASE p_partkey % 3 WHEN 0 THEN ['complaint_received', 'final'] WHEN 1 THEN ['suspended'] ELSE [] END) AS kind FROM part""")
def milestones_in_text(t: Tables) -> DataFrame:
    """Affirmative statements of milestones only."""
    text = F.when(col("p_partkey") % 3 == 0, cat("Recebo a denúncia contra ", col("p_name"), ". Por fim transitou em julgado.")).when(col("p_partkey") % 3 == 1, F.lit("a suspensão condicional do processo foi aceita")).otherwise(F.lit("não recebida a denúncia"))
    rows = t.part.select(F.col("p_partkey").alias("id"), text.alias("text"))
    return extract.text_milestones(rows, ["id"], "text").select("id", "kind")


@query("""
SELECT p_partkey AS id, unnest(CASE p_partkey % 3 WHEN 0 THEN ['no requests'] WHEN 1 THEN ['no facts', 'request without ground'] ELSE [] END) AS rule, unnest(CASE p_partkey % 3 WHEN 0 THEN ['high'] WHEN 1 THEN ['medium', 'medium'] ELSE [] END) AS severity FROM part""")
def draft_structure(t: Tables) -> DataFrame:
    """Rules about the sections of a draft."""
    row = lambda title, body: F.struct(F.lit(title).alias("title"), body.alias("body"))
    facts, asks = row("DOS FATOS", cat("O acusado foi visto com ", col("p_name"), " na praça central")), row("DOS PEDIDOS", cat("a) absolver o acusado visto na praça com ", col("p_name")))
    other = row("DO DIREITO", F.lit("jurisprudência antiga"))
    own = F.when(col("p_partkey") % 3 == 0, F.array(facts, other)).when(col("p_partkey") % 3 == 1, F.array(other, asks)).otherwise(F.array(facts, asks))
    sections = t.part.select(F.col("p_partkey").alias("id"), F.explode(own).alias("s")).select("id", "s.*")
    return validate.draft_alerts(sections, "id").select("id", "rule", "severity")


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE p_name END AS value, p_partkey % 2 = 0 AS safe FROM part")
def suspicious_values(t: Tables) -> DataFrame:
    """Values that stand for none; paths that stay below their folder."""
    value = F.element_at(F.array(F.lit(" - "), F.lit("[VERIFICAR] nome"), F.lit(None).cast("string"), cat(" ", col("p_name"), " ")), (col("p_partkey") % 4 + 1).cast("int"))
    path = F.when(col("p_partkey") % 2 == 0, cat("a/", col("p_name"), "/b.md")).otherwise(F.element_at(F.array(F.lit("../x"), F.lit("/etc/x"), F.lit("a/../../x"), F.lit("C:\\x")), (col("p_partkey") % 8 / 2 + 1).cast("int")))
    return t.part.select(F.col("p_partkey").alias("id"), validate.cleaned(value).alias("value"), lookup.safe_path(path).alias("safe"))
