import datetime as dt

from pyspark.sql import functions as F

from quire.functions import dates, similarity
from quire.functions import text as tx


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_normalizers_stay_apart(spark):
    s = F.lit("AÇÃO nº 1 — ½ ß")
    r = one(spark, same=tx.fold_same_length(s), ascii=tx.fold_ascii(s), upper=tx.fold_upper(s), marks=tx.strip_marks(s), squash=tx.squash(s))
    assert r.same == "acao nº 1 — ½ ß" and len(r.same) == len("AÇÃO nº 1 — ½ ß")
    assert r.ascii == "acao no 1  12 " and r.upper == "ACAO NO 1  12 "
    assert r.marks == "ACAO nº 1 — ½ ß"
    assert r.squash == "acao n 1"


def test_text_helpers(spark):
    t = F.lit("TÍTULO DA PEÇA\nlinha\n  valor  \nNum. 12 - Pág. 3")
    r = one(
        spark,
        title=tx.is_title(F.lit("TÍTULO DA PEÇA")), prose=tx.is_title(F.lit("Isto não é título")), value=tx.value_after(t, "linha"),
        line=tx.line_number(t, F.lit(17)), dropped=tx.lines_dropped(t, ["Num\\."]), kept=tx.without_lines(t, ["Num\\."]), hook=tx.first_useful_line(F.lit("# x\n\n- **oi** [[n]]")),
        slug=tx.slug(F.lit("Ação, já!")), key=tx.duplicate_key(F.lit("A ç.1")), links=tx.wikilinks(F.lit("[[a|b]] [[c#d]]")), refs=tx.references(F.lit("veja https://x.y/z, e ./a/b.")),
        sample=tx.sample_list(F.array(*[F.lit(str(i)) for i in range(8)]), 2), controls=tx.control_count(F.lit("a\x01b\n")), nfc=tx.compose(F.lit("é\0")),
        number=tx.line_number(F.lit("abc"), F.lit(1)), article=tx.article_key(F.lit("Art. 121-a")), ordinal=tx.article_key(F.lit("5º")), process=tx.process_number(F.lit("HC 12 REsp 1.234.567")),
        pkey=tx.process_key(F.lit("hc"), F.lit("12.345/SP")), paragraphs=tx.paragraphs(F.lit("<p>" + "x" * 31 + "</p><p>short</p>")), entities=tx.decode_entities(F.lit("a&amp;lt; &nbsp;")), tokens=tx.token_estimate(F.lit("abcdefg")),
    )
    assert r.title and not r.prose and r.value == "valor" and r.line == 2 and r.dropped == 1 and r.kept.endswith("valor  ")
    assert r.hook == "oi n" and r.slug == "acao-ja" and r.key == "ac1" and r.links == ["a", "c"] and r.refs == ["https://x.y/z", "./a/b"]
    assert r["sample"] == "0, 1 (+6)" and r.controls == 1 and r.nfc == "é" and r.number == 1
    assert r.article == "121-A" and r.ordinal == "5" and r.process == "1.234.567" and r.pkey == "HC12345" and len(r.paragraphs) == 1 and r.entities == "a&lt;  " and r.tokens == 2


def test_parsers(spark):
    r = one(
        spark, pages=tx.page_ranges(F.lit("3,1-2,9-,2"), F.lit(10)), size=tx.parse_size(F.lit("1.5MB")), no_size=tx.parse_size(F.lit("big")), human=tx.format_size(F.lit(1536)),
        hms=tx.hms(F.lit(3725.6)), cut=tx.hms(F.lit(3725.6), False), months=tx.months_of(F.lit("2 anos e 6 meses")), short=tx.months_of(F.lit("6m")), none=tx.months_of(F.lit("soon")),
        br=tx.br_date(F.lit("29/02/2024")), bad=tx.br_date(F.lit("98/13/2024")), named=tx.named_date(F.lit("12 de março de 2024")), short_named=tx.named_date(F.lit("5 mar 2023")),
    )
    assert r.pages == [3, 1, 2, 9, 10, 2] and r.size == 1572864 and r.no_size is None and r.human == "1.5 KB"
    assert (r.hms, r.cut, r.months, r.short, r.none) == ("01:02:06", "01:02:05", 30, 6, None)
    assert r.br == dt.date(2024, 2, 29) and r.bad is None and r.named == dt.date(2024, 3, 12) and r.short_named == dt.date(2023, 3, 5)


def test_front_matter(spark):
    r = one(spark, m=tx.front_matter(F.lit('---\na: 1\nb: "x y"\nc: null\na: 2\n---\nbody')), none=tx.front_matter(F.lit("---\na: 1\nno end")), body=tx.body_after_front_matter(F.lit("---\na: 1\n---\nbody")))
    assert r.m == {"a": "2", "b": "x y", "c": None} and r.none == {} and r.body.strip() == "body"


def test_snippets_stay_in_the_original(spark):
    r = one(spark, s=tx.snippet(F.lit("Ação **penal** é longa"), F.lit(8), 5, 4))
    assert r.s == "**penal**"


def test_similarity_and_repair(spark):
    r = one(spark, same=similarity.similarity(F.lit("a"), F.lit("a")), ratio=similarity.similarity(F.lit("abcd"), F.lit("bcde")), none=similarity.similarity(F.lit(None).cast("string"), F.lit("a")), share=similarity.longest_block_share(F.lit("abcdef"), F.lit("xxabcxx")))
    assert (r.same, r.ratio, r.none, r.share) == (1.0, 0.75, None, 0.5)
    assert similarity.repair('noise {"a": [1, {"b": "cut of') == '{"a": [1, {"b": "cut of"}]}'
    assert similarity.repair('{"a": 1, "b"') == '{"a": 1}'
    assert similarity.repair("nothing") is None


def test_easter_and_ages(spark):
    known = {1954: (4, 18), 1981: (4, 19), 2000: (4, 23), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25), 2076: (4, 19)}
    rows = spark.createDataFrame([(y,) for y in known], "y int").select("y", dates.easter(F.col("y")).alias("e")).collect()
    assert {r.y: (r.e.month, r.e.day) for r in rows} == known
    d = lambda s: F.lit(s).cast("date")
    r = one(spark, a=dates.age_at(d("2000-03-01"), d("2021-02-28")), b=dates.age_at(d("2000-03-01"), d("2021-03-01")), c=dates.in_recess(d("2024-12-20")), e=dates.in_recess(d("2024-01-21")))
    assert (r.a, r.b, r.c, r.e) == (20, 21, True, False)
