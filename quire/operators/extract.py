"""Fields read out of running text: citation lines, labels, penalties, record sheets, bylines, milestones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx


def cut_at_labels(body: Column, labels: list[str]) -> Column:
    """The text before the first of several metadata labels."""
    first = F.array_min(F.filter(F.array(*(F.locate(label, body) for label in labels)), lambda p: p > 0))
    return F.regexp_replace(F.when(first.isNull(), body).otherwise(F.substring(body, F.lit(1), first - 1)), r"^\s+|\s+$", "")


def numbered_blocks(docs: DataFrame, id: str, text: str, opening: str, labels: list[str], cancelled: str = r"(?i)cancelad") -> DataFrame:
    """id, number, body, cancelled: blocks from one numbered opening to the next, cut at the first label; of one number the longest."""
    bodies = F.split(text, opening, -1)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(opening), F.lit(1)).alias("n"), F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))).alias("b"))
    rows = docs.select(id, F.explode(zipped).alias("x")).select(id, F.col("x.n").try_cast("int").alias("number"), F.col("x.b").alias("raw"))
    rows = rows.where("number IS NOT NULL").withColumns({"body": cut_at_labels(F.col("raw"), labels), "cancelled": F.col("raw").rlike(cancelled)})
    return rows.groupBy(id, "number").agg(F.max_by("body", F.struct(F.length("body"), "body")).alias("body"), F.max("cancelled").alias("cancelled"))


#: From here on a paragraph lists the precedents of others.
OTHERS = r"(?i)\bprecedentes?\s+citad|\bcitados?\s*:"


def decompose_citation(line: Column) -> dict[str, Column]:
    """Class, number, state, rapporteur and date of a citation that closes a paragraph; what follows the list of precedents
    cited belongs to others and is not read."""
    from quire.operators import citations

    form = next(f for f in citations.FORMS if f.kind == "PRECEDENT")
    own = F.split(line, OTHERS, 2)[0]
    plain = citations.without_marks(own)
    part = lambda g: F.nullif(F.regexp_extract(plain, form.pattern, g), F.lit(""))
    after = F.regexp_extract(own, r"(?i)\bRel(?:ator|atora)?\b\.?\s*(.+)$", 1)
    name = F.trim(F.regexp_extract(F.regexp_replace(after, r"(?i)^(?:p/\s*ac[oó]rd[aã]o\s*)?(?:Min(?:istr[oa])?\b\.?\s*)?", ""), "^[^,;(]*", 0))
    date = F.regexp_extract(own, r"(?<![0-9])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9])", 0)
    return {"cls": part(form.scope), "number": tx.digits(part(form.number)), "state": part(form.part), "rapporteur": F.nullif(name, F.lit("")), "decided": tx.br_date(F.nullif(date, F.lit("")))}


def end_of_last(text: Column, pattern: str) -> Column:
    """The position (from 1) after the last match, 1 if there is none: where the body begins after an index."""
    parts = F.split(text, pattern, -1)
    return F.when(F.size(parts) > 1, F.length(text) - F.length(F.element_at(parts, -1)) + 1).otherwise(F.lit(1))


# Number words.
NUMBERS = {"um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10, "onze": 11, "doze": 12, "quinze": 15, "vinte": 20, "trinta": 30}


def folded_number(word: Column) -> Column:
    """A number in digits or as a folded word; else null."""
    table = F.create_map(*(x for k, v in NUMBERS.items() for x in (F.lit(k), F.lit(v))))
    # Digits come before letters; asking a word for its number costs an exception.
    return F.when(word < "a", word.try_cast("int")).otherwise(F.try_element_at(table, word))


#: A line that begins like this no longer belongs to an article's head.
BELOW_HEAD = ("§", "paragrafo", "i -", "i –", "pena - multa", "pena – multa")
# Words of a penalty, folded; amounts of time in months.
PENALTIES = ("reclusao", "detencao")
UNITS = {"mes": 1, "meses": 1, "ano": 12, "anos": 12}


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once: the functions below name their values often, and inside lambdas nothing is shared."""
    return F.get(F.transform(F.array(value), then), 0)


def article_head(article: Column) -> Column:
    """The lines of an article before its first paragraph, item or fine, folded."""
    below = F.array(*map(F.lit, BELOW_HEAD))
    lines = bound(article, lambda a: F.transform(F.split(tx.fold_same_length(a), "\n", -1), lambda x: tx.squeeze(x)))
    first = lambda ls: F.array_position(F.transform(ls, lambda x: F.exists(below, lambda b: F.startswith(x, b))), True)
    above = lambda ls: bound(first(ls), lambda n: F.when(n > 1, F.slice(ls, F.lit(1), (n - 1).cast("int"))).otherwise(ls))
    return F.array_join(bound(lines, above), " ")


def maximum_penalty(article: Column) -> Column:
    """The upper end, in months, of the penalty that an article's head states; null if it states none.

    The head is read word by word: after the kind of penalty, of the first two amounts with a unit the last is the upper end;
    an amount is a number, a number word, or a number in brackets beside one.
    """
    words = F.regexp_extract_all(article_head(article), F.lit("[a-z0-9]+"), F.lit(0))
    kinds = F.array(*map(F.lit, PENALTIES))
    begin = lambda ws: F.array_position(F.transform(ws, lambda w: F.array_contains(kinds, w)), True)
    tail = lambda ws: bound(begin(ws), lambda b: F.when(b > 0, F.slice(ws, b.cast("int"), F.lit(24))))
    return bound(bound(words, tail), _upper_end)


def _upper_end(tail: Column) -> Column:
    """The upper end stated by the folded words from a kind of penalty on."""
    units = F.create_map(*(x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))))
    amounts = F.transform(tail, lambda w, i: F.struct(folded_number(w).alias("n"), F.try_element_at(units, w).alias("unit"), i.alias("i")))
    joined = F.exists(tail, lambda w: w.isin("a", "e"))

    def read(numbers: Column, first: Column, second: Column) -> Column:
        before = lambda to, after: F.filter(numbers, lambda x: (x["i"] < to["i"]) & (x["i"] > after))
        last_before = lambda to, after: F.try_element_at(before(to, after), F.lit(-1))["n"]
        # "de X a Y anos" has one unit and two numbers before it; "de X meses a Y anos" has two units.
        single = F.exists(before(first, F.lit(-1)), lambda x: F.get(tail, x["i"] + 1).isin("a", "e"))
        # The unit of an upper end stands behind it; a lower end may leave its own out ("de seis a vinte anos").
        upper = F.when(single, last_before(first, F.lit(-1)) * first["unit"]).otherwise(last_before(second, first["i"]) * second["unit"])
        return F.when(first.isNotNull(), upper)

    with_units = lambda xs: F.filter(xs, lambda x: x["unit"].isNotNull())
    with_numbers = lambda xs: F.filter(xs, lambda x: x["n"].isNotNull())
    named = lambda xs: bound(F.struct(with_numbers(xs).alias("n"), with_units(xs).alias("u")), lambda x: read(x["n"], F.get(x["u"], 0), F.get(x["u"], 1)))
    return F.when(joined, bound(amounts, named))


# Names by which laws are cited, and the data sets that hold them.
LAWS = {"cpp": "cpp", "codigo de processo penal": "cpp", "cp": "cp", "codigo penal": "cp", "cpc": "cpc", "codigo de processo civil": "cpc", "cf": "cf", "constituicao": "cf", "constituicao federal": "cf", "crfb": "cf", "lep": "lep", "lei de execucao penal": "lep", "cc": "cc", "codigo civil": "cc", "ctn": "ctn", "lindb": "lindb", "lgpd": "lei13709", "cadh": "cadh", "pidcp": "pidcp", "eaoab": "eaoab"}


def law_of(label: Column) -> Column:
    """The data set of a law as it is cited; numbered laws by their number, without the year."""
    s = F.regexp_replace(tx.squash(label), r"\bn[o]?\b\s*", "")
    numbered = F.regexp_extract(s, r"^lei (\d{1,2}) ?(\d{3})(?: \d{2,4})?$", 0)
    number = F.concat(F.lit("lei"), F.regexp_extract(s, r"^lei (\d{1,2}) ?(\d{3})", 1), F.regexp_extract(s, r"^lei (\d{1,2}) ?(\d{3})", 2))
    table = F.create_map(*(F.lit(x) for kv in LAWS.items() for x in kv))
    return F.when(numbered != "", number).otherwise(F.try_element_at(table, F.trim(s)))


def record_sheet(text: Column, kinds: dict[str, str]) -> Column:
    """kind, stated, document, date of the sheet that an export puts before a document; null without one.  ``kinds`` maps how
    a stated type begins (folded) to a kind; longer beginnings are asked first."""
    head = F.left(text, F.lit(3000))
    get = lambda p: F.trim(F.regexp_extract(head, p, 1))
    stated, document = get(r"(?im)^\s*Tipo\s+de\s+documento:\s*(.+)$"), get(r"(?im)^\s*Descri[çc][ãa]o\s+do\s+documento:\s*(.+)$")
    kind = F.lit(None).cast("string")
    for begins, name in sorted(kinds.items(), key=lambda kv: len(kv[0])):
        kind = F.when(F.startswith(tx.squash(stated), F.lit(begins)), F.lit(name)).otherwise(kind)
    kind = F.coalesce(kind, F.upper(tx.squash(stated)))
    return F.when(stated != "", F.struct(kind.alias("kind"), stated.alias("stated"), document.alias("document"), tx.br_date(get(r"(?i)Data\s+da\s+assinatura:\s*(\d{2}/\d{2}/\d{4})")).alias("date")))


def byline(html: Column, excluded: list[str]) -> Column:
    """The first author that a page names and that is no house name."""
    names = F.regexp_extract_all(html, F.lit(r"(?i)(?:rel=[\"']author[\"'][^>]*>|class=[\"'][^\"']*author[^\"']*[\"'][^>]*>|name=[\"']author[\"']\s+content=[\"'])\s*([^<\"']{3,80})"), F.lit(1))
    own = F.filter(F.transform(names, lambda n: tx.squeeze(n)), lambda n: ~tx.squash(n).isin([x.lower() for x in excluded]))
    return F.get(own, 0)


# What an affirmative statement of each kind of milestone looks like.
MILESTONES = [("complaint_received", r"(?i)\brecebo\s+a\s+den[úu]ncia|(?<!n[ãa]o\s)\brecebid[ao]\s+a\s+den[úu]ncia"), ("suspended", r"(?i)suspens[ãa]o\s+condicional\s+do\s+processo\s+(?:foi\s+)?(?:aceita|homologada)"), ("final", r"(?i)transit(?:ou|ado)\s+em\s+julgado")]


def text_milestones(acts: DataFrame, keys: list[str], text: str, rules: list[tuple[str, str]] | None = None, around: int = 80) -> DataFrame:
    """keys, kind, quote: the first statement of each kind in an act, with what stands around it."""
    found = F.array_compact(F.array(*(F.when(F.rlike(text, F.lit(p)), F.struct(F.lit(k).alias("kind"), F.regexp_extract(text, f"(?s)(.{{0,{around}}}(?:{p}).{{0,{around}}})", 1).alias("q"))) for k, p in (MILESTONES if rules is None else rules))))
    return acts.select(*keys, F.explode(found).alias("m")).select(*keys, "m.kind", F.left(tx.squeeze(F.col("m.q")), F.lit(240)).alias("quote"))


def timely(filed: Column, due: Column) -> Column:
    """timely, late, or unknown where either day is."""
    return F.when(filed.isNull() | due.isNull(), "unknown").when(filed <= due, "timely").otherwise("late")
